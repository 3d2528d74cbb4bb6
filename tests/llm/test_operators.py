"""Corpus operators against brute force and SQL, and on tables with nulls, ties, copies and nothing."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, decontamination, jaccard, licences, mixing, records, secrets, sharding, suffixes, topk, toxicity
from tessera.llm.registry import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "_b int, shard string, key string, k int, found string, slot int"


def docs_of(spark, texts, sources=None, odd=False):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS _b", "'x' AS shard", "'y' AS key", "2 AS k", "'z' AS found", "3 AS slot") if odd else df


def prose(n, seed=0, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


@pytest.fixture(scope="module")
def tricky():
    base = prose(12, 3)
    near = [base[0].replace(base[0].split()[60], "changed", 1), base[1] + " and more", base[2]]
    return [*base, *near, None, "", "short", "short", "a b c d", "aaaa " * 400, base[3][:300] + base[4][100:500], base[0] * 30, "\n\n.,;", "é" * 700, base[5][:199], base[5][:200]]


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, small_tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_tables}/{t}.parquet'")
    df = QUERIES[name](spark, small_tables)
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


ALL = {
    "secrets": secrets.secrets,
    "licences": licences.licences,
    "jaccard": jaccard.near_duplicates,
    "sharding": sharding.shard_documents,
    "mixing": mixing.mix,
    "toxicity": lambda d: toxicity.toxicity(d, toxicity.Lexicon({" x ": 1.0})),
    "decontamination": lambda d: decontamination.contamination(d, d.selectExpr("doc_id AS item_id", "text").where("doc_id < 3")),
    "suffixes": suffixes.repeats,
    "mix order": mixing.in_mix_order,
}


@pytest.mark.parametrize("name", list(ALL))
def test_empty_null_and_extra_columns(spark, name):
    f = ALL[name]
    assert f(docs_of(spark, [], odd=False)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "x y", None, None, None), (1, "x y", None, None, None), (None, "x y", "en", "s", 3)], DOCS)
    assert f(nulls).count() == 6
    assert f(docs_of(spark, ["one two", None, "three"], odd=True)).count() == 3


# ------------------------------------------------------------------ 1


def test_topk_is_exact(spark):
    rng = np.random.default_rng(1)
    n = 900
    x = rng.standard_normal((n, 16)).round(2)
    x[100:400] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2050, [float("nan")] * 16), (2100, [None] + [0.0] * 15), (2150, [float("inf")] * 16), (0, [float(v) for v in x[0]])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(v, v.where("vec_id % 50 = 0"))
    e = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, n, 50):
        s = e @ e[q]
        best = sorted((i for i in range(n) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == want


def test_topk_few_vectors_and_huge_numbers(spark):
    v = spark.createDataFrame([(0, [1 << 40, 3]), (50, [1 << 40, 5]), (7, [-(1 << 40), 1])], "vec_id long, v array<long>")
    got = {(r[0], r[1]): (r[2], r[3]) for r in topk.top_k(spark.createDataFrame([(0, [1 << 20, 3]), (1, [1 << 20, 5])], v.schema), v.selectExpr("vec_id", "array(1L, 1L) AS v")).collect()}
    assert got[(0, 1)] == (1, (1 << 20) + 5)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# ------------------------------------------------------------------ 2, 8, 9, 10


def test_suffixes_equal_brute_force(spark, tricky):
    texts = [*tricky, "Shti " * 300, "xy" * 100 + "Q" + "xy" * 100]
    count = collections.Counter(b[p : p + 200] for t in texts for b in [(t or "").encode()] for p in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffixes.repeats(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        r = got[i]
        spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(gone.sum()), spans), i
        assert r["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def test_long_texts_are_named_in_pieces(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = bytearray(" ".join(rng.choice(words) for _ in range(110_000)).encode())
    assert len(long) > 2 * suffixes.TOGETHER
    for a, b, n in ((1000, suffixes.TOGETHER - 150, 400), (5000, 2 * suffixes.TOGETHER - 199, 230), (9000, 300_000, 200), (12_000, 310_000, 199)):
        long[b : b + n] = long[a : a + n]
    texts = [long.decode(), "z" * (suffixes.TOGETHER + 5000), "short", long[400_000:400_260].decode()]
    docs = [t.encode() for t in texts]
    count = collections.Counter(hash(b[p : p + 200]) for b in docs for p in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffixes.repeats(docs_of(spark, texts)).collect()}
    for i, b in enumerate(docs):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[hash(b[p : p + 200])] > 1:
                gone[p : p + 200] = True
        assert got[i]["n_removed"] == int(gone.sum()), i
        assert got[i]["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def plain_base(text):
    """Base spans by plain scanning, without patterns."""
    out, n = [], len(text)
    same = lambda a, b: len(a) == len(b) and all(x == y or x.isascii() and x.lower() == y for x, y in zip(a, b))
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < n:
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if end is None and same(text[at : at + len(word)], word):
                for quoted in (1, 0):
                    i = at + len(word)
                    if quoted and (i >= n or text[i] not in "\"'"):
                        continue
                    i += quoted
                    while i < n and text[i] == " ":
                        i += 1
                    if i < n and text[i] in ":=":
                        i += 1
                        while i < n and text[i] == " ":
                            i += 1
                        if i < n and text[i] in "\"'":
                            i += 1
                        stop = i
                        while stop < n and text[stop] in value:
                            stop += 1
                        if stop > i:
                            end = stop
                            if stop - i >= 8:
                                out.append((at, "assign", stop))
                            break
        at = end or at + 1
    for kind, head, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), ("hex", "", set("0123456789abcdef"), 32)):
        at = 0
        while at < n:
            stop = at + len(head)
            if text[at:stop] == head:
                while stop < n and text[stop] in allowed:
                    stop += 1
            if text[at : at + len(head)] == head and stop > at + len(head):
                if stop - at >= least:
                    out.append((at, kind, stop))
                at = stop
            else:
                at += 1
    return out


def test_secrets_against_plain_scan(spark, small_tables):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    odd = ["password'=\"'x", "TOKEN  :  abcdefgh9", "token=short token = longenough1", "AKIA" * 6, "tokentoken=12345678", "apikey=abcdefgh secret:", "a" * 31 + "g" + "b" * 32, 'passwd":"x=1234567', "ſecret=abcdefgh"]
    texts.update({-k - 1: t for k, t in enumerate(odd)})
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        base = plain_base(t)
        order = sorted(base, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in base) for x in ("assign", "access", "hex")], i
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in order).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(spans)
        for kind, a, b in (s.split(":") for s in spans):
            part = t[int(a) : int(b)]
            if kind == "pem":
                assert part.startswith("-----BEGIN") and part.endswith("-----")
            elif kind == "jwt":
                assert part.count(".") == 2


def test_contamination_in_passes_is_the_same(spark, tricky, monkeypatch):
    docs = docs_of(spark, tricky)
    items = spark.createDataFrame([(1, tricky[0][20:300]), (2, tricky[4][:260]), (3, "a b c d"), (3, "a b c d"), (None, "short"), (5, None), (6, "")], "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    one = sorted(map(repr, decontamination.contamination(docs, items).select(*names).collect()))
    monkeypatch.setattr(decontamination, "PASS_BYTES", 100)
    assert one == sorted(map(repr, decontamination.contamination(docs, items).select(*names).collect()))
    kept = {r["doc_id"] for r in decontamination.without_contaminated(docs, items).collect()}
    monkeypatch.undo()
    assert kept == {r["doc_id"] for r in decontamination.without_contaminated(docs, items).collect()}
    assert len(kept) == sum("contaminated=False" in r for r in one)


def test_rows_without_a_name_of_their_own_are_judged_alone(spark, monkeypatch):
    bad, *clean = prose(5, 8)
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in [(None, bad), (None, clean[0]), (None, None), (7, bad), (7, clean[1]), (7, clean[1]), (8, clean[2]), (9, bad)]], DOCS).selectExpr("*", "1 AS h", "2 AS d")
    items = spark.createDataFrame([(1, bad), (2, clean[3])], "item_id long, text string")
    want = sorted(map(repr, docs.where(~docs.text.eqNullSafe(bad)).collect()))
    for size in (1 << 20, 100):
        monkeypatch.setattr(decontamination, "PASS_BYTES", size)
        out = decontamination.without_contaminated(docs, items)
        assert out.columns == docs.columns
        assert sorted(map(repr, out.collect())) == want


def test_toxicity_on_labelled_tables(spark, small_tables):
    big = small_tables.replace("sf0.001", "sf0.01")
    df = toxicity.op8_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    rows = df.collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)


# ------------------------------------------------------------------ 3

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD2 = """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD3 = (
    BSD2
    + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
)
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """# Copyright 2020 A Person
#
# Licensed under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance
# with the License. You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# is distributed on an "AS IS" BASIS.
"""
GPL = """    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version.
"""
NOTICES = [
    (MIT, "MIT", {"mit_grant", "mit_notice", "as_is"}),
    ("MIT License\n\n" + MIT, "MIT", {"mit_title", "mit_grant", "mit_notice", "as_is"}),
    (BSD2 + DISCLAIMER, "BSD-2-Clause", {"reserved", "bsd_grant", "bsd_source", "bsd_binary"}),
    (BSD3 + DISCLAIMER, "BSD-3-Clause", {"reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_names"}),
    (BSD3.replace("the copyright holder nor", "Some Company, Inc. nor").replace("Inc.", "Inc"), "BSD-3-Clause", {"reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_names"}),
    (BSD3.replace("1. ", "(1) ").replace("2. ", "b) ").replace("3. ", "* "), "BSD-3-Clause", {"reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_names"}),
    (APACHE, "Apache-2.0", {"apache2_ref", "apache2_comply", "apache2_copy"}),
    (GPL.format(":", ",", 3), "GPL-3.0-or-later", {"gpl_free", "gpl3_terms"}),
    (GPL.format(";", ";", 2), "GPL-2.0-or-later", {"gpl_free", "gpl_terms", "gpl2_later"}),
    (GPL.format(":", ",", 3).replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later", {"gpl_free", "agpl3_terms"}),
    (GPL.format(";", ";", 3).replace("GNU General", "GNU Lesser General").replace("program", "library"), "LGPL", {"gpl_free", "lgpl_terms", "gpl3_later"}),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Somebody\n", "GPL-3.0", {"gpl_title", "fsf_v3"}),
    ("Copyright (c) 2020 A Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nOther words.\n", "ISC", {"isc_grant"}),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.\n", "Zlib", {"zlib_grant", "zlib_origin"}),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file)\n", "BSL-1.0", {"bsl_ref"}),
    ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.\n", "MPL-2.0", {"mpl2_ref", "mpl2_copy"}),
    ("CC0 1.0 Universal\n", "CC0-1.0", {"cc0_title"}),
    ("MIT License\nnext line\nLicensed under\nCC BY 4.0", "CC-BY-4.0,MIT", {"mit_title", "ccby4_ref"}),
]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_licences_of_whole_notices(spark, ending):
    docs = docs_of(spark, [f"Some words.\n{n}\nMore words.\n".replace("\n", ending) for n, _, _ in NOTICES])
    got = {r["doc_id"]: r for r in licences.licences(docs).collect()}
    for i, (_, name, ids) in enumerate(NOTICES):
        assert (got[i]["licences"], set(got[i]["sentence_ids"].split(","))) == (name, ids), i
        assert got[i]["n_known"] == len(ids), i
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    found = con.execute(licences.SQL)
    names = [c[0] for c in found.description]
    assert sorted(map(tuple, (licences.licences(docs).select(*names).collect()))) == sorted(found.fetchall())


# ------------------------------------------------------------------ 4


def test_jaccard_equals_brute_force(spark, tricky):
    rng = random.Random(9)
    base = prose(30, 11)
    texts = list(tricky)
    for b in base:
        w = b.split()
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    sets = []
    for t in texts:
        w = common.words_of(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    n = len(texts)
    linked = lambda a, b: sets[a] is not None and sets[b] is not None and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    links = [[b for b in range(n) if b != a and linked(a, b)] for a in range(n)]
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs_of(spark, texts)).collect()}
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert got[a]["class_id"] == min(seen), a
        assert got[a]["n_links"] == len(links[a]), a
        assert got[a]["copy_id"] == min(b for b in range(n) if b == a or sets[b] is not None and sets[b] == sets[a])


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 5)
    w = prose(1, 5)[0].split()
    texts = [" ".join([*w[:k], "zz", *w[k + 1 :]]) for k in range(40)]
    got = jaccard.near_duplicates(docs_of(spark, texts)).collect()
    assert {r["class_id"] for r in got} == {0}
    assert all(r["n_links"] == 39 for r in got)


# ------------------------------------------------------------------ 5, 6, 7


def test_shards_are_contiguous_and_even(spark, tricky):
    texts = tricky * 20
    rows = sharding.shard_documents(docs_of(spark, texts)).orderBy("doc_id").collect()
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert [r["slot"] for r in own] == list(range(len(own)))
    most = max(r["size"] for r in rows)
    even = sum(r["size"] for r in rows) / 16
    assert all(abs(sum(r["size"] for r in own) - even) <= most for own in by.values())
    assert [r["text_crc32"] for r in rows] == [zlib.crc32((t or "").encode()) for t in texts]


@pytest.mark.parametrize("weights", [{"a": 4, "b": 2, "c": 1, None: 1}, {"big": 900, **{f"s{k}": 1 for k in range(100)}}])
def test_mix_stays_within_a_block(spark, weights):
    total = sum(weights.values())
    blocks = {k: 2 * w for k, w in weights.items()}  # two periods of blocks of two rows
    sources = [k for k, n in blocks.items() for _ in range(2 * n)]
    docs = docs_of(spark, ["x"] * len(sources), sources)
    rows = mixing.mix(docs, weights, block=2).orderBy("mix_at").collect()
    assert len({r["mix_at"] for r in rows}) == len(sources)
    slots = {}
    for r in rows:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
    served = dict.fromkeys(weights, 0)
    for t in range(2 * total):
        served[slots[t]] += 1
        assert all(abs(total * served[s] - (t + 1) * w) < total for s, w in weights.items())
    assert rows == mixing.mix(docs, weights, block=2).orderBy("mix_at").collect()


def test_buckets_ascend_and_split_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 50)
    rows = [(None, k) for k in range(900)] + [(7, k) for k in range(900)] + [(k, 0) for k in range(2000)] + [(10**12 + k, 0) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, k long").withColumn("h", common.unit(common.F.xxhash64("k")))
    got = df.withColumn("b", common.range_bucket(df, "doc_id", 16, common.F.col("h"))).collect()
    ordered = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    assert [r["b"] for r in ordered] == sorted(r["b"] for r in got)
    assert max(collections.Counter(r["b"] for r in got).values()) < 400


@pytest.mark.parametrize("weights", [{"a": 4, "b": 2, "c": 1, None: 1}, {"a": 999, "b": 1}, {"a": 35, "b": 3, "c": 2, None: 7}])
def test_mix_keeps_the_given_weights(spark, weights):
    total, size = sum(weights.values()), 60
    sources = [k for k, w in weights.items() for _ in range(-(-size * 20 * w // total))]
    rows = mixing.mix(docs_of(spark, ["x"] * len(sources), sources), weights, block=1).collect()
    assert len({r["mix_at"] for r in rows}) == len(rows)
    for s, w in weights.items():
        slots = sorted(r["slot"] for r in rows if r["source"] == s)
        assert all(j * total // w <= t < -(-(j + 1) * total // w) for j, t in enumerate(slots))


def test_mix_takes_any_number_of_sources(spark):
    rows = mixing.mix(spark.range(5000).selectExpr("id AS doc_id", "concat('site', id % 4500) AS source")).collect()
    assert len(rows) == len({r["mix_at"] for r in rows}) == 5000


def test_mix_order_keeps_columns_of_its_own_names(spark):
    docs = docs_of(spark, ["x"] * 40).selectExpr("*", "'b' AS block", "doc_id + 100 AS slot", "'m' AS mix_at", "7 AS n", "8 AS j", "9 AS src")
    assert sorted(map(tuple, mixing.in_mix_order(docs).collect())) == sorted(map(tuple, docs.collect()))


def test_schedule_stays_within_a_block_of_any_weights():
    rng = random.Random(4)
    for _ in range(60):
        weights = [rng.choice([1, 2, 30, rng.randint(1, 400)]) for _ in range(rng.randint(1, 12))]
        period, at, js, slots = mixing.schedule(weights, [10**6] * len(weights))
        assert period == sum(weights) // np.gcd.reduce(weights)
        assert slots.tolist() == list(range(period))
        for i, w in enumerate(weights):
            ran = np.cumsum(at == i)
            assert (np.abs(ran * sum(weights) - (np.arange(period) + 1) * w) < sum(weights)).all()


def test_records_equal_the_library(spark, small_tables):
    P = pytest.importorskip("public_tokenizers")
    lib = records.word_ids(P.path("word_bpe_49k.json")).lib
    rows = sorted(map(tuple, records.op7_records(spark, small_tables).collect()))
    start = 0
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").orderBy("doc_id").collect()
    for r, d in zip(rows, docs, strict=True):
        ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        assert r == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_are_fetched_in_any_order(spark, small_tables, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    lib = records.word_ids(path).lib
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").where("doc_id < 60").selectExpr("*", "'x' AS file", "1 AS at", "2 AS part")
    folder = common.fresh_path(spark, "r")
    index = records.write_records(docs, folder, path)
    every = index.select("doc_id", "file", "at", "n_bytes").collect()
    random.Random(3).shuffle(every)
    wanted = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(every[:40] + every[:5])] + [(99, None, None, None)], "place long, file string, at long, n_bytes long")
    got = {r["place"]: (r["doc_id"], r["ids"]) for r in records.fetch_records(wanted, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {k: (r["doc_id"], [*lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]) for k, r in enumerate(every[:40] + every[:5])}
    assert records.fetch_records(wanted.limit(0), folder).count() == 0


def test_records_of_nulls_and_nothing(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, None), (3, "a b"), (3, "a b"), (1, "")], "doc_id long, text string")
    rows = records.token_records(df, common.fresh_path(spark, "r"), path).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(None, 1), (1, 1), (3, 3), (3, 3)]
    assert records.token_records(df.limit(0), common.fresh_path(spark, "r"), path).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_against_plain_python(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    all_rows = {r["doc_id"]: r for r in docs.collect()}
    got = corpus_pipeline.run(spark, small_tables).collect()
    lexicon = toxicity.learnt(docs, spark.read.parquet(f"{small_tables}/labels.parquet"))
    kept = {i: r for i, r in all_rows.items() if lexicon.score(r["text"]) < 0.5}
    sets = {}
    for i, r in kept.items():
        w = common.words_of(r["text"])
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(kept)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    kept = {i: r for i, r in kept.items() if find(i) == i}
    bench = set()
    for r in spark.read.parquet(f"{small_tables}/benchmark.parquet").collect():
        w = common.words_of(r["text"])
        bench |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = {}
    for i, r in kept.items():
        w = common.words_of(r["text"])
        hit = set()
        for m in {len(g) for g in bench}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in bench:
                    hit |= set(range(k, k + m))
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = r
    assert {r["doc_id"] for r in got} == set(clean)
    assert all(r["text"] == all_rows[r["doc_id"]]["text"] for r in got)
    shards = collections.Counter()
    for r in got:
        shards[r["shard"]] += r["size"]
    assert max(shards) == 15
    most = max(r["size"] for r in got)
    assert max(shards.values()) - min(shards.values()) <= 2 * most


def test_near_copies_keep_one_row_of_each_class(spark):
    a, b, c, d = prose(4, 21)
    near = a + " tail"
    rows = [(None, a), (None, near), (3, b), (None, b), (None, b + " tail"), (4, c), (4, c), (4, c + " tail"), (4, d), (None, None), (None, None), (6, ""), (6, ""), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], DOCS)
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    for own, ids in (((a, near), {None}), ((b, b + " tail"), {3}), ((c, c + " tail"), {4}), ((d,), {4})):
        assert [i for (i, x), n in got.items() if x in own for _ in range(n)] == list(ids)
    assert [got[k] for k in ((None, None), (6, ""), (4, ""))] == [2, 2, 2]
    assert got.total() == 10


def test_stages_keep_the_columns(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small_tables)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), small_tables).count() == 0, name
    assert corpus_pipeline.sharding(spark, docs.limit(0), small_tables).count() == 0


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    from tessera.llm import graph

    tags, keep = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, tag: tags.append(tag) or keep(df, tag))
    stars = spark.createDataFrame([(1, 4), (1, 3), (3, 1), (2, 7), (9, 9)], "a long, b long")
    assert {tuple(r) for r in graph.components(stars).collect()} == {(1, 1), (3, 1), (4, 1), (2, 2), (7, 2), (9, 9)}
    assert tags == ["links", "least"]
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 52), (51, 52), (50, 52)], "a long, b long")
    assert {tuple(r) for r in graph.components(path).collect()} == {(k, 0) for k in range(41)} | {(k, 50) for k in (50, 51, 52)}
