"""Repeated 200-byte strings cut from documents: prefix doubling over sampled positions.

The rank of a position at a length tells equal strings of that length from others, and the rank at
a greater length follows from the ranks at two positions. Up to 100 bytes a position's rank
is a 64-bit name made of pairs of names inside its text (8, 16, 32, 64, 100): equal strings have
equal names everywhere. From there on Spark counts and sorts (rank, rank at an offset) of the
positions that are left, and a position goes as soon as its rank is unique:

1. length 100, at sampled positions: of the 101 positions from which 100 bytes stay within a
   200-byte window the one with the least name is the window's anchor, so equal windows have
   anchors at the same place. An anchor of unique rank is done: its windows are unique.
2. all windows of an anchor together (200 to 300 bytes): where these strings are equal
   elsewhere, every window of the anchor is repeated, and the position is done.
3. length 176, for each 25 places of an anchor in its windows: the bytes that these windows share. Where
   they are unique, so are the windows; where all of the windows together are equal elsewhere,
   they are repeated.
4. the positions of the windows that are left: at 100 bytes both halves of each window get a
   rank in sorted order, and windows with a unique half go; at 200 bytes, the threshold, the
   pairs (rank, rank 100 further on) are ranked again, and those that tie are repeated.

The texts are named once, in step 1. Steps 3 and 4 work on the 300 bytes around the anchors that are
left. Documents with equal texts are one for all this; they repeat each other whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pair_name, ranked, saved, small_batches, split_join, tasks, utf8

LENGTH = 200
HALF = LENGTH // 2
#: Places of an anchor that are decided together, and the bytes that their windows share.
STEP = 25
CORE = LENGTH - STEP + 1
#: Bytes of texts handled together; of a longer text, windows that are named together.
TOGETHER = 1 << 18

ONE, MANY, HELPER = 1, 2, 3


def names(raw: np.ndarray) -> np.ndarray:
    """Of each position from which HALF bytes follow: their name. ``raw`` ends in 8 bytes more, which no name covers."""
    n = len(raw) - 8
    name = np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1)).copy().view("<u8").ravel()  # the first rank: 8 bytes
    name = pair_name(name, name)
    for step in (8, 16, 32):
        name = pair_name(name[:-step], name[step:])  # 16, 32, 64
    return pair_name(name[: -(HALF - 64)], name[HALF - 64 :])[: n - HALF + 1]


class Windows:
    """Names, anchors and windows of some texts."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        n = len(raw) - 8
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.empty = n < LENGTH
        if self.empty:
            return
        self.half = names(raw)
        # The least of each HALF + 1 names and, in the low half of the word, its position: the first of equal ones.
        low = self.half & np.uint64(0xFFFFFFFF00000000) | np.arange(len(self.half), dtype=np.uint64)
        width = 1
        while 2 * width <= HALF + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        more = HALF + 1 - width
        low = np.minimum(low[:-more], low[more:]) if more else low
        count = min(len(low), n - LENGTH + 1)
        owner = np.repeat(np.arange(len(texts)), sizes)[:count]
        at = np.flatnonzero(np.arange(count) + LENGTH <= self.ends[owner])
        if not len(at):
            self.empty = True
            return
        anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        tail = np.append(head[1:], len(at)) - 1
        #: Of each anchor: its text, the first and last window and the names.
        self.first, self.last, place = at[head], at[tail], anchor[head]
        self.owner = owner[self.first]
        self.offset = place - self.first
        self.name = self.half[place]
        self.whole = _spanned(self.half, self.first, self.last, place)


def _spanned(half: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A name of all bytes of the windows from ``first`` to ``last``, seen from the anchor."""
    ends = pair_name(pair_name(half[first], half[first + HALF]), pair_name(half[last], half[last + HALF]))
    return pair_name(ends, ((last - first) << 32 | (place - first)).astype(np.uint64))


def _runs(at: np.ndarray) -> bytes:
    """Ascending positions as (start, how many follow one another)."""
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    return np.column_stack([at[head], np.diff(np.append(head, len(at)))]).astype("<i8").tobytes()


def _segments(part: dict):
    """(rows of the part, texts, positions in the rows' texts): all short texts at once, long ones in pieces that overlap."""
    short = [i for i, t in enumerate(part["text"]) if not t or len(t) <= TOGETHER]
    if short:
        yield short, [utf8(part["text"][i]) for i in short], 0
    for i in set(range(len(part["text"]))).difference(short):
        raw = utf8(part["text"][i])
        for at in range(0, len(raw), TOGETHER):
            yield [i], [raw[at : at + TOGETHER + LENGTH - 1]], at


_ANCHOR = pa.schema([("name", pa.int64()), ("whole", pa.int64()), ("key", pa.int64()), ("text_h", pa.int64()), ("m", pa.int32()), ("at", pa.int64()), ("width", pa.int32()), ("off", pa.int32()), ("more", pa.binary())])


def _anchors(batches):
    """A row for each anchor's name and its windows' name in a text (a piece of a long one), how often they stand there, and where."""
    for part in chunks(batches, TOGETHER):
        for rows, texts, base in _segments(part):
            w = Windows(texts)
            if w.empty:
                continue
            order = np.lexsort((w.first, w.whole, w.name, w.owner))
            a, b, c = w.name[order], w.whole[order], w.owner[order]
            head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
            one, m = order[head], np.diff(np.append(head, len(a)))
            at = w.first - w.starts[w.owner] + base
            more: list = [None] * len(head)
            for x in np.flatnonzero(m > 1):
                more[x] = _runs(at[order[head[x] : head[x] + m[x]]])
            key, text_h = (np.array([part[k][i] for i in rows], np.int64)[w.owner[one]] for k in ("key", "text_h"))
            columns = [w.name[one].view(np.int64), w.whole[one].view(np.int64), key, text_h, m, at[one], (w.last - w.first)[one], w.offset[one], more]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _ANCHOR)], schema=_ANCHOR)


_PIECE = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("width", pa.int32()), ("off", pa.int32()), ("kind", pa.int32()), ("piece", pa.binary())])


def _pieces(batches):
    """The bytes of the windows of each anchor that is left, or may help those."""
    for part in chunks(batches, TOGETHER):
        rows: list[tuple] = []
        for key, text, found in zip(part["key"], part["text"], part["found"]):
            raw = utf8(text)
            rows += [(key, f["at"], f["width"], f["off"], f["kind"], raw[f["at"] : f["at"] + f["width"] + LENGTH]) for f in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _PIECE)], schema=_PIECE)


def _slices(batches, rows: int = 1_000):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _named(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all positions of the pieces put together, and where each piece starts."""
    every = pieces.to_pylist()
    sizes = np.array([len(x) for x in every], np.int64)
    raw = np.frombuffer(b"".join(every) + bytes(8), np.uint8)
    return names(raw), np.cumsum(sizes) - sizes


_CORE = pa.schema([("name", pa.int64()), ("whole", pa.int64()), ("key", pa.int64()), ("m", pa.int32()), ("at", pa.int64()), ("width", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64())])


def _cores(batches):
    """A row for each STEP places of the anchors in their windows; those that may help others count twice."""
    for batch in _slices(batches):
        key, at, width, off, kind = (np.asarray(batch.column(i)) for i in range(5))
        half, base = _named(batch.column(5))
        last = base + width
        place = base + off
        low, high = (place - last) // STEP, (place - base) // STEP
        count = (high - low + 1).astype(np.int64)
        own = np.repeat(np.arange(len(count)), count)
        b = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[own]
        spot = place[own]
        first = np.maximum(base[own], spot - STEP * b - STEP + 1)
        end = np.minimum(last[own], spot - STEP * b)
        core = pair_name(half[spot - STEP * b], half[spot - STEP * b + CORE - HALF])
        core = pair_name(core, b.astype(np.uint64))
        whole = _spanned(half, first, end, spot)
        columns = [core.view(np.int64), whole.view(np.int64), key[own], np.where(kind[own] == ONE, 1, 2), at[own] + first - base[own], end - first, spot - first, at[own]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _CORE)], schema=_CORE)


_HALF = pa.schema([("name", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("m", pa.int32())])


def _halves(batches):
    """Both halves of each window of the places that are left; those that may help others count twice."""
    for batch in _slices(batches):
        key, anchor = (np.asarray(batch.column(i)) for i in range(2))
        half, base = _named(batch.column(2))
        found = batch.column(3).to_pylist()
        own = np.repeat(np.arange(len(found)), [len(f) for f in found])
        first, width, kind = (np.array([f[c] for row in found for f in row], np.int64) for c in ("at", "width", "kind"))
        count = width + 1
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        own, m = np.repeat(own, count), np.repeat(np.where(kind == ONE, 1, 2), count)
        spot = at - anchor[own] + base[own]
        for side in (0, 1):
            columns = [half[spot + side * HALF].view(np.int64), key[own], at, np.full(len(at), side), m]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _HALF)], schema=_HALF)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])


def _spans(ranges: list[dict]) -> list[tuple[int, int]]:
    """Merged spans of bytes from ranges of window starts."""
    found = []
    for r in ranges:
        if r["more"]:
            runs = np.frombuffer(r["more"], "<i8").reshape(-1, 2)
            found.append(np.column_stack([runs[:, 0], runs.sum(axis=1) - 1 + r["width"] + LENGTH]))
        else:
            found.append(np.array([[r["at"], r["at"] + r["width"] + LENGTH]]))
    both = np.concatenate(found)
    both = both[np.argsort(both[:, 0], kind="stable")]
    end = np.maximum.accumulate(both[:, 1])
    head = np.flatnonzero(np.concatenate([[True], both[1:, 0] > end[:-1]]))
    return list(zip(both[head, 0].tolist(), end[np.append(head[1:], len(end)) - 1].tolist()))


def _cut(batches):
    for part in chunks(batches, TOGETHER):
        rows = []
        for doc_id, text, copies, found in zip(part["doc_id"], part["text"], part["copies"], part["found"]):
            raw = utf8(text)
            n = len(raw)
            spans = [(0, n)] if copies > 1 and n >= LENGTH else _spans(found) if found else []
            digest, at = hashlib.sha256(), 0
            view = memoryview(raw)
            for a, b in spans:
                digest.update(view[at:a])
                at = b
            digest.update(view[at:])
            rows.append((doc_id, n, sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _RESULT)], schema=_RESULT)


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and byte spans removed, of every document.

    A byte goes if any 200-byte string over it also starts elsewhere, in its own document or another;
    strings don't cross documents. A null text is empty and loses nothing. Repeated rows, and
    documents with equal texts of 200 bytes or more, lose all. An empty table gives an
    empty result; other columns are not read. Texts are cut whole; a long text is named in pieces
    of ``TOGETHER`` bytes, whose windows overlap, so a task needs a few times the bytes of
    its longest text.

    Names are 64 bits for anchors and 128 for windows, ``key`` 64 for id and text: chances of 2 ** -64
    a pair, against which anchors only choose what is counted exactly after them.
    """
    n = tasks(small_batches(docs).sparkSession)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_h"), "doc_id", "text")
    digest = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("d"))
    same = digest.groupBy("d").agg(F.count("*").alias("copies"), F.min("key").alias("first")).where("copies > 1")
    copied = saved(digest.join(same, "d").select("key", F.least("copies", F.lit(2)).cast("int").alias("copies"), (F.col("key") == F.col("first")).alias("own")).distinct(), "copied")
    # 100 bytes at the anchors. A name is shared if it stands twice in a text, which its place or windows tell, or in two texts that differ.
    anchors = saved(rows.select("key", "text_h", "text").mapInArrow(_anchors, _ddl(_ANCHOR)), "anchors")
    tied = F.expr("m > 1 or x <> y or v <> w or s <> t")
    shared = anchors.groupBy("name").agg(
        F.max("m").alias("m"), F.min("text_h").alias("x"), F.max("text_h").alias("y"), F.min("whole").alias("v"), F.max("whole").alias("w"), F.min("at").alias("s"), F.max("at").alias("t"), F.count("*").alias("n")
    )
    left = split_join(anchors.drop("text_h"), saved(shared.where(tied).select("name", "n"), "shared"), ["name"], "n").drop("n")
    left = saved(left.join(copied.where("not own").select("key"), "key", "left_anti"), "left")
    # 200 to 300 bytes: all windows of an anchor.
    many, rest = _decided(left.withColumn("anchor", F.col("at")))
    rest = saved(rest, "rest")
    dealt = rows.select("key", "doc_id", "text").repartition(n, "key")
    found = rest.groupBy("key").agg(F.collect_list(F.struct("at", "width", "off", "kind")).alias("found"))
    pieces = saved(dealt.join(found, "key").select("key", "text", "found").mapInArrow(_pieces, _ddl(_PIECE)), "pieces")
    # 176 bytes: STEP windows at a time.
    cores = saved(pieces.select("key", "at", "width", "off", "kind", "piece").mapInArrow(_cores, _ddl(_CORE)), "cores")
    some, open_ = _decided(cores.withColumn("more", F.lit(None).cast("binary")))
    open_ = open_.groupBy("key", "anchor").agg(F.collect_list(F.struct("at", "width", "kind")).alias("found"))
    around = pieces.select("key", F.col("at").alias("anchor"), "piece").dropDuplicates(["key", "anchor"]).join(open_, ["key", "anchor"])
    halves = saved(around.select("key", "anchor", "piece", "found").mapInArrow(_halves, _ddl(_HALF)), "halves")
    # 100 bytes at every position that is left, then 200 from the pairs of ranks.
    first = split_join(halves, ranked(halves, ["name"], "m"), ["name"], "n")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("rank"))).alias(f"r{k}")
    pairs = saved(first.groupBy("key", "at").agg(side(0), side(1), F.max("m").alias("m")).where("r0 is not null and r1 is not null"), "pairs")
    last = split_join(pairs.where("m = 1").drop("m"), ranked(pairs, ["r0", "r1"], "m"), ["r0", "r1"], "n")
    single = last.select("key", "at", F.lit(0).alias("width"), F.lit(None).cast("binary").alias("more"))
    ranges = many.unionByName(some).unionByName(single)
    known = ranges.groupBy("key").agg(F.collect_list(F.struct("at", "width", "more")).alias("found"))
    full = dealt.join(known, "key", "left").join(copied.select("key", "copies"), "key", "left")
    return full.select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "found").mapInArrow(_cut, _ddl(_RESULT))


def _decided(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of windows that are repeated whole, and those that stay open or may help open ones, the first of equal ones alone."""
    whole = saved(left.groupBy("name", "whole").agg(F.sum("m").alias("n"), F.min(F.struct("key", "at")).alias("one")), "wholes")
    groups = whole.groupBy("name").agg((F.min("n") == 1).alias("open"), F.sum("n").alias("total"), F.count("*").alias("c")).where("total > 1").drop("total")
    told = saved(split_join(whole, saved(groups, "groups"), ["name"], "c").drop("c").where("n > 1 or open"), "told")
    kinds = saved(split_join(left, told, ["name", "whole"], "n"), "kinds")
    many = kinds.where("n > 1").select("key", "at", "width", "more")
    rest = kinds.where("open and (n = 1 or one = struct(key, at))")
    return many, rest.select("key", "at", "width", "off", F.when(F.col("n") == 1, ONE).otherwise(HELPER).alias("kind"), "anchor").distinct()


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT r, doc_id, b, CAST(octet_length(b) AS BIGINT) AS n FROM d),
w AS (SELECT r, p, md5_number(hex(b[p + 1:p + {LENGTH}])) AS h FROM (SELECT r, b, unnest(range(0, n - {LENGTH - 1})) AS p FROM e WHERE n >= {LENGTH})),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM w SEMI JOIN t USING (h)),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM s),
c AS (SELECT r, min(p) AS a, max(p) + {LENGTH} AS z FROM g GROUP BY r, g),
k AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM c GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, n_spans + 1),
    lambda i: hex(b[CASE WHEN i = 0 THEN 1 ELSE z[i] + 1 END:CASE WHEN i = n_spans THEN n ELSE a[i + 1] END])), '')) END) AS kept_sha256
FROM e LEFT JOIN k USING (r)
"""
