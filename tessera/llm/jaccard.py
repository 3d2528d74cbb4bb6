"""Near-duplicate documents: a chosen-path join on the Jaccard similarity of word 5-grams.

1. A text's set of 5-gram hashes becomes a digest of the set and ``POSITIONS`` minima under random
   hashes: sampled tokens, of which two sets share a position with a probability equal to their
   similarity. Equal digests are one class of copies; only one of them goes on.
2. Each of ``RUNS`` runs splits all sets by their token at a sampled position; a bucket above
   ``SMALL`` sets is split again at another position, up to ``DEPTH`` times. Small buckets are compared
   pair by pair on the sampled tokens and give a spanning forest, never all pairs. With
   similarity s a pair meets in a run with a probability of s ** DEPTH at least; ``RUNS`` makes the
   chance of never meeting at 0.8 less than 1 - ``RECALL``.
3. The forest's components hold all linked pairs. In each, sets are compared exactly, in blocks;
   links are counted there and a spanning forest of the true links gives the final classes.

Texts of fewer than five words, but not none, have one 5-gram of all their words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pair_name, saved, scrambled, tasks, words_of
from .graph import components

N = 5
SIMILAR = 0.8
POSITIONS = 128
DEPTH = 3
RECALL = 0.99999
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILAR**DEPTH))
SMALL = 96
#: Sets in one block of a bucket that is still large at the last split; blocks meet pairwise.
LARGE = 4_096
#: Of POSITIONS, as many must agree: over seven standard deviations below what SIMILAR gives.
AGREE = int(POSITIONS * SIMILAR - 7 * math.sqrt(POSITIONS * SIMILAR * (1 - SIMILAR))) + 1
#: Sets and 5-grams in one block of an exact comparison.
BLOCK_SETS, BLOCK_GRAMS = 256, 400_000
#: Words whose 5-grams are hashed together: some 100 bytes are held for each byte of them.
PIECE_WORDS = 1 << 17

_rng = np.random.default_rng(20_240_501)
_A = (_rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)
_PLACES = [[int(x) for x in _rng.permutation(POSITIONS)[:DEPTH]] for _ in range(RUNS)]
_C = np.uint64(0xD6E8FEB86659FD93)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 5-gram hashes of each text one after another, and how many each has.

    Of long texts one piece is hashed at a time; pieces share ``N`` - 1 words, so that each 5-gram is in one.
    """
    words = [words_of(t) for t in texts]
    if all(len(w) <= PIECE_WORDS for w in words):
        return _grams(words)
    sets = [np.unique(np.concatenate([_grams([w[k : k + PIECE_WORDS + N - 1]])[0] for k in range(0, max(1, len(w) - N + 1), PIECE_WORDS)])) for w in words]
    return np.concatenate(sets), np.array([len(x) for x in sets], np.int64)


def _grams(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.uint64), sizes
    joined = b" ".join(b" ".join(w) for w in words if w) + b" "
    raw = np.frombuffer(joined, np.uint8)
    stop = np.flatnonzero(raw == 32)
    begin = np.concatenate([[0], stop[:-1] + 1])
    power = np.full(len(raw), _C, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(scrambled(raw.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    inverse = np.full(len(raw), np.uint64(pow(int(_C), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    each = np.maximum(sizes - N + 1, np.minimum(sizes, 1))  # 5-grams with repeats
    first_word = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first_gram = np.concatenate([[0], np.cumsum(each)[:-1]])
    owner = np.repeat(np.arange(len(words)), each)
    at = np.arange(int(each.sum())) - first_gram[owner] + first_word[owner]
    last = np.minimum(at + N, first_word[owner] + sizes[owner]) - 1
    start, end = begin[at], stop[last]
    hashes = pair_name((sums[end] - sums[start]) * inverse[start], (end - start).astype(np.uint64))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    return hashes[new], np.bincount(owner[new], minlength=len(words))


def _digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, whatever the order; None for an empty one."""
    sums = np.zeros((len(sizes), 2), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[full]
        for i, x in enumerate((hashes, pair_name(hashes, hashes))):
            sums[full, i] = np.add.reduceat(scrambled(x), starts)
        sums = pair_name(sums, sums[:, ::-1] + sizes[:, None].astype(np.uint64))
    rows = sums.tobytes()
    return [rows[16 * i : 16 * i + 16] if sizes[i] else None for i in range(len(sizes))]


def _signatures(batches):
    for part in chunks(batches, 1 << 19):
        hashes, sizes = grams(part["text"])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        full = np.flatnonzero(sizes)
        minima = np.zeros((len(sizes), POSITIONS), np.uint32)
        if len(full):
            low = (scrambled(hashes) >> np.uint64(32)).astype(np.uint32)
            for i in range(POSITIONS):
                v = low * _A[i] + _B[i]
                v ^= v >> np.uint32(15)
                v *= np.uint32(0x2C1B3C6D)
                minima[full, i] = np.minimum.reduceat(v, starts[full])
        tokens = minima.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part["doc_id"], pa.int64()),
                pa.array(part["h"], pa.int64()),
                pa.array(_digests(hashes, sizes), pa.binary()),
                pa.array(sizes.astype(np.int64)),
                pa.array([tokens[4 * POSITIONS * i : 4 * POSITIONS * (i + 1)] if sizes[i] else None for i in range(len(sizes))], pa.binary()),
            ],
            ["doc_id", "h", "k", "n", "tokens"],
        )


def _groups(batches, keys: int):
    """(key, columns) of consecutive rows with equal values in the first ``keys`` columns, from sorted Arrow batches."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(i).to_pylist() if i < keys else batch.column(i) for i in range(batch.num_columns)]
        all_keys = list(zip(*columns[:keys]))
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or all_keys[i] != all_keys[start]:
                if all_keys[start] != last and held:
                    yield last, held
                    held = []
                last = all_keys[start]
                held.append([c.slice(start, i - start) for c in columns[keys:]])
                start = i
    if held:
        yield last, held


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a square matrix of links."""
    left, out = np.ones(len(close), bool), []
    for s in range(len(close)):
        if left[s]:
            left[s] = False
            todo = [s]
            while todo:
                near = np.flatnonzero(close[todo.pop()] & left)
                left[near] = False
                out += [(s, int(x)) for x in near]
                todo += near.tolist()
    return out


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _spread(tokens: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the rows that agree on AGREE tokens, directly or not, each tree a star around its first row, so
    that one group's links are the same in all runs. Rows once reached are compared no more, so a
    group of near copies costs one comparison for each row."""
    left, out = np.arange(len(tokens)), []
    while len(left) > 1:
        first, todo, left = int(left[0]), [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = (tokens[left] == tokens[x]).sum(axis=1) >= AGREE
            found, left = left[near], left[~near]
            out += [(first, int(y)) for y in found]
            todo += found.tolist()
    return out


def _compare(batches):
    """Links within a bucket, or within two blocks of a large one."""
    out: list[tuple[bytes, bytes]] = []
    for _, pieces in _groups(batches, 3):
        names = [x for p in pieces for x in p[0].to_pylist()]
        if len(names) < 2:
            continue
        tokens = np.frombuffer(b"".join(x for p in pieces for x in p[1].to_pylist()), np.uint8).reshape(len(names), POSITIONS)
        if len(names) == 2:
            if (tokens[0] == tokens[1]).sum() >= AGREE:
                out.append((names[0], names[1]))
        else:
            out += [(names[i], names[j]) for i, j in _spread(tokens)]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=_LINKS)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=_LINKS)


def _blocks(df: DataFrame, n_blocks) -> DataFrame:
    """Rows for each pair of blocks that theirs is part of: ``i`` <= ``j``, and ``own``, the row's block."""
    own = F.pmod(F.xxhash64("k"), n_blocks).cast("int")
    return df.withColumn("own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), n_blocks.cast("int") - 1))).withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o")).drop("_o")


def _candidates(sets: DataFrame) -> DataFrame:
    """Links (a, b), which may repeat, of sets that agree on AGREE tokens, directly or not, from the buckets of all runs."""
    token = lambda place: F.expr(f"substring(tokens, {4 * place + 1}, 4)")
    runs = sets.select("k", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), *[token(p).alias(f"t{d}") for d, p in enumerate(places)]) for r, places in enumerate(_PLACES)])).alias("x")).select("k", "x.*")
    level = runs.withColumn("bucket", F.xxhash64("r", "t0"))
    found = None
    for d in range(DEPTH):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
        level = level.join(sizes, "bucket")
        if d < DEPTH - 1:
            level = saved(level, "level")  # read by the buckets that are done, by the next split's sizes and by its rows
        done = level if d == DEPTH - 1 else level.where(F.col("c") <= SMALL)
        done = done.select("bucket", "c", "k")
        found = done if found is None else found.unionByName(done)
        if d < DEPTH - 1:
            level = level.where(F.col("c") > SMALL).drop("c").withColumn("bucket", F.xxhash64("bucket", F.lit(d), f"t{d + 1}"))
    found = _blocks(found, F.ceil(F.col("c") / F.lit(LARGE)))
    bytes_of = F.concat(*[F.expr(f"substring(tokens, {4 * i + 1}, 1)") for i in range(POSITIONS)])
    rows = found.join(sets.select("k", bytes_of.alias("t")), "k").select("bucket", "i", "j", "k", "t")
    rows = rows.repartition(tasks(sets.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "k")
    return rows.mapInArrow(_compare, "a binary, b binary")


_EXACT = pa.schema([("k", pa.binary()), ("links", pa.int64()), ("b", pa.binary())])


def _overlaps(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets."""
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)
    width = max(1, (8 << 20) // (4 * n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T  # whole numbers below 2 ** 24 in each slice
    return out


def _verify(batches):
    """Per set: the documents in other classes that it is linked to in this pair of blocks, and a forest of the links."""
    out: list[tuple] = []
    for (_, i, j), pieces in _groups(batches, 3):
        own = np.concatenate([np.asarray(p[0]) for p in pieces])
        names = [x for p in pieces for x in p[1].to_pylist()]
        weight = np.concatenate([np.asarray(p[2]) for p in pieces])
        sizes = np.concatenate([np.asarray(p[3].value_lengths()) for p in pieces])
        flat = np.concatenate([np.asarray(p[3].flatten()) for p in pieces])
        n = len(names)
        both = _overlaps(flat, np.repeat(np.arange(n), sizes), n)
        # At least 8 parts of 10 of the union, in whole numbers.
        close = 10 * both >= 8 * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(close, False)
        counted = close if i == j else close & (own[:, None] != own[None, :])
        links = counted @ weight
        out += [(names[x], int(links[x]), None) for x in np.flatnonzero(links)]
        out += [(names[x], 0, names[y]) for x, y in _forest(close)]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _EXACT)], schema=_EXACT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _EXACT)], schema=_EXACT)


def _sets(batches):
    for part in chunks(batches, 1 << 19):
        hashes, sizes = grams(part["text"])
        rows = _digests(hashes, sizes)
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), values], ["k", "grams"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_id and n_links of every document.

    Two documents are linked when their sets' similarity is 0.8 or more. ``class_id`` is the least
    doc_id of those linked directly or not, ``copy_id`` of those with an equal set, ``n_links`` the
    number of other documents linked directly, copies included. Null ids count as
    greater than all; a class of nothing but null ids has a null id. A document without words
    (null, empty) is linked to none and its ids are its own. Repeated rows are copies. An
    empty table gives an empty result; other columns are not read.
    """
    return classed(docs).drop("h", "root")


def classed(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with ``h``, the hash of the text, and ``root``, the class's name: null without words."""
    spark = docs.sparkSession
    signed = saved(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_signatures, "doc_id long, h long, k binary, n long, tokens binary"), "signatures")
    copies = saved(signed.where("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.min("doc_id").alias("copy_id"), F.max("n").alias("n"), F.first("tokens").alias("tokens")), "copies")
    candidates = components(_candidates(copies.select("k", "tokens")))
    member = saved(candidates.join(copies.select("k", "w", "n", "copy_id"), "k"), "members")
    size = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS))).alias("blocks"))
    # One document of each set that has candidates brings its text. Where ids repeat or are null it may
    # bring others' too: a set's name follows from the text, and one of each name stays.
    ids = signed.join(member.select("k"), "k").groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "k binary, grams array<long>").dropDuplicates(["k"])
    rows = _blocks(member.join(size, "root").join(sets, "k"), F.col("blocks"))
    rows = rows.select("root", "i", "j", "own", "k", "w", "grams").repartition(tasks(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "k")
    exact = saved(rows.mapInArrow(_verify, "k binary, links long, b binary"), "exact")
    links = exact.where("b is null").groupBy("k").agg(F.sum("links").alias("links"))
    classes = components(exact.where("b is not null").select(F.col("k").alias("a"), "b"))
    least = classes.join(copies.select("k", "copy_id"), "k").groupBy("root").agg(F.min("copy_id").alias("class_id"))
    found = copies.select("k", "w", "copy_id").join(classes, "k", "left").join(least, "root", "left").join(links, "k", "left")
    found = found.select("k", F.coalesce("root", "k").alias("root"), "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return signed.select("doc_id", "h", "k").join(found, "k", "left").select(
        "doc_id",
        "h",
        "root",
        F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM w WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS k, count(*) AS n FROM s GROUP BY s),
g AS (SELECT k, len(s) AS size, unnest(s) AS g FROM c),
p AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k, a.size, b.size HAVING 10 * count(*) >= 8 * (a.size + b.size - count(*))),
r(k, m) AS (SELECT k, k FROM c UNION SELECT r.k, p.b FROM r JOIN p ON r.m = p.a),
root AS (SELECT k, min(m) AS class_id FROM r GROUP BY k),
l AS (SELECT p.a AS k, sum(c.n) AS links FROM p JOIN c ON c.k = p.b GROUP BY p.a)
SELECT d.doc_id, coalesce(root.class_id, d.doc_id) AS class_id, coalesce(c.k, d.doc_id) AS copy_id,
  CAST(coalesce(l.links, 0) + coalesce(c.n, 1) - 1 AS BIGINT) AS n_links
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.s = s.s LEFT JOIN root ON root.k = c.k LEFT JOIN l ON l.k = c.k
"""
