"""Benchmark passages in documents, found with an FM-index for each shard of documents.

Words of the benchmark get numbers; a word that no item has is 0, and no window crosses it. A
shard is a batch of documents. Only runs of numbered words as long as the shortest window can hold
an occurrence, so only these enter the shard's index: a suffix array, the Burrows-Wheeler
transform in a wavelet tree, and every eighth suffix position. All windows are searched backwards
together; a row's position comes from walking to a sampled one. Overlapping occurrences of
a document merge into its removal spans.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, saved, words_of

WINDOW = 13
SAMPLE = 8
#: UTF-8 bytes of benchmark texts that are broadcast at once; more go in further passes.
PASS_BYTES = 8 << 20


class WaveletTree:
    """Ranks of symbols in a sequence: a bit row with counts for each binary digit, high ones first."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.rows, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.rows.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])  # one stable partition a digit

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.rows, self.zeros)):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            low_ones, at_ones = ones[low], ones[at]
            low = np.where(bit == 1, zeros + low_ones, low - low_ones)
            at = np.where(bit == 1, zeros + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.rows, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix starts in order, by prefix doubling; only ties are sorted again. The end is below all."""
    n = len(seq)
    rank = seq.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        sorted_rank = rank[order]
        head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, n))
        if (sizes == 1).all():
            return order
        rank[order] = np.repeat(starts, sizes) + 1  # a rank is the first place of its group
        tied = np.repeat(sizes > 1, sizes)
        rows = order[tied]
        later = np.zeros(len(rows), np.int64)
        inside = rows + width < n
        later[inside] = rank[rows[inside] + width]
        order[tied] = rows[np.lexsort((later, rank[rows]))]
        key = later[np.lexsort((later, rank[rows]))]
        new = rank[order].copy()
        places = np.flatnonzero(tied)
        changed = np.concatenate([[True], (key[1:] != key[:-1]) | (new[places][1:] != new[places][:-1])])
        first = np.maximum.accumulate(np.where(changed, places, 0))
        rank[order[places]] = first + 1
        width *= 2


class FmIndex:
    """Counts and positions of patterns in a sequence of numbers from 0 on."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        seq = np.append(seq, 0) + 1  # an end below every symbol
        seq[-1] = 0
        order = suffix_array(seq)
        self.tree = WaveletTree(seq[order - 1], n_symbols + 1)
        self.before = np.zeros(n_symbols + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=n_symbols + 1), out=self.before[1:])
        self.marked = order % SAMPLE == 0
        self.places = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]
        self.n = len(seq)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each pattern; a row of ``patterns`` ends at its right edge."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(high[live] > low[live])]
            todo = live[lengths[live] > k]
            if not len(todo):
                break
            c = patterns[todo, -1 - k].astype(np.int64) + 1
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[todo], high[todo]]))
            low[todo], high[todo] = self.before[c] + both[: len(todo)], self.before[c] + both[len(todo) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.marked[rows[todo]]
            hit = todo[done]
            out[hit] = self.samples[self.places[rows[hit]]] + steps[hit]
            todo = todo[~done]
            c = self.tree.access(rows[todo])
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
        return out


class _Numbers(dict):
    def __missing__(self, word):
        return 0


class Patterns:
    """The distinct windows of some items, and which items have each: 4 bytes for a word of a window, 4 for an item with it.

    Arrays, not objects, as they are broadcast: about 80 bytes for each word of the items.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.numbers = _Numbers()
        self.names = sorted({i for i, _ in items})
        place = {n: k for k, n in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], []
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                ids = np.concatenate([np.zeros(max(0, window - len(ids)), np.int32), ids])  # a shorter item ends at the right edge
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owners.append(np.full(len(rows[-1]), place[item], np.int32))
        every = np.concatenate(rows)
        self.matrix, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([which.ravel(), np.concatenate(owners)]), axis=0) if owners else np.zeros((0, 2), np.int64)
        self.owners = pairs[:, 1].astype(np.int32)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))
        self.lengths = (self.matrix > 0).sum(axis=1)

    def items(self, patterns: list[int]) -> list[str]:
        """Sorted ids of the items that have any of the windows."""
        own = [self.owners[self.starts[p] : self.starts[p + 1]] for p in patterns]
        return [self.names[k] for k in np.unique(np.concatenate(own))] if own else []

    def hits(self, texts: list[list[bytes]]) -> dict[int, list[tuple[int, int, int]]]:
        """By text: (first word, word after the last, pattern) of each occurrence."""
        if not len(self.lengths):
            return {}
        sizes = np.array([len(t) for t in texts], np.int64)
        get = self.numbers.__getitem__
        ids = np.fromiter((x for t in texts for x in map(get, t)), np.int64, sizes.sum())
        if not len(ids):
            return {}
        owner = np.repeat(np.arange(len(texts)), sizes)
        cut = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(ids > 0, owner, -1), [-1]])))
        starts, ends = cut[:-1], cut[1:]
        held = (ids[starts] > 0) & (ends - starts >= self.lengths.min()) if len(starts) else np.zeros(0, bool)
        starts, ends = starts[held], ends[held]
        if not len(starts):
            return {}
        spread = ends - starts + 1  # each run and a 0 after it
        seq = np.zeros(spread.sum(), np.int64)
        origin = np.repeat(starts - np.concatenate([[0], np.cumsum(spread)[:-1]]), spread) + np.arange(len(seq))
        inside = np.ones(len(seq), bool)
        inside[np.cumsum(spread) - 1] = False
        seq[inside] = ids[origin[inside]]
        index = FmIndex(seq, len(self.numbers) + 1)
        low, high = index.search(self.matrix, self.lengths)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return {}
        count = high[hit] - low[hit]
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        which = np.repeat(hit, count)
        at = origin[index.locate(rows)]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out: dict[int, list[tuple[int, int, int]]] = {}
        for doc, word, p in zip(owner[at], at - first[owner[at]], which):
            out.setdefault(int(doc), []).append((int(word), int(word + self.lengths[p]), int(p)))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_ROW = "doc_id long, h long, n_words long, spans array<struct<a:long,b:long>>, items array<string>"
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _found(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Patterns(items, window))  # PASS_BYTES of texts at most, but for one longer item

    def scan(batches):
        patterns = shared.value
        for part in chunks(batches, 2 << 20):
            texts = [words_of(t) for t in part["text"]]
            hits = patterns.hits(texts)
            rows = {n: [] for n in _ROW_ARROW.names}
            for k, (doc_id, h, words) in enumerate(zip(part["doc_id"], part["h"], texts)):
                own = hits.get(k, [])
                rows["doc_id"].append(doc_id)
                rows["h"].append(h)
                rows["n_words"].append(len(words))
                rows["spans"].append([{"a": a, "b": b} for a, b in merged([(a, b) for a, b, _ in own])])
                rows["items"].append(patterns.items(sorted({p for _, _, p in own})))
            yield pa.RecordBatch.from_pydict(rows, schema=_ROW_ARROW)

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(scan, _ROW)


def _passes(benchmark: DataFrame):
    """Lists of (item_id as text, text), each of ``PASS_BYTES`` at most, but for one longer item."""
    held, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").orderBy("i").toLocalIterator():
        n = len(r["text"] or "")
        if held and size + n > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((r["i"], r["text"]))
        size += n
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words, items with occurring windows, n_hit, n_items, items_sha256, contaminated.

    A null text has no words, and an item without words no window. Repeated items count once by
    id; a null item_id is the id "null". Repeated documents give repeated results. An empty
    benchmark hits nothing. Other columns are not read. A benchmark above ``PASS_BYTES`` is
    searched in passes over the documents, whose findings are put together by document.
    """
    return _judged(_all_found(docs, benchmark, window)).drop("h")


def _all_found(docs: DataFrame, benchmark: DataFrame, window: int) -> list[DataFrame]:
    """The findings of each pass; of several each is saved before the next one's windows are gathered and broadcast."""
    passes = _passes(benchmark)
    first, second = next(passes), next(passes, None)
    if second is None:
        return [_found(docs, first, window)]
    parts = []
    for items in itertools.chain([first, second], passes):
        part = _found(docs, items, window)
        parts.append(saved(part if not parts else part.where("size(items) > 0"), "found"))
    return parts


def _judged(parts: list[DataFrame]) -> DataFrame:
    """``contamination`` from the findings of its passes, with ``h``, the text's hash."""
    found = parts[0]
    if len(parts) > 1:  # repeated rows find the same in each pass: they are counted in one and joined to the union
        for p in parts[1:]:
            found = found.unionByName(p)
        together = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), "h").agg(
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = parts[0].select("doc_id", "h", "n_words", F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z")).join(together, ["d", "z", "h"])
        step = """aggregate(array_sort(spans), cast(array() as array<struct<a:bigint,b:bigint>>), (acc, x) ->
            if(size(acc) > 0 and x.a <= acc[size(acc) - 1].b,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', acc[size(acc) - 1].a, 'b', greatest(acc[size(acc) - 1].b, x.b)))), concat(acc, array(x))))"""
        found = found.withColumn("spans", F.expr(step))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select("doc_id", "h", "n_words", "spans", "items", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones, each row judged by its own text. With a benchmark of one pass no row leaves its partition."""
    passes = _passes(benchmark)
    first = next(passes)
    second = next(passes, None)
    if second is not None:
        key = [F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z")]
        bad = _judged(_all_found(docs, benchmark, window)).where("contaminated").select(*key, "h").distinct()
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key, F.xxhash64("text").alias("h"))
        return rows.join(bad, ["d", "z", "h"], "left_anti").select("_row.*")
    shared = docs.sparkSession.sparkContext.broadcast(Patterns(first, window))
    at = docs.columns.index("text")

    def keep(batches):
        patterns = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [words_of(x.as_py()) for x in part.column(at)]
                hits, ok = patterns.hits(texts), []
                for k, words in enumerate(texts):
                    n = sum(b - a for a, b in merged([(a, b) for a, b, _ in hits.get(k, [])]))
                    ok.append(not (n > 0 and 20 * n >= len(words)))
                yield part.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, coalesce(w, []) AS w, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words FROM dw),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (
  SELECT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS g
  FROM bw WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM bi),
dg AS (
  SELECT doc_id, m, unnest(range(1, n_words - m + 2)) AS p, unnest(list_transform(range(1, n_words - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM d, m WHERE n_words >= m),
h AS (SELECT DISTINCT dg.doc_id, dg.p, dg.m, bi.item_id FROM dg JOIN bi ON dg.g = bi.g AND dg.m = bi.m),
c AS (SELECT doc_id, CAST(count(DISTINCT q) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, d.n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= d.n_words AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
