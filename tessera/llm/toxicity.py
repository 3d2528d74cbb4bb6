"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: case, marks over letters, look-alike letters, invisible characters, and digits or signs that stand
for letters inside a word. Lexicon entries are word beginnings (" moron") or whole
words (" scum "), so one automaton over the text with single spaces between words finds all of
them in one pass. Matches within an exception phrase don't count. The sum of the matches' weights
and its density in the text's words give the score through a logistic curve.

How telling an entry must be is chosen by cross-validation inside the rows that are learnt from. The
lexicon, the exceptions and the curve are learnt from at most ``FIT_ROWS`` labelled rows, a
documented bound; scoring covers every text whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches

FIT_ROWS = 6_000
#: Characters of one text that fitting takes; longer ones are left out of the fit, not cut.
FIT_CHARS = 60_000
#: Toxic documents to each other one that an entry must have at least: cross-validation picks one of these.
RATIOS = (1, 2, 3, 5, 8)
FOLDS = 3

# Letters that look like a-z, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "η": "n", "ɑ": "a", "ı": "i", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "ɩ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
# Harmless phrases that contain insults.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "pond scum", "scum line", "sore loser board", "circus clown")

_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x034F])
_TABLE = str.maketrans(LOOKALIKES)
_INSIDE = re.compile(r"(?<=[a-z])[0134578@$!+]+(?=[a-z])|(?<![a-z0-9@$!+])[0134578@$]+(?=[a-z][a-z0-9@$!+])|(?<=[a-z]{2})[01345789]+(?![a-z0-9])")
_MARKS = re.compile("[\u0300-\u036f]")
_GAP = re.compile(r"[\W_]+")
_SUSPECT = re.compile(r"[0-9@$!+]")
_DIGIT_TABLE = str.maketrans(DIGITS)


def folded(text: str | None) -> str:
    """Lower-case words between single spaces, with one at either end."""
    if not text:
        return " "
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_INVISIBLE))).lower().translate(_TABLE)
    else:
        text = text.lower()
    if _SUSPECT.search(text):
        text = _INSIDE.sub(lambda m: m[0].translate(_DIGIT_TABLE), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Entries' weights, exception phrases and the curve's three numbers."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.0, 10.0)
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None)

    def matches(self, plain: str) -> list[tuple[int, str, float]]:
        """(end, entry, weight) of the matches outside exception phrases; of nested ones at a word the heaviest."""
        if not self.weights:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for e in self.exceptions:
                self._automaton.add_word(f" {e}", (f" {e}", None))
            for e, w in self.weights.items():
                self._automaton.add_word(e, (e, w))
            self._automaton.make_automaton()
        shielded, by_start = [], {}
        for end, (entry, weight) in self._automaton.iter(plain):
            start = end - len(entry) + 1
            if weight is None:
                shielded.append((start, end))
            elif start not in by_start or by_start[start][2] < weight:
                by_start[start] = (end, entry, weight)
        if shielded:
            by_start = {s: m for s, m in by_start.items() if not any(a <= s and m[0] - m[1].endswith(" ") <= b for a, b in shielded)}
        return [by_start[s] for s in sorted(by_start)]

    def features(self, text: str | None) -> tuple[float, float]:
        """The logarithm of 1 and the summed weight, and the summed weight for each root of the number of words."""
        return self.weighed(folded(text))

    def weighed(self, plain: str) -> tuple[float, float]:
        """``features`` of a text that is folded already."""
        total = sum(w for _, _, w in self.matches(plain))
        return math.log1p(total), total / math.sqrt(max(1, plain.count(" ") - 1))

    def score(self, text: str | None) -> float:
        return self.risk(*self.features(text))

    def risk(self, a: float, b: float) -> float:
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _entries(plain: str) -> set[str]:
    out = set()
    for w in set(plain.split()):
        if w.isdigit():
            continue
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(len(w), 12) + 1))
    return out


def _chosen(in1: Counter, in0: Counter, n1: int, n0: int, ratio: int) -> dict[str, float]:
    """Weights of the entries whose documents' labels differ from the base rate by more than chance among all entries would give.

    Of entries where one begins the other, the more telling stays, and of equal ones the longer.
    """

    def telling(a: int, b: int) -> float:
        out = 0.0
        for x, n in ((a, n1), (b, n0)):
            q, q0 = x / n, (a + b) / (n1 + n0)
            out += (x * math.log(q / q0) if x else 0) + ((n - x) * math.log((1 - q) / (1 - q0)) if x < n else 0)
        return 2 * out

    known = [e for e, c in in1.items() if c >= 4]
    least = 2 * math.log(max(2, len(known))) + 4
    good = {e: t for e in known if in1[e] >= ratio * in0[e] and (t := telling(in1[e], in0[e])) >= least}
    weights: dict[str, float] = {}
    for e in sorted(good, key=lambda e: (-round(good[e], 9), -len(e), e)):
        if not any(e.startswith(k) or k.startswith(e) for k in weights):
            weights[e] = math.log((in1[e] + 0.5) / (n1 + 1) / ((in0[e] + 0.5) / (n0 + 1)))
    return weights


def _curved(weights: dict[str, float], plain: list[tuple[str, int]]) -> Lexicon:
    """The lexicon with exceptions and curve learnt from folded texts and their labels."""
    lexicon = Lexicon(weights)
    phrases: dict[str, list[int]] = {}
    for p, y in plain:
        for end, entry, _ in lexicon.matches(p):
            start = end - len(entry) + 1
            before = p.rfind(" ", 0, start) + 1
            stop = p.find(" ", start + 1)
            if before < start:
                phrases.setdefault(p[before : stop if stop > 0 else len(p)], [0, 0])[y] += 1
    found = sorted(k for k, (no, yes) in phrases.items() if no >= 5 and yes == 0)
    lexicon = Lexicon(weights, EXCEPTIONS + tuple(found))
    x = np.array([(1.0, *lexicon.weighed(p)) for p, _ in plain])
    y = np.array([y for _, y in plain], float)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):  # Newton steps of a logistic regression; the ridge bounds it where labels separate
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Lexicon(weights, lexicon.exceptions, tuple(float(b) for b in beta))


def fit(rows: list[tuple[str | None, int]]) -> Lexicon:
    """A lexicon from (text, label) rows.

    Each of ``RATIOS`` is tried on ``FOLDS`` parts of these rows, learning from the others; that with the
    fewest wrong predictions, then the least surprise, is kept, and the lexicon learnt from all rows.
    """
    plain = [(folded(t), y) for t, y in rows]
    n1 = sum(y for _, y in plain)
    n0 = len(plain) - n1
    if not n1 or not n0:
        return Lexicon(curve=(-3.0 if not n1 else 3.0, 1.0, 1.0))
    in1, in0 = ([Counter() for _ in range(FOLDS)] for _ in range(2))
    for i, (p, y) in enumerate(plain):
        if y:
            in1[i % FOLDS].update(_entries(p))
    all1 = sum(in1, Counter())
    known = {e for e, c in all1.items() if c >= 4}
    for i, (p, y) in enumerate(plain):
        if not y:
            in0[i % FOLDS].update(_entries(p) & known)
    all0 = sum(in0, Counter())
    all1 = Counter({e: all1[e] for e in known})
    trials: dict[int, tuple[int, float]] = {r: (0, 0.0) for r in RATIOS}
    for k in range(FOLDS):
        own, rest = plain[k::FOLDS], [x for i, x in enumerate(plain) if i % FOLDS != k]
        m1 = sum(y for _, y in rest)
        if not m1 or m1 == len(rest):
            continue
        with1, with0 = Counter({e: all1[e] - in1[k][e] for e in known}), Counter({e: all0[e] - in0[k][e] for e in known})
        for ratio in RATIOS:
            lexicon = _curved(_chosen(with1, with0, m1, len(rest) - m1, ratio), rest)
            risks = [lexicon.risk(*lexicon.weighed(p)) for p, _ in own]
            wrong = sum((r >= 0.5) != bool(y) for r, (_, y) in zip(risks, own))
            surprise = -sum(math.log(max(1e-9, r if y else 1 - r)) for r, (_, y) in zip(risks, own))
            trials[ratio] = (trials[ratio][0] + wrong, trials[ratio][1] + surprise)
    best = min(RATIOS, key=lambda r: (trials[r][0], round(trials[r][1], 6), -r))
    return _curved(_chosen(all1, all0, n1, n0, best), plain)


def learnt(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon from those labelled rows whose crc32 of the id is not divisible by 5, ``rows`` of them at most by hash of the id.

    Rows with a null id or label are left out. Of a doc_id that repeats one text counts, the one of
    the least hash, and with several labels it is toxic if one says so.
    """
    ids = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS)
    got = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("doc_id")  # ``rows`` ids
    return fit([(r["text"], int(r["toxic"] > 0)) for r in got.select("text", "toxic").toLocalIterator()])


def held_out(column: str):
    """Whether the id belongs to the part that is never learnt from; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text has no match and the curve's lowest score. Repeated rows give repeated
    results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # entries learnt from FIT_ROWS rows

    def scan(batches):
        for part in chunks(batches):
            scores = [shared.value.score(t) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(part["held_out"], pa.bool_()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    slim = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return slim.mapInArrow(scan, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; the model is learnt from the labelled ones among them.

    Each row is judged by its own text, so repeated rows go or stay together; a null or empty text stays
    unless nearly all labels are toxic. Null ids are judged like others. All columns are kept whatever their names.
    """
    lexicon = learnt(small_batches(docs), labels)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = docs.columns
    at = names.index("text")

    def keep(batches):
        for batch in batches:
            ok = [shared.value.score(t) < 0.5 for t in (batch.column(at)[i].as_py() for i in range(batch.num_rows))]
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
