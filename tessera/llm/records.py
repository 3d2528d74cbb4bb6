"""Token ids in files of length-delimited binary records with a separate offset index.

A record is: length of its payload (unsigned 64 bits), masked checksum of these 8 bytes
(32 bits), payload, masked checksum of the payload, all little-endian. The checksum is
crc32, masked by rotating it 15 bits to the right and adding a constant. The payload is the
document's id (signed 64 bits), a flag byte, and its token ids in 16 bits, or in 32 bits where the
vocabulary has more than 65,536. The flag tells width and whether the id is null.
The index, a Parquet table beside the files, has each record's file and offset, and
``fetch_records`` reads records by it in any order.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, fresh_path, tasks

END_ID = 1
_MASK = 0xA282EAD8
_WIDE, _NULL = 1, 2
#: Records and bytes after which a task begins a new file: what it holds of the index is bounded by these.
FILE_RECORDS, FILE_BYTES = 50_000, 256 << 20
#: Words in each of the two generations that a worker remembers.
REMEMBERED = 500_000
#: Letters that have one composed form and one lower case, with at most one mark after them that no rule joins to them.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,|]?)")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(stream):
    """The payloads of a stream of records; ValueError at a wrong length or checksum."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("record with a damaged length")
        size = struct.unpack("<Q", head[:8])[0]
        payload, check = stream.read(size), stream.read(4)
        if len(payload) < size or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
            raise ValueError("record with damaged content")
        yield payload


def packed(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<qB", doc_id or 0, wide * _WIDE + (doc_id is None) * _NULL) + ids


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flag = struct.unpack_from("<qB", payload)
    return None if flag & _NULL else doc_id, np.frombuffer(payload, "<u4" if flag & _WIDE else "<u2", offset=9)


class WordIds(dict):
    """Ids of a text, word by word.

    The vocabulary's rules drop white space and no rule looks across it, so the ids of a text are
    those of its words one after another. Texts with a special token's mark or with control characters
    that only some libraries take for white space are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.wide = self.lib.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.older: dict[str, bytes] = {}
        # Byte-level names of bytes: printable ones name themselves, the others follow from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        names = [chr(b) if b in shown else chr(next(others)) for b in range(256)]
        self.letters = str.maketrans({chr(c): "".join(names[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)})
        probes = [chr(c) * n + "s" * n for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)) for n in (1, 2)]
        self.direct = all(self.word(w) == self.whole(w) == self.whole(w.upper() if w[0] not in "ßÿ" else w) for w in probes)
        self.marks = {m: self.whole(m) for m in ".,|"}
        self.odd = "\x1c\x1d\x1e\x1f\x85"

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, letters: str) -> bytes:
        """A lower-case word's ids from the library's model, without the steps that leave it as it is."""
        try:
            ids = [t.id for t in self.lib.model.tokenize(letters if letters.isascii() else letters.translate(self.letters))]
        except Exception:  # noqa: BLE001  a model of another kind
            return b""
        small = not self.wide and sys.byteorder == "little"
        return array("H", ids).tobytes() if small else np.array(ids, self.kind).tobytes()

    def learn(self, words: set[str]) -> None:
        """Remembers the words: from the older generation, from their letters and mark, or from the library."""
        older, odd = self.older, []
        for w in words:
            if (code := older.get(w)) is not None:
                self[w] = code
            elif self.direct and (m := _PLAIN.fullmatch(w)):
                letters, mark = m.groups()
                letters = letters.lower()
                code = self.get(letters) or older.get(letters) or self.word(letters)
                self[letters] = code
                self[w] = code + self.marks[mark] if mark else code
            else:
                odd.append(w)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for w, e in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False)):
                self[w] = np.array(e.ids, self.kind).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        words = [None if "<|" in t or any(c in t for c in self.odd) else t.split() for t in texts]
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        new: set[str] = set()
        for w in words:
            if w:
                new.update(filterfalse(self.__contains__, w))
        if new:
            self.learn(new)
        return [self.whole(t) if w is None else b"".join(map(self.__getitem__, w)) for t, w in zip(texts, words)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _open(uri: str):
    """The file system and path of a Hadoop-style address."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


INDEX = "part long, seq long, doc_id long, file string, at long, n_bytes long, n_tokens long"
_INDEX = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes all texts' ids in ascending doc_id order below ``folder`` and returns the saved index.

    A null text is empty and has the end id alone; null doc_ids come first; rows of one doc_id
    follow by the text's hash. An empty table gives an empty index. Other columns are not read.
    ``part`` ascends over the files. A task writes its files under names of their own and names each in
    the index only when complete, so what a lost or repeated task leaves behind is not part of the result.
    """
    spark = docs.sparkSession

    def write(batches):
        import gc
        import uuid

        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        ids = word_ids(tokenizer)
        end = np.array([end_id], ids.kind).tobytes()
        store, top = _open(folder)
        n_files, out, rows, at = 0, None, [], 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _INDEX)], schema=_INDEX)

        gc.disable()  # the words' codes hold no cycles, and there are many
        try:
            for piece in chunks(batches, 4 << 20):
                if out is not None and (len(rows) >= FILE_RECORDS or at >= FILE_BYTES):
                    yield closed()
                    out = None
                if out is None:
                    part, uri = first + n_files, f"part-{first >> 32:06d}-{n_files:06d}-{uuid.uuid4().hex}.rec"
                    store.create_dir(top, recursive=True)
                    out, rows, at, n_files = store.open_output_stream(f"{top}/{uri}"), [], 0, n_files + 1
                for doc_id, code in zip(piece["doc_id"], ids.many([t or "" for t in piece["text"]])):
                    record = framed(packed(doc_id, code + end, ids.wide))
                    out.write(record)
                    rows.append((part, len(rows), doc_id, uri, at, len(record), (len(code) + len(end)) // len(end)))
                    at += len(record)
            if out is not None:
                yield closed()
        finally:
            gc.enable()

    n = tasks(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


READ = "part long, doc_id long, before long, n_tokens long, ids_crc32 long"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """From the files: per record its part, doc_id, ids before it in the file, number of ids and crc32 of the ids in 32 bits."""
    kinds, columns = [pa.int64()] * 5, [x.split()[0] for x in READ.split(", ")]

    def read(batches):
        store, top = _open(folder)
        for batch in batches:
            for part, name in zip(*batch.to_pydict().values()):
                rows, before = [], 0
                with store.open_input_stream(f"{top}/{name}", buffer_size=1 << 20) as stream:
                    for payload in unframed(stream):
                        doc_id, ids = unpacked(payload)
                        rows.append((part, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        before += len(ids)
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    files = index.select("part", "file").distinct().repartition(tasks(index.sparkSession), "part")
    return files.mapInArrow(read, READ)


FETCHED = "place long, doc_id long, ids array<long>"


def fetch_records(wanted: DataFrame, folder: str) -> DataFrame:
    """Single records in any order: ``wanted`` has ``place`` (long) and the index's ``file``, ``at`` and ``n_bytes``.

    Each record is read at its offset and checked; ``place``, such as a position in a shuffled
    order, comes back with it. Rows of one file are read in the order of their offsets. A record asked
    for twice comes twice; none asked for, none returned. Null addresses are left out.
    """

    def read(batches):
        import io

        store, top = _open(folder)
        name, stream = None, None
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    rows = []
                    for place, file, at, size in zip(*batch.slice(start, 512).to_pydict().values()):
                        if file != name:
                            if stream is not None:
                                stream.close()
                            name, stream = file, store.open_input_file(f"{top}/{file}")
                        doc_id, ids = unpacked(next(unframed(io.BytesIO(stream.read_at(size, at)))))
                        rows.append((place, doc_id, ids.tolist()))
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["place", "doc_id", "ids"])
        finally:
            if stream is not None:
                stream.close()

    known = wanted.select("place", "file", "at", "n_bytes").where("file is not null and at is not null and n_bytes is not null")
    near = known.repartition(tasks(wanted.sparkSession), "file", F.expr(f"at div {FILE_BYTES >> 4}")).sortWithinPartitions("file", "at")
    return near.mapInArrow(read, FETCHED)


def token_records(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the records and reads them back: doc_id, start, n_tokens, ids_crc32."""
    index = write_records(docs, folder, tokenizer)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read_records(index, folder).join(F.broadcast(starts), "part").select(  # a row for each file
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_records(docs, fresh_path(spark, "records"), public_tokenizers.path("word_bpe_49k.json"))
