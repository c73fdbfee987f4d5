"""Token ids in fixed-width bit-packed files with block offsets.

Layout, little-endian: blocks of BLOCK ids, each id in the fewest bits that
hold the vocabulary, a block padded to whole bytes; then a footer of int64
arrays (block offsets, document ids, their null flags, id counts) and a trailer
(bits, block, documents, ids, footer offset, magic). Any id range decodes from
its blocks alone, with numpy.

Documents are range-partitioned and sorted by id; a task writes one file under
a temporary name and renames it, so a repeated task replaces the same file.
Files go through pyarrow's file systems, by the URI of the shared folder.

Cases: null text encodes like the empty text (the end id alone); null ids come
first; rows of one id are ordered by the first characters of their text and then
by its hash, and may fill any number of files; very long texts pass in blocks; an
empty table writes no documents; other columns are ignored. ``start`` counts the ids of all documents before, over all
files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, portions, scratch_path
from .tokens import encoder

BLOCK, MAGIC = 65_536, b"LSTOKEN1"
TRAILER = struct.Struct("<qqqqq8s")


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    flat = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, 0
        self.offsets, self.docs, self.nulls, self.lengths = [], [], [], []
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(flat[i : i + BLOCK])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> int:
        if self.n_held:
            self._block(np.concatenate(self.held))
        footer = b"".join(np.array(x, "<i8").tobytes() for x in (self.offsets, self.docs, self.nulls, self.lengths))
        total = sum(self.lengths)
        self.out.write(footer)
        self.out.write(TRAILER.pack(self.bits, BLOCK, len(self.docs), total, self.at, MAGIC))
        return total


class Reader:
    """Random access to one file: ``ids(start, stop)`` reads only the blocks it needs."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - TRAILER.size)
        self.bits, self.block, self.n_docs, self.n_ids, at, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(at)
        footer = np.frombuffer(file.read(size - TRAILER.size - at), "<i8")
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.append(footer[:blocks], at)
        self.docs, self.nulls, self.lengths = footer[blocks:].reshape(3, self.n_docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._last = (-1, None)

    def _get(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self.file.seek(int(self.offsets[k]))
            data = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
            self._last = (k, unpack(data, min(self.block, self.n_ids - k * self.block), self.bits))
        return self._last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts = [self._get(k)[max(0, start - k * self.block) : stop - k * self.block] for k in range(start // self.block, -(-stop // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def crcs(self) -> Iterator[int]:
        for s, n in zip(self.starts.tolist(), self.lengths.tolist()):
            crc = 0
            for at in range(s, s + n, self.block):  # a very long document passes in blocks
                crc = zlib.crc32(self.ids(at, min(s + n, at + self.block)).tobytes(), crc)
            yield crc


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files under ``path`` (a URI); one manifest row per file: file, part, n_docs, n_tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        fs, root = _open(path)
        fs.create_dir(root)
        final, temp = f"{root}/part-{part:06d}.tok", f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as out:
            writer = Writer(out, width(max(enc.size, end_id + 1)))
            for batch in portions(batches, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
            total = writer.close()
        fs.move(temp, final)
        yield pa.RecordBatch.from_pylist(
            [{"file": f"part-{part:06d}.tok", "part": part, "n_docs": len(writer.docs), "n_tokens": total}],
            pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # An id may have any part of all rows; equal rows may go anywhere, so they stay apart by where they come from.
    rows = rows.withColumns({"head": F.substring("text", 1, 24), "th": F.xxhash64("text"), "source": F.spark_partition_id()})
    rows = rows.repartitionByRange("doc_id", "head", "th", "source").sortWithinPartitions("doc_id", "head", "th").select("doc_id", "text")
    return materialize(rows.mapInArrow(task, "file string, part int, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32."""
    files, base = [], 0
    for r in manifest.orderBy("part").collect():  # one small row per file
        files.append((r["file"], base))
        base += r["n_tokens"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/{name}") as file:
                    reader = Reader(file)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.docs, mask=reader.nulls.astype(bool)), pa.array(reader.starts + first),
                            pa.array(reader.lengths), pa.array(list(reader.crcs()), pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    table = spark.createDataFrame(files, "file string, base long").repartition(max(1, min(len(files), 10_000)))
    return table.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    return read_tokens(spark, path, write_tokens(docs, path, tokenizer, end_id, id_col, text_col))
