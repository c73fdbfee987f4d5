"""Packing token pieces into fixed-length sequences, shortest pack first.

A document's ids are cut into full pieces and one remainder. Only the histogram
of piece lengths (at most ``length`` rows) reaches the driver: lengths go in,
longest first, to the pack with the most room, and a pack is a pattern of
lengths with a count, so the work depends on the histogram and not on the
corpus. No more sequences are kept than the ids fill: the emptiest packs are
dissolved, and their pieces are cut at the room that is left in the others, again
by patterns and counts. So all sequences but a few are full, whatever the
lengths are. The pieces then find their pattern by their rank among the pieces
of their length, and those that were cut fetch their ids.

Cases: null text counts as empty and gives a piece of the end id alone; an
empty table gives no pieces; very long texts are cut in full pieces; repeated rows
and null ids have pieces of their own; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, portions, ranked
from .tokens import encoder

SLOTS = "s_length int, s_first long, s_end long, s_at int, s_size int, s_offset int, s_sequence long"


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths, number of packs) that use up the histogram.

    Longest lengths first; each goes to the packs with the most room, else to a
    new pack. All packs of one pattern are handled together, and a count splits
    a pattern at most once, so there are O(lengths) steps each.
    """
    packs: Counter = Counter()
    room: list[tuple[int, tuple[int, ...]]] = []  # a heap by the most room
    for piece in sorted(histogram, reverse=True):
        left, changed = histogram[piece], []
        while left:
            while room and not packs[room[0][1]]:
                heapq.heappop(room)
            if room and -room[0][0] >= piece:
                free, pattern = heapq.heappop(room)
                n = min(packs[pattern], left)
                packs[pattern] -= n
                if packs[pattern]:
                    heapq.heappush(room, (free, pattern))
                new, free = (*pattern, piece), -free - piece
            else:
                n, new, free = left, (piece,), length - piece
            packs[new] += n
            left -= n
            if free:
                changed.append((-free, new))
            for x in changed:
                heapq.heappush(room, x)
            changed = []
    return [(p, n) for p, n in sorted(packs.items()) if n]


def padding(patterns: list[tuple[tuple[int, ...], int]], length: int) -> int:
    """Padded ids: a pack is filled to ``length`` unless its size is a power of two."""
    return sum(n * (length - sum(p)) for p, n in patterns if sum(p) & (sum(p) - 1))


def slots(patterns: list[tuple[tuple[int, ...], int]], length: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """Rows of SLOTS and (sequence id, ids in it) of the sequences that are not full, fewer than ``length``.

    A piece of s_length with rank r from s_first to s_end has s_size of its ids,
    from s_at on, in sequence s_sequence + r - s_first at s_offset.
    """
    surplus = sum(n for _, n in patterns) - -(-sum(n * sum(p) for p, n in patterns) // length)
    used: defaultdict[int, int] = defaultdict(int)
    out, sequence = [], 0
    open_: list[tuple[int, int, int]] = []  # (-room, sequences): the most room first
    loose: list[tuple[int, int, int, int, int]] = []  # (-ids left, piece, ranks, first id left): the longest first
    for pattern, n in sorted(patterns, key=lambda x: (sum(x[0]), x[0])):
        gone = min(n, surplus)  # the emptiest packs
        surplus -= gone
        offset = 0
        for piece in pattern:
            first, end = used[piece], used[piece] + n
            used[piece] = end
            if gone:
                heapq.heappush(loose, (-piece, piece, first, first + gone, 0))
            if gone < n:
                out.append((piece, first + gone, end, 0, piece, offset, sequence))
            offset += piece
        if gone < n:
            if offset < length:
                heapq.heappush(open_, (offset - length, sequence, sequence + n - gone))
            sequence += n - gone
    while loose:
        left, piece, first, end, at = heapq.heappop(loose)
        room, low, high = heapq.heappop(open_)
        n, size = min(end - first, high - low), min(-left, -room)
        out.append((piece, first, first + n, at, size, length + room, low))
        if first + n < end:
            heapq.heappush(loose, (left, piece, first + n, end, at))
        if low + n < high:
            heapq.heappush(open_, (room, low + n, high))
        if size < -left:
            heapq.heappush(loose, (left + size, piece, first, first + n, at + size))
        if size < -room:
            heapq.heappush(open_, (room + size, low, low + n))
    return out, [(s, length + room) for room, low, high in open_ for s in range(low, high)]


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def cut_pieces(rows: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows with the part [s_at, s_at + s_size) of their ids, as an array, and its checksum."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(encoder(tokenizer).size, end_id)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, size = batch.column("s_at").to_pylist(), batch.column("s_size").to_pylist()
            parts = [np.frombuffer(x, kind)[a : a + n].astype("<u4") for x, a, n in zip(batch.column("ids").to_pylist(), at, size)]
            ends = pa.array(np.cumsum([0, *size]).astype(np.int32))
            new = {"ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(np.int32))), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)

    return rows.mapInArrow(task, ", ".join("ids array<int>" if c == "ids" else f"`{c}` {t}" for c, t in rows.dtypes))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian, 2 bytes each if the vocabulary allows): full pieces and one remainder of each document."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in portions(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            kind = id_type(enc.size, end_id)
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), length):
                    piece = ids[s : s + length]
                    rows.append((doc_id, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(kind).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(task, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids if kept).

    padded_length: the size of the piece's sequence after padding.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, end_id, length, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, unfilled = slots(shortest_pack_first(histogram, length), length)
    table = spark.createDataFrame(found, SLOTS)
    fills = spark.createDataFrame(unfilled, "f_sequence long, f_sum int")
    key = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    rows = ranked(pieces if keep_ids else pieces.drop("ids"), "length", key, key, sum(histogram.values()), "rank")
    # Patterns and lengths bound this table, not documents.
    rows = rows.join(F.broadcast(table), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_end")))
    if keep_ids:
        rows = cut_pieces(rows, tokenizer, end_id)
    elif any(size < piece for piece, _, _, _, size, _, _ in found):
        whole = F.col("s_size") == F.col("length")
        cut = materialize(rows.where(~whole), "cut")
        named = cut.select(*[F.col(c).alias(f"k_{c}") for c in key]).distinct()
        same = pieces["doc_id"].eqNullSafe(F.col("k_doc_id")) & (pieces["start"] == F.col("k_start")) & (pieces["ids_crc32"] == F.col("k_ids_crc32")) & (pieces["doc_tokens"] == F.col("k_doc_tokens"))
        ids = pieces.join(named, same).select(*[c for c in named.columns], "ids").dropDuplicates(named.columns)
        same = cut["doc_id"].eqNullSafe(F.col("k_doc_id")) & (cut["start"] == F.col("k_start")) & (cut["ids_crc32"] == F.col("k_ids_crc32")) & (cut["doc_tokens"] == F.col("k_doc_tokens"))
        rows = rows.where(whole).unionByName(cut_pieces(cut.join(ids, same).select(*cut.columns, "ids"), tokenizer, end_id).drop("ids"))
    out = rows.withColumn("sequence_id", F.col("s_sequence") + F.col("rank") - F.col("s_first")).join(F.broadcast(fills), F.col("sequence_id") == F.col("f_sequence"), "left")
    two = F.bit_count("f_sum") == 1
    return out.select(
        "doc_id", (F.col("start") + F.col("s_at")).alias("start"), F.col("s_size").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id",
        F.col("s_offset").cast("long").alias("offset"), F.when(two, F.col("f_sum")).otherwise(length).alias("padded_length"), *(["ids"] if keep_ids else []),
    )
