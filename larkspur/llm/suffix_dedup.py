"""Exact removal of repeated byte strings with range-partitioned suffixes.

A byte goes if a string of LENGTH bytes around it also starts anywhere else. The
suffixes of all positions don't need sorting: by winnowing, each string selects
one anchor, the start of its k-gram with the least hash, which depends on the
string alone, so equal strings have equal anchors at equal offsets. Anchors
whose k-gram is unique have no repeated strings. For the others:

* An anchor's context is the bytes of all strings that select it. Equal contexts
  (by BLAKE2b) go to the sort as one row with a count, so that the copies of a
  frequent passage are no burden; the bucket marks all strings of a row that
  counts twice.
* Contexts are sorted as suffixes from the anchor. Sampled splitters deal them
  over range partitions by their leading bytes, at two levels where there are
  many, so that the driver holds a fixed number of splitters. A bucket sorts by
  multikey quicksort on words of eight bytes, once to the right of the anchors
  and once to the left; the common prefixes of neighbours then tell, for each
  offset of the anchor, which contexts hold equal strings.
* A run that shares its prefix with a bucket's first or last row may go on in the
  next bucket. Its strings are compared across boundaries, by a shuffle on their
  SHA-256.

Then texts and their repeated intervals meet once, and the rest is kept.

Cases: null text counts as empty; texts shorter than LENGTH stay whole; very long
texts pass in pieces; repeated rows are each other's copies and get a row each;
null ids are legal; an empty table gives no rows; other columns are ignored
(``deduplicated`` keeps them).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_sample, keyed, materialize, portions, same_row, split_join, text_key

LENGTH, GRAM = 200, 80
OFFSETS = LENGTH - GRAM + 1  # an anchor starts 0 .. OFFSETS - 1 bytes into its string
PIECE = 200_000
SPLITTERS_PER_BUCKET, BUCKET_ROWS = 8, 60_000
#: Most buckets of the first level, whose splitters pass the driver.
LEVEL = 512
PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (PRIME, pow(PRIME, -1, 1 << 64)):
        x = np.full(n + 1, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x, out=x))
    return out[0], out[1]


_cached: list[np.ndarray] = []


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte * PRIME ** position, from which any range's hash follows."""
    if not _cached or len(_cached[0]) < len(data) + 1:
        _cached[:] = _powers(max(len(data), 1 << 16))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _cached[0][: len(data)], out=sums[1:])
    return sums


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop], the same wherever these bytes lie."""
    return (sums[stop] - sums[start]) * _cached[1][start]


_places: list[np.ndarray] = []


def places(n: int) -> np.ndarray:
    """Positions modulo 2 * OFFSETS."""
    if not _places or len(_places[0]) < n:
        _places[:] = [np.arange(max(n, PIECE + LENGTH)) % (2 * OFFSETS)]
    return _places[0][:n]


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the string, anchor, k-gram hash) wherever the anchor changes, for one piece of text."""
    n = len(data) - LENGTH + 1
    sums = prefix_sums(data)
    raw = (sums[GRAM:] - sums[:-GRAM]) * _cached[1][: len(data) - GRAM + 1]
    # The least hash, rightmost first; the low bits make room for the position within the block pair.
    h = mixed(raw, 0xD6E8FEB86659FD93) & np.uint64(MASK ^ 0xFF)
    h |= (0xFF - places(len(h))).astype(np.uint64)
    if len(h) % OFFSETS:
        h = np.append(h, np.full(-len(h) % OFFSETS, MASK, np.uint64))
    x = h.reshape(-1, OFFSETS)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    low, high = behind[:n], ahead[OFFSETS - 1 : OFFSETS - 1 + n]
    # Positions modulo 2 * OFFSETS wrap; compare hashes first, then take the right block's on ties.
    best = np.where((high >> np.uint64(8)) <= (low >> np.uint64(8)), high, low)
    ahead_by = 0xFF - (best & np.uint64(0xFF)).astype(np.int64) - places(n)
    anchor = np.arange(n) + ahead_by + 2 * OFFSETS * (ahead_by < 0)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return new, anchor[new], raw[anchor[new]]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string, k-gram hash) of some bytes, which pass in pieces."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    found = []
    for p in range(0, n, PIECE):
        first, spot, gram = _anchors(data[p : min(n, p + PIECE) + LENGTH - 1])
        found.append((first + p, spot + p, gram))
    first, spot, gram = (np.concatenate(x) for x in zip(*found))
    new = np.append(True, spot[1:] != spot[:-1])
    first, spot, gram = first[new], spot[new], gram[new]
    return spot, first, np.append(first[1:], n) - 1, mixed(gram, 0xA0761D6478BD642F).view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch in a row, and where each one starts; the end is last."""
    column = column.fill_null("").cast(pa.large_string())
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def anchors_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first string, last string, k-gram hash), at places in ``data``; strings that leave their text don't count."""
    spot, first, last, gram = anchors(data)
    row = np.searchsorted(bounds, spot, "right") - 1
    first, last = np.maximum(first, bounds[row]), np.minimum(last, bounds[row + 1] - LENGTH)
    inside = first <= last
    return row[inside], spot[inside], first[inside], last[inside], gram[inside]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def gram_rows(rows: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            data, bounds = text_bytes(batch.column(2))
            row, spot, _, _, gram = anchors_of(data, bounds)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), batch.column(0).take(take), batch.column(1).take(take), pa.array((spot - bounds[row]).astype(np.int32))],
                ["gram", "doc_id", "th", "spot"],
            )

    return rows.mapInArrow(task, "gram long, doc_id long, th long, spot int")


CONTEXTS = "c1 long, c2 long, doc_id long, th long, spot int, low int, high int"


def context_rows(rows: DataFrame) -> DataFrame:
    """The contexts of candidate anchors (column spots) as the halves c1, c2 of their digest, and the anchor's least and greatest offset in their strings."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            data, bounds = text_bytes(batch.column(2))
            spots = batch.column(3)
            wanted = spots.flatten().to_numpy() + np.repeat(bounds[:-1], np.diff(spots.offsets.to_numpy()))
            row, spot, first, last, _ = anchors_of(data, bounds)
            keep = np.isin(spot, wanted)
            row, spot, first, last = row[keep], spot[keep], first[keep], last[keep]
            whole, blake = data.tobytes(), hashlib.blake2b
            # Where the anchor lies belongs to the context.
            digests = [blake(whole[f:e] + bytes([a]), digest_size=16).digest() for f, e, a in zip(first.tolist(), (last + LENGTH).tolist(), (spot - first).tolist())]
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(take), batch.column(1).take(take),
                 *(pa.array(x.astype(np.int32)) for x in (spot - bounds[row], spot - last, spot - first))],
                [c.split()[0] for c in CONTEXTS.split(", ")],
            )

    return rows.mapInArrow(task, CONTEXTS)


SUFFIXES = "c1 long, c2 long, n long, left binary, right binary, low int, high int"


def suffix_rows(rows: DataFrame) -> DataFrame:
    """Distinct contexts (column picks of structs) with their bytes: left of the anchor, reversed, and from it on.

    low, high: the offsets that the anchor has in the context's strings.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            out = []
            for text, picks in zip(*(c.to_pylist() for c in batch.columns)):
                data = as_bytes(text).tobytes()
                for p in picks:
                    s, f, e = p["spot"], p["first"], p["last"]
                    out.append((p["c1"], p["c2"], p["n"], data[f:s][::-1], data[s : e + LENGTH], s - e, s - f))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int32()] * 2
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in SUFFIXES.split(", ")])

    return rows.mapInArrow(task, SUFFIXES)


def padded_words(strings: list[bytes], size: int) -> np.ndarray:
    """Rows of big-endian 8-byte words, zero-padded to ``size`` bytes, and the length as the last word."""
    return np.frombuffer(b"".join(s.ljust(size, b"\0") + len(s).to_bytes(8, "big") for s in strings), ">u8").reshape(len(strings), size // 8 + 1)


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of 8-byte words, by multikey quicksort.

    A segment of rows that are equal so far is split at a pivot word in smaller,
    equal and greater ones; the equal ones go on with the next word. All
    segments take their step at once.
    """
    keys = keys.astype(np.uint64)
    order = np.arange(len(keys))
    at, depth = order.copy(), np.zeros(len(keys), np.int64)  # places in open segments, and the word they are at
    segment = np.zeros(len(keys), np.int64)
    if len(keys) < 2:
        return order
    while len(at):
        rows = order[at]
        word = keys[rows, depth]
        starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        sizes = np.diff(np.append(starts, len(at)))
        low, middle, high = word[starts], word[starts + sizes // 2], word[starts + sizes - 1]
        pivot = np.repeat(np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high)), sizes)
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        to = np.repeat(starts, sizes)  # each row's place in its segment: after those of lower sides, in order within its own
        for k in range(3):
            own = side == k
            before = np.cumsum(own) - own
            to = np.where(own, to + before - np.repeat(before[starts], sizes), to + (side > k) * np.repeat(np.add.reduceat(own, starts, dtype=np.int64), sizes))
        part = np.empty_like(to)
        order[at[to]], part[to] = rows, np.repeat(np.arange(len(starts)), sizes) * 3 + side
        depth[to] = depth + (side == 1)
        new = np.append(True, part[1:] != part[:-1])
        open_ = ~(new & np.append(new[1:], True)) & (depth < keys.shape[1])
        at, depth, segment = at[open_], depth[open_], part[open_]
    return order


def common_prefixes(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common bytes of each sorted row and the one before it."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] ^ keys[:-1]
        word = (differ != 0).argmax(1)
        same = ~(differ != 0).any(1)
        first = differ[np.arange(len(differ)), word].astype(np.uint64)
        # Whole equal bytes at the top of the first different word.
        equal = sum(((first >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 8))
        found = np.where(same, keys.shape[1] * 8, word * 8 + equal)
        out[1:] = np.minimum(found, np.minimum(lengths[1:], lengths[:-1]))
    return out


def repeated_offsets(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """repeated[i, d]: the string of context i with d bytes before its anchor also lies in another context of the bucket."""
    n = len(left)
    out = np.zeros((n, OFFSETS), bool)
    rights, lefts = padded_words(right, LENGTH), padded_words(left, -(-OFFSETS // 8) * 8)
    right_order, left_order = multikey_quicksort(rights), multikey_quicksort(lefts)
    r_len, l_len = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    r_common = common_prefixes(rights[right_order], r_len[right_order])
    l_common = common_prefixes(lefts[left_order], l_len[left_order])
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(OFFSETS):
        has = np.flatnonzero((low <= d) & (d <= high))
        if len(has) < 2:
            continue
        r_class[right_order] = np.cumsum(r_common < LENGTH - d)  # equal from the anchor on
        l_class[left_order] = np.cumsum(l_common < d)  # equal before it
        key = r_class[has] * (n + 1) + l_class[has]
        by = np.argsort(key)
        key = key[by]
        equal = key[1:] == key[:-1]
        twice = np.append(False, equal) | np.append(equal, False)
        out[has[by[twice]], d] = True
    return out


def find_repeats(several: bool):
    """A bucket's marks (c1, c2, n, d, key): key is null if the string at offset d repeats here, at -1 all do; else its digest, to be compared across boundaries.

    ``several``: there are other buckets.
    """

    def task(table: pa.Table) -> pa.Table:
        c1, c2, n, low, high = (table[c].to_numpy() for c in ("c1", "c2", "n", "low", "high"))
        left, right = table["left"].to_pylist(), table["right"].to_pylist()
        here = repeated_offsets(left, right, low, high)
        copied = np.flatnonzero(n > 1)
        here[copied] = False
        i, d = np.nonzero(here)
        i, d = np.concatenate([copied, i]), np.concatenate([np.full(len(copied), -1), d])
        keys: list = [None] * len(i)
        edges = {min(right), max(right)} if several else set()
        more_i, more_d = [], []
        for k in range(len(right) if several else 0):
            shared = max(_shared(right[k], s) for s in edges)
            if shared >= GRAM:
                for offset in range(max(low[k], LENGTH - shared), high[k] + 1):
                    string = left[k][:offset][::-1] + right[k][: LENGTH - offset]
                    more_i.append(k), more_d.append(offset), keys.append(hashlib.sha256(string).digest())
        i, d = np.concatenate([i, np.array(more_i, np.int64)]), np.concatenate([d, np.array(more_d, np.int64)])
        columns = [pa.array(c1[i]), pa.array(c2[i]), pa.array(n[i]), pa.array(d.astype(np.int32)), pa.array(keys, pa.binary())]
        return pa.table(columns, names=[c.split()[0] for c in MARKS.split(", ")])

    return task


MARKS = "c1 long, c2 long, n long, d int, key binary"


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(x.argmax())


def cut_points(sample: list[tuple[bytes, bytes]], buckets: int) -> list[tuple[bytes, bytes]]:
    """Evenly spaced members of a sample of (right, left) that part it in ``buckets``."""
    found = sorted(sample)
    return sorted({found[k * len(found) // buckets] for k in range(1, buckets)}) if found else []


def deal_suffixes(distinct: DataFrame, rows: int) -> DataFrame:
    """Contexts with their bucket: ranges between sampled splitters, by leading bytes.

    The driver sees the splitters of at most LEVEL ranges. Where more buckets are
    wanted, each range has its own splitters, found and applied in tasks.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    coarse = min(buckets, LEVEL)
    fine = -(-buckets // coarse)
    taken = hash_sample(distinct, rows, coarse * SPLITTERS_PER_BUCKET, "c1", "c2").select("right", "left").collect() if coarse > 1 else []
    bounds = cut_points([(bytes(s["right"]), bytes(s["left"])) for s in taken], coarse)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(bounds, p) for p in pairs], pa.int64())], [*batch.schema.names, "bucket"])

    dealt = distinct.mapInArrow(task, SUFFIXES + ", bucket long")
    if fine == 1:
        return dealt

    def split(table: pa.Table) -> pa.Table:
        found = cut_points(list(zip(table["right"].to_pylist(), table["left"].to_pylist())), fine)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(found), pa.int64()), "r": pa.array([r for r, _ in found], pa.binary()), "l": pa.array([x for _, x in found], pa.binary())})

    def place(table: pa.Table, own: pa.Table) -> pa.Table:
        inner = sorted(zip(own["r"].to_pylist(), own["l"].to_pylist()))
        pairs = zip(table["right"].to_pylist(), table["left"].to_pylist())
        at = [b * fine + bisect_right(inner, p) for b, p in zip(table["bucket"].to_pylist(), pairs)]
        table = table.drop_columns(["bucket", "salt"])
        return table.append_column("bucket", pa.array(at, pa.int64()))

    salts = max(1, fine)  # so a group holds about a bucket's rows
    thin = hash_sample(distinct, rows, buckets * SPLITTERS_PER_BUCKET, "c1", "c2").mapInArrow(task, SUFFIXES + ", bucket long")
    inner = thin.select("bucket", "right", "left").groupBy("bucket").applyInArrow(split, "bucket long, r binary, l binary")
    inner = materialize(inner, "splitters").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("c2", "c1"), F.lit(salts)).cast("int"))
    return dealt.groupBy("bucket", "salt").cogroup(inner.groupBy("bucket", "salt")).applyInArrow(place, SUFFIXES + ", bucket long")


def repeated_intervals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): candidate texts, and for their anchors the repeated string offsets.

    ``docs``: doc_id, th, text. marks: doc_id, th, spot, first, last, all (all
    strings repeat) or offsets (those that do).
    """
    grams = gram_rows(docs)
    twice = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    spots = split_join(grams, twice, ["gram"], "n").groupBy("doc_id", "th").agg(F.collect_set("spot").alias("spots"))
    spots = materialize(spots, "anchors")
    discard(twice)
    texts = materialize(docs.join(spots, same_row(docs, spots)).select(docs["doc_id"], docs["th"], docs["text"], "spots"), "candidates")
    discard(spots)
    stored = materialize(context_rows(texts.select("doc_id", "th", "text", "spots")), "contexts")
    # r tells the occurrences of a context apart.
    contexts = stored.select(
        "c1", "c2", F.xxhash64("doc_id", "th", "spot").alias("r"), "doc_id", "th", "spot", (F.col("spot") - F.col("high")).alias("first"), (F.col("spot") - F.col("low")).alias("last")
    )
    classes = materialize(contexts.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")), "classes")
    picked = (
        contexts.join(classes, ["c1", "c2", "r"])
        .groupBy("doc_id", "th").agg(F.collect_set(F.struct("c1", "c2", "n", "spot", "first", "last")).alias("picks"))
    )
    chosen = texts.join(picked, same_row(texts, picked)).select(texts["text"], "picks")
    distinct = materialize(suffix_rows(chosen).dropDuplicates(["c1", "c2"]), "suffixes")
    discard(classes)
    rows = distinct.count()
    marks = materialize(deal_suffixes(distinct, rows).groupBy("bucket").applyInArrow(find_repeats(rows > BUCKET_ROWS), MARKS), "marks")
    discard(distinct)
    across = marks.where("key IS NOT NULL")
    shared = across.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    offsets = marks.where("key IS NULL").drop("key").union(across.join(shared, "key", "left_semi").drop("key"))
    offsets = materialize(offsets.groupBy("c1", "c2").agg(F.max("n").alias("n"), F.collect_set("d").alias("offsets")), "offsets")
    every = F.array_contains("offsets", -1)
    found = split_join(contexts, offsets, ["c1", "c2"], "n").select(
        "doc_id", "th", "spot", "first", "last", every.alias("all"), F.when(~every, F.col("offsets")).alias("offsets")
    )
    return texts, found


def removed_runs(length: int, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals of repeated strings."""
    depth = np.cumsum(np.bincount(starts, minlength=length + 1) - np.bincount(stops, minlength=length + 1))
    edge = np.flatnonzero(np.diff(depth > 0, prepend=False))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def intervals(marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of a batch's marks, in the order of rows."""
    spot, first, last, whole, offsets = marks.flatten().flatten()
    row = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    whole = whole.to_numpy(zero_copy_only=False).astype(bool)
    sizes = pc.fill_null(pc.list_value_length(offsets), 0).to_numpy()
    single = np.repeat(spot.to_numpy(), sizes).astype(np.int64) - offsets.flatten().to_numpy()
    start = np.concatenate([first.to_numpy()[whole].astype(np.int64), single])
    stop = np.concatenate([last.to_numpy()[whole].astype(np.int64), single]) + LENGTH
    row = np.concatenate([row[whole], np.repeat(row, sizes)])
    by = np.argsort(row, kind="stable")
    return row[by], start[by], stop[by]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_bytes, n_removed, n_spans, spans, kept, kept_sha256.

    spans and kept (the remaining text, without bytes that no longer form UTF-8) are null if nothing was removed.
    """
    docs = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts, found = repeated_intervals(docs)
    lists = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("spot", "first", "last", "all", "offsets")).alias("marks"))
    once = texts.dropDuplicates(["doc_id", "th"])
    both = once.join(lists, same_row(once, lists)).select(once["doc_id"], once["th"], once["text"], "marks")
    schema = "k_id long, k_th long, n_removed long, spans array<struct<start long, end long>>, kept string, sha string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in portions(batches, 2):
            removed, spans, kept, digests = [], [], [], []
            row, first, stop = intervals(batch.column(3))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for text, i, j in zip(batch.column(2).to_pylist(), cuts[:-1], cuts[1:]):
                data = (text or "").encode()
                runs = removed_runs(len(data), first[i:j], stop[i:j])
                removed.append(sum(e - s for s, e in runs))
                spans.append([{"start": s, "end": e} for s, e in runs])
                starts, stops = [0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)]
                rest = b"".join(data[s:e] for s, e in zip(starts, stops))
                kept.append(rest.decode("utf-8", "ignore"))
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string()), pa.array(digests, pa.string())], ["k_id", "k_th", "n_removed", "spans", "kept", "sha"])

    changed = materialize(both.mapInArrow(task, schema), "kept")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", "th", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    return base.join(changed, base["doc_id"].eqNullSafe(changed["k_id"]) & (base["th"] == changed["k_th"]), "left").select(
        "doc_id", "th", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        "spans", "kept", F.coalesce("sha", "whole").alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes gone from its texts."""
    out = remove_repeats(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("kept").alias("__kept")).where("__kept IS NOT NULL").dropDuplicates(["__id", "__th"])
    text = F.when(F.col("__kept").isNull(), docs[text_col]).otherwise(F.col("__kept"))
    joined = docs.join(out, docs[id_col].cast("long").eqNullSafe(out["__id"]) & (text_key(docs[text_col]) == out["__th"]), "left")
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
