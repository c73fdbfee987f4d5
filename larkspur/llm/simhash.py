"""SimHash near-duplicates through vantage-point trees.

Fingerprints: word shingles hashed with XXH64, a bit set if it is in over half
of the hashes. Distinct fingerprints are compared, in one of two ways:

* ``near_fingerprints``: 64 bits, linked within a few differing bits. Exact.
* ``near_duplicates``: a Jaccard similarity of sets of distinct shingles, 0.8 by
  default. Copies that alike differ in about a sixth of the bits, and within such
  a radius no distance in 64 bits prunes anything. So the fingerprint has 512 bits
  (of eight mixes of each hash), and a pair is a candidate if all 512 bits are
  within three standard deviations of that similarity. Fingerprints meet in
  shards of equal least shingles (below). Candidates only form groups: within a group all
  sets are compared exactly, by a prefix filter, and only those similar enough
  link. Sets of at most SHORT shingles, whose bits are no measure, also meet by the
  prefix filter alone. So nothing below the threshold links, and of binomial bits
  a pair of exactly 0.8 is missed with a probability of about 0.002 by itself
  (0.0014 by the bits, 0.0003 by the shards).
  Groups of over GROUP sets are compared with one of theirs first; the triangle
  inequality of the Jaccard distance leaves few to compare in pieces.

The search of 512 bits: a tree or a look-up by bits meets a fixed part of all pairs,
so its work grows with the square of the rows. A set's least shingles under an
order are equal to those of another with the probability of their similarity, and
to those of an unrelated one hardly ever. Each fingerprint is dealt to SHARDS
shards, each named by the least shingles under two orders; a pair of 0.8 misses
all of them with a probability of 0.64 for each. In a shard all fingerprints are
compared. Those of shards above GROUP rows, which share passages, are searched
together by 18 blocks of 28 bits within 3 bits, as follows.

The search of 64 bits and of blocks: a tree over a bounded sample splits the Hamming space
into shards. At a node, those within the radius of the vantage point go left,
the others right. A fingerprint has one home; by the triangle inequality a node
can only cut a pair within ``bits`` if its right one lies at most ``bits``
beyond the radius, so such rows visit the left side too. A shard of whole
fingerprints builds its own tree in the same way and compares exactly in the
leaves; in one of 28-bit blocks a tree prunes next to nothing, so halves of the
blocks are looked up instead. It returns a spanning
forest of its links, which keeps every connection without listing the pairs of a
group; components join the forests.

Cases: null text counts as empty; texts without words have fingerprint zero,
linked like any other; very long texts count whole; repeated rows and null ids get a row each; the smallest
id of a component ignores null ids unless there is no other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hash_sample, keyed, materialize, portions, split_join, text_key

#: Fingerprints that the shards' tree is made from: at least SAMPLE, 16 a shard, at most MOST_SAMPLE.
SAMPLE, MOST_SAMPLE = 8192, 131_072
LEAF = 256
PER_SHARD = 200_000
WORDS, BLOCK_BITS, BLOCK_RADIUS = 8, 28, 3
#: Shards of a set, by least shingles; rows compared in one task.
SHARDS, SHARD_ROWS = 8, 100_000
#: Sets up to this size also meet without fingerprints.
SHORT = 20
#: Most sets of a group, or fingerprints of a shard, compared in one task; larger groups are cut in pieces.
GROUP = 2000
LANES = np.uint64(0x0101010101010101)
MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(1, WORDS)], np.uint64)

#: Unrelated odd factors: each puts the hashes in another order.
ORDERS = np.frombuffer(b"".join(blake2b(bytes([k]), digest_size=8).digest() for k in range(2 * SHARDS)), "<u8").astype(np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes: only A-Z, and only ASCII white space
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(join(words), 42)], np.uint64)
    grams = zip(*(words[i:] for i in range(shingle)))
    return np.fromiter((digest(join(g), 42) for g in grams), np.uint64, len(words) - shingle + 1)


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit word for each run of hashes: bits set in over half of the run. All sizes > 0."""
    ends = np.cumsum(sizes)
    per = -(-sizes // 255)  # byte lanes hold sums of up to 255
    run = np.repeat(np.arange(len(sizes)), per)
    k = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per)
    cuts, firsts = (ends - sizes)[run] + 255 * k, np.cumsum(per) - per
    out = np.zeros(len(sizes), np.uint64)
    for s in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(s)) & LANES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), firsts, axis=0)
        for lane in range(8):
            out |= (2 * ones[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + s)
    return out


def fingerprint_texts(texts: list[str | None], shingle: int, words: int) -> np.ndarray:
    return fingerprint_sets((shingle_hashes(t, shingle) for t in texts), words, len(texts))


def fingerprint_sets(hashes: Iterable[np.ndarray], words: int, n: int | None = None) -> np.ndarray:
    """Fingerprints as rows of ``words`` 64-bit integers."""
    out = np.zeros((len(hashes) if n is None else n, words), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        if held:
            h, sizes = np.concatenate(held), np.array([len(x) for x in held])
            for w in range(words):
                if w:
                    x = (h ^ (h >> np.uint64(29))) * MIX[w - 1]
                    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                out[rows, w] = _majority(x ^ (x >> np.uint64(31)) if w else h, sizes)
            held.clear(), rows.clear()

    total = 0
    for i, h in enumerate(hashes):
        if len(h):
            held.append(h)
            rows.append(i)
            total += len(h)
        if total > 500_000:
            flush()
            total = 0
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), fp: the fingerprint's bytes, big-endian words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            fps = fingerprint_texts(batch.column(2).to_pylist(), shingle, words).astype(">u8")
            data = pa.array([r.tobytes() for r in fps], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["doc_id", "th", "fp"])

    rows = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(task, "doc_id long, th long, fp binary")


def shard_keys(sets: list[np.ndarray]) -> np.ndarray:
    """SHARDS keys of each set of shingles: hashes of the least shingles under two orders; 0 of an empty set."""
    out = np.zeros((len(sets), SHARDS), np.uint64)
    sizes = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k in range(SHARDS):
            a, b = (np.minimum.reduceat(h * x, starts) for x in ORDERS[2 * k : 2 * k + 2])
            a = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
            out[full, k] = (a ^ (a >> np.uint64(29))) * ORDERS[k]
    return out


def as_words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint64)


def block(fp: np.ndarray, k: int, width: int) -> np.ndarray:
    """Bits [k * width, (k + 1) * width) of each fingerprint."""
    word, shift = divmod(k * width, 64)
    out = fp[:, word] >> np.uint64(shift)
    if shift + width > 64:
        out = out | (fp[:, word + 1] << np.uint64(64 - shift))
    return out & np.uint64((1 << width) - 1)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage_tree(sample: np.ndarray, leaf: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, left, right); a child -1 - k is shard k."""
    nodes: list[list[int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        best = None
        if len(points) > leaf:
            # Of a few points and radii, those with the fewest others just beyond the radius.
            for v in points[:: max(1, len(points) // 8)][:8]:
                d = distance(points, v)
                for q in (35, 50, 65):
                    r = int(np.percentile(d, q))
                    side = int((d <= r).sum())
                    if min(side, len(points) - side) * 5 >= len(points):
                        edge = int(((d > r) & (d <= r + 2)).sum())
                        if best is None or edge < best[0]:
                            best = (edge, int(v), r, d)
        if best is None:
            shards += 1
            return -shards
        _, v, r, d = best
        k = len(nodes)
        nodes.append([v, r, 0, 0])
        nodes[k][2] = grow(points[d <= r])
        nodes[k][3] = grow(points[d > r])
        return k

    grow(sample)
    return [tuple(n) for n in nodes]


def route(keys: np.ndarray, tree: list[tuple[int, int, int, int]], bits: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, shard, home): rows have one home shard and may visit others."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def down(node: int, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if node < 0:
            out.append((rows, -1 - node, home))
            return
        v, r, left, right = tree[node]
        d = distance(keys[rows], np.uint64(v))
        to_left = d <= r + bits
        to_right = (d > r) | (~home & (d > r - bits))
        down(left, rows[to_left], (home & (d <= r))[to_left])
        down(right, rows[to_right], (home & (d > r))[to_right])

    down(0 if tree else -1, np.arange(len(keys)), np.ones(len(keys), bool))
    return out


def cells(rows: np.ndarray, home: np.ndarray, salt: np.ndarray, pieces: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, home, rows): home pieces times pieces of all rows, so that any pair with one row at home shares a cell."""
    if pieces == 1:
        yield 0, home, rows
        return
    mixed = salt * np.uint64(0x9E3779B97F4A7C15)
    piece = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(pieces)).astype(np.int64)
    for i in range(pieces):
        for j in range(pieces):
            own = home & (piece == i)
            # Pairs at home on both sides meet once, where the home piece is the lower.
            taken = own | ((piece == j) & (~home | (i < j)))
            if taken.any():
                yield i * pieces + j, own[taken], rows[taken]


def dense_pairs(fp: np.ndarray, rows: np.ndarray, most: int, root: np.ndarray, rest: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``most`` on all bits that connect all such pairs of the rows taken out; ``rest`` receives the others.

    A row and all rows near it are taken out at once. By the triangle inequality
    those can only meet others at most ``most`` farther from the row than they
    are, so near copies cost one pass and not all their pairs.
    """
    misses = 0
    while len(rows) > LEAF and misses < 16:
        d = np.bitwise_count(fp[rows] ^ fp[rows[0]]).sum(1, dtype=np.int32)
        near = d <= most
        members, others, dm, do = rows[near], rows[~near], d[near], d[~near]
        yield np.full(len(members) - 1, rows[0]), members[1:]
        if len(others):
            wanted = dm + most >= do.min()
            members, dm = members[wanted], dm[wanted]
            close = do <= most + (int(dm.max()) if len(dm) else -1)
            reached = others[close]
            step = max(1, 200_000 // max(1, len(reached)))
            for i in range(0, len(members) if len(reached) else 0, step):
                part = members[i : i + step]
                open_ = reached[root[reached] != root[part[0]]]  # members are connected by now
                a, b = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[open_][None]).sum(2, dtype=np.int32) <= most)
                yield part[a], open_[b]
        misses = 0 if near.sum() * 50 >= len(rows) else misses + 1
        rows = others
    rest.append(rows)


def spread(counts: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k) for each k below counts[i], about ``most`` at a time."""
    starts = np.cumsum(counts) - counts
    cuts = np.flatnonzero(np.diff(starts // most)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)]):
        part = counts[low:high]
        yield np.repeat(np.arange(low, high), part), np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)


def equal_pairs(keys: np.ndarray, fp: np.ndarray, most: int, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal keys; rows of one key that are too many for all pairs are taken as a crowd, within ``most`` on all bits."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(keys)))
    later = np.repeat(first + sizes, sizes) - np.arange(len(keys)) - 1
    later[np.repeat(sizes > LEAF, sizes)] = 0
    for i, k in spread(later):
        yield order[i], order[i + k + 1]
    for g in np.flatnonzero(sizes > LEAF):
        rest: list[np.ndarray] = []
        yield from dense_pairs(fp, order[first[g] : first[g] + sizes[g]], most, root, rest)
        for i, k in spread(np.arange(len(rest[0]))):
            yield rest[0][i], rest[0][k]


def block_pairs(keys: np.ndarray, width: int, radius: int, fp: np.ndarray, most: int, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose keys of ``width`` bits are within ``radius``, 3 at most, but for pairs that connect nothing new in ``root``.

    Of two halves of such keys one differs in at most one bit, so equal halves and
    those with one bit turned are compared. Rows of one key that are too many
    for all pairs are a crowd of near copies, within ``most`` on all bits.
    """
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, int)
    values, sizes = keys[order][first], np.diff(np.append(first, len(keys)))
    yield from equal_pairs(keys, fp, most, root)

    def rows_of(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = root[order]
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        new = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])  # keys whose rows are not all connected yet
        x, y = x[new], y[new]
        for i, k in spread(sizes[x] * sizes[y]):
            yield order[first[x[i]] + k // sizes[y[i]]], order[first[y[i]] + k % sizes[y[i]]]

    for shift, bits in ((0, width // 2), (width // 2, width - width // 2)):
        half = ((values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        by = np.argsort(half, kind="stable")
        count = np.bincount(half, minlength=1 << bits)
        start = np.cumsum(count) - count
        for turned in (0, *(1 << b for b in range(bits))):
            a = np.flatnonzero((half & turned) == 0)
            for i, k in spread(count[half[a] ^ turned]):
                x = a[i]
                y = by[start[half[x] ^ turned] + k]
                ok = (np.bitwise_count(values[x] ^ values[y]) <= radius) & ((x < y) | (turned > 0))
                if ok.any():
                    yield from rows_of(x[ok], y[ok])


def near_pairs(keys: np.ndarray, home: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within ``bits``, one at least at home, from a local vantage-point tree."""
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        inner, outer = stack.pop()
        if len(inner) > LEAF:
            v = keys[inner[0]]
            d, o = distance(keys[inner], v), distance(keys[outer], v)
            r = int(np.median(d))
            r -= int((d <= r).all())
            left, right, edge = inner[d <= r], inner[d > r], inner[(d > r) & (d <= r + bits)]
            if len(left) and max(len(left), len(right)) + len(edge) / 4 < 0.9 * len(inner):
                stack.append((left, np.concatenate([outer[o <= r + bits], edge])))
                stack.append((right, outer[o > r - bits]))
                continue
        everything = np.concatenate([inner, outer])
        step = max(1, 2_000_000 // max(1, len(everything)))
        for i in range(0, len(inner), step):
            rows = inner[i : i + step]
            a, b = np.nonzero(np.bitwise_count(keys[rows][:, None] ^ keys[everything][None, :]) <= bits)
            a, b = rows[a], everything[b]
            yield a[a != b], b[a != b]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """Spanning edges of the graph on 0..n-1; ``root``, 0..n-1 at first, follows the connections."""
    root = np.arange(n) if root is None else root
    edges = [np.zeros((0, 2), np.int64)]
    for a, b in pairs:
        while True:  # known connections drop out at once
            ra, rb = root[a], root[b]
            new = ra != rb
            if not new.any():
                break
            a, b = a[new], b[new]
            hi, lo = np.maximum(ra, rb)[new], np.minimum(ra, rb)[new]
            _, first = np.unique(hi, return_index=True)  # one smaller root for each root
            root[hi[first]] = lo[first]
            edges.append(np.stack([a[first], b[first]], 1))
            while (root[root] != root).any():
                root[:] = root[root]
    return np.concatenate(edges)


def within_most(pairs: Iterator[tuple[np.ndarray, np.ndarray]], fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within ``most`` on all bits."""
    for a, b in pairs:
        for i in range(0, len(a), 500_000):
            x, y = a[i : i + 500_000], b[i : i + 500_000]
            ok = np.bitwise_count(fp[x] ^ fp[y]).sum(1, dtype=np.int32) <= most
            yield x[ok], y[ok]


def linked(classes: DataFrame, n: int, blocks: int, width: int, radius: int, most: int) -> DataFrame:
    """(a, b): spanning links between nodes of ``classes`` (fp, node; fps distinct).

    A pair links if one of ``blocks`` blocks of ``width`` bits is within
    ``radius`` and the whole fingerprints are within ``most``.
    """
    if not n:
        return classes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    shards = max(1, -(-n // PER_SHARD), min(16, n // 2000) if blocks == 1 else 1)
    taken = hash_sample(classes, n, min(MOST_SAMPLE, max(SAMPLE, 16 * shards)), "fp").select("fp").collect()
    sample = as_words(pa.array([bytes(r[0]) for r in taken], pa.binary()))
    trees = [vantage_tree(block(sample, k, width), max(16, len(sample) // shards)) for k in range(blocks)]
    # Shards that no tree can split, by the rows to expect from the sample: each is cut in pieces that meet in pairs.
    pieces: dict[tuple[int, int], int] = {}
    for k in range(blocks):
        for rows, shard, home in route(block(sample, k, width), trees[k], radius):
            pieces[k, shard] = max(1, -(-int(home.sum()) * n // (max(1, len(sample)) * 2 * PER_SHARD)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = as_words(batch.column(0))
            for k in range(blocks):
                for rows, shard, home in route(block(fp, k, width), trees[k], radius):
                    for cell, own, at in cells(rows, home, fp[rows, 0], pieces.get((k, shard), 1)):
                        taken = pa.array(at)
                        parts = [pa.array(np.full(len(at), x, np.int32)) for x in (k, shard, cell)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *parts, pa.array(own)], ["fp", "node", "block", "shard", "cell", "home"])

    def within(table: pa.Table) -> pa.Table:
        fp, node = as_words(table["fp"]), table["node"].to_numpy()
        keys = block(fp, int(table["block"][0].as_py()), width)

        root = np.arange(len(fp))
        pairs = block_pairs(keys, width, radius, fp, most, root) if blocks > 1 else near_pairs(keys, table["home"].to_numpy(), radius)
        edges = forest(len(fp), within_most(pairs, fp, most), root)
        return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    return (
        classes.select("fp", "node").mapInArrow(deal, "fp binary, node long, block int, shard int, cell int, home boolean")
        .groupBy("block", "shard", "cell").applyInArrow(within, "a long, b long")
    )


def shard_links(classes: DataFrame, n: int, most: int) -> DataFrame:
    """(a, b): spanning links between nodes of ``classes`` (fp, node, keys; fps distinct, stored) that share a key and are within ``most``."""

    def within(table: pa.Table) -> pa.Table:
        fp, node, keys = as_words(table["fp"]), table["node"].to_numpy(), table["key"].to_numpy()
        root = np.arange(len(fp))
        edges = forest(len(fp), within_most(equal_pairs(keys, fp, most, root), fp, most), root)
        return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    dealt = classes.select("fp", "node", F.explode("keys").alias("key"))
    # At most n * SHARDS / GROUP keys.
    large = materialize(dealt.groupBy("key").count().where(F.col("count") > GROUP).select("key"), "large-shards")
    some = not large.isEmpty()
    rows = dealt.join(F.broadcast(large), "key", "left_anti") if some else dealt
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(64, n * SHARDS // SHARD_ROWS))))
    links = rows.groupBy("bucket").applyInArrow(within, "a long, b long")
    if not some:
        return links
    crowded = dealt.join(F.broadcast(large), "key", "left_semi").select("fp", "node").distinct()
    crowded = materialize(crowded, "crowded")
    return links.union(linked(crowded, crowded.count(), 64 * WORDS // BLOCK_BITS, BLOCK_BITS, BLOCK_RADIUS, most))


def named_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` (node, first) with component_id: the least ``first`` of the component, which is found (node, component) or the node alone."""
    named = materialize(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    return split_join(named, materialize(least, "least"), ["component"], "n_nodes").drop("n_nodes")


def near_fingerprints(docs: DataFrame, shingle: int = 5, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 64-bit fingerprints linked within ``bits``."""
    rows = materialize(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    node = F.conv(F.hex("fp"), 16, -10).cast("long")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", node), "classes")
    found = components(linked(classes, classes.count(), 1, 64, bits, bits))
    named = named_components(classes, found).select("fp", "n", "component_id")
    rows = split_join(rows, materialize(named, "named"), ["fp"], "n")
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def prefix_sizes(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Two sets in one order that are similar enough share an item among so many first ones."""
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def alike(common: np.ndarray | int, sizes: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    """Whether sets of ``sizes`` items together, ``common`` of them shared, are similar enough."""
    return common * (1 + similarity) >= similarity * sizes - 1e-9


def exact_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the graph of all sets with a Jaccard similarity of at least ``similarity``."""
    sizes = np.array([len(x) for x in sets])
    _, items, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare items first
    ranked = [np.sort(x) for x in np.split(rank[items], np.cumsum(sizes)[:-1])]
    take = prefix_sizes(sizes, similarity)
    owner = np.repeat(np.arange(len(sets)), np.minimum(take, sizes))
    heads = np.concatenate([r[:n] for r, n in zip(ranked, take)])
    order = np.lexsort((owner, heads))
    heads, owner = heads[order], owner[order]
    starts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if len(heads) else np.zeros(0, int)
    root, here, failed, edges = np.arange(len(sets)), np.zeros(len(counts), bool), set(), []
    for lo, hi in zip(starts, np.r_[starts[1:], len(heads)]):
        group = owner[lo:hi]
        for at in range(len(group) - 1):
            i = int(group[at])
            others = group[at + 1 :]
            n = sizes[others]
            others = others[(root[others] != root[i]) & (np.minimum(n, sizes[i]) >= similarity * np.maximum(n, sizes[i]) - 1e-9)]
            if not len(others):
                continue
            here[ranked[i]] = True
            for j in others.tolist():
                if root[j] == root[i] or (i, j) in failed:
                    continue
                if alike(int(here[ranked[j]].sum()), int(sizes[i] + sizes[j]), similarity):
                    edges.append((i, j))
                    root[root == root[j]] = root[i]
                else:
                    failed.add((i, j))
            here[ranked[i]] = False
    return edges


def exact_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): spanning links of the similar sets in each group of ``members`` (g, node, items; stored)."""
    reach = 1 - similarity

    def compare(table: pa.Table) -> pa.Table:
        g, node = table["g"].to_numpy(), table["node"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table["items"].to_pylist()]
        a, b = [], []
        order = np.lexsort((node, g))
        for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            rows = rows[np.r_[True, np.diff(node[rows]) != 0]]
            for i, j in exact_forest([sets[r] for r in rows], similarity):
                a.append(node[rows[i]])
                b.append(node[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                d.append(1 - common / max(1, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d, pa.float64())], ["g", "node", "items", "pivot", "d"])

    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    sizes = materialize(sizes, "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    small = members.join(sizes.where(F.col("n") <= GROUP).select("g"), "g")
    bucket = F.pmod(F.xxhash64("g"), F.lit(max(64, total // GROUP)))
    links = small.select("g", "node", "items", bucket.alias("bucket")).groupBy("bucket").applyInArrow(compare, "a long, b long")
    large = sizes.where(F.col("n") > GROUP)
    if large.isEmpty():
        return links
    # There are at most rows / GROUP large groups, so their pivots are broadcast.
    pivots = members.join(F.broadcast(large), (members["g"] == large["g"]) & (members["node"] == large["pivot"]), "left_semi").dropDuplicates(["g"])
    pivots = pivots.select(F.col("g").alias("pg"), F.col("node").alias("pivot"), F.col("items").alias("p_items"))
    rows = members.join(F.broadcast(pivots), F.col("g") == F.col("pg")).select("g", "node", "items", "pivot", "p_items")
    rows = materialize(rows.mapInArrow(measure, "g long, node long, items binary, pivot long, d double"), "measured")
    near = F.col("d") <= reach + 1e-9
    star = rows.where(near & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    # A linked set can only meet one that is at most ``reach`` farther from the pivot.
    nearest = rows.where(~near).groupBy("g").agg(F.min("d").alias("nearest"), F.count(F.lit(1)).alias("far"))
    left = rows.join(F.broadcast(nearest), "g").where(~near | (F.col("d") >= F.col("nearest") - reach - 1e-9))
    left = materialize(left.select("g", "node", "items"), "left")
    pieces = left.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    cells = left.join(F.broadcast(pieces), "g").withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cells = cells.select("g", "node", "items", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"))
    return links.union(star).union(cells.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long"))


def set_prints(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, node (hash of the set of shingles), fp and keys (of the set), items (the set, of short ones only)."""
    import xxhash

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            fps = fingerprint_sets(sets, WORDS).astype(">u8")
            node = np.array([xxhash.xxh3_64_intdigest(x.astype("<u8").tobytes()) for x in sets], np.uint64).view(np.int64)
            items = pa.array([x.astype("<u8").tobytes() if 0 < len(x) <= SHORT else None for x in sets], pa.binary())
            keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SHARDS, shard_keys(sets).view(np.int64).ravel())
            columns = [batch.column(0), batch.column(1), pa.array(node), pa.array([r.tobytes() for r in fps], pa.binary()), keys, items]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "fp", "keys", "items"])

    rows = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(task, "doc_id long, th long, node long, fp binary, keys array<long>, items binary")


def short_members(classes: DataFrame, similarity: float) -> DataFrame:
    """(g, node, items): short sets under the items of their prefixes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()]
            take = prefix_sizes(np.array([len(x) for x in sets], np.int64), similarity)
            at = pa.array(np.repeat(np.arange(len(sets)), take))
            g = np.concatenate([x[:n] for x, n in zip(sets, take)] or [np.zeros(0, "<u8")]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), batch.column(0).take(at), batch.column(1).take(at)], ["g", "node", "items"])

    return classes.where("items IS NOT NULL").select("node", "items").mapInArrow(task, "g long, node long, items binary")


def candidate_members(docs: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(g, node, items): the sets of all nodes in ``groups`` (node, component)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2):
            items = [shingle_set(t, shingle).astype("<u8").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.binary())], ["g", "node", "items"])

    named = classes.join(groups, "node").select(F.col("component").alias("g"), "node", F.col("pick.doc_id").alias("p_id"), F.col("pick.th").alias("p_th"))
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_key(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    rows = texts.join(named, texts["doc_id"].eqNullSafe(named["p_id"]) & (texts["th"] == named["p_th"]))
    return rows.select("g", "node", "text").dropDuplicates(["node"]).mapInArrow(task, "g long, node long, items binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, component (a number that tells all components apart), component_id: texts linked by similar sets of shingles (see above)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of bits that differ
    bits = 64 * WORDS
    most = math.ceil(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    rows = materialize(set_prints(docs, shingle, similarity, id_col, text_col), "fingerprints")
    classes = rows.groupBy("node").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("pick"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("items").alias("items")
    )
    classes = materialize(classes, "classes")
    # Equal fingerprints of different sets are candidates by themselves.
    prints = materialize(classes.groupBy("fp").agg(F.min(F.struct("node", "keys")).alias("lead")).select("fp", "lead.*"), "prints")
    same = classes.join(prints.select("fp", F.col("node").alias("lead")), "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    found = shard_links(prints, prints.count(), most)
    groups = components(found.union(same))
    members = materialize(candidate_members(docs, classes, groups, shingle, id_col, text_col), "members")
    short = materialize(short_members(classes, similarity), "short")
    exact = components(exact_links(members, similarity).union(exact_links(short, similarity)))
    named = materialize(named_components(classes.select("node", "first", "n"), exact).select("node", "n", "component", "component_id"), "named")
    return split_join(rows.select("doc_id", "th", "node"), named, ["node"], "n").select("doc_id", "th", "component", "component_id")
