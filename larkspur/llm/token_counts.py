"""Edit-aware token counts.

``build_trees`` stores, for each document, its pre-tokens' lengths and token
counts; that table is kept, and ``apply_edits`` applies edits that come later to
it and gives the trees after them, which can be stored and edited again. A
loaded tree holds its pre-tokens in blocks with a segment tree of sums over the
blocks. An edit finds its place by descending the tree, re-splits the text from a
little before the edit until a split falls on an old one behind the edit,
re-encodes those pre-tokens only, and updates the sums on the blocks' paths.

Cases: null text counts as empty and null edits as none; an edit's position
and length are clamped to the text, a null position, length or insert counts as
0, 0 and ''; texts of any alphabet and added tokens are edited alike; very long
texts too; tokenizers that change the text before they split it are counted whole
after every edit; an empty table gives no rows; repeated rows and null ids give a
row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions
from .tokens import Encoder, encoder

BLOCK = 64


def split_counts(text: str, enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token; of the whole text, where the tokenizer changes texts before it splits them."""
    if enc.pattern is None or enc.lower:
        found = [(len(text), len(enc.tokenizer.encode(text, add_special_tokens=False).ids))] if text else []
        return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    pieces = enc.pieces(text)
    return np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(enc.counts(pieces), np.int64)


def dump(chars: np.ndarray, tokens: np.ndarray) -> bytes:
    """Both in the narrowest of 1, 2 or 4 bytes, which the first byte tells."""
    most = int(max(chars.max(initial=0), tokens.max(initial=0)))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([size]) + chars.astype(f"<u{size}").tobytes() + tokens.astype(f"<u{size}").tobytes()


def load(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)
    return flat[: len(flat) // 2], flat[len(flat) // 2 :]


def sum_tree(leaves: np.ndarray) -> list[int]:
    """Sums of a binary tree over a power of two of leaves; node n has the children 2 n and 2 n + 1."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    return [0, *(x for level in reversed(levels) for x in level.tolist())]


class CountTree:
    """Pre-token lengths and counts of one text, with sums over blocks in a segment tree."""

    def __init__(self, text: str, enc: Encoder, counts: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.enc = text, enc
        self.encoded = 0
        self.whole = enc.pattern is None or enc.lower
        self._build(*(split_counts(text, enc) if counts is None else counts))

    def _build(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        self._stored = lengths, counts
        self.blocks: list[list[tuple[int, int]] | None] = [None] * max(1, -(-len(lengths) // BLOCK))  # None: as stored
        self.n_words = len(lengths)
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = (sum_tree(np.pad(x, (0, self.leaves * BLOCK - len(x))).reshape(-1, BLOCK).sum(1)) for x in self._stored)

    def _words(self, block: int) -> list[tuple[int, int]]:
        if self.blocks[block] is None:
            self.blocks[block] = list(zip(*(x[block * BLOCK : (block + 1) * BLOCK].tolist() for x in self._stored)))
        return self.blocks[block]

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and counts of all pre-tokens."""
        out = []
        for k, x in enumerate(self._stored):
            parts = [x[i * BLOCK : (i + 1) * BLOCK] if b is None else np.array([w[k] for w in b], np.int64) for i, b in enumerate(self.blocks)]
            out.append(np.concatenate(parts))
        return out[0], out[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _block_at(self, position: int) -> tuple[int, int]:
        """The block that holds a character position, and the block's first position."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if position >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.leaves, before

    def _set(self, block: int, words: list[tuple[int, int]]) -> None:
        self.n_words += len(words) - len(self._words(block))
        self.blocks[block] = words
        node = self.leaves + block
        self.chars[node], self.tokens[node] = sum(x[0] for x in words), sum(x[1] for x in words)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, position: int, delete: int, insert: str) -> None:
        position = min(max(0, position), len(self.text))
        delete = min(max(0, delete), len(self.text) - position)
        old_end, grown = position + delete, len(insert) - delete
        self.text = self.text[:position] + insert + self.text[old_end:]
        if self.whole:
            self._build(*split_counts(self.text, self.enc))
            self.encoded += self.n_words
            return
        # Start at the first pre-token that could depend on the edit.
        reach = self.enc.reach
        first, start = self._block_at(max(0, position - reach - 1))
        i = 0
        words = self._words(first)
        while i < len(words) and start + words[i][0] + reach <= position:
            start += words[i][0]
            i += 1
        kept, last, old, j = words[:i], first, start, i
        new: list[str] = []
        at = start
        for piece in self.enc.pieces_from(self.text, at):
            new.append(piece)
            at += len(piece)
            while old + grown < at or old < old_end:  # the old split at or behind this one
                while j >= len(self._words(last)) and last + 1 < len(self.blocks):
                    last, j = last + 1, 0
                if j >= len(self._words(last)):
                    break
                old += self._words(last)[j][0]
                j += 1
            if old >= old_end and old + grown == at:
                break
        else:
            last, j = len(self.blocks) - 1, len(self._words(len(self.blocks) - 1))
        self.encoded += len(new)
        words = kept + list(zip(map(len, new), self.enc.counts(new)))
        if last == first:
            self._set(first, words + self._words(first)[j:])
        else:
            tail = self._words(last)[j:]
            self._set(first, words)
            for b in range(first + 1, last):
                self._set(b, [])
            self._set(last, tail)
        if len(self._words(first)) > 8 * BLOCK:  # rebalance; counts are kept, nothing is encoded
            self._build(*self.flat())


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty), n_tokens, n_pretokens, tree: to be stored, and edited later."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in portions(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [split_counts(t, enc) for t in texts]
            sizes = [pa.array([int(n.sum()) for _, n in counts], pa.int64()), pa.array([len(n) for _, n in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *sizes, pa.array([dump(*c) for c in counts], pa.binary())], ["doc_id", "text", "n_tokens", "n_pretokens", "tree"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(task, "doc_id long, text string, n_tokens long, n_pretokens long, tree binary")


def apply_edits(trees: DataFrame, tokenizer: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_reencoded, n_tokens_edited, n_pretokens_edited, n_chars_edited; with ``keep`` also text and tree after the edits.

    ``trees``: a table of build_trees() with ``edits``, an array<struct<position
    int, delete int, insert string>> over characters (code points), applied in
    order. n_reencoded: the pre-tokens encoded again by all edits of the document.
    """
    fields = ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_reencoded", "n_tokens_edited", "n_pretokens_edited", "n_chars_edited"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in portions(batches, 1):
            rows, after = [], []
            for doc_id, text, n, words, data, script in zip(*(c.to_pylist() for c in batch.columns)):
                tree = CountTree(text, enc, load(data))
                for e in script or []:
                    if e is not None:
                        tree.edit(e["position"] or 0, e["delete"] or 0, e["insert"] or "")
                rows.append((doc_id, n, words, len(script or []), tree.encoded, tree.total, tree.n_words, len(tree.text)))
                after.append((tree.text, dump(*tree.flat())) if keep else None)
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            if keep:
                columns += [pa.array([a[0] for a in after], pa.string()), pa.array([a[1] for a in after], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, fields + ["text", "tree"] * keep)

    rows = trees.select("doc_id", "text", "n_tokens", "n_pretokens", "tree", "edits")
    return rows.mapInArrow(task, ", ".join(f"{f} long" for f in fields) + ", text string, tree binary" * keep)


def edited_trees(edited: DataFrame) -> DataFrame:
    """The trees after apply_edits(), in the form that build_trees() gives them."""
    return edited.select("doc_id", "text", F.col("n_tokens_edited").alias("n_tokens"), F.col("n_pretokens_edited").alias("n_pretokens"), "tree")


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` or trees with an ``edits`` array from a table (id, seq, position, delete, insert), in seq order."""
    script = F.array_sort(F.collect_list(F.struct("seq", "position", "delete", "insert")))
    lists = edits.groupBy(F.col(id_col).alias("__edit_id")).agg(
        F.transform(script, lambda e: F.struct(e["position"].alias("position"), e["delete"].alias("delete"), e["insert"].alias("insert"))).alias("edits")
    )
    docs = docs.drop("edits")
    return docs.join(lists, docs[id_col].eqNullSafe(lists["__edit_id"]), "left").drop("__edit_id")
