"""Exact tokenization with the tokenizers library and a cache of pre-tokens.

BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in
order. Pre-tokens repeat a lot; each worker has the library's BPE model encode a
new one once, as long as it comes again before many others. Texts are cut at the tokenizer's added tokens first, which stand
for themselves wherever their text occurs, as in the library. Texts with
characters outside a safe alphabet, where Python's and the library's Unicode
tables could disagree or normalization reaches across pre-tokens, are encoded
whole by the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np

BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ByteLevel writes each byte as a printable character: itself, or one from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Anything but printable ASCII, tab, newlines, Latin letters without dotted capital I, dashes and quotes, the euro sign.
UNSAFE = r"[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ‐-‧€]"


class Encoder:
    def __init__(self, path: str, most: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.tokenize = self.tokenizer.model.tokenize
        self.most, self.cache, self.sizes = most, Ids(self), Sizes(self)
        self.unsafe = regex.compile(UNSAFE).search
        self.lower = False
        pattern = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        parts = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            pattern = BYTE_LEVEL
        elif [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
            if kinds == ["NFC", "Replace", "Lowercase"]:
                pattern, self.lower = parts[0]["pattern"]["Regex"], True
        added = spec.get("added_tokens") or []
        self.added = {t["content"]: t["id"] for t in added}
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            pattern = None  # these reach beyond their own text
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        #: How far from a place in a text its pre-tokens can depend on it: "'ll", white space before a word, added tokens.
        self.reach = max(3, *map(len, self.added), 3)
        self.pattern = regex.compile(pattern) if pattern else None

    def holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def chunks(self, text: str) -> list[str] | None:
        """The text cut at white space, where pre-tokens always end too; None if the library must encode it whole."""
        if self.pattern is None or self.unsafe(text):
            return None
        if self.holds_added(text):
            parts = self.cut(text)
            return [c for i, p in enumerate(parts) for c in (["\0" + p] if i % 2 else self._chunks(p))]  # no safe text holds \0
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        if self.lower:
            return text.lower().split()
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\t" in text or "\r" in text:
            return self.pattern.findall(text)  # how a run of white space is cut depends on what follows
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def pieces(self, text: str) -> list[str]:
        """All pre-tokens and added tokens, which joined are the text; for tokenizers that keep it as it is."""
        if self.holds_added(text):
            return [w for i, p in enumerate(self.cut(text)) for w in ([p] if i % 2 else self._pieces(p))]
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if not self.unsafe(text):
            return self.pattern.findall(text)
        return [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces_from(self, text: str, at: int, step: int = 128) -> Iterator[str]:
        """The pieces from ``at`` on, where one begins, without a look at the whole text."""
        while at < len(text):
            window = text[at : at + step]
            exact = len(window) - (self.reach if at + step < len(text) else 0)
            end = 0
            for piece in self.pieces(window):
                if end + len(piece) > exact:
                    break
                end += len(piece)
                yield piece
            at += end
            step = min(step * (2 if end else 4), 1 << 24 if end else len(text))

    def ids(self, chunk: str) -> bytes:
        """The ids of a chunk, from those of its pre-tokens."""
        if chunk[:1] == "\0":
            return pack_ids("<I", self.added[chunk[1:]])
        if not (chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha())):
            words = self.pattern.findall(chunk)
            if len(words) != 1 or words[0] != chunk:
                return b"".join(map(self.cache.__getitem__, words))
        ids = self.model(chunk)
        return pack_ids(f"<{len(ids)}I", *ids)

    def model(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        if word.isascii() and word.isprintable():
            word = word.replace(" ", BYTE_CHARS[32])
        else:
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.tokenize(word)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            chunks = self.chunks(text)
            if chunks is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            data = []
            for i in range(0, len(chunks), 100_000):  # a very long text may hold any number of words
                self.cache.age()
                data.append(b"".join(map(self.cache.__getitem__, chunks[i : i + 100_000] if len(chunks) > 100_000 else chunks)))
            out.append(np.frombuffer(b"".join(data), "<u4"))
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece of pieces()."""
        if len(self.sizes) > self.most:
            self.sizes.clear()
        return list(map(self.sizes.__getitem__, pieces))


class Ids(dict):
    """Ids of chunks, encoded when first asked for. Of two generations the older goes when the newer is full, but for what was asked for again."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encoder.ids(chunk)
        self[chunk] = ids
        return ids

    def age(self) -> None:
        if 2 * len(self) > self.encoder.most:
            self.old = self.copy()
            self.clear()


class Sizes(dict):
    """Tokens of a piece, counted when it is first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        self[piece] = n = 1 if piece in self.encoder.added else len(self.encoder.model(piece))
        return n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer file, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return Encoder(path)
