"""Media columns: interleaved documents of text and media references.

``parse_html`` turns HTML into an ordered sequence of structs (position, kind,
text, digest, caption): text runs and media references keep their order, and a
figure's caption stays with its reference. ``store_media`` writes payloads as
8-bit gray PNG images of WIDTH samples a row in a content-addressed table, and
``resolve`` joins references to stored media by digest, so each sequence row
gets its payload's facts at its position. Payload bytes never move in a shuffle:
features are computed where a stored payload is read.

Cases: null html or text counts as empty; references without a stored payload
keep null facts; null ids are kept; very long texts pass a few at a time; equal payloads are kept once per file and resolve to the same
facts; tags that are never closed and unknown entities are kept as text by the
parser's rules; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, portions, split_join

WIDTH = 576
SEQUENCE = "array<struct<position int, kind string, text string, digest string, caption string>>"
FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PNG = b"\x89PNG\r\n\x1a\n"


class _Parser(HTMLParser):
    """Text runs and <img>/<video>/<audio>/<source> references in order."""

    BLOCKS = frozenset("p div br li td th tr h1 h2 h3 h4 h5 h6 figure figcaption section article".split())
    MEDIA = frozenset("img video audio source".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.in_caption = False
        self.figure: list[dict] | None = None
        self.caption: list[str] = []

    def _flush(self) -> None:
        text = "".join(self.text)
        self.text.clear()
        if text.strip():
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.BLOCKS:
            self._flush()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.in_caption, self.caption = True, []
        if tag in self.MEDIA:
            self._flush()
            a = dict(attrs)
            src = a.get("src") or ""
            item = {"position": len(self.items), "kind": "media", "text": None, "digest": src.removeprefix("digest:"), "caption": a.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.in_caption:
            self.in_caption = False
            for item in self.figure or []:
                item["caption"] = "".join(self.caption)
        if tag == "figure":
            self.figure = None
        if tag in self.BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.in_caption:
            self.caption.append(data)
        elif not self.skip:
            self.text.append(data)


def parse_html(html: str | None) -> list[dict]:
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.items


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """doc_id, items: the interleaved sequence of each page."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in portions(batches, 1):
            items = [parse_html(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, kind)], ["doc_id", "items"])

    return pages.select(pages[id_col].cast("long").alias("doc_id"), pages[html_col].alias("html")).mapInArrow(task, f"doc_id long, items {SEQUENCE}")


def references(sequence: DataFrame) -> DataFrame:
    """doc_id, position, digest, caption of every media reference."""
    item = F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i")
    return sequence.select("doc_id", item).select("doc_id", "i.position", "i.digest", "i.caption")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Lossless 8-bit gray PNG, WIDTH samples a row; the payload's size is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that to_png() wrote, as rows."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, packed, width, height = 8, [], 0, 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only filter type 0 is written")
    return raw[:, 1:]


def feature(samples: np.ndarray) -> str:
    """64-bit average hash over an 8 x 8 grid of cell means, and the mean sample."""
    flat = samples.reshape(-1)
    cells = np.add.reduceat(flat.astype(np.int64), np.arange(64) * len(flat) // 64) / np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat)))
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"ahash:{bits};mean:{flat.mean():.4f}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A stored table (digest, media): texts as padded payloads, as PNG; digest is the payload's SHA-256."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in portions(batches, 0):
            digests, media = [], []
            for text in batch.column(0):
                payload = padded(text.as_py())
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if len(seen) < 1_000_000:  # only saves space; resolve() drops repeats
                        seen.add(digest)
                    digests.append(digest.hex())
                    media.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(task, "digest string, media binary"), "media")


def media_facts(media: DataFrame) -> DataFrame:
    """Read stored media back: facts of each distinct payload."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                samples = from_png(data)
                payload = samples.tobytes()
                rows.append({
                    "digest": digest, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(samples),
                })
            schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in FACTS.split(", "))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return media.mapInArrow(task, FACTS).dropDuplicates(["digest"])


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References (digest and other columns) with the facts of their stored payload."""
    refs = materialize(refs, "references")
    counts = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("__refs"))
    facts = materialize(media_facts(media).join(counts, "digest"), "media-facts")
    return split_join(refs, facts, ["digest"], "__refs", "left").drop("__refs")


def interleaved_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, html, n_bytes: each document as a page of its text and a figure that refers to its payload."""
    text = F.coalesce(docs[text_col], F.lit(""))
    raw = text.cast("binary")
    n = F.octet_length(raw)
    size = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int") * WIDTH
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("ff"), size - n))), 256)
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    figure = F.concat(F.lit('<figure><img src="digest:'), digest, F.lit('"><figcaption>'), n.cast("string"), F.lit(" bytes</figcaption></figure>"))
    return docs.select(docs[id_col].alias("doc_id"), n.cast("long").alias("n_bytes"), F.concat(F.lit("<p>"), escaped, F.lit("</p>"), figure).alias("html"))
