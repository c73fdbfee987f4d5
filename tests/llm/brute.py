"""Plain versions of the operators over lists of (doc_id, text), for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def raw(text):
    return (text or "").encode()


def suffix_dedup(docs, length=200):
    seen = Counter()
    for _, text in docs:
        data = raw(text)
        seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for doc_id, text in docs:
        data = raw(text)
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text)))
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_fingerprints(docs, bits=2, k=3):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    fps = [simhash(t, k) for _, t in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    return [(d[0], f"{f:016x}", docs[g][0]) for d, f, g in zip(docs, fps, groups(len(docs), links))]


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for item_id, text in items:
        w = item_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item_id)
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w = item_words(text)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[t]
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def token_ids(texts, tokenizer, end_id):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return [[*e.ids, end_id] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def media(docs, width=576):
    out = []
    for doc_id, text in docs:
        data = raw(text)
        payload = data + b"\xff" * (max(1, -(-len(data) // width)) * width - len(data))
        out.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    return out


def average_hash(text, width=576):
    data = raw(text)
    data += b"\xff" * (max(1, -(-len(data) // width)) * width - len(data))
    cuts = [i * len(data) // 64 for i in range(65)]
    means = [sum(data[i:j]) / (j - i) for i, j in zip(cuts, cuts[1:])]
    bits = "".join("1" if m > sum(means) / 64 else "0" for m in means)
    return f"ahash:{int(bits, 2):016x};mean:{sum(data) / len(data):.4f}"


def url_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]
