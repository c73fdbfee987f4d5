"""Toxicity: a subsequence string-kernel SVM with Nystrom landmarks, trained on labelled sentences.

The kernel compares two words by their common subsequences of three characters,
each discounted by the width it spans (decay ** width, at most SPAN wide), so
gapped and inserted characters cost little. A sentence is a bag of words, and two
sentences are as alike as their most alike words; words split by single spaces
into letters are joined first.

Training, on labelled documents (a bounded sample): every sentence of a clean
document is labelled 0. A toxic document's sentences have no labels of their own:
those are labelled 1 that hold a word which scores as toxic so far, its best one
at least, and the others stay out. Landmark words are chosen from the labelled
sentences, words map into the landmarks' Nystrom space, and a linear SVM is
trained on the best words of sentences labelled 1 against words of sentences
labelled 0; then the sentences are labelled anew, for a few rounds. The model of
a word is linear in its subsequence counts, so scoring needs a table lookup per
subsequence and no kernel evaluations. A sentence scores as its best word and a
document as its best sentence, through a logistic function fitted on the training
documents.

Cases: null and empty texts and texts without letters get the score of a bag
without words (clean), labelled or not, and teach nothing; labels of unknown
documents, null labels and null ids are ignored; an id with several labels is
toxic if one says so, and of several texts with one labelled id the one with the
least hash is used; with only one class in the sample all scores are that
class's; very long texts count whole; an empty table gives no rows; repeated rows
get a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, keyed, materialize, portions

DECAY, SPAN = 0.7, 5
#: Table of hashed subsequences, as a power of two.
TABLE = 1 << 18
LANDMARKS, ROUNDS = 256, 4
#: Most labelled documents used for training (all, if there are fewer).
SAMPLE = 4000
LONGEST = 40
#: The score of a text without words.
NOTHING = -3.0
#: A word: letters, with single marks inside that do not separate words.
WORD = re.compile(r"[^\W\d_](?:[^\w\s]?[^\W\d_])*")
LETTERS = re.compile(r"[^\W\d_]+")
#: From the first to the last letter of a token.
CORE = re.compile(r"[^\W\d_].*[^\W\d_]", re.S)
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
#: Characters besides letters that training inserts in words.
INSERTED = "0123456789_.-*'"
#: Where a sentence ends.
ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased pieces between white space, and words spelled with single spaces, joined."""
    text = (text or "").lower()
    return {*text.split(), *(m.replace(" ", "") for m in SPACED.findall(text))}


def parts(token: str) -> list[str]:
    """The words of a token: letters, with and without what is among them; long ones in overlapping parts.

    Besides its words, the letters joined over all digits, underscores and marks
    are one, and so is the token from its first to its last letter as it stands.
    """
    if token.isalpha():
        found = {token}
    else:
        runs = LETTERS.findall(token)
        found = {"".join(LETTERS.findall(w)) for w in WORD.findall(token)} | {*runs, "".join(runs), *CORE.findall(token)}
    for w in [w for w in found if len(w) > LONGEST]:
        found.discard(w)
        found.update(w[i : i + LONGEST] for i in range(0, len(w), LONGEST // 2))
    return [w for w in found if len(w) > 1]


def words(text: str | None) -> list[str]:
    return sorted({w for token in tokens(text) for w in parts(token)})


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence that has some."""
    return [ws for ws in map(words, ENDS.split(text or "")) if ws]


def subsequences(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, table slot, weight) of every subsequence of three characters, words padded by one blank on each side."""
    if not ws:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    lengths = np.array([len(w) + 2 for w in ws])
    codes = np.frombuffer("".join(f" {w} " for w in ws).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(ws)), lengths)
    at, slots, weights = [], [], []
    for i, j in OFFSETS:
        if len(codes) <= j:
            continue
        same = np.flatnonzero(owner[:-j] == owner[j:])
        h = (codes[same] * np.uint64(0x9E3779B1) + codes[same + i]) * np.uint64(0x85EBCA77) + codes[same + j]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        at.append(owner[same])
        slots.append((h >> np.uint64(40)).astype(np.int64) & (TABLE - 1))
        weights.append(np.full(len(same), DECAY ** (j + 1)))
    if not at:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(at), np.concatenate(slots), np.concatenate(weights)


def norms(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """A word's size: the root of its squared subsequence weights, so it depends on the length only."""
    return np.sqrt(np.maximum(np.bincount(at, weights**2, n), 1e-12))


def dense(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalized subsequence weights over the table slots in use, and those slots."""
    at, slots, weights = subsequences(ws)
    used, columns = np.unique(slots, return_inverse=True)
    m = np.zeros((len(ws), len(used)))
    np.add.at(m, (at, columns), weights)
    return m / norms(at, weights, len(ws))[:, None], used


def trigrams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of the subsequences without gaps."""
    at, slots, weights = subsequences(ws)
    tight = weights > DECAY**3.5
    return at[tight], slots[tight]


def typical(ws: list[str], odds: np.ndarray) -> np.ndarray:
    """Mean log odds of each word's trigrams."""
    at, slots = trigrams(ws)
    n = np.bincount(at, minlength=len(ws))
    return np.where(n > 2, np.bincount(at, odds[slots], len(ws)) / np.maximum(n, 1), -1.0)


def noisy(word: str, rng: np.random.Generator, characters: str = "abcdefghijklmnopqrstuvwxyz", most: int = 1) -> str:
    """The word with one inserted character, or up to ``most`` of them in one place."""
    i = int(rng.integers(1, len(word)))
    c = characters[int(rng.integers(len(characters)))]
    return word[:i] + c * int(rng.integers(1, most + 1)) + word[i:]


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros(TABLE, np.float32))
    bias: float = -1.0
    slope: float = 1.0
    center: float = 0.0

    def word_scores(self, ws: list[str]) -> np.ndarray:
        at, slots, weights = subsequences(ws)
        n = len(ws)
        return np.bincount(at, weights * self.table[slots], n) / norms(at, weights, n) + self.bias

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (best - self.center), -50, 50)))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by Newton-like steps on the active set; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    reg = np.eye(z.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(20):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        new = np.linalg.solve(reg + (za * ca[:, None]).T @ za, za.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], w[-1]


def train(texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
    """Fit on labelled documents in memory (the caller bounds their number)."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return Model(bias=1.0 if len(y) and y[0] == 1 else -1.0, slope=5.0)
    split = [sentences(t) for t in texts]
    bags = [sorted(set().union(*x)) for x in split]
    bad_bags = [b for b, t in zip(bags, toxic) if t and b]
    bad_sentences = [x for x, t in zip(split, toxic) if t and x]  # by document
    clean_words = sorted({w for b, t in zip(bags, toxic) if not t for w in b})
    if not bad_bags or not clean_words:
        return Model(bias=-1.0, slope=5.0)
    # First labels: by the word whose trigrams are most typical of toxic documents.
    counts = np.zeros((2, TABLE))
    for b, t in zip(bags, toxic):
        counts[t, np.unique(trigrams(b)[1])] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5 * n0 / n1) / (n0 + 1))
    odds = np.clip(odds, -1, 4) * np.minimum(1, counts[1] / 4)
    in_bad, in_clean = Counter(w for b in bad_bags for w in b), Counter(w for b, t in zip(bags, toxic) if not t for w in b)
    # All words of a sentence labelled 0 are clean: a toxic word is rare there, for its share of toxic documents.
    able = {w for w, c in in_bad.items() if c * n0 > 8 * in_clean[w] * n1 and len(w) > 2}
    first = dict(zip(ws := sorted(able), typical(ws, odds))) if able else {}
    best = [max((w for w in s if w in able), key=lambda w: (first[w], w), default=None) for x in bad_sentences for s in x]
    witness = [[w] for w in best if w is not None and first[w] > 0.3]  # of sentences labelled 1
    clean = [clean_words[i] for i in rng.permutation(len(clean_words))[:8000]]
    hard = [clean_words[i] for i in np.argsort(-typical(clean_words, odds), kind="stable")[:1500]]
    able_words = sorted(able)
    if not witness:
        return Model(bias=-1.0, slope=5.0)
    # Landmarks: words typical of toxic sentences, the most common words, words typical in clean sentences.
    seen = Counter(w for b in bags for w in b)
    chosen = Counter(w for b in witness for w in b)
    landmarks = list(dict.fromkeys(
        [w for w, _ in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))][: LANDMARKS // 2]
        + [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))][: LANDMARKS // 4] + hard[: LANDMARKS // 8] + clean[: LANDMARKS // 8]
    ))
    phi, used = dense(landmarks)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])

    def embed(ws: list[str]) -> np.ndarray:
        """Kernel values with the landmarks, in Nystrom coordinates."""
        out = np.zeros((len(ws), len(landmarks)), np.float32)
        lookup = np.zeros((TABLE, 1), np.int32)
        lookup[used, 0] = np.arange(1, len(used) + 1)
        columns = np.vstack([np.zeros(len(landmarks), np.float32), phi.T.astype(np.float32)])
        for i in range(0, len(ws), 200):
            part = ws[i : i + 200]
            at, slots, weights = subsequences(part)
            m = np.zeros((len(part), len(used) + 1), np.float32)
            np.add.at(m, (at, lookup[slots, 0]), weights)
            out[i : i + 200] = (m @ columns) / norms(at, weights, len(part))[:, None]
        return out @ whiten

    x0 = embed(clean)
    model = Model()
    for _ in range(ROUNDS):
        positives = [w for b in witness for w in b]
        plain = [w for w in positives if len(w) > 4]
        positives += [noisy(w, rng) for w in plain if rng.random() < 0.5] + [noisy(w, rng, INSERTED, 2) for w in plain if rng.random() < 0.25]
        x1, xh = embed(positives), embed(hard)
        x = np.concatenate([x1, x0, xh])
        labels = np.concatenate([np.ones(len(x1)), -np.ones(len(x0) + len(xh))])
        cost = np.where(labels > 0, 2000 / len(x1), 3000 / (len(x0) + len(xh)))
        w, bias = svm(x, labels, cost)
        model = Model(bias=float(bias))
        model.table[used] = phi.T @ (whiten @ w)
        scores = {w: v for i in range(0, len(able_words), 5000) for w, v in zip(able_words[i : i + 5000], model.word_scores(able_words[i : i + 5000]))}
        witness = []
        for sentence_bags in bad_sentences:
            best = [sorted((v for v in s if v in able), key=lambda v: (-scores[v], v))[:3] for s in sentence_bags]
            labelled = [found for s in best if (found := [v for v in s if scores[v] > 0])]
            top = max((s[0] for s in best if s), key=lambda v: (scores[v], v), default=None)
            witness += labelled or ([[top]] if top is not None and scores[top] > -0.7 else [])
        if not witness:
            break
        s0 = np.concatenate([model.word_scores(clean_words[i : i + 5000]) for i in range(0, len(clean_words), 5000)])
        hard = list(dict.fromkeys(hard + [clean_words[i] for i in np.argsort(-s0, kind="stable")[:1000]]))
    best = np.array([model.word_scores(b).max() if b else NOTHING for b in bags])
    # One threshold on the best word of the best sentence: the fewest balanced errors, then a logistic slope around it.
    order = np.unique(best)
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    wrong = [((best > c) != (y == 1)).sum() for c in cuts]
    model.center = float(np.median(cuts[np.array(wrong) == min(wrong)]))
    model.slope = 6.0
    return model


def training_rows(docs: DataFrame, labels: DataFrame, use: Column | None, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """A bounded sample of labelled documents (d_id, text, y), the same for the same rows: least hashes of ids first."""
    rows = labels.select(labels[id_col].cast("long").alias("l_id"), labels[label_col].cast("int").alias("y")).where("l_id IS NOT NULL AND y IS NOT NULL")
    if use is not None:
        rows = rows.where(use)
    rows = materialize(rows.groupBy("l_id").agg(F.max("y").alias("y")), "labels")
    picked = hash_sample(rows, rows.count(), 2 * sample, "l_id").orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("l_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # At most ``sample`` rows are broadcast, and as many texts are left.
    joined = texts.join(F.broadcast(picked), "l_id").groupBy("l_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t"))
    return joined.select(F.col("l_id").alias("d_id"), F.col("t.text").alias("text"), (F.col("y") > 0).cast("int").alias("y"))


def fit(rows: DataFrame) -> Model:
    """Train in one task on the bounded sample, so that the driver only receives the model."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1] or ""))
        m = train([r[1] for r in found], [r[2] for r in found])
        yield pa.RecordBatch.from_pylist([{"weights": m.table.tobytes(), "bias": float(m.bias), "slope": float(m.slope), "center": float(m.center)}])

    row = rows.repartition(1).mapInArrow(task, "weights binary, bias double, slope double, center double").first()
    if row is None:
        return train([], [])
    return Model(np.frombuffer(bytes(row["weights"]), np.float32), row["bias"], row["slope"], row["center"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, score (0 to 1)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in portions(batches, 2):
            bags = [tokens(t) for t in batch.column(2).to_pylist()]
            if len(known) > 400_000:
                known.clear()
            new = sorted(t for t in set().union(*bags) if t not in known)
            for i in range(0, len(new), 5000):
                split = [parts(t) for t in new[i : i + 5000]]
                flat = [w for ws in split for w in ws]
                top = np.full(len(split), NOTHING)
                np.maximum.at(top, np.repeat(np.arange(len(split)), [len(ws) for ws in split]), model.word_scores(flat) if flat else [])
                known.update(zip(new[i : i + 5000], top.tolist()))
            best = np.array([max(map(known.__getitem__, b), default=NOTHING) for b in bags])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.probability(best))], ["doc_id", "th", "score"])

    rows = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(task, "doc_id long, th long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Train on the labelled documents that ``use`` (a condition on ``l_id``) admits; doc_id, th, score of every document."""
    model = fit(training_rows(docs, labels, use, id_col, text_col, label_col, sample))
    return score_documents(docs, model, id_col, text_col)
