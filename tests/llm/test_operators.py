"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names, against brute force."""

import hashlib
import random

import pytest

from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def table():
    passage, item = prose(70), prose(30)
    long = prose(6000)
    docs = [(i, prose(RNG.randint(1, 150))) for i in range(40)]
    docs += [(50 + i, f"{prose(20)} {passage} {prose(30)}") for i in range(4)]
    docs += [(60, long), (61, long), (62, long.replace(" ", "  ", 3)), (63, None), (64, ""), (65, "  \t\n"), (66, "ÉÀ İ. ＡＢ 中文 " * 40), (67, "a" * 900)]
    docs += [(70, f"{prose(9)} {item} {prose(9)}"), (71, " ".join(item.split()[:14])), (72, f"{prose(400)} {item}"), (73, "Solo")]
    docs += [(80, docs[3][1]), (80, docs[3][1]), (81, docs[3][1] + " x")]
    docs += [(90, "hello <|endoftext|> world  <|endoftext|><|startoftext|>end <|ENDOFTEXT|> <|endof"), (91, f"中文 <|endoftext|>é {item}\n<|startoftext|>")]
    docs += [(None, prose(30)), (None, prose(40)), (None, docs[3][1]), (None, None)]
    return docs, [(0, item), (1, "solo"), (2, None), (3, "... !!"), (None, item), (4, prose(20))]


DOCS, ITEMS = table()


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves
    rows = [(d, t, "x", i, 7) for i, (d, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, th string, fp int, shard int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_suffix_dedup(docs, none):
    from larkspur.llm.suffix_dedup import deduplicated, remove_repeats

    assert rows(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(DOCS), key=repr)
    assert deduplicated(docs).columns == docs.columns and deduplicated(docs).count() == len(DOCS)
    assert remove_repeats(none).count() == 0


def test_suffix_buckets(docs, monkeypatch):
    """Many range partitions: strings meet across boundaries."""
    from larkspur.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 3)
    assert rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(DOCS), key=repr)


@pytest.mark.parametrize("level", [2, 5])
def test_suffix_levels(docs, monkeypatch, level):
    """Splitters of a second level, found in tasks."""
    from larkspur.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "LEVEL", level)
    assert rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(DOCS), key=repr)


def test_multikey_quicksort():
    import numpy as np

    from larkspur.llm.suffix_dedup import multikey_quicksort, padded_words

    rng = random.Random(4)
    for n, letters in ((0, b"ab"), (1, b"ab"), (2, b"a"), (700, b"ab"), (3000, bytes(range(256)))):
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 3, 8, 9, 40]))) for _ in range(n)]
        strings += [s + b"\0" for s in strings[:50]]
        keys = padded_words(strings, 48) if strings else np.zeros((0, 7), ">u8")
        assert [strings[i] for i in multikey_quicksort(keys)] == sorted(strings)


def test_split_join(spark):
    """Frequent keys meet in pieces; every row stays, with and without a partner."""
    from larkspur.llm.common import split_join

    left = spark.createDataFrame([(i, i % 7 if i % 2 else 0) for i in range(600)] + [(900, None), (901, 99)], "x int, k int")
    table = left.where("k IS NOT NULL AND k <> 99").groupBy("k").count()
    for how in ("inner", "left"):
        got = split_join(left, table, ["k"], "count", how, least=5)
        assert rows(got, "x", "k", "count") == rows(left.join(table, "k", how), "x", "k", "count")


def test_scratch_of_one_owner(spark, docs):
    """A lazy result outlives other work's deletion of its own tables."""
    from larkspur.llm.common import Scratch, discard, materialize

    lazy = materialize(docs, "mine")
    with Scratch(spark) as own:
        other = materialize(docs, "other")
        third = materialize(docs, "third")
    assert own.serves(other.select("doc_id")) and not own.serves(lazy)
    discard(third)
    own.release()
    assert lazy.count() == len(DOCS) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    with pytest.raises(Exception):
        other.count()


def test_simhash(docs, none):
    from larkspur.llm.simhash import near_duplicates, near_fingerprints

    assert rows(near_fingerprints(docs, 3, 2), "doc_id", "fingerprint", "component_id") == sorted(brute.near_fingerprints(DOCS), key=repr)
    near = dict(rows(near_duplicates(docs), "doc_id", "component_id"))
    assert near[61] == near[60] == near[62] and near[80] == near[3] and near[40 - 1] == 39
    assert near_fingerprints(none, 3, 2).count() == 0


def planted_pairs():
    """Pairs of texts with similarities from below 0.7 to 0.9 and short ones, and their Jaccard similarity."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    pairs = [("a b c d e f g h", "a b c d e f g h i")]
    for n in (8, 12, 24, 60, 200, 500):
        for k in range(24):
            w = [word() for _ in range(n)]
            v = list(w)
            for at in rng.sample(range(n), max(1, k * n // 600)):
                v[at] = word()
            pairs.append((" ".join(w), " ".join(v if k % 2 else v + [word() for _ in range(k % 5)])))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    return [(a, b, len(grams(a) & grams(b)) / len(grams(a) | grams(b))) for a, b in pairs]


@pytest.mark.parametrize("group", [2000, 1])
def test_near_duplicates_are_exact(spark, monkeypatch, group):
    """Planted pairs link if and only if their sets of shingles are similar enough."""
    from larkspur.llm import simhash

    monkeypatch.setattr(simhash, "GROUP", group)
    pairs = planted_pairs()
    assert sum(0.7 < s < 0.8 for *_, s in pairs) > 8 and sum(0.8 <= s < 0.9 for *_, s in pairs) > 8
    texts = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    got = dict(rows(simhash.near_duplicates(texts), "doc_id", "component_id"))
    assert [(i, s) for i, (*_, s) in enumerate(pairs) if (got[2 * i] == got[2 * i + 1]) != (s >= 0.8)] == []


def test_exact_forest():
    import numpy as np

    from larkspur.llm.simhash import exact_forest

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, int(n)).astype("<u8")) for n in rng.integers(1, 60, 30)]
    sets = [np.unique(np.concatenate([x[rng.random(len(x)) < keep], x[:1]])) for x in base for keep in (1, 0.95, 0.9, 0.85, 0.8)]
    both = lambda a, b: len(np.intersect1d(a, b))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * both(sets[i], sets[j]) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert brute.groups(len(sets), exact_forest(sets, 0.8)) == brute.groups(len(sets), links)


def crowd(n):
    """Fingerprints: a crowd of near copies, and others that share their first block."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fp = np.tile(base, (n, 1))
    for _ in range(45):
        fp[np.arange(n), rng.integers(1, 8, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    other = rng.integers(0, 2**63, (n // 10, 8), dtype=np.uint64)
    other[: n // 20, 1:] ^= (other[:n // 20, 1:] ^ base[1:]) & rng.integers(0, 2**63, (n // 20, 7), dtype=np.uint64)  # half way to the crowd
    other[:, 0] = base[0]
    return np.concatenate([fp, other])


def test_crowds_take_few_pairs():
    """Near copies with one block key are not compared in all pairs, and every connection is found."""
    import numpy as np

    from larkspur.llm.simhash import block_pairs, forest

    for n, exact in ((1500, True), (20000, False)):
        fp, seen = crowd(n), 0
        root = np.arange(len(fp))

        def pairs():
            nonlocal seen
            for a, b in block_pairs(fp[:, 0] & np.uint64(2**28 - 1), 28, 3, fp, 102, root):
                seen += len(a)
                ok = np.bitwise_count(fp[a] ^ fp[b]).sum(1) <= 102
                yield a[ok], b[ok]

        edges = forest(len(fp), pairs(), root)
        if exact:
            d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
            want = np.argwhere((d <= 102) & (np.arange(len(fp))[:, None] < np.arange(len(fp)))).tolist()
            assert brute.groups(len(fp), edges.tolist()) == brute.groups(len(fp), want)
        assert seen < 1000 * len(fp)


def test_null_ids_stay_apart(spark):
    """Different texts with null ids are different components."""
    from larkspur.llm.simhash import near_duplicates

    texts = [(None, prose(30)), (None, prose(30)), (None, None), (5, prose(30))]
    assert len({r["component"] for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}) == 4


def test_cells_meet_all_pairs():
    import numpy as np

    from larkspur.llm.simhash import cells

    rng = np.random.default_rng(2)
    home, rows_, met = rng.random(60) < 0.6, np.arange(60), set()
    for _, own, at in cells(rows_, home, rng.integers(0, 2**63, 60, dtype=np.uint64), 4):
        met |= {(int(a), int(b)) for a, o in zip(at, own) if o for b in at} | {(int(b), int(a)) for a, o in zip(at, own) if o for b in at}
    assert met == {(a, b) for a in range(60) for b in range(60) if home[a] or home[b]}


def test_pieces_of_shards(spark, monkeypatch):
    """Shards that no tree can split are cut in pieces."""
    import numpy as np

    from larkspur.llm.common import components
    from larkspur.llm.simhash import linked
    from larkspur.llm import simhash

    monkeypatch.setattr(simhash, "PER_SHARD", 100)
    fp = crowd(600)[:630]
    data = spark.createDataFrame([(bytearray(r.astype(">u8").tobytes()), i) for i, r in enumerate(fp)], "fp binary, node long")
    got = dict(rows(components(linked(data, len(fp), 18, 28, 3, 102)), "node", "component"))
    assert {got[i] for i in range(600)} == {0}


def test_block_pairs_are_all():
    """Against all pairs of keys, with many equal ones."""
    import numpy as np

    from larkspur.llm.simhash import block_pairs, forest

    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2**28, 1500).astype(np.uint64)
    for _ in range(3):
        keys = np.concatenate([keys, keys[rng.integers(0, len(keys), 300)] ^ (np.uint64(1) << rng.integers(0, 28, 300).astype(np.uint64))])
    fp, root = np.zeros((len(keys), 8), np.uint64), np.arange(len(keys))
    edges = forest(len(keys), block_pairs(keys, 28, 3, fp, 0, root), root)
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 3
    assert near[edges[:, 0], edges[:, 1]].all()
    assert brute.groups(len(keys), edges.tolist()) == brute.groups(len(keys), np.argwhere(np.triu(near, 1)).tolist())


def test_vantage_points_prune_exactly():
    import numpy as np

    from larkspur.llm.simhash import forest, near_pairs, route, vantage_tree

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    keys = np.unique(np.concatenate([base, base[:500] ^ np.uint64(1 << 7), base[:300] ^ np.uint64(3 << 40)]))
    want = {tuple(sorted((i, j))) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 2).tolist() if i != j}
    found = set()
    for r, _, home in route(keys, vantage_tree(keys[::3], 100), 2):
        for a, b in near_pairs(keys[r], home, 2):
            found |= {tuple(sorted(p)) for p in zip(r[a].tolist(), r[b].tolist())}
    assert found == want
    pairs = (np.array([p[0] for p in want]), np.array([p[1] for p in want]))
    assert len(set(brute.groups(len(keys), want))) == len(keys) - len(forest(len(keys), iter([pairs])))


def test_decontamination(spark, docs, none):
    from pyspark.sql import functions as F

    from larkspur.llm.decontam import contamination

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs, items).withColumn("sha", F.sha2(F.array_join("item_ids", ","), 256))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == sorted(brute.contamination(DOCS, ITEMS), key=repr)
    assert contamination(docs, items.where("false")).where("contaminated").count() == 0
    assert contamination(none, items).count() == 0


def test_packing(docs, none):
    from larkspur.llm.packing import pack_documents, padding, shortest_pack_first

    path = P.path("byte_bpe_50k.json")
    got = pack_documents(docs, path, keep_ids=True).collect()
    want = sorted(brute.token_ids([t for _, t in DOCS], path, 1))
    by_doc = {}
    for r in got:
        assert brute.crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    texts = {}
    for (d, _), ids in zip(DOCS, brute.token_ids([t for _, t in DOCS], path, 1)):
        texts.setdefault((d, len(ids)), []).append(ids)
    assert by_doc.keys() == texts.keys()
    for key, whole in texts.items():  # each id of each document in exactly one piece
        each = sorted(((s, i) for ids in whole for s, i in enumerate(ids)))
        assert each == sorted((s + k, i) for s, ids in by_doc[key] for k, i in enumerate(ids)), key
    assert sum(r["length"] for r in got) == sum(map(len, want))
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    histogram = {n: RNG.randint(0, 50) for n in range(1, 2049)}
    patterns = shortest_pack_first(histogram, 2048)
    assert all(sum(n * p.count(k) for p, n in patterns) == c for k, c in list(histogram.items())[::97])
    assert padding(patterns, 2048) < 0.02 * sum(k * c for k, c in histogram.items())
    assert pack_documents(none, path).count() == 0


@pytest.mark.parametrize("histogram", [{1100: 1000}, {1100: 7}, {n: 5 for n in range(1025, 2048)}, {2048: 9}, {1: 3}, {2047: 50, 3: 20}, {n: 1 + 3000 // n for n in range(1, 2049)}, {}], ids=lambda h: f"{len(h)}-{max(h, default=0)}")
def test_packs_are_full(histogram):
    """Every id of every piece lies in one place, sequences have no gaps, and there are no more than the ids fill."""
    from larkspur.llm.packing import shortest_pack_first, slots

    found, unfilled = slots(shortest_pack_first(histogram, 2048), 2048)
    pieces, sequences = {}, {}
    for length, first, end, at, size, offset, sequence in found:
        for k in range(end - first):
            pieces.setdefault((length, first + k), []).append((at, size))
            sequences.setdefault(sequence + k, []).append((offset, size))
    assert len(pieces) == sum(histogram.values())
    for groups, want in ((pieces, lambda k: k[0]), (sequences, lambda k: dict(unfilled).get(k, 2048))):
        for key, parts in groups.items():
            end = 0
            for start, n in sorted(parts):
                assert start == end and n > 0
                end += n
            assert end == want(key)
    assert sorted(sequences) == list(range(-(-sum(k * n for k, n in histogram.items()) // 2048)))


def test_cut_pieces(spark):
    """Documents of one length over half a sequence, repeated and null ids among them."""
    from larkspur.llm.packing import pack_documents

    path = P.path("byte_bpe_50k.json")
    words = [prose(4) for _ in range(30)]
    texts = [(i if i % 5 else None, f"{words[i % 30]} " + "the " * 1200) for i in range(40)]
    texts += texts[:6]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((d is None, d or 0, i, x) for (d, _), ids in zip(texts, brute.token_ids([t for _, t in texts], path, 1)) for i, x in enumerate(ids))
    for keep in (True, False):
        got = pack_documents(docs, path, keep_ids=keep).collect()
        assert len({r["sequence_id"] for r in got}) == -(-len(want) // 2048) and any(r["length"] < 1000 for r in got)
        if keep:
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"] + k, x) for r in got for k, x in enumerate(r["ids"])) == want
            crcs = sorted((r["doc_id"] or -1, r["start"], r["length"], brute.crc(r["ids"])) for r in got)
        assert sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"]) for r in got) == crcs


def test_token_files(docs, none):
    import xxhash

    from larkspur.llm.token_files import token_files

    path = P.path("word_bpe_49k.json")
    hashed = lambda t: xxhash.xxh64(t.encode(), 42).intdigest()
    signed = lambda t: (hashed(t) + 2**63) % 2**64 - 2**63
    ordered = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "")[:24], 42 if d[1] is None else signed(d[1])))
    start, want = 0, []
    for (d, _), ids in zip(ordered, brute.token_ids([t for _, t in ordered], path, 2)):
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert rows(token_files(docs, path, 2), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_files(none, path, 2).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_bit_packing(bits):
    import numpy as np

    from larkspur.llm.token_files import pack, unpack

    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    assert (unpack(pack(ids, bits), len(ids), bits) == ids).all()


def test_media(docs, none):
    from larkspur.llm.media import from_png, interleaved_documents, parse_html, references, resolve, sequences, store_media

    refs = references(sequences(interleaved_documents(docs), "doc_id", "html"))
    assert rows(refs, "doc_id", "caption") == sorted(((d, f"{n} bytes") for d, n, *_ in brute.media(DOCS)), key=repr)
    stored = store_media(docs)
    media = {hashlib.sha256(from_png(bytes(m)).tobytes()).hexdigest(): bytes(m) for (m,) in stored.select("media").collect()}
    want = [(d, p, s, c, len(media[s]), hashlib.sha256(media[s]).hexdigest(), brute.average_hash(t)) for (d, _, p, s, c), (_, t) in zip(brute.media(DOCS), DOCS)]
    got = resolve(refs, stored)
    assert rows(got, "doc_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == sorted(want, key=repr)
    assert [i["kind"] for i in parse_html("a<img src='digest:x' alt=c>b<p>c")] == ["text", "media", "text", "text"] and parse_html(None) == []
    assert store_media(none).count() == 0


def test_urls(spark):
    from larkspur.llm.queries import RULES
    from larkspur.llm.url_filter import apply_rules, rules_frame

    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com", "http://a.b.example.com/en/", "https://x.net/es/1", "https://x.net/esp", "http://y.net/fr/", "ftp://com/", "http://com?q=/", "http://a.com/x\n/y", "://com/a"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls[-3:])], "page_id int, url string, rule int")
    got = apply_rules(pages, rules_frame(spark, RULES))
    assert rows(got, "page_id", "host", "path", got["rule"], "verdict") == sorted(((i, *brute.url_verdict(u, RULES)) for i, u in enumerate(urls + urls[-3:])), key=repr)
    assert apply_rules(pages.where("false"), rules_frame(spark, RULES)).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_urls_of_many_lengths_and_names(spark, monkeypatch, broadcast):
    """Rules of 5000 path lengths, a frequent url, a column name of every kind that the operator uses."""
    from larkspur.llm import url_filter

    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    rules = [("block", "long.net", "/" + "a" * n) for n in range(5000)] + [("allow", "net", "/a")]
    urls = [f"http://x.long.net/{'a' * n}?q" for n in (0, 1, 50, 4095, 4096, 4097, 4999, 6000)] + ["http://other.net/a"] * 2500 + ["http://none.org/"]
    names = "id int, u string, n int, c0 int, __rule int, __verdict int, best int, digest int, host int"
    pages = spark.createDataFrame([(i, u, *[1] * 7) for i, u in enumerate(urls)], names)
    got = url_filter.apply_rules(pages, url_filter.rules_frame(spark, rules), "u").select("id", F_col("host"), "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == sorted((i, *brute.url_verdict(u, rules)) for i, u in enumerate(urls))


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_toxicity(spark, none):
    from larkspur.llm.toxicity import toxicity

    rows_ = [(i, prose(40) + (" " + RNG.choice(["blorkwit", "zangfool", "blorkwits"]) if i % 6 == 0 else "") + " " + prose(20)) for i in range(600)]
    docs = spark.createDataFrame(rows_ + [(900, None), (901, ""), (902, "12 !"), (903, "you b.l.o.r.k.w.i.t now"), (904, prose(50))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(450)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in range(450, 600))
    assert got[900] == got[901] == got[902] < 0.5 <= got[903] and got[904] < 0.5
    assert toxicity(none, labels).count() == 0


def test_toxicity_of_texts_without_words(spark):
    """Labelled nulls, empty texts and texts without words neither stop nor teach; labels may repeat and disagree."""
    from larkspur.llm.toxicity import toxicity, train

    rows_ = [(i, prose(20) + (" blorkwit" if i % 4 == 0 else "") + ". " + prose(9)) for i in range(200)]
    odd = [(900, None), (901, ""), (902, "a b"), (903, "12 !"), (904, None), (None, "blorkwit")]
    docs = spark.createDataFrame(rows_ + odd + rows_[:3], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(900, 1), (901, 0), (902, 1), (903, 0), (904, 0), (4, 0), (None, 0)], "doc_id long, toxic int")
    got = [(r["doc_id"], r["score"]) for r in toxicity(docs, labels).collect()]
    assert len(got) == len(rows_) + len(odd) + 3
    assert [i for i, s in got if i is not None and i < 900 and (s >= 0.5) != (i % 4 == 0)] == []
    assert len({s for i, s in got if i is not None and i >= 900}) == 1 and dict(got)[900] < 0.5 <= dict(got)[None]
    for texts, y in (([None, ""], [1, 0]), (["", "fine words"], [1, 0]), (["bad words", ""], [1, 0]), ([], []), (["bad"], [1])):
        train(texts, y)


def test_toxicity_of_inserted_characters(spark):
    """Digits, underscores and several marks inside an insult, or between all its letters, do not hide it."""
    from larkspur.llm.toxicity import parts, toxicity

    for token in ("b_l_o_r_k", "b1l1o1r1k", "b..l..o..r..k", "blo9rk", "bl__ork", "(b-_l0ork)!"):
        assert "blork" in parts(token), token
    rows_ = [(i, prose(40) + (" " + RNG.choice(["blorkwit", "zangfool", "blorkwits"]) if i % 6 == 0 else "") + " " + prose(20)) for i in range(450)]
    bad = ["b_l_o_r_k_w_i_t", "b1l1o1r1k1w1i1t", "b..l..o..r..k..w..i..t", "blo9rkwit", "bl__orkwit", "zang--fool", "z4angfool", "(zan_gf0ool)!"]
    clean = [" ".join(c.join(w) for w in prose(30).split()) for c in ("_", "1", "..")]
    docs = spark.createDataFrame(rows_ + [(1000 + i, f"{prose(20)} {w} {prose(9)}") for i, w in enumerate(bad)] + [(2000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(450)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    assert [w for i, w in enumerate(bad) if got[1000 + i] < 0.5] == [] and all(got[2000 + i] < 0.5 for i in range(len(clean)))


def test_sharding(docs, none):
    from larkspur.llm.sharding import schedule, shard_documents

    got = shard_documents(docs, 5).collect()
    assert sorted(r["size"] for r in got) == sorted(len(brute.raw(t)) + 8 for _, t in DOCS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({(r["text_crc32"], r["shard"]) for r in got}) == len({t or "" for _, t in DOCS})
    assert schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert shard_documents(none, 5).count() == 0


def test_token_counts(spark, docs, none):
    """Stored trees, edited later and again, count as whole texts do, in any alphabet and with added tokens."""
    from pyspark.sql import functions as F

    from larkspur.llm.token_counts import CountTree, apply_edits, attach_edits, build_trees, dump, edited_trees, load
    from larkspur.llm.tokens import Encoder

    path = P.path("byte_bpe_50k.json")
    enc = Encoder(path)
    whole = lambda t: len(enc.tokenizer.encode(t, add_special_tokens=False).ids)
    for _, text in DOCS:
        tree = CountTree(text or "", enc)
        now = text or ""
        assert tree.total == whole(now)
        for _ in range(12):
            p, d = RNG.randint(0, len(now)), RNG.choice([0, 0, 1, 5, 40, 3000])
            ins = RNG.choice(["", " ", "x", "'ll", "  \n", " new words here", "\n\n", "é 12", prose(300), "中文 字", "<|endoftext|>", "<|endof", "text|>", "🙂🙂"])
            tree = CountTree(tree.text, enc, load(dump(*tree.flat()))) if RNG.random() < 0.5 else tree
            tree.edit(p, d, ins)
            now = now[:p] + ins + now[min(len(now), p + d) :]
            assert tree.text == now and tree.total == whole(now)
            fresh = CountTree(now, enc)
            assert [x.tolist() for x in tree.flat()] == [x.tolist() for x in fresh.flat()] and tree.n_words == fresh.n_words
    edits = spark.createDataFrame([(0, 2, 0, 3, "ab"), (0, 1, None, None, None), (66, 1, 5, 2, "中")], "doc_id long, seq int, position int, delete int, insert string")
    trees = build_trees(docs, path)
    first = apply_edits(attach_edits(trees, edits), path)
    again = apply_edits(attach_edits(edited_trees(first), edits), path)
    text = dict(DOCS)
    for r in first.collect():
        if r["doc_id"] in (0, 66):
            t = text[r["doc_id"]]
            assert r["text"] == ("ab" + t[3:] if r["doc_id"] == 0 else t[:5] + "中" + t[7:])
            assert r["n_tokens"] == whole(t) and r["n_tokens_edited"] == whole(r["text"]) and 0 < r["n_reencoded"] < 20
    counted = sorted((repr(r["doc_id"]), r["n_tokens_edited"], r["n_tokens_edited"] == whole(r["text"])) for r in again.collect())
    assert len(counted) == len(DOCS) and all(c[2] for c in counted)
    assert apply_edits(build_trees(none, path).withColumn("edits", F.lit(None).cast("array<struct<position int, delete int, insert string>>")), path).count() == 0


def test_encoder_equals_the_library():
    """Both tokenizers, texts of all kinds, in one batch and again from the cache."""
    from larkspur.llm.tokens import Encoder

    texts = [t or "" for _, t in DOCS] + ["<|endoftext|>", " <|endoftext|> ", "a\n<|endoftext|>\n\n b", "x \u00a0y", "İi ǅ ﬁ", "a\tb\r\nc  d", "\0 x", "don't WE'LL I'M"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, want = Encoder(P.path(name)), brute.token_ids(texts, P.path(name), 7)
        for _ in range(2):
            assert [[*map(int, ids), 7] for ids in enc.encode(texts)] == want
        if not enc.lower:
            for t in texts:
                assert "".join(enc.pieces(t)) == t and list(enc.pieces_from(t, 0, 5)) == enc.pieces(t)




def test_shards_meet_similar_sets_only():
    """Sets of a similarity of 0.8 share a shard but for 0.64 ** 8 misses; of unrelated fingerprints hardly any are compared, however many there are."""
    import numpy as np

    from larkspur.llm.simhash import SHARDS, equal_pairs, shard_keys

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, 100, dtype=np.uint64)) for _ in range(4000)]
    a, b = shard_keys([x[:90] for x in sets]), shard_keys([x[10:] for x in sets])
    assert abs((a == b).mean() - 0.64) < 0.02 and (a == b).any(1).sum() >= 3990
    fp = rng.integers(0, 2**64, (4000, 8), dtype=np.uint64)
    assert sum(len(x) for k in range(SHARDS) for x, _ in equal_pairs(a[:, k], fp, 102, np.arange(4000))) <= 5
    assert shard_keys([np.zeros(0, np.uint64)]).tolist() == [[0] * SHARDS]


def test_words_are_encoded_once():
    """A word with a mark after it is not encoded anew, words in use outlive new ones, and the ids are the library's."""
    from public_tokenizers import path

    from larkspur.llm.tokens import Encoder

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, seen = Encoder(path(name), most=200), []
        model = encoder.model
        encoder.model = lambda w: seen.append(w) or model(w)
        rng = random.Random(7)
        new = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
        texts = [f"a quorvex{mark} of {new()} {new()}{mark}" for _ in range(300) for mark in (",", ".", "")]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert sum("quorvex" in w for w in seen) == 1 and len(encoder.cache) + len(encoder.cache.old) <= 220
