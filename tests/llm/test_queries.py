"""The registered queries themselves, over the whole small tables: against their SQL, or plain versions."""

import hashlib
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tests.test_queries import rows

P = pytest.importorskip("public_tokenizers")
TABLES = ["documents", "benchmark", "pages", "labels"]


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__

    return __spark_entry__.queries()


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist() for t in TABLES}


@pytest.fixture(scope="module")
def texts(tables):
    return [(r["doc_id"], r["text"]) for r in tables["documents"]]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op4_decontamination", "op6_url_filter"])
def test_sql(spark, sf_dir, queries, name):
    import __spark_entry__

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(queries[name](spark, sf_dir).toPandas()) == rows(con.execute(__spark_entry__.oracle_sql()[name]).df())


def test_every_oracle_has_its_query(queries):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries} and "pipeline" in queries


def test_op1(spark, sf_dir, queries, texts):
    assert got(queries["op1_suffix_dedup"](spark, sf_dir)) == sorted(brute.suffix_dedup(texts), key=repr)


def test_op2(spark, sf_dir, queries, texts):
    ids = dict(zip([d for d, _ in texts], brute.token_ids([t for _, t in texts], P.path("byte_bpe_50k.json"), 1)))
    pieces = queries["op2_packing"](spark, sf_dir).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == brute.crc(own[r["start"] : r["start"] + r["length"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at, groups in ((len, by_doc), (None, by_sequence)):
        for key, parts in groups.items():
            end = 0
            for start, n in sorted(parts):
                assert start == end and n > 0
                end += n
            assert end == len(ids[key]) if at else end <= 2048
    assert by_doc.keys() == ids.keys() and sorted(by_sequence) == list(range(len(by_sequence)))
    padded = sum(2048 - t for s in by_sequence.values() if (t := sum(n for _, n in s)) & (t - 1))
    assert padded < max(2048, 0.01 * sum(map(len, ids.values())))


def test_op3(spark, sf_dir, queries, texts):
    start, want = 0, []
    ordered = sorted(texts)
    for (d, _), ids in zip(ordered, brute.token_ids([t for _, t in ordered], P.path("word_bpe_49k.json"), 2)):
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert got(queries["op3_token_files"](spark, sf_dir)) == sorted(want, key=repr)


def test_op4_op8_brute(spark, sf_dir, queries, texts, tables):
    items = [(r["item_id"], r["text"]) for r in tables["benchmark"]]
    assert got(queries["op4_decontamination"](spark, sf_dir)) == sorted(brute.contamination(texts, items), key=repr)
    assert got(queries["op8_simhash"](spark, sf_dir)) == sorted(brute.near_fingerprints(texts), key=repr)


def test_op5(spark, sf_dir, queries, texts):
    want = [(*r, brute.average_hash(t)) for r, (_, t) in zip(brute.media(texts), texts)]
    df = queries["op5_media_columns"](spark, sf_dir)
    assert got(df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")) == sorted(want, key=repr)
    facts = df.select("payload_sha256", "media_bytes", "media_sha256").distinct().collect()
    assert len({r[0] for r in facts}) == len({r[2] for r in facts}) == len(facts) and all(r[1] > 60 for r in facts)


def test_op7(spark, sf_dir, queries, texts, tables):
    """Held-out documents by their labels; a part of the labels contradicts the words of the texts."""
    label = {r["doc_id"]: r["toxic"] for r in tables["labels"]}
    found = queries["op7_toxicity"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(d for d, _ in texts)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    known = [(label[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert sum(y == p for y, p in known) >= 0.8 * len(known)


def test_op9(spark, sf_dir, queries, texts):
    text = dict(texts)
    found = queries["op9_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(text)
    loads, slots, shard = [0] * 24, {}, {}
    for r in found:
        data = brute.raw(text[r["doc_id"]])
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert shard.setdefault(data, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    heaviest = max(sum(r["size"] for r in found if brute.raw(text[r["doc_id"]]) == d) for d in shard)
    assert max(loads) - min(loads) <= heaviest


def test_op10(spark, sf_dir, queries, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in texts}
    found = queries["op10_token_counts"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == sizes
    assert all(r["n_edits"] == 3 and r["n_reencoded"] < 60 for r in found)


def test_pipeline_stages(spark, sf_dir, texts, tables):
    """Each stage on what the one before kept, against plain versions."""
    import corpus_pipeline
    from larkspur.llm.toxicity import toxicity

    stages = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    write = lambda df: spark.createDataFrame(df.collect(), df.schema)
    columns = docs.columns

    clean = write(stages["toxicity"](spark, docs, sf_dir))
    scores = {r["doc_id"]: r["score"] for r in toxicity(docs, corpus_pipeline.table(spark, sf_dir, "labels"), use=~corpus_pipeline.held_out("l_id")).collect()}
    assert got(clean.select("doc_id")) == sorted(((d,) for d, s in scores.items() if s < 0.5), key=repr)

    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = write(stages["simhash_near_dedup"](spark, clean, sf_dir))
    left.sort()
    grams = lambda x: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((x or "").encode().lower().split())
    sets = [grams(x) for _, x in left]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert got(single.select("doc_id")) == sorted(((left[g][0],) for g in set(brute.groups(len(left), links))), key=repr)

    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    cut = write(stages["suffix_dedup"](spark, single, sf_dir))
    kept = {d: sha for d, _, _, _, sha in brute.suffix_dedup(left)}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    left = [(r["doc_id"], r["text"]) for r in cut.collect()]
    free = write(stages["decontamination"](spark, cut, sf_dir))
    found = brute.contamination(left, [(r["item_id"], r["text"]) for r in tables["benchmark"]])
    assert got(free.select("doc_id")) == sorted(((f[0],) for f in found if not f[5]), key=repr)
    assert clean.columns == single.columns == cut.columns == free.columns == columns

    packed = stages["packing"](spark, free, sf_dir).collect()
    left = {r["doc_id"]: r["text"] for r in free.collect()}
    ids = dict(zip(left, brute.token_ids(list(left.values()), P.path("byte_bpe_50k.json"), 1)))
    for r in packed:
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert sum(r["length"] for r in packed) == sum(map(len, ids.values()))


def test_pipeline_beside_a_lazy_result(spark, sf_dir, queries, texts):
    """A result that is not yet read outlives a run of the pipeline in the same session."""
    lazy = queries["op2_packing"](spark, sf_dir)
    assert queries["pipeline"](spark, sf_dir).count() > 0
    assert {r["doc_id"] for r in lazy.select("doc_id").distinct().collect()} == {d for d, _ in texts}
