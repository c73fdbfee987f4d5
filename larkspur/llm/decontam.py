"""Benchmark decontamination as a prefix-filtered set join on word shingles.

A window is ``window`` consecutive item words, or a whole shorter item; it is a
sequence of shingles of ``shingle`` words (fewer in shorter items). Shingles are
ordered by rarity: by how often their words occur in the documents, the rarest
word first. For exact containment the prefix of a window is its single rarest
shingle. Only these meet the documents, first by their rarest word and then
whole. Where one occurs it gives the only place that the window can have there;
the place must lie within the document (bounds of length and position), and the
words at the place must be the window's, all of them. A window with a word that
no document has drops out before. DataFrame functions only.

Cases: null and word-less texts have no words and no hits; items without words
have no windows; empty tables give no hits or no rows; very long texts pass word
by word and only 2 * window - 1 words around a match are kept of them; repeated
documents get a row each; null document ids are equal to each other, with texts
told apart; repeated item ids count once, null item ids never; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, same_row, sized, split_join
from .url_filter import LOWER, UPPER

#: What separates words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most words or shingles of a benchmark that are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item (id as a string), win (digest), n, ww: the words of each window of each item."""
    rows = items.select(items[id_col].cast("string").alias("item"), words(items[text_col]).alias("w")).where("size(w) > 0")
    n = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    wins = rows.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("ww")).distinct()
    return wins.withColumn("win", F.sha2(F.concat_ws(" ", "ww"), 256))


def word_counts(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """word, c: how often the words of the windows occur in the documents."""
    vocabulary = materialize(wins.select(F.explode("ww").alias("word")).distinct(), "vocabulary")
    every = docs.select(F.explode(words(F.col("text"))).alias("word"))
    if vocabulary.count() <= BROADCAST_ROWS:
        return every.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("c")).join(vocabulary, "word", "left_semi")


def prefixes(wins: DataFrame, counts: DataFrame, shingle: int) -> DataFrame:
    """win, n, ww, size, j, o, sh, word: each possible window's rarest shingle, which starts at its word j and has its rarest word at o."""
    spots = wins.select("win", "n", "ww").dropDuplicates(["win"]).select("win", "n", "ww", F.posexplode("ww").alias("p", "word")).join(counts, "word", "left")
    known = (
        spots.groupBy("win").agg(F.first("n").alias("n"), F.first("ww").alias("ww"), F.count("c").alias("n_seen"), F.array_sort(F.collect_list(F.struct("p", "c"))).alias("pc"))
        .where("n_seen = n").withColumn("cs", F.col("pc.c")).withColumn("size", F.least(F.lit(shingle), F.col("n")))
    )
    at = F.sequence(F.lit(0), F.col("n") - F.col("size"))
    order = F.transform(at, lambda j: F.struct(F.array_sort(F.slice("cs", j + 1, F.col("size"))).alias("rarity"), j.alias("j")))
    first = known.withColumn("first", F.array_min(order)).withColumn("j", F.col("first.j"))
    first = first.withColumn("o", (F.array_position(F.slice("cs", F.col("j") + 1, F.col("size")), F.col("first.rarity")[0]) - 1).cast("int"))
    words_of = F.slice("ww", F.col("j") + 1, F.col("size"))
    return first.select("win", "n", "ww", "size", "j", "o", F.concat_ws(" ", words_of).alias("sh"), F.col("ww")[F.col("j") + F.col("o")].alias("word"))


def shingle_hits(docs: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """doc_id, th, n_words, sh, at, around, lo: where prefix shingles occur, and the words around from word ``lo`` on."""
    keys = materialize(first.select("word", "size", "o").distinct(), "prefix-words")
    known = materialize(first.select("sh").distinct(), "prefix-shingles")
    split = docs.select("doc_id", "th", words(F.col("text")).alias("w"))
    rows = split.select("doc_id", "th", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    lo = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = F.slice("w", lo + 1, F.lit(2 * window - 1))
    if keys.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(keys), "word").withColumn("lo", lo).withColumn("around", around)
    else:  # whole texts are not to be shuffled once for each of their words
        rows = rows.withColumn("lo", lo).withColumn("around", around).drop("w").join(keys, "word")
    rows = rows.withColumn("at", F.col("pos") - F.col("o")).where("at >= 0 AND at + size <= n_words")
    rows = rows.withColumn("sh", F.concat_ws(" ", F.slice("around", F.col("at") - F.col("lo") + 1, F.col("size"))))
    return rows.join(sized(known, BROADCAST_ROWS), "sh", "left_semi").select("doc_id", "th", "n_words", "sh", "at", "around", "lo").distinct()


def occurrences(hits: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id, th, win, n, start: the places where whole windows lie."""
    of = first.groupBy("sh").agg(F.collect_list(F.struct("win", "n", "j", "ww")).alias("wins"))
    table = materialize(of.join(hits.groupBy("sh").agg(F.count(F.lit(1)).alias("n_rows")), "sh"), "shingle-windows")
    met = split_join(hits, table, ["sh"], "n_rows").select("doc_id", "th", "n_words", "at", "around", "lo", F.inline("wins"))
    met = met.withColumn("start", F.col("at") - F.col("j")).where("start >= 0 AND start + n <= n_words")
    whole = F.slice("around", F.col("start") - F.col("lo") + 1, F.col("n")) == F.col("ww")
    return met.where(whole).select("doc_id", "th", "win", "n", "start").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, one_in: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, item_ids (sorted strings), contaminated: one row for each input row.

    contaminated: hit words are at least one in ``one_in`` words, and not none.
    """
    docs = keyed(docs, id_col, text_col)
    wins = materialize(item_windows(items, item_col, item_text, window), "windows")
    counts = materialize(word_counts(docs, wins), "word-counts")
    first = materialize(prefixes(wins, counts, shingle), "prefixes")
    hits = materialize(shingle_hits(docs, first, window), "shingle-hits")
    found = materialize(occurrences(hits, first), "occurrences")
    hit = (
        found.select("doc_id", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p")).distinct()
        .groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    met = materialize(found.select("doc_id", "th", "win").distinct(), "windows-met")
    owners = wins.where("item IS NOT NULL").groupBy("win").agg(F.collect_set("item").alias("items"))
    owners = materialize(owners.join(met.groupBy("win").agg(F.count(F.lit(1)).alias("n_rows")), "win"), "owners")
    named = split_join(met, owners, ["win"], "n_rows").groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    both = hit.join(named, same_row(hit, named), "left").select(hit["doc_id"], hit["th"], "n_hit", "item_ids")
    sizes = docs.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(both, same_row(sizes, both), "left").select(
        sizes["doc_id"], sizes["th"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
    return out.withColumns({
        "n_items": F.size("item_ids").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")),
    })
