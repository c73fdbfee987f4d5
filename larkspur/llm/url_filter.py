"""URL filters: host-suffix and path-prefix expressions joined by hash prefix.

Every distinct (host, path) is expanded into its host suffixes. A suffix joins
the rules' hosts, each with the lengths of its rules' paths, and so is expanded
into path prefixes of those lengths only. Such an expression joins the rules on
the first bytes of its SHA-256 and is confirmed on the whole digest; the longest
rule wins, and of equally long ones the greater name. DataFrame functions only.

Cases: null urls and urls without ``://`` have empty host and path and meet no
rule; equal urls get equal rows, one for each input row, those of a frequent url
in several tasks; very long urls and any number of rules' path lengths are
expanded in full; no rules or no pages give the default verdict or no rows; rules
with a null host or path never fit; other columns are kept, but for host, path,
rule and verdict, which the result's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, split_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rules that are broadcast; more are shuffled, with SALTS copies against frequent hosts.
BROADCAST_RULES, SALTS = 100_000, 16


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def prefix_join(rows: DataFrame, table: DataFrame, large: bool) -> DataFrame:
    """Rows (digest, salt) that meet ``table`` (t_digest): on eight hex digits first, then on all."""
    rows, table = rows.withColumn("prefix", F.substring("digest", 1, 8)), table.withColumn("t_prefix", F.substring("t_digest", 1, 8))
    met = (F.col("prefix") == F.col("t_prefix")) & (F.col("digest") == F.col("t_digest"))
    if large:
        table = table.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(table, met & (F.col("salt") == F.col("t_salt")))
    return rows.join(F.broadcast(table), met)


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` plus host, path, rule and verdict (named so in the result).

    ``rules``: verdict, host, path; for equal (host, path) block comes before allow.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host IS NOT NULL AND path IS NOT NULL")
    rules = materialize(rules, "rules")
    large = rules.count() > BROADCAST_RULES
    hosts = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).select(digest(F.col("host")).alias("t_digest"), "lengths")
    table = rules.select(digest(F.col("host"), F.col("path")).alias("t_digest"), "verdict", F.concat("host", "path").alias("rule"))
    urls = pages.select(pages[url_col].alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    parts = urls.select("u", url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p")).where("h <> ''")
    labels = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    salt = F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int").alias("salt")
    heads = parts.select("u", "p", salt, F.explode(F.array_distinct(suffixes)).alias("hs")).withColumn("digest", digest(F.col("hs")))
    fits = F.filter("lengths", lambda n: n <= F.length("p"))
    lengths = prefix_join(heads, hosts, large).select("u", "p", "salt", "hs", F.explode(fits).alias("n_path"))
    expressions = lengths.select("u", "salt", digest(F.col("hs"), F.substring(F.col("p"), F.lit(1), F.col("n_path"))).alias("digest"))
    best = F.max(F.struct(F.length("rule"), F.col("rule"), F.col("verdict"))).alias("best")
    hits = prefix_join(expressions, table, large).groupBy("u").agg(best).select("u", "best.rule", "best.verdict")
    names = {c: f"c{i}" for i, c in enumerate(pages.columns)}  # no name of the input can clash
    rows = pages.select(*[pages[c].alias(n) for c, n in names.items()], pages[url_col].alias("u"))
    hits = materialize(hits.join(urls, "u"), "url-hits")
    out = split_join(rows, hits, ["u"], "n", "left")
    own = {"host": url_host(F.col("u")), "path": url_path(F.col("u")), "rule": F.col("rule"), "verdict": F.coalesce("verdict", F.lit(default))}
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in own], *[v.alias(c) for c, v in own.items()])
