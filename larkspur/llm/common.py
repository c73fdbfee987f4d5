"""Helpers shared by the operators of this subpackage.

Rows are identified by ``(id, xxhash64(text))`` so that repeated ids with
different texts stay apart and repeated rows share one result; null ids are
legal and compare equal to each other.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most keys that split_join() broadcasts; a key with more than this part of all rows is cut in pieces.
HOT_KEYS = 10_000
#: Shuffle files of a finished write go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.conf.get("larkspur.scratch", None):
        spark.conf.set("larkspur.scratch", "file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return spark.conf.get("larkspur.scratch")


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    """Names of the folders of the files that ``df`` reads."""
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


class Scratch:
    """Owner of the tables stored in its ``with`` block, so that each piece of work deletes its own and no others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        self._token = _owner.set(self)
        return self

    def __exit__(self, *error) -> None:
        _owner.reset(self._token)

    def release(self) -> None:
        """Delete the tables; call it once nothing that reads them is left to run."""
        while self.paths:
            _delete(self.spark, self.paths.pop())

    def serves(self, df: DataFrame) -> bool:
        """Whether ``df`` reads one of the tables."""
        return not _folders(df).isdisjoint(p.rsplit("/", 1)[-1] for p in self.paths)


_owner: ContextVar[Scratch | None] = ContextVar("owner", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    if (owner := _owner.get()) is not None:
        owner.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that its only reader is done with; any other table stays."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/larkspur/[\w-]+-[0-9a-f]{32}$", f):
            _delete(df.sparkSession, f)


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a text column, since texts may be very long; none is empty."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield batch.slice(i, j - i)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a stored table, to be broadcast if it has at most so many rows, else shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def hash_sample(df: DataFrame, rows: int, wanted: int, *key: str) -> DataFrame:
    """About ``wanted`` of ``rows`` rows, the same for the same keys; tasks send no others."""
    rate = max(1, rows // max(1, wanted))
    return df.where(F.pmod(F.xxhash64(F.lit(17), *key), F.lit(rate)) == 0)


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """``rows`` joined by name to ``table``, which has one row a key and in ``n`` the number of rows that have it.

    Both are stored tables. Keys of more than a HOT_KEYS-th of all rows, of which
    there are fewer than HOT_KEYS, are dealt over pieces of that size; the
    table's rows for them are repeated for each piece.
    """
    limit = max(least, (table.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    pieces = F.ceil(F.col(n) / limit).cast("int")
    hot = table.where(F.col(n) > limit).select(*keys, pieces.alias("__pieces"))
    if hot.isEmpty():
        return rows.join(table, keys, how)
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("__piece", F.pmod(F.xxhash64("__row"), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces", "__row")
    table = table.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return dealt.join(table, [*keys, "__piece"], how).drop("__piece")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc_id, th, text only: other columns of the input can't clash."""
    text = docs[text_col]
    return docs.select(docs[id_col].alias("doc_id"), text_key(text).alias("th"), text.alias("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["th"] == right["th"])


def ranked(df: DataFrame, part: str, salt: list[str], order: list[str], rows: int, to: str) -> DataFrame:
    """``to`` = gapless rank from 0 within ``part``, without one task per part.

    Rows of a part are dealt over salts; a salt's rank starts where the rows of
    the lower salts end. ``df`` is read twice, so pass a stored table. The bases
    are at most (parts x salts) rows; salts grow with ``rows`` only.
    """
    salts = max(16, rows // 2_000_000)
    df = df.withColumn("__salt", F.pmod(F.xxhash64(*salt), F.lit(salts)))
    before = Window.partitionBy(part).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(part, "__salt").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(F.col(part).alias("__p"), F.col("__salt").alias("__s"), "__base")
    )
    local = F.row_number().over(Window.partitionBy(part, "__salt").orderBy(*order)) - 1
    out = df.withColumn("__rank", local)
    return (
        out.join(bases, (out[part] == bases["__p"]) & (out["__salt"] == bases["__s"]))
        .withColumn(to, F.col("__rank") + F.col("__base"))
        .drop("__p", "__s", "__base", "__rank", "__salt")
    )


def meet(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges with the least neighbour of ``a``; the edges of hubs are dealt over pieces where there are many edges."""
    if n < 1_000_000:
        return edges.join(least.drop("n"), "a")
    return split_join(edges, materialize(least, "least"), ["a"], "n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for nodes of ``edges`` (a long, b long); component is its smallest node.

    Alternating large-star and small-star rounds; each is one shuffle of the
    edges, stored before the next, and hubs only ever gather edges to smaller
    nodes. An isolated node must be given as an edge to itself or left out.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    n = edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = (
            meet(both, least, n).where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        large = materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            meet(large, low, n)
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        small = materialize(small, "small")
        # Done when every node has one edge and it leads to a root.
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        nodes = small.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        state = nodes.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("unsettled")).first()
        n, done = state["n"] or 0, not state["unsettled"]
        edges = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
