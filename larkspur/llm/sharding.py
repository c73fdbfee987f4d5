"""Sharding by longest-processing-time scheduling; law ``bytes``.

Rows with equal texts form a group that stays in one shard. Groups above a
share of the total, of which there can only be a bounded number, are scheduled
one by one; the others are bundled by the hash of their text into a fixed
number of coarse and fine bundles. Items go, largest first, to the least loaded
shard of a heap. A group larger than a shard's share makes that shard larger,
since it may not be split.

Cases: null text counts 8 bytes and groups with the empty text; an empty table
gives no rows; repeated rows and null ids keep one slot each; other columns of
the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

COARSE, FINE, HEAVY = 4096, 2048, 256


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each (size, name): largest first to the least loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(loads)
        out[name] = s
        heapq.heappush(loads, (load + size, s))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each input row."""
    spark = docs.sparkSession
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            docs[id_col].alias("doc_id"), (F.octet_length(raw).cast("long") + 8).alias("size"),
            F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("digest"),
        ), "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    limit = max(1, total // (shards * HEAVY))
    h = F.xxhash64("digest")
    part = F.shiftright(h, 8)
    bundle = F.when(F.pmod(h, F.lit(16)) == 0, F.pmod(part, F.lit(FINE)) + COARSE).otherwise(F.pmod(part, F.lit(COARSE))).cast("string")
    name = F.when(F.col("bytes") > limit, F.col("digest")).otherwise(bundle)
    # At most shards * HEAVY heavy groups and COARSE + FINE bundles.
    items = groups.select(name.alias("name"), "bytes").groupBy("name").agg(F.sum("bytes").alias("bytes")).collect()
    placed = schedule([(r["bytes"], r["name"]) for r in items], shards)
    plan = spark.createDataFrame(list(placed.items()), "p_name string, shard int")
    heavy, light = plan.where(F.length("p_name") == 64), plan.where(F.length("p_name") < 64)
    heavy = F.broadcast(heavy.select(F.col("p_name").alias("h_name"), F.col("shard").alias("h_shard")))
    out = rows.withColumn("bundle", bundle)
    out = (
        out.join(heavy, out["digest"] == heavy["h_name"], "left")
        .join(F.broadcast(light), F.col("bundle") == F.col("p_name"), "left")
        .select("doc_id", "size", "text_crc32", "digest", F.coalesce("h_shard", "shard").alias("shard"))
    )
    return ranked(out, "shard", ["doc_id", "digest"], ["doc_id", "digest"], n, "slot").drop("digest")
