"""Shards of near equal size by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go to the least loaded shard in
falling order of size. The schedule is made on the driver over units of bounded number: every group
of at least 1 / (shards * UNITS) of all bytes is a unit of its own, so there are at most
shards * UNITS of them; smaller groups are first dealt into shards * UNITS bundles by hash.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import partitions
from flowloom.session import cut_lineage

#: Scheduled units of either kind per shard; a shard's load is off by about 1 / UNITS.
UNITS = 1000
#: Bytes a row costs besides its text.
ROW_BYTES = 16


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Unit -> shard: units in falling order of size (ties by unit) to the least loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[unit] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def _lookup(spark, key: str, column: str, placed: dict[int, int]) -> DataFrame:
    frame = pd.DataFrame({key: list(placed), column: list(placed.values())}, dtype="int64")
    return F.broadcast(spark.createDataFrame(frame, f"{key} long, {column} long"))


def shard(docs: DataFrame, shards: int, units: int = UNITS) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, size, text_crc32, grp, shard, slot.

    size is the text's UTF-8 bytes plus 16; a null text has no bytes, checksum 0 and is grouped with
    empty texts. slot numbers a shard's rows from 0 without gaps, in no order that means anything.
    Repeated rows are rows of their own in one shard. An empty table gives an empty result. Other
    columns of `docs` are left out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = shards * units
    bundle = F.pmod(F.xxhash64("grp"), F.lit(count))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    large = groups.where(F.col("bytes") * count >= total).collect()
    heavy = {r["grp"]: r["bytes"] for r in large}
    known = _lookup(spark, "grp", "own", dict.fromkeys(heavy, 1))
    light = rows.join(known, "grp", "left_anti").groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("bytes"))
    # a group and a bundle may have the same number, so units are (kind, number)
    sizes = [((0, k), v) for k, v in heavy.items()] + [((1, r["bundle"]), r["bytes"]) for r in light.collect()]
    placed = schedule(sizes, shards)
    own = _lookup(spark, "grp", "own", {k: v for (kind, k), v in placed.items() if kind == 0})
    shared = _lookup(spark, "bundle", "shared", {k: v for (kind, k), v in placed.items() if kind == 1})
    out = (
        rows.withColumn("bundle", bundle)
        .join(own, "grp", "left")
        .join(shared, "bundle", "left")
        .select("doc_id", "size", "text_crc32", "grp", F.coalesce("own", "shared").cast("int").alias("shard"))
    )
    return _with_slots(out)


def _with_slots(out: DataFrame) -> DataFrame:
    """Number the rows of each shard: ranks in (shard, block of rows) plus the rows of earlier blocks.

    Blocks come from a hash of the row, so that a shard with most of the rows is numbered by all tasks.
    """
    n = partitions(out.sparkSession)
    out = out.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(4 * n)))
    place = Window.partitionBy("block", "shard").orderBy("doc_id", "text_crc32", "size")
    ranked = out.repartition(n, "block").withColumn("rank", F.row_number().over(place) - 1)
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "block").count().select(
        "shard", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    return ranked.join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "grp", "shard", (F.col("rank") + F.col("before")).alias("slot")
    )
