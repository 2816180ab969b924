"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import narrow, settled, shuffle_parts

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Equal texts that take more than one 100th of a shard together get their shard before all
#: others; so there are at most 100 such groups for each shard.
LARGE = 100


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``row``, their number in ``order`` (from 0), and ``start``, the bytes before them.

    Range partitions; their totals (one row each, a number that the session sets) are
    summed, and every partition adds its own running sums.
    """
    # The checkpoint fixes which row is in which range, also if a task runs again.
    ranged = settled(rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before")
    )
    inside = Window.partitionBy("part").orderBy(*order)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranged.join(F.broadcast(offsets), "part").withColumns({"start": start, "row": F.col("rows_before") + F.row_number().over(inside) - 1})
    return settled(placed.drop("part", "bytes_before", "rows_before"))


def _packed(groups: list, n_shards: int) -> tuple[list[int], list[int]]:
    """A shard for each of ``groups`` (bytes, largest first), the emptiest one each time; and the bytes of the shards."""
    emptiest = [(0, s) for s in range(n_shards)]
    shards, load = [], [0] * n_shards
    for size in groups:
        held, s = heapq.heappop(emptiest)
        shards.append(s)
        load[s] = held + size
        heapq.heappush(emptiest, (load[s], s))
    return shards, load


def _room(load: list[int], rest: int) -> list[int]:
    """What each shard takes of ``rest`` bytes, so that all come to one level (those above it take nothing)."""
    level, used = 0, 0
    for k, held in enumerate(sorted(load)):
        used += held
        level = (used + rest) / (k + 1)
        if k + 1 == len(load) or level <= sorted(load)[k + 1]:
            break
    return [max(0, round(level - x)) for x in load]


def byte_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents, equal texts together, into shards of near-equal bytes.

    Equal texts that take between a 100th of a shard and a whole one are dealt first,
    each group to the shard that has least so far (there are at most 100 for a shard, so
    the driver does it).  All other rows are put in order by a hash of their text, and
    prefix sums of their bytes are cut at what each shard has room for, which is an equal
    share where there are no large groups: a row goes to the shard in which its middle
    byte falls, or, with small groups, that of all of them.  Texts that take more than a
    shard together are cut, as they have to be; every other text is in one shard.  So
    shards are equal but for a 100th and one document at either end, unless large groups
    alone make one larger.  ``slot`` counts from 0 within a shard, equal texts in a row.

    Null texts count as no bytes; rows that are equal in id and text take
    neighbouring slots in any order; very long texts count whole and are only hashed;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    group = ["text_hash", "size", "text_crc32"]
    order = [*group, "doc_id"]
    rows = settled(narrow(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), (F.octet_length("text") + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")
    ))
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    # Partial sums, so copies don't meet.
    together = rows.groupBy(*group).agg(F.count("*").alias("copies"), F.sum("size").alias("group_bytes")).where("copies > 1").select(*group, "group_bytes")
    fits = wide("group_bytes") * n_shards <= whole
    large = together.where(fits & (wide("group_bytes") * (n_shards * LARGE) > whole)).orderBy(F.desc("group_bytes"), *group).collect()
    shards, load = _packed([g.group_bytes for g in large], n_shards)
    dealt = spark.createDataFrame([(*g[:3], s) for g, s in zip(large, shards, strict=True)], "text_hash long, size long, text_crc32 long, large_shard int")
    sorted_ = rows.join(F.broadcast(dealt), group, "left")
    others = _numbered(sorted_.where("large_shard is null").drop("large_shard"), order)
    # Where the small groups begin.  A hot group is none of them, and its rows can be split in the join.
    small = together.where(fits).join(F.broadcast(dealt), group, "left_anti")
    held = settled(others.join(small, group).groupBy(*group).agg(F.min("start").alias("group_start"), F.first("group_bytes").alias("group_bytes")))
    cuts, at = [], 0
    for room in _room(load, whole - sum(load))[:-1]:
        at += room
        cuts.append(at)
    middle: Column = F.coalesce("group_start", "start").cast("decimal(28,0)") * 2 + F.coalesce("group_bytes", "size")
    lines = F.array(*(F.lit(2 * c).cast("decimal(28,0)") for c in cuts)) if cuts else F.array().cast("array<decimal(28,0)>")
    shard = F.size(F.filter(lines, lambda c: c <= F.col("middle")))
    by_bytes = others.join(held, group, "left").withColumn("middle", middle).select("doc_id", *group, shard.alias("shard"))
    by_group = sorted_.where("large_shard is not null").select("doc_id", *group, F.col("large_shard").alias("shard"))
    placed = _numbered(by_bytes.union(by_group), ["shard", *order])
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def query(spark, sf_dir):
    shards = byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
