"""Sharding by a two-pass external shuffle.

Pass 1 scatters records by seeded hash into buckets that fit in memory; pass 2 permutes each bucket with
Fisher-Yates. Bucket after bucket this is one random order of all records, which is cut into shards whose
row counts differ by one at most (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS = 24
#: Bytes that one bucket may hold on average, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 256
#: Partitions that buckets are dealt out in, at most: a bucket has one of its own up to 4 TB of records.
MOST_PARTITIONS = 1 << 16


#: Rows equal in all plain columns that may share a bucket; more of them are scattered one by one.
MOST_EQUAL = 1000


def _identity(docs: DataFrame, key: str) -> list[Column]:
    """The key, then the other columns of plain types: rows that share a key, null above all, spread over buckets too."""
    plain = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType)
    return [common.col(key), *[common.col(f.name) for f in docs.schema if f.name != key and isinstance(f.dataType, plain)]]


def _others(docs: DataFrame) -> Column:
    """A hash of the columns of other types, maps among them: it orders rows that agree in all plain columns."""
    nested = [common.col(f.name) for f in docs.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    return F.xxhash64(F.to_json(F.struct(*nested))) if nested else F.lit(0).cast("long")


def scatter(docs: DataFrame, key: str, size: Column, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS) -> tuple[DataFrame, int]:
    """(row, size, null, tie, other, bucket) with a uniform bucket from the seeded hash of key and values, and the number of buckets.

    The row holds the input's columns, so that no name of theirs can clash. Rows equal in all plain columns hash alike;
    where there are very many of one kind, each takes its place in the input as a salt.
    """
    own = _identity(docs, key)
    rows = docs.select(F.struct(*[common.col(c) for c in docs.columns]).alias("row"), size.alias("size"), common.col(key).isNull().alias("null"), F.xxhash64(*own, F.lit(seed)).alias("hash"), F.xxhash64(*own, F.lit(seed + 1)).alias("tie"), _others(docs).alias("other"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(least_buckets, -(-int(total) // bucket_bytes))
    many = common.materialize(rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EQUAL).select(F.col("hash").alias("many")), "shard-many")
    if not many.isEmpty():
        salt = F.xxhash64("hash", F.monotonically_increasing_id())
        rows = rows.withColumn("salt", salt).join(common.small_side(many), F.col("hash") == F.col("many"), "left")
        rows = rows.select("row", "size", "null", F.when(F.col("many").isNull(), F.col("hash")).otherwise(F.col("salt")).alias("hash"), "tie", "other")
    return rows.select("row", "size", "null", "tie", "other", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int").alias("bucket")), buckets


def shuffle_rows(docs: DataFrame, key: str, size: Column, seed: int = 0, **how) -> DataFrame:
    """(row, place, count): place (from 0, gapless) in a seeded random order of all rows, and how many there are.

    Buckets are dealt out in a number of partitions that the size decides. Rows are numbered in a sorted order, which
    spills where it must; Fisher-Yates permutes a bucket's numbers, of 4 bytes a row, and every row looks its place up
    there. Sorted numbers and seeded draws come out alike when a task is repeated.
    """
    rows, buckets = scatter(docs, key, size, seed, **how)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("rows"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = common.materialize(counts.select("bucket", "rows", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("start"), F.sum("rows").over(whole).alias("count")), "shard-starts")
    partitions = min(buckets, MOST_PARTITIONS)
    numbered = rows.repartition(partitions, "bucket").withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("null", "tie", "other")))
    drawn = starts.repartition(partitions, "bucket").sortWithinPartitions("bucket").select("bucket", "start", "count", F.shuffle(F.sequence(F.lit(0), F.col("rows").cast("int") - 1), seed).alias("order"))
    # merged, never broadcast: together the permutations grow with the rows, which their estimated size does not show
    mixed = numbered.join(drawn.hint("merge"), "bucket")
    return mixed.select("row", (F.col("start") + F.get("order", F.col("at") - 1)).alias("place"), "count")


def cut(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, shard, slot) from (row, place, count): the first count % shards shards hold one row more."""
    base, more = F.expr(f"count div {shards}"), F.col("count") % shards
    edge = (base + 1) * more
    late = F.col("place") >= edge
    shard = F.when(late, more + F.expr(f"(place - (count div {shards} + 1) * (count % {shards})) div greatest(count div {shards}, 1L)")).otherwise(F.expr(f"place div (count div {shards} + 1)"))
    slot = F.when(late, (F.col("place") - edge) % F.greatest(base, F.lit(1).cast("long"))).otherwise(F.col("place") % (base + 1))
    return rows.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """All columns (but ones named shard or slot, which are replaced) with shard and slot.

    A null text has size 8, repeated rows each get a slot of their own, an empty table gives an empty result. Columns may
    be of any type and name.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    size = F.octet_length(F.coalesce(common.col(text).cast("string"), F.lit(""))).cast("long") + 8
    placed = cut(shuffle_rows(docs.select(*[common.col(c) for c in own]), doc_id, size, seed), shards)
    return placed.select(*[F.col("row")[c].alias(c) for c in own], "shard", "slot")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write each shard to its own folder, rows in slot order. Null texts stay null; an empty table makes no folder."""
    out = shard(docs, **how)
    out.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6(spark, sf_dir: str) -> DataFrame:
    out = shard(common.table(spark, sf_dir, "documents"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(whole).cast("long") + 8).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
