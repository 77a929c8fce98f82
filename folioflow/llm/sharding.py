"""Rendezvous hashing of stable record keys over weighted shards.

Each record scores every shard by ``-weight / ln(u)``, ``u`` being a hash of key and shard in (0, 1), and goes to the
highest score.  A new shard can only win records for itself, so growing by one moves about ``1 / (n + 1)`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets per shard over which slots are counted; the table of offsets has ``shards * BUCKETS`` rows at most.
BUCKETS = 1024
#: Copies of one row that are given their slots together.
BLOCK = 10_000


def score(key: Column, shard: Column, weight: Column) -> Column:
    """Score of a shard for a key; a NULL key hashes as a value of its own, a weight of 0 never wins."""
    u = (F.shiftrightunsigned(F.xxhash64(F.xxhash64(key), shard), 11) + 0.5) * F.lit(2.0**-53)
    return -weight / F.ln(u)


def best(key: Column, weights: Sequence[float]) -> Column:
    """``struct(score, shard)`` of the winning shard of ``0 .. len(weights) - 1``; equal scores go to the higher number."""
    offered = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_max(F.transform(offered, lambda w, i: F.struct(score(key, i, w).alias("score"), i.alias("shard"))))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return best(key, weights)["shard"].cast("int")


def grown_shard_of(key: Column, weights: Sequence[float], new_weight: float = 1.0) -> Column:
    """Shard of the key once one more shard stands after ``weights``."""
    held, new = best(key, weights), F.lit(len(weights))
    return F.when(score(key, new, F.lit(float(new_weight))) > held["score"], new).otherwise(held["shard"]).cast("int")


def bucket_of(names: Sequence[str], buckets: int = BUCKETS) -> Column:
    """Bucket of a row by all its columns, so that different rows of one hot key are in different ones."""
    return F.pmod(F.xxhash64(F.lit("slot"), *names), F.lit(buckets)).cast("int")


def place(rows: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    Slots follow (bucket of the row's hash, all columns of the row); rows alike in every column take one slot each.
    Every column of ``rows`` must be orderable; columns named like the three new ones are replaced.  No rows give none.

    No shard is gathered in one task: like rows are counted before the shuffle, slots are numbered within a
    ``1 / buckets`` part of a shard, and the parts' offsets are a table of at most ``shards * buckets`` rows.
    """
    kept = rows.drop("shard", "slot", "grown_shard")
    names = [c for c in kept.columns]
    one = kept.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    one = one.select(
        *names,
        "__n",
        bucket_of(names, buckets).alias("__bucket"),
        best(F.col(key), weights).alias("__best"),
    )
    new = F.lit(len(weights))
    one = one.select(
        *names,
        "__n",
        "__bucket",
        F.col("__best.shard").cast("int").alias("shard"),
        F.when(score(F.col(key), new, F.lit(float(new_weight))) > F.col("__best.score"), new).otherwise(F.col("__best.shard")).cast("int").alias("grown_shard"),
    )
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = one.groupBy("shard", "__bucket").agg(F.sum("__n").alias("__rows"))
    offsets = offsets.select("shard", "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = one.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), ["shard", "__bucket"])
    blocks = placed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / BLOCK))))
    first = F.col("__block") * BLOCK
    copies = blocks.withColumn("__copy", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("__n")) - 1)))
    return copies.select(*names, "shard", (F.col("__offset") + F.col("__before") + F.col("__copy")).cast("long").alias("slot"), "grown_shard")


def sizes(docs: DataFrame, header: int = 16) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text, NULL none, plus ``header``) and unsigned ``text_crc32``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + header).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
