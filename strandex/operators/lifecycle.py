"""Decay, pruning, merging of snapshots, and ciphertext mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx


def confidence_now(now: int, half_life: int = fx.HALF_LIFE) -> Column:
    """Confidence after decay: of the stored one, or full; since the last use, or creation."""
    return fx.decayed(F.coalesce("confidence", F.lit(fx.FULL).cast("long")), F.coalesce("last_used", "created"), F.lit(now).cast("long"), F.lit(half_life).cast("long"))


def stale(memories: DataFrame, now: int, below: int = fx.PRUNE_FLOOR, half_life: int = fx.HALF_LIFE) -> DataFrame:
    """(id, confidence) of records whose decayed confidence is under the floor."""
    return memories.select("id", confidence_now(now, half_life).alias("confidence")).where(F.col("confidence") < below).orderBy("id")


def listed(memories: DataFrame, mtype: str | None = None, tag: str | None = None) -> DataFrame:
    out = memories
    if mtype is not None:
        out = out.where(F.col("mtype") == mtype)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    return out.orderBy("id")


def touched(memories: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Records used now: full confidence, last_used now."""
    hit = ids.select("id", F.lit(True).alias("_hit"))
    rows = memories.join(hit, "id", "left")
    return rows.withColumn("confidence", F.when(F.col("_hit"), F.lit(fx.FULL).cast("long")).otherwise(F.col("confidence"))).withColumn("last_used", F.when(F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("last_used"))).select(*memories.columns)


def merged(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three snapshots (id, content) -> the merged one, and (id, base, ours, theirs) where both sides changed differently. null: not there."""
    rows = base.select("id", F.col("content").alias("base")).join(ours.select("id", F.col("content").alias("ours")), "id", "full_outer").join(theirs.select("id", F.col("content").alias("theirs")), "id", "full_outer")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    conflict = ~same("ours", "theirs") & ~same("ours", "base") & ~same("theirs", "base")
    content = F.when(same("ours", "base"), F.col("theirs")).otherwise(F.col("ours"))
    return rows.where(~conflict).select("id", content.alias("content")).where("content is not null"), rows.where(conflict)


def encrypted(rows: DataFrame, key: str) -> DataFrame:
    """(id, content) -> (id, sealed): AES-GCM with the id as authenticated data. key: 16, 24 or 32 bytes as hex."""
    return rows.select("id", F.base64(F.aes_encrypt(F.encode("content", "utf-8"), F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode("id", "utf-8"))).alias("sealed"))


def decrypted(rows: DataFrame, key: str) -> DataFrame:
    return rows.select("id", F.decode(F.aes_decrypt(F.unbase64("sealed"), F.unhex(F.lit(key)), F.lit("GCM"), F.lit("DEFAULT"), F.encode("id", "utf-8")), "utf-8").alias("content"))


def unsealed_gone(mirror: DataFrame, live: DataFrame) -> DataFrame:
    """Ciphertexts whose plain record is gone; to be removed."""
    return mirror.join(live.select("id"), "id", "left_anti")
