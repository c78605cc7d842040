"""Shards by rendezvous hashing of stable record keys over weighted shards.

Each key ranks all shards by ``-weight / ln(u(key, shard))`` and goes to the first. A shard that
is added only takes keys to itself, one that goes only gives its own away, and a changed weight
moves keys to or from that shard alone. The law is ``key``: key and shards decide, nothing else.

Defined cases: a null key hashes as one fixed text; rows with equal keys share a shard; a null
text has 0 bytes and the checksum of the empty text; an empty table gives no rows; columns of
the input beside key and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.llm.common import row_key

#: Slots are counted in this many ranges of each shard; a range holds 1 / BUCKETS of its rows.
BUCKETS = 4096


def score(key: Column, shard: int, weight: float) -> Column:
    h = F.xxhash64(F.concat(key, F.lit(f"#{shard}")))
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.lit(float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of ``key``: the one with the greatest score; the smaller number wins ties."""
    alive = {s: w for s, w in weights.items() if w > 0}
    if not alive:
        raise ValueError("no shard has a positive weight")
    best = F.greatest(*(F.struct(score(key, s, w).alias("v"), F.lit(-s).alias("s")) for s, w in alive.items())) if len(alive) > 1 else None
    return F.lit(next(iter(alive))).cast("int") if best is None else (-best["s"]).cast("int")


def assign_shards(df: DataFrame, shards: int | Sequence[float] = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``shards`` is a count or a list of weights; ``grown_shard`` is the shard with one more of
    weight 1. Slots are gapless from 0 within a shard, in the order of a hash of the key: equal
    rows are counted before they are ordered, each range of hashes is ordered by itself, and
    only the ranges' sizes are summed up over a shard.
    """
    weights = dict(enumerate([1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = row_key("_id")
    base = df.select(F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = (
        base.groupBy("_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"shard": rendezvous(key, weights), "grown_shard": rendezvous(key, weights | {len(weights): 1.0}), "_h": F.xxhash64(key)})
        .withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 32), F.lit(BUCKETS)).cast("int"))
    )
    ranges = rows.groupBy("shard", "_b").agg(F.sum("_n").alias("_m"))
    ranges = ranges.select("shard", "_b", (F.sum("_m").over(W.partitionBy("shard").orderBy("_b")) - F.col("_m")).alias("_from"))
    own = W.partitionBy("shard", "_b").orderBy("_h", "_id", "size", "text_crc32")
    rows = rows.withColumn("_at", F.sum("_n").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    rows = rows.join(ranges, ["shard", "_b"])
    # copies of a row, in two steps so that no array grows with their number
    rows = rows.withColumn("_hi", F.explode(F.sequence(F.lit(0), F.expr("(_n - 1) div 10000"))))
    rows = rows.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.least(F.lit(9999).cast("long"), F.col("_n") - 1 - F.col("_hi") * 10000).cast("int"))))
    return rows.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_from") + F.col("_at") + F.col("_hi") * 10000 + F.col("_lo")).cast("long").alias("slot"), "grown_shard",
    )


def shard_documents(df: DataFrame, shards: int | Sequence[float] = 8, *, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``df`` with shard and grown_shard, without a shuffle; such columns of the input are replaced."""
    weights = dict(enumerate([1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]))
    key = row_key(id_col)
    shard, grown = rendezvous(key, weights), rendezvous(key, weights | {len(weights): 1.0})
    return df.select(*(F.col(c) for c in df.columns if c not in ("shard", "grown_shard")), shard.alias("shard"), grown.alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int | Sequence[float] = 8, *, id_col: str = "doc_id", files: int = 16) -> None:
    """Write all columns of ``df`` under ``path/shard=k``, each shard in up to ``files`` files.

    Rows are dealt by shard and a hash of the key, so that no task holds a whole shard.
    """
    out = shard_documents(df, shards, id_col=id_col).drop("grown_shard")
    out.repartition("shard", F.pmod(F.xxhash64(row_key(id_col)), F.lit(files))).write.partitionBy("shard").parquet(path)
