"""Mixing sources to target weights under a time-varying curriculum.

Each source has a schedule: a weight at knots of training time between 0 and 1, linear between
them. The schedule's integral gives the source's share of all words; the share up to time t is
the cumulative demand. A source's documents, in the order of a hash of their keys, lie end to end
on its demand, once more for each further pass; inverting the demand at the middle of a document
gives its training position, and documents are range-sorted by position. DataFrame functions only.

Defined cases: a null text has size 0, takes nothing and has no position; null is a source of its
own, the last; a source without words has target 0; equal rows are placed one after another; an
empty table gives no rows; the plan reads no other columns of the input, the mix passes them on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrid.llm.common import WORD, row_key

Knots = Sequence[tuple[float, float]]
#: Schedules that sources take in turn; their integrals are 3, 1 and 2.
CURRICULUM: tuple[Knots, ...] = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def _segments(knots: Knots) -> Column:
    """The schedule's pieces, normalised: from time t, weights a to b over d, demand c before."""
    whole, done, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 > t0 and w0 + w1 > 0:
            part = (t1 - t0) * (w0 + w1) / 2 / whole
            out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("t", t0), ("d", t1 - t0), ("a", w0 / whole), ("b", w1 / whole), ("c", done), ("e", done + part)))))
            done += part
    return F.array(*out)


def position(share: Column, number: Column, curriculum: Sequence[Knots] = CURRICULUM) -> Column:
    """The time by which a source has had ``share`` (0 to 1) of its demand."""
    pieces = F.element_at(F.array(*(_segments(k) for k in curriculum)), (number % len(curriculum) + 1).cast("int"))
    s = F.coalesce(F.get(F.filter(pieces, lambda p: p["e"] >= share), F.lit(0)), F.element_at(pieces, -1))
    left, slope = share - s["c"], (s["b"] - s["a"]) / s["d"]
    return s["t"] + F.lit(2.0) * left / (s["a"] + F.sqrt(F.greatest(F.lit(0.0), s["a"] * s["a"] + F.lit(2.0) * slope * left)))


def source_targets(sizes: DataFrame, curriculum: Sequence[Knots] = CURRICULUM, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size); adds number and target.

    Weights go round the sources in code-point order. Resharing what is above ``most`` times a
    source's size fills the sources in the order of size over weight, each to the brim, until
    the rest need less than they have. One row a source: the only windows without a key here.
    """
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weights = F.array(*(F.lit(float(integral(k))) for k in curriculum))
    s = sizes.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("_w", F.element_at(weights, (F.col("number") % len(curriculum) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = W.orderBy((F.col("_cap") / F.col("_w")), "number").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "_all": F.sum("source_size").over(everything) * F.lit(float(share)), "_ws": F.sum("_w").over(everything),
        "_c": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_v": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("_full", F.col("_cap") * (F.col("_ws") - F.col("_v")) <= F.col("_w") * (F.col("_all") - F.col("_c")))
    s = s.withColumns({"_fc": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything), "_fw": F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0)).over(everything)})
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * (F.col("_all") - F.col("_fc")) / (F.col("_ws") - F.col("_fw")))
    return s.select("source", "source_size", "number", target.alias("target"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _place(base: DataFrame, keys: Sequence[str], curriculum: Sequence[Knots], share: float, passes: int) -> DataFrame:
    """``base`` (_id, source, size and ``keys``), a row each, with source_size, target, takes and places.

    Equal rows are counted before they are ordered. Hot sources are split into ranges of their
    hashes: only range sums meet in one place.
    """
    docs = base.groupBy("_id", "source", "size", *keys).agg(F.count(F.lit(1)).alias("_n"))
    docs = docs.withColumn("_h", F.md5(row_key("_id").cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    ranges = docs.groupBy("source", "_b").agg(F.sum(F.col("size") * F.col("_n")).alias("_m"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_m").alias("source_size")), curriculum, share, float(passes))
    ranges = ranges.select("source", "_b", (F.sum("_m").over(W.partitionBy("source").orderBy("_b")) - F.col("_m")).alias("_from"))
    ranges = ranges.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    own = W.partitionBy("source", "_b").orderBy("_h", "_id", "size", *keys).rowsBetween(W.unboundedPreceding, 0)
    docs = docs.withColumn("_at", F.sum(F.col("size") * F.col("_n")).over(own) - F.col("size") * F.col("_n"))
    ranges = ranges.withColumnsRenamed({"source": "_s", "_b": "_r"})
    docs = docs.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_r")))
    docs = docs.withColumn("_hi", F.explode(F.sequence(F.lit(0), F.expr("(_n - 1) div 10000"))))
    docs = docs.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.least(F.lit(9999).cast("long"), F.col("_n") - 1 - F.col("_hi") * 10000).cast("int"))))
    docs = docs.withColumn("_at", F.col("_from") + F.col("_at") + (F.col("_hi") * 10000 + F.col("_lo")) * F.col("size"))
    words = F.round("target").cast("long")
    takes, places = [], []
    for k in range(passes):
        at = F.col("_at") + F.col("source_size") * k
        take = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - at))
        takes.append(take)
        middle = (at.cast("double") + take / F.lit(2.0)) / F.col("target")
        places.append(F.when(take > 0, position(F.least(F.lit(1.0), middle), F.col("number"), curriculum)))
    return docs.withColumns({"takes": F.array(*takes), "places": F.array(*places)})


def plan_mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum: Sequence[Knots] = CURRICULUM, share: float = 1.5, passes: int = 2, sort: bool = True) -> DataFrame:
    """One row a row of ``df``, by position: id, size, source_size, target, taken, takes, places, position.

    ``takes`` and ``places`` hold the words taken and the position of each pass (null place:
    nothing taken). The last document a source's demand reaches is cut to the words it still needs.
    """
    base = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"))
    docs = _place(base, [], curriculum, share, passes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + t)
    out = docs.select(F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "takes", "places", F.get("places", F.lit(0)).alias("position"))
    if not sort:
        return out
    by = [F.col("position").asc_nulls_last(), F.col(id_col).asc_nulls_last()]
    return out.repartitionByRange(*by).sortWithinPartitions(*by)


def mix_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum: Sequence[Knots] = CURRICULUM, share: float = 1.5, passes: int = 2) -> DataFrame:
    """The training order: the rows of ``df``, all columns, once for each pass that takes them.

    Whole documents go in, also the last that a source's demand reaches, so a source's words come
    to its target within one document. Rows that are equal in all columns travel as one, with the
    position of each pass of each of them. Columns of type map have no hash and are refused by Spark.
    """
    columns = [F.col(c) for c in df.columns]
    rows = df.select(F.struct(*columns).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(1), *columns).alias("_k2"))
    plan = _place(rows.drop("_row"), ["_k1", "_k2"], curriculum, share, passes)
    plan = plan.select("_k1", "_k2", F.col("_id").alias("_i"), F.explode(F.filter("places", lambda p: p.isNotNull())).alias("_t"))
    rows = rows.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    out = rows.join(plan, ["_k1", "_k2"])
    return out.repartitionByRange("_t", "_i", "_k1").sortWithinPartitions("_t", "_i", "_k1").select("_row.*")
