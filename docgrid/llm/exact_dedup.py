"""Exact dedup by skew-safe combining, comparing full content at every stage.

1. Locally: each task folds equal texts of its own rows together, in windows of bounded memory.
2. Salted: the local winners of a digest meet in groups of digest and salt; only digests with
   many rows get salts, and at most ``HOT_LIST`` of them can exist.
3. Globally: salt winners of those digests meet by digest.

Two texts are equal when they are identical without white space; the digest only brings them
together, the text itself is compared. Copies never travel: a local winner carries the ids of the
rows it stands for, of one window at most.

Defined cases: null is the empty text; of equal texts the one with the most code points before
normalising, then the smallest id, stays (a null id comes last); of rows equal in all that, each
is returned with the same result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm.common import SPACE, cut

#: Bytes of text, and rows, that one task keeps before it hands on its local winners.
WINDOW_BYTES, WINDOW_ROWS = 32_000_000, 100_000
#: Local winners from which a digest is salted, the salts, and the most digests that can be so.
HOT_ROWS, SALTS, HOT_LIST = 2_000, 16, 100_000


def _fold(id_type: pa.DataType):
    schema = pa.schema([("sha", pa.string()), ("norm", pa.string()), ("members", pa.list_(id_type)), ("best_n", pa.int64()), ("best_id", id_type)])

    def emit(groups: dict) -> Iterator[pa.RecordBatch]:
        rows = [(sha, *g) for sha, held in groups.items() for g in held]
        at = 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end][1]) < 4_000_000):
                size += len(rows[end][1])
                end += 1
            part = rows[at:end]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], type=schema.field(k).type) for k in range(5)], schema=schema)
            at = end

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, list] = {}
        kept = rows = 0
        for batch in batches:
            ids, shas, norms, sizes = (c.to_pylist() for c in batch.columns)
            for i, sha, norm, n in zip(ids, shas, norms, sizes, strict=True):
                held = groups.setdefault(sha, [])
                for g in held:
                    if g[0] == norm:
                        g[1].append(i)
                        if n > g[2] or n == g[2] and i is not None and (g[3] is None or i < g[3]):
                            g[2:] = [n, i]
                        break
                else:
                    held.append([norm, [i], n, i])
                    kept += len(norm)
                rows += 1
                if kept >= WINDOW_BYTES or rows >= WINDOW_ROWS:
                    yield from emit(groups)
                    groups, kept, rows = {}, 0, 0
        yield from emit(groups)

    return fold


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_field = df.schema[id_col].dataType
    base = df.select(F.col(id_col).alias("id"), F.regexp_replace(text, f"[{SPACE}]+", "").alias("norm"), F.char_length(text).cast("long").alias("n"))
    base = base.select("id", F.sha2("norm", 256).alias("sha"), "norm", "n")

    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("sha", T.StringType()), ("norm", T.StringType()), ("members", T.ArrayType(id_field)), ("best_n", T.LongType()), ("best_id", id_field)]
    local = cut(base.mapInArrow(_fold(to_arrow_type(id_field)), T.StructType([T.StructField(*f) for f in fields])))
    counts = cut(local.groupBy("sha").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_ROWS))
    rows = counts.agg(F.sum("c")).first()[0] or 0
    hot = counts.filter(F.col("c") > rows / HOT_LIST).select("sha", F.lit(True).alias("hot"))  # fewer than HOT_LIST rows
    local = local.join(F.broadcast(hot), "sha", "left")
    local = local.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("best_id", "best_n", F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0))

    first = [F.col("best_n").desc(), F.col("best_id").asc_nulls_last()]
    same = W.partitionBy("sha", "salt", "norm").orderBy(*first)
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = local.withColumns({"rn": F.row_number().over(same), "top": F.first(F.struct("best_n", "best_id")).over(whole), "total": F.sum(F.size("members").cast("long")).over(whole)})
    local = cut(local.select("sha", "salt", F.coalesce("hot", F.lit(False)).alias("hot"), "members", "rn", "top", "total", F.when(F.col("hot") & (F.col("rn") == 1), F.col("norm")).alias("norm")))

    top = local.filter(F.col("norm").isNotNull()).select("sha", "salt", "norm", "total", F.col("top").alias("s_top"), F.col("top.best_n").alias("best_n"), F.col("top.best_id").alias("best_id"))
    over = W.partitionBy("sha", "norm").orderBy(*first).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    top = top.select("sha", "salt", "s_top", F.first(F.struct("best_n", "best_id")).over(over).alias("top"), F.sum("total").over(over).alias("total"))

    cold = local.filter(~F.col("hot")).select("sha", "members", F.col("top.best_id").alias("keep_id"), "total")
    warm = local.filter("hot").withColumnRenamed("top", "s_top").select("sha", "salt", "s_top", "members")
    warm = warm.join(top, (warm.sha == top.sha) & (warm.salt == top.salt) & warm.s_top.eqNullSafe(top.s_top)).select(warm.sha, "members", F.col("top.best_id").alias("keep_id"), "total")
    out = cold.unionByName(warm).select(F.explode("members").alias(id_col), "keep_id", F.col("total").alias("group_size"), "sha")
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns: the one that ``exact_duplicates`` keeps."""
    keep = exact_duplicates(df, id_col=id_col, text_col=text_col).filter("kept").select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_of")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), F.sha2(F.regexp_replace(text, f"[{SPACE}]+", ""), 256).alias("_sha"), F.struct(F.char_length(text), F.xxhash64(text)).alias("_n"))
    rows = rows.join(keep, (F.col("_sha") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_keep")))
    # rows of one id and digest: the longest of them; equal ones as one
    return rows.groupBy("_sha").agg(F.max_by("_row", "_n").alias("_row")).select("_row.*")
