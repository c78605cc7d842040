"""Helpers shared by the operators: reading tables, cutting lineage, vectorised tokens."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_docgrid_shared"):
        spark.sparkContext._docgrid_shared = "file://" + tempfile.mkdtemp(prefix="docgrid-")
    return spark.sparkContext._docgrid_shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what is above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as ``cut`` gives it, in buckets by ``keys``, as many as shuffles have partitions.

    A join by all of the keys moves the other side only. Rows should come dealt by the keys, else each task writes to each bucket.
    """
    spark = df.sparkSession
    name = f"docgrid_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(shuffles(spark), *keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # read before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(c: str | Column) -> Column:
    """A text of a key that is never null, by which hashes are taken."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit("∅"))


# --- tokens by numpy -----------------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 20
_pow: np.ndarray | None = None
_inv: np.ndarray | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if _pow is None or len(_pow) < n:
        n = max(n, _STEP + 1024)
        p = np.full(n, np.uint64(_BASE), np.uint64)
        q = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)), np.uint64)
        p[0] = q[0] = 1
        _pow, _inv = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def _lookup(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    return low, sep


#: Words between white space, and words of letters and digits only (all but ASCII counts as letter).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())
_tables = {k: _lookup(k) for k in (SPACES, PUNCTUATION)}


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, for ASCII and Latin-1 letters."""
    out = _tables[SPACES][0][data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def _hash_slice(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, q = powers(len(low) + 1)
    c = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[: len(low)], dtype=np.uint64, out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all texts, and where each text's words begin.

    Works on slices of about a megabyte that end between words, so that memory follows the
    number of words, not a multiple of the bytes.
    """
    sep_of = _tables[separators][1]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    text_at = np.concatenate([[0], np.cumsum(lengths + 1)])
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + _STEP, len(data))
        while end < len(data) and not sep_of[data[end - 1]]:
            ahead = np.flatnonzero(sep_of[data[end : end + _STEP]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + _STEP, len(data))
        low = folded(data[at:end])
        edge = np.diff(np.concatenate([[True], sep_of[low], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes.append(_hash_slice(low, starts, ends))
        places.append(starts + at)
        at = end
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    first = np.searchsorted(place, text_at)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), first


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole, when it is shorter; none of nothing."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(out + np.uint64(n))


def slices(texts: list[bytes], most: int = 2_000_000):
    """Index ranges of ``texts`` of about ``most`` bytes each, one text at least."""
    at = 0
    while at < len(texts):
        end, total = at + 1, len(texts[at])
        while end < len(texts) and total + len(texts[end]) <= most:
            total += len(texts[end])
            end += 1
        yield at, end
        at = end
