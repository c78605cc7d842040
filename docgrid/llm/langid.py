"""Language identification by hierarchical discrimination.

First the language family, then the language within it: between each two families, and between
each two languages of a family, stands a linear support vector machine; votes decide, margins
break ties. Features are byte n-grams of the letters of the whole text in lower case, hashed, square-rooted
and scaled to length 1. The machines are trained by dual coordinate descent on the driver, over a
sample of labelled rows of at most about ``SAMPLE`` a language, drawn by a hash of key and text.

Defined cases: ``und`` with score 0 for a null text and one without a letter, and for all texts when
nothing is labelled; with one learned language every text with a letter is that language, score 1; a
null key is never learned from and not held out; null languages teach nothing; languages outside
the table below are families of their own; repeated rows each get a result; an empty table gives
no rows; only key, text and (for learning) language are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "celtic": "ga gd cy br",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
    "sinitic": "zh",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
UNDECIDED = "und"
#: Labelled rows a language that the machines learn from, feature buckets, n-gram sizes in bytes.
SAMPLE, BUCKETS, SIZES = 400, 1 << 14, (1, 2, 3, 4)
_SLICE, _ROWS = 500_000, 64


def letters(text: Column) -> Column:
    """A text's letters in lower case, all else as single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each run of ``n`` bytes."""
    m = len(data) - n + 1
    h = np.zeros(m, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + data[k : k + m].astype(np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
    return (h ^ (h >> np.uint32(12))) % BUCKETS


def features(texts: list[bytes], piece: int = _SLICE) -> np.ndarray:
    """Rows of hashed n-gram features of ``letters``, of length 1 (0 for a text without letters).

    A text counts as a whole between two spaces; it is read in pieces that overlap by what an
    n-gram needs, and each n-gram is counted in one of them.
    """
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        text = text.strip(b" ")
        if not text:
            continue
        data, counts = np.frombuffer(b" " + text + b" ", np.uint8), np.zeros(BUCKETS)
        for a in range(0, len(data), piece):
            for n in SIZES:
                part = data[a : a + piece + n - 1]
                if len(part) >= n:
                    counts += np.bincount(_grams(part, n), minlength=BUCKETS)
        row = np.sqrt(counts)
        out[i] = row / np.linalg.norm(row)
    return out


#: A row of features that are not 0: buckets and values.
Sparse = tuple[np.ndarray, np.ndarray]


def train_svm(x: list[Sparse], y: np.ndarray, c: float = 10.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine for labels 1 and -1, squared hinge loss, dual coordinate descent."""
    w, alpha, rng = np.zeros(BUCKETS), np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([v @ v for _, v in x]) + 0.5 / c
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, value = x[i]
            g = y[i] * (value @ w[at]) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * value
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Node:
    """Machines between each two classes."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def fit(self, x: list[Sparse], labels: np.ndarray) -> Node:
        columns = []
        for a, b in combinations(range(len(self.names)), 2):
            own = np.flatnonzero((labels == self.names[a]) | (labels == self.names[b]))
            columns.append(train_svm([x[i] for i in own], np.where(labels[own] == self.names[a], 1.0, -1.0)))
            self.pairs.append((a, b))
        self.weights = np.stack(columns, 1).astype(np.float32) if columns else None
        return self

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner of each row and how sure its closest contest was (0.5 to 1, or less when it lost one)."""
        if self.weights is None:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights
        votes, total = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margin[:, k] > 0
            votes[:, b] += margin[:, k] <= 0
            total[:, a] += margin[:, k]
            total[:, b] -= margin[:, k]
        win = np.argmax(votes + 0.4 * np.tanh(total / len(self.names)), axis=1)
        sure = np.ones(len(x))
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-3.0 * margin[:, k]))
            sure = np.minimum(sure, np.where(win == a, p, np.where(win == b, 1 - p, 1.0)))
        return win, sure


@dataclass
class Model:
    families: Node
    languages: list[Node]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.families.decide(x)
        names = [""] * len(x)
        for f, node in enumerate(self.languages):
            own = np.flatnonzero(family == f)
            if len(own):
                win, sure = node.decide(x[own])
                score[own] *= sure
                for i, w in zip(own, win, strict=True):
                    names[i] = node.names[w]
        return names, score


def train(x: list[Sparse], labels: np.ndarray) -> Model | None:
    """A model of rows of features and their languages."""
    if not x:
        return None
    by_family = defaultdict(list)
    for lang in sorted(set(labels.tolist())):
        by_family[FAMILY.get(lang, f"only {lang}")].append(lang)
    family = np.array([FAMILY.get(lang, f"only {lang}") for lang in labels])
    names = sorted(by_family)
    return Model(Node(names).fit(x, family), [Node(by_family[f]).fit([x[i] for i in np.flatnonzero(family == f)], labels[family == f]) for f in names])


def held_out(key: str):
    """The rows that are kept from learning: the remainder 2 of the key's checksum by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(l, at, value): the features that are not 0, by bucket, as bytes."""
    for frame in frames:
        rows = []
        for a in range(0, len(frame), _ROWS):
            part = frame.iloc[a : a + _ROWS]
            for lang, x in zip(part["l"], features([t.encode() for t in part["t"]]), strict=True):
                at = np.flatnonzero(x)
                rows.append((lang, at.astype(np.uint16).tobytes(), x[at].tobytes()))
        yield pd.DataFrame(rows, columns=["l", "at", "value"])


def learn(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Train on about ``sample`` different rows a language that have letters and are not held out.

    Texts stay on the executors, which send the features of the sample: at most BUCKETS numbers a row.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 40)).alias("u"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, sample / n)))
    some = rows.filter(F.col("u") / F.lit(float(1 << 40)) < F.element_at(share, F.col("l"))).dropDuplicates(["l", "u"])
    some = some.select("l", letters(F.col("t")).alias("t")).mapInPandas(_sparse, "l string, at binary, value binary")
    found = sorted((r["l"], bytes(r["at"]), bytes(r["value"])) for r in some.collect())
    rows = [(np.frombuffer(at, np.uint16).astype(np.int32), np.frombuffer(value, np.float32).astype(np.float64)) for _, at, value in found]
    return train(rows, np.array([lang for lang, _, _ in found]))


def identify(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``df``: id, held_out, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            ok = frame["ok"].to_numpy(bool) & (model is not None)
            names, score = np.full(len(frame), UNDECIDED, object), np.zeros(len(frame))
            rows = np.flatnonzero(ok)
            for a in range(0, len(rows), _ROWS):
                part = rows[a : a + _ROWS]
                names[part], score[part] = model.predict(features([t.encode() for t in frame["text"].to_numpy()[part]]))
            yield pd.DataFrame({"id": frame["id"], "held_out": frame["held_out"], "lang_pred": names, "score": np.clip(score, 0, 1)})

    base = df.select(F.col(id_col).cast("string").alias("id"), letters(F.col(text_col)).alias("text"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("ok"))
    out = base.mapInPandas(predict, "id string, held_out boolean, lang_pred string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that have a letter, all columns and lang_pred and score, which replace columns of these names.

    No score is too low to stay: what a low one means is for those who read it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in texts:
            names, score, values = np.full(len(s), UNDECIDED, object), np.zeros(len(s)), s.to_numpy()
            for a in range(0, len(s) if model is not None else 0, _ROWS):
                names[a : a + _ROWS], score[a : a + _ROWS] = model.predict(features([t.encode() if isinstance(t, str) else b"" for t in values[a : a + _ROWS]]))
            yield pd.DataFrame({"lang_pred": names, "score": np.clip(score, 0, 1)})

    rows = df.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).withColumn("_told", told(letters(F.col(text_col))))
    return rows.withColumns({c: F.col("_told")[c] for c in ("lang_pred", "score")}).drop("_told")
