"""Near-duplicate detection by DartMinHash signatures and banded joins.

A document is the set of its five-word shingles, each weighted by its count (or of weight 1).
Every element throws darts: over the region of its weight axis from 2^v - 1 to 2^(v+1) - 1 they
arrive along the rank axis as a Poisson process of rate 2^v, from hashes of element, region and
arrival alone, so that all documents see the same darts. A dart hits if its height lies below the
element's weight; it falls on one of ``COORDINATES`` coordinates, and the hit of the lowest rank
is that coordinate's value. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Ranks are looked at up to a bound by the document's total weight,
about k ln k + 2k hits whatever its size, and further only while a coordinate is empty.

Bands of ``ROWS`` coordinates, together with the size class of the set, bring candidates together:
sets that are similar enough differ in size by less than one class, and each stands in its own and
the next. Buckets of the same members are one. Within a bucket one member, the pivot, is compared with
all, and so is every member that it is not linked to; what is left are pairs that are in one group
already. A bucket of one block is decided in one task. Of a larger one, each block meets the pivot
alone, and only the members that are not linked to it meet all blocks, in blocks themselves: a bucket
of n members of which u are not like the pivot costs n (1 + u / BLOCK) texts. Links, which are exact,
are closed to groups by their least digest.

Copies of a text (equal words) are one node, named by a digest of their words: each row is signed,
but one of them stands for all in buckets, links and groups.

Defined cases: a text under five words is one shingle; a text without words (or null) is linked
to nothing; words are compared in lower case between white space; a null id comes last and is the
class of another row only where all ids of its group are null; rows of one id and different texts are
different documents; rows with equal id and text share a result, and ``drop_near_duplicates`` keeps one
of them; an empty table gives no rows; only id and text are read, other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import cut, mix, shingle_hashes, slices, unit, word_hashes

COORDINATES, ROWS = 125, 5
SHINGLE, SIMILARITY = 5, 0.8
#: Members, and bytes of text, of a block.
BLOCK, BLOCK_BYTES = 500, 8_000_000


def _chain(x: np.ndarray, *salts: int) -> np.ndarray:
    for s in salts:
        x = mix(x + np.uint64(pow(0xD6E8FEB86659FD93, s + 2, 1 << 64)))
    return x


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures of ``n`` weighted sets, one row each; ``owner`` says whose an element is.

    Every set must have an element of positive weight.
    """
    total = np.bincount(owner, weight, n)
    bound = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    value = np.zeros((n, k), np.uint64)
    todo = np.ones(n, bool)
    while todo.any():
        best = np.full(n * k, np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for v in range(int(np.log2(weight.max() + 1)) + 1 if len(weight) else 0):
            base, rate = float(2**v - 1), float(2**v)
            live = np.flatnonzero((weight > base) & todo[owner])
            key, who, top = _chain(element[live], v), owner[live], weight[live]
            rank, arrival = np.zeros(len(live)), 0
            while len(key):
                dart = _chain(key, arrival)
                rank = rank - np.log(unit(dart)) / rate
                on = rank < bound[who]
                key, who, top, rank, dart = key[on], who[on], top[on], rank[on], dart[on]
                hit = base + rate * unit(_chain(dart, 1)) < top if v or weight.max() != 1 else slice(None)
                hits.append((who[hit] * k + (_chain(dart[hit], 2) % np.uint64(k)).astype(np.int64), rank[hit], dart[hit]))
                arrival += 1
        if hits:
            slot, rank, dart = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(-rank, kind="stable")
            best[slot[order]] = rank[order]
            value.reshape(-1)[slot[order]] = dart[order]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        bound = np.where(todo, bound * 2, bound)
    return value


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signature.shape
    out = np.zeros((n, k // rows), np.uint64)
    parts = signature.reshape(n, k // rows, rows)
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return out.view(np.int64)


def _sign(k: int, rows: int, n_words: int, weighting: str):
    """A row a row: id and text hash; digest, size and bands are null for a text without words."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, hashes, texts = frame["id"].tolist(), frame["th"].tolist(), [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]
            for a, b in slices(texts):
                words, at = word_hashes(texts[a:b])
                owner, elements, weights, digests, sizes = [], [], [], [None] * (b - a), [None] * (b - a)
                signed = [i for i in range(b - a) if at[i + 1] > at[i]]
                for n, i in enumerate(signed):
                    own = words[at[i] : at[i + 1]]
                    el, count = np.unique(shingle_hashes(own, n_words), return_counts=True)
                    owner.append(np.full(len(el), n))
                    elements.append(el)
                    weights.append(count.astype(float) if weighting == "count" else np.ones(len(el)))
                    sizes[i] = float(weights[-1].sum())
                    digests[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                found: list = [None] * (b - a)
                if signed:
                    sig = bands(dart_signatures(np.concatenate(owner), np.concatenate(elements), np.concatenate(weights), len(signed), k), rows)
                    for n, i in enumerate(signed):
                        found[i] = sig[n]
                yield pd.DataFrame({"id": pd.Series(ids[a:b], dtype=object), "th": hashes[a:b], "digest": digests, "size": sizes, "bands": found})

    return sign


class Similar:
    """Weighted Jaccard similarities among sets of (elements, counts), by an index of who holds an element."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n), [len(e) for e, _ in sets])
        values, self.code = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
        self.count = np.concatenate([c for _, c in sets]).astype(np.int64)
        order = np.argsort(self.code, kind="stable")
        self.held_by, self.held = owner[order], self.count[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.code, minlength=len(values)))])
        self.first = np.concatenate([[0], np.cumsum([len(e) for e, _ in sets])])
        self.total = np.bincount(owner, self.count, self.n)

    def to(self, x: int) -> np.ndarray:
        """The similarity of each set to set ``x``."""
        own, mine = self.code[self.first[x] : self.first[x + 1]], self.count[self.first[x] : self.first[x + 1]]
        lo, m = self.start[own], self.start[own + 1] - self.start[own]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        both = np.bincount(self.held_by[at], np.minimum(self.held[at], np.repeat(mine, m)), self.n)
        return both / (self.total[x] + self.total - both)


class Forest:
    """Which sets are already held together by links."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart until now."""
        x, y = self.top(x), self.top(y)
        self.parent[y] = x
        return x != y


def link(sets: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int, float]]:
    """A spanning forest of the pairs of (elements, counts) whose Jaccard similarity is ``least`` or more."""
    similar, forest = Similar(sets), Forest(len(sets))
    out, seed = [], similar.to(0)
    for x in [0, *np.flatnonzero(seed < least).tolist()]:
        row = similar.to(x) if x else seed
        out += [(x, y, float(row[y])) for y in np.flatnonzero(row >= least).tolist() if forest.join(x, y)]
    return out


def _sets(frame: pd.DataFrame, n_words: int, weighting: str) -> list[tuple[np.ndarray, np.ndarray]]:
    words, at = word_hashes([t.encode() for t in frame["text"]])
    sets = []
    for i in range(len(frame)):
        el, count = np.unique(shingle_hashes(words[at[i] : at[i + 1]], n_words), return_counts=True)
        sets.append((el, count if weighting == "count" else np.ones(len(el), np.int64)))
    return sets


def _link(n_words: int, least: float, weighting: str):
    """Links within a bucket of one block; the rows are distinct by digest."""

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("digest").sort_values("digest")
        ids = frame["digest"].tolist()
        return pd.DataFrame([(ids[x], ids[y], s) for x, y, s in link(_sets(frame, n_words, weighting), least)], columns=["a", "b", "similarity"])

    return linked


def _against(n_words: int, least: float, weighting: str):
    """Each member of a block against the given few (``asks``): a spanning forest of their links, and members that none of them is like as (digest, null, null)."""

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["digest", "asks"]).sort_values(["digest", "asks"])
        similar, ids, asks = Similar(_sets(frame, n_words, weighting)), frame["digest"].tolist(), frame["asks"].to_numpy(bool)
        out, alone, forest, first = [], ~asks, Forest(len(ids)), {}
        for i, name in enumerate(ids):  # who asks and is asked is one
            forest.join(first.setdefault(name, i), i)
        for i in np.flatnonzero(asks).tolist():
            row = similar.to(i)
            for j in np.flatnonzero((row >= least) & ~asks).tolist():
                alone[j] = False
                if forest.join(i, j):
                    out.append((ids[i], ids[j], float(row[j])))
        out += [(ids[j], None, None) for j in np.flatnonzero(alone).tolist()]
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return met


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id that each id of ``links`` (a, b) is connected with.

    Alternates large and small stars; each round is cut, and sums decide when it stands still.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small)
        state = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (edges, after)]
        edges = after
        if state[0] == state[1]:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE, similarity: float = SIMILARITY, k: int = COORDINATES, rows: int = ROWS, weighting: str = "count") -> tuple[DataFrame, DataFrame]:
    """Classes and links.

    Classes: one row a row of ``df``: id, class_id (the least id of its group), class_size, kept.
    Links: (a, b, similarity) between different texts, each by the least id of its copies; they
    hold the groups together, and need not be all pairs within one.
    """
    signed, nodes, links = _grouped(df, id_col, text_col, n_words, similarity, k, rows, weighting)
    nodes = nodes.select(F.col("digest").alias("_d"), "class", "class_size")
    out = signed.select("id", "th", "digest").join(nodes, F.col("digest") == F.col("_d"), "left")
    one = F.lit(1).cast("long")
    alone = F.col("class").isNull()
    out = out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class.id")).alias("class_id"), F.coalesce("class_size", one).alias("class_size"),
        (alone | (F.col("id").eqNullSafe(F.col("class.id")) & (F.col("th") == F.col("class.th")))).alias("kept"),
    )
    names = nodes_of(signed).select("digest", F.col("rep.id").alias("id"))
    links = links.join(names.withColumnsRenamed({"digest": "a", "id": "_a"}), "a").join(names.withColumnsRenamed({"digest": "b", "id": "_b"}), "b")
    return out, links.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity")


def nodes_of(signed: DataFrame) -> DataFrame:
    """(digest, rep, copies, size, bands): the least row of each digest stands for it."""
    first = F.struct(F.col("id").isNull().alias("null"), "id", "th")
    return signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))


def _grouped(df: DataFrame, id_col: str, text_col: str, n_words: int, similarity: float, k: int, rows: int, weighting: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, th, digest, ...) of each row; (digest, class, class_size) of each node in a group of rows; the links between digests."""
    kind = df.schema[id_col].dataType
    base = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    text_id = base.select(F.col("id").cast("string").alias("id"), "th", "text")
    signed = text_id.mapInPandas(_sign(k, rows, n_words, weighting), "id string, th long, digest binary, size double, bands array<bigint>")
    signed = cut(signed.withColumn("id", F.col("id").cast(kind)))

    nodes = cut(nodes_of(signed))
    own = F.floor(F.log("size") / F.lit(-math.log(similarity))).cast("int")
    band = nodes.select(F.col("digest"), own.alias("own"), F.posexplode("bands").alias("band", "hash")).select("digest", "own", F.xxhash64("band", "hash").alias("b"))
    shared = band.groupBy("b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("b")
    band = cut(band.join(shared, "b").select("b", "digest", F.explode(F.array("own", F.col("own") + 1)).alias("bin")))
    # the members of a bucket as one value: buckets of equal members are equal
    members = band.groupBy("b", "bin").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"), F.min("digest").alias("pivot")).filter("n > 1")
    buckets = band.join(members, ["b", "bin"]).select(F.xxhash64("n", "x", "y").alias("key"), "n", "bin", "digest", "pivot").groupBy("key", "n", "pivot", "digest").agg(F.max("bin").alias("bin"))
    held = F.greatest(F.lit(8), F.least(F.lit(BLOCK), (F.lit(float(BLOCK_BYTES)) / (F.pow(F.lit(1 / similarity), "bin") * 8)).cast("int")))
    buckets = cut(buckets.withColumns({"held": held, "g": F.ceil(F.col("n") / held).cast("int")}).drop("n"))

    needed = buckets.select("digest").distinct().join(nodes.select("digest", "rep.id", "rep.th"), "digest").select("digest", F.col("id").alias("_i"), F.col("th").alias("_t"))
    texts = base.join(needed, (F.col("th") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_i")))
    texts = cut(texts.groupBy("digest").agg(F.first("text").alias("text")))
    result = "a binary, b binary, similarity double"
    small = buckets.filter("g = 1").select("key", "digest").join(texts, "digest")
    found = small.groupBy("key").applyInPandas(_link(n_words, similarity, weighting), result)

    large = buckets.filter("g > 1").withColumn("part", F.pmod(F.xxhash64("digest", "key"), F.col("g")).cast("int")).select("key", "digest", "pivot", "held", "g", "part")
    parts = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part")
    pivots = large.filter("digest = pivot").select("key", "digest", parts, F.lit(0).alias("few"), F.lit(True).alias("asks"))
    met = pivots.unionByName(large.select("key", "digest", "part", F.lit(0).alias("few"), F.lit(False).alias("asks"))).join(texts, "digest")
    star = cut(met.groupBy("key", "part", "few").applyInPandas(_keyed(_against(n_words, similarity, weighting)), f"key bigint, {result}"))
    found = found.unionByName(star.filter("b is not null").select("a", "b", "similarity"))
    # members that are not like the pivot meet all blocks, in blocks of their own
    unlike = star.filter("b is null").select("key", F.col("a").alias("digest"))
    sizes = unlike.groupBy("key").agg(F.count(F.lit(1)).alias("u")).join(large.select("key", "held", "g").distinct(), "key").withColumn("f", F.ceil(F.col("u") / F.col("held")).cast("int"))
    askers = unlike.join(sizes, "key").withColumn("few", F.pmod(F.xxhash64("digest", F.lit(7)), F.col("f")).cast("int")).select("key", "digest", parts, "few", F.lit(True).alias("asks"))
    asked = large.select("key", "digest", "part").join(sizes.select("key", "f"), "key").select("key", "digest", "part", F.explode(F.sequence(F.lit(0), F.col("f") - 1)).alias("few"), F.lit(False).alias("asks"))
    rest = askers.unionByName(asked).join(texts, "digest").groupBy("key", "part", "few").applyInPandas(_against(n_words, similarity, weighting), result)
    found = found.unionByName(rest.filter("b is not null"))

    links = cut(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first("similarity").alias("similarity")))
    labels = components(links).withColumnRenamed("id", "_d")
    classes = nodes.select("digest", "rep", "copies").join(labels, F.col("digest") == F.col("_d"), "left").select("digest", "rep", "copies", F.coalesce("label", "digest").alias("label"))
    groups = classes.groupBy("label").agg(F.min("rep").alias("class"), F.sum("copies").alias("class_size"))
    return signed, classes.select("digest", "label").join(groups, "label").select("digest", "class", "class_size"), links


def _keyed(met):
    def with_key(key, frame: pd.DataFrame) -> pd.DataFrame:
        out = met(frame)
        out.insert(0, "key", key[0])
        return out

    return with_key


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE, similarity: float = SIMILARITY, k: int = COORDINATES, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """One row of each group, with all columns: that of the least id; all rows without words."""
    signed, nodes, _ = _grouped(df, id_col, text_col, n_words, similarity, k, rows, weighting)
    gone = signed.select("id", "th", "digest").join(nodes.withColumnRenamed("digest", "_d"), F.col("digest") == F.col("_d"))
    gone = gone.filter(~(F.col("id").eqNullSafe(F.col("class.id")) & (F.col("th") == F.col("class.th")))).select(F.col("id").alias("_i"), F.col("th").alias("_t")).distinct()
    # rows that stay and are equal in id and text, as one
    twice = signed.filter(F.col("digest").isNotNull()).groupBy("id", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("id").alias("_i2"), F.col("th").alias("_t2"))
    rest = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    rest = rest.join(gone, (F.col("_th") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_i")), "left_anti")
    rest = rest.join(twice, (F.col("_th") == F.col("_t2")) & F.col("_id").eqNullSafe(F.col("_i2")), "left")
    one = rest.filter(F.col("_t2").isNotNull()).groupBy("_id", "_th").agg(F.first("_row").alias("_row")).select("_row.*")
    return rest.filter(F.col("_t2").isNull()).select("_row.*").unionByName(one)
