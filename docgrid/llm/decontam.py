"""Benchmark decontamination by greedy string tiling.

Shared runs of five tokens are the seeds: an index of the benchmark's runs is joined to those of
each document. Where the seeds of an item cover enough of it, the item and the document are tiled:
running Karp-Rabin finds matches of unmarked tokens, the longest are marked first, until none of
five tokens is left. Marked tokens over the item's length are its coverage; as tiles may stand in
any order, passages whose parts were moved are found too. Seeds cover whatever tiles can, so the
seed test loses nothing.

The index goes to the executors only in blocks of bounded size (``BLOCK_TOKENS``); a benchmark of
several blocks is matched block by block against all documents, one after another: what a block
finds is written before the next is sent.

Defined cases: tokens are runs of letters and digits in lower case (everything but ASCII counts
as a letter); an item under five tokens must stand in the document as a whole; an item without
tokens, a null or empty text match nothing; repeated items and rows give a row each; empty tables
give no rows; columns beside the keys and texts are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import PUNCTUATION, cut, mix, powers, shingle_hashes, slices, word_hashes

TILE, COVERAGE = 5, 0.8
#: Tokens of the benchmark in one index that is sent to the executors.
BLOCK_TOKENS = 2_000_000


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[object, str]], tile: int = TILE):
        self.tile, self.items = tile, []
        by_size: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for key, text in items:
            words, _ = word_hashes([text.encode()], PUNCTUATION)
            if len(words):
                by_size[min(tile, len(words))].append((shingle_hashes(words, tile), len(self.items)))
                self.items.append((key, words))
        self.seeds = {}
        for size, runs in by_size.items():
            h = np.concatenate([r for r, _ in runs])
            item = np.concatenate([np.full(len(r), i) for r, i in runs])
            at = np.concatenate([np.arange(len(r)) for r, _ in runs])
            order = np.argsort(h, kind="stable")
            self.seeds[size] = (h[order], item[order], at[order])

    def candidates(self, words: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items whose seeds in ``words`` cover ``least`` of them, and the document's tokens that seeds touch.

        Each different seed of the document is looked up once, so the work is that of the document's
        and the items' lengths, however often a seed stands in either.
        """
        for size, (h, item, at) in self.seeds.items():
            if len(words) < size:
                continue
            runs = shingle_hashes(words, size)
            distinct, code = np.unique(runs, return_inverse=True)
            lo, hi = np.searchsorted(h, distinct), np.searchsorted(h, distinct, "right")
            n = hi - lo
            if not n.any():
                continue
            seed = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            which, own, where = np.repeat(np.arange(len(distinct)), n), item[seed], at[seed]
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                i = int(own[part[0]])
                if _spread(where[part], size, len(self.items[i][1])).sum() >= least * len(self.items[i][1]):
                    found = np.zeros(len(distinct), bool)
                    found[which[part]] = True
                    yield i, np.flatnonzero(_spread(np.flatnonzero(found[code]), size, len(words)))


def _spread(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``length`` places lie in a run of ``size`` that begins at one of ``starts``."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, length), -1)
    return np.cumsum(edge[:-1]) > 0


def tiles(item: np.ndarray, doc: np.ndarray, open_doc: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``item`` with ``doc`` by running Karp-Rabin: (item at, doc at, length).

    ``open_doc`` says which of the document's tokens may be marked. The length of the longest match
    of unmarked tokens is found by halving, as a match of n tokens holds one of every smaller
    length; all matches of that length are marked, front to back in the item and then in the
    document. Each step is one pass of rolling hashes over both, and there are no more lengths
    than the root of twice the item.
    """
    free_i, free_d = np.ones(len(item), bool), open_doc.copy()
    rolling_i, rolling_d = _Rolling(item), _Rolling(doc)
    out: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where free windows of ``n`` stand whose hash the other side has, and their hashes."""
        at_i, at_d = _free_windows(free_i, n), _free_windows(free_d, n)
        of_i, of_d = rolling_i.windows(n)[at_i], rolling_d.windows(n)[at_d]
        in_i, in_d = np.isin(of_i, of_d), np.isin(of_d, of_i)
        return at_i[in_i], of_i[in_i], at_d[in_d], of_d[in_d]

    most = min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        most, marked = low, False
        at_i, of_i, at_d, of_d = common(most)
        places: dict[int, list[int]] = defaultdict(list)
        for j, h in zip(at_d[::-1].tolist(), of_d[::-1].tolist(), strict=True):
            places[h].append(j)
        for i, h in zip(at_i.tolist(), of_i.tolist(), strict=True):
            # tiles marked here are as long as the windows, so one that overlaps holds an end of it
            if not (free_i[i] and free_i[i + most - 1]):
                continue
            left = places[h]
            while left and not (free_d[left[-1]] and free_d[left[-1] + most - 1]):
                left.pop()
            if left and (item[i : i + most] == doc[left[-1] : left[-1] + most]).all():
                j = left.pop()
                free_i[i : i + most] = free_d[j : j + most] = False
                out.append((i, j, most))
                marked = True
        if not marked:  # only hashes were equal
            most -= 1
    return sorted(out)


class _Rolling:
    def __init__(self, words: np.ndarray):
        power, self.inverse = powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.inverse[:m])


def _free_windows(free: np.ndarray, n: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(c[n:] - c[: len(c) - n] == n)


def _given_away(index: Index, texts: list[bytes], least: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, marked tokens, tiles) of each text that gives an item away."""
    for a, b in slices(texts):
        words, at = word_hashes(texts[a:b], PUNCTUATION)
        for d in range(b - a):
            own = words[at[d] : at[d + 1]]
            for i, tokens in index.candidates(own, least):
                item, first = index.items[i][1], int(tokens[0])
                open_doc = np.zeros(int(tokens[-1]) - first + 1, bool)
                open_doc[tokens - first] = True
                found = tiles(item, own[first : tokens[-1] + 1], open_doc, min(index.tile, len(item)))
                marked = sum(n for _, _, n in found)
                if marked >= least * len(item):
                    yield a + d, i, marked, len(found)


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def _match(shared, least: float):
    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for frame in frames:
            ids, out = frame["id"].tolist(), []
            for d, i, marked, n in _given_away(index, _encoded(frame["text"]), least):
                key, item = index.items[i]
                out.append((ids[d], key, len(item), marked, n, marked / len(item)))
            yield pd.DataFrame(out, columns=["id", "item", "n_tokens", "n_matched", "n_tiles", "coverage"])

    return match


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, tile: int, block_tokens: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of bounded size over the items, and whether there are several."""
    block, tokens, more = [], 0, False
    for key, text in benchmark.select(F.col(item_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(text.split())
        if block and tokens + n > block_tokens:
            more = True
            yield Index(block, tile), more
            block, tokens = [], 0
        block.append((key, text))
        tokens += n
    if block:
        yield Index(block, tile), more


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tile: int = TILE, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and item it gives away: id, item id, n_tokens, n_matched, n_tiles, coverage."""
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    base = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    out = None
    for index, more in _blocks(benchmark, item_col, item_text_col, tile, block_tokens):
        shared = spark.sparkContext.broadcast(index)
        part = base.mapInPandas(_match(shared, coverage), f"id string, item {kinds[1]}, n_tokens long, n_matched long, n_tiles long, coverage double")
        if more:  # one index at a time is on the executors
            part = cut(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, n_tokens long, n_matched long, n_tiles long, coverage double")
    return out.select(F.col("id").cast(kinds[0]).alias(id_col), F.col("item").alias(item_col), "n_tokens", "n_matched", "n_tiles", "coverage")


def _clean(shared, least: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index: Index = shared.value
        for texts in batches:
            out = np.ones(len(texts), bool)
            for d, _, _, _ in _given_away(index, _encoded(texts), least):
                out[d] = False
            yield pd.Series(out)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", tile: int = TILE, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that give no item away, with all columns; each row is decided by its own text."""
    for index, more in _blocks(benchmark, item_col, item_text_col, tile, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.filter(_clean(shared, coverage)(F.col(text_col)))
        if more:
            docs = cut(docs)
            shared.destroy()
    return docs
