"""Exact scores by shared terms in tiles: queries against the postings of all chunks of a document at once, so that no row per query and chunk or document is made."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.session import durable, spread

#: Chunks of a tile (more where a document alone has more), queries that meet it at once, and chunks whose words are taken apart at a time.
TILE, QUERIES, PARSED = 16_384, 32_768, 16_384


def _new(*columns: pa.ChunkedArray) -> np.ndarray:
    """Whether a sorted row differs from the one before in any of the columns."""
    codes = [c.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns]
    return np.append(True, np.any([c[1:] != c[:-1] for c in codes], 0))


class _Postings:
    """Chunks of a tile by document and id: for each of `terms` the chunks that have it and its part of their score."""

    def __init__(self, chunks: pa.Table, terms: pa.Array, k1: float, b: float, avgdl: float) -> None:
        chunks = chunks.take(pc.sort_indices(chunks, [("label", "ascending"), ("chunk_id", "ascending")]))
        # A chunk given in several lengths is one chunk: its rows are summed.
        doc, chunk = _new(chunks.column("label")), _new(chunks.column("label"), chunks.column("chunk_id"))
        of, first = np.cumsum(chunk) - 1, np.flatnonzero(chunk)
        self.n, self.labels = len(first), chunks.column("label").take(pa.array(np.flatnonzero(doc))).to_pylist()
        self.begin = of[np.flatnonzero(doc)]
        norm = k1 * (1 - b + b * chunks.column("dl").to_numpy() / avgdl)
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for a in range(0, len(of), PARSED):
            words = pc.split_pattern(chunks.column("words").slice(a, PARSED).combine_chunks(), " ")
            at = pc.index_in(words.flatten(), value_set=terms)
            row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            known = at.is_valid().to_numpy(zero_copy_only=False)
            key, f = np.unique(at.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64) * len(words) + row[known], return_counts=True)
            place, row = np.divmod(key, len(words))
            parts.append((place, of[a + row], f * (k1 + 1) / (f + norm[a + row])))
        place, self.rows, self.part = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(place, kind="stable")
        self.rows, self.part = self.rows[order], self.part[order]
        self.ends = np.searchsorted(place[order], np.arange(len(terms) + 1))

    def best(self, places: np.ndarray, weights: np.ndarray, digits: int) -> np.ndarray:
        """Of each document the greatest rounded score of a chunk that shares a term with the query, -inf where none does."""
        cuts = [(slice(a, e), w) for a, e, w in zip(self.ends[places], self.ends[places + 1], weights, strict=True) if e > a]
        if not cuts:
            return np.full(len(self.labels), -np.inf)
        rows = np.concatenate([self.rows[c] for c, _ in cuts])
        s = np.bincount(rows, np.concatenate([self.part[c] * w for c, w in cuts]), self.n)
        # Where all weights are positive a score of 0 says that no term is shared.
        s[s == 0 if (weights > 0).all() else np.bincount(rows, minlength=self.n) == 0] = -np.inf
        return np.round(np.maximum.reduceat(s, self.begin), digits) + 0.0


def _scored(chunks: pa.Table, queries: pa.Table, k1: float, b: float, avgdl: float, digits: int) -> Iterator[tuple[int, list, int, np.ndarray]]:
    """Number of the query, documents of the tile, how many of them come before the query's target by name, and their scores."""
    if not chunks.num_rows or not queries.num_rows:
        return
    words = pc.split_pattern(queries.column("words").combine_chunks(), " ")
    known = words.flatten().dictionary_encode()
    at, ends = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)))
    w = queries.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tile = _Postings(chunks, known.dictionary, k1, b, avgdl)
    for j, target in enumerate(queries.column("target").to_pylist()):
        own = slice(ends[j], ends[j + 1])
        yield j, tile.labels, bisect_left(tile.labels, target), tile.best(at[own], w[own], digits)


def _before(best: np.ndarray, own: float, at: int) -> int:
    """Documents before the one of score `own` that `at` documents precede by name."""
    return int(np.count_nonzero(best > own) + np.count_nonzero(best[:at] == own))


def _own(*how: float):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        got, targets = [], queries.column("target").to_pylist()
        for j, labels, at, best in _scored(chunks, queries, *how):
            if at < len(labels) and labels[at] == targets[j] and best[at] > -np.inf:
                got.append((j, best[at], _before(best, best[at], at)))
        j, own, n = (np.array([g[i] for g in got], (np.int64, np.float64, np.int64)[i]) for i in range(3))
        mine = queries.select(["query_id", "target"]).take(pa.array(j))
        return mine.append_column("own", pa.array(own)).append_column("n", pa.array(n))

    return run


def _ahead(*how: float):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n, own = np.zeros(queries.num_rows, np.int64), queries.column("own").to_numpy()
        for j, _, at, best in _scored(chunks, queries, *how):
            n[j] = _before(best, own[j], at)
        left = np.flatnonzero(n)
        return queries.select(["query_id", "target"]).take(pa.array(left)).append_column("n", pa.array(n[left]))

    return run


class TermTiles:
    """Chunks (label, chunk_id, dl, words: terms with a space between) dealt to tiles by document, to be met by queries (query_id, target, words: different terms, w: their weights).

    All chunks of a document are in one tile of about TILE chunks, so a document is
    scored whole by one task and a tile gives at most one row per query.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame, k1: float, b: float, avgdl: float, digits: int) -> None:
        self.how = k1, b, avgdl, digits
        self.qt, self.lt = (queries.schema[c].dataType.simpleString() for c in ("query_id", "target"))
        self.queries, self.chunks = queries, chunks
        self.parts = max(1, math.ceil(chunks.count() / TILE))

    def _met(self, queries: DataFrame, run, more: str, others: bool) -> DataFrame:
        """What `run` makes of each tile and block of queries: the tile of a query's target, or with `others` all other tiles."""
        q_blocks = max(1, math.ceil(queries.count() / (QUERIES if others else QUERIES * self.parts)))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")
        q = queries.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"), "own_part": part("target")})
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))).where("part <> own_part") if others else q.withColumn("part", F.col("own_part"))
        c = self.chunks.withColumns({"part": part("label"), "qb": F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))})
        q, c = (spread(d, self.parts * q_blocks, "part", "qb") for d in (q.drop("own_part"), c))
        return c.groupBy("part", "qb").cogroup(q.groupBy("part", "qb")).applyInArrow(run, f"query_id {self.qt}, target {self.lt}, {more}")

    def target_ranks(self, within: int | None = None) -> DataFrame:
        """query_id, target, rank of the target among the documents that share a term, by their best chunk, ties by document; no row if it shares none.

        The tile of the target gives its score and the documents before it there; the
        other tiles add theirs. With `within` ranks beyond it give no row, and a query
        that has so many documents before its target in that tile alone meets no other.
        """
        own = durable(self._met(self.queries, _own(*self.how), "own double, n long", False), "own-scores")
        left = own if within is None else own.where(F.col("n") < within)
        counts = left.select("query_id", "target", "n")
        if self.parts > 1:
            asked = durable(self.queries.join(left.select("query_id", "target", "own"), ["query_id", "target"]), "asked")
            counts = counts.unionByName(self._met(asked, _ahead(*self.how), "n long", True))
        ranks = counts.groupBy("query_id", "target").agg((F.sum("n") + 1).alias("rank"))
        return ranks if within is None else ranks.where(F.col("rank") <= within)
