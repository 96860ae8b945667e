"""Exact retrieval in tiles: queries against all chunks of a document at once, so that no row per query and chunk or document is made."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.functions.ordering import top_per
from policygrid.session import durable, spread

#: Chunks of a tile (more where a document alone has more), queries that meet it at once, and scores held at a time.
TILE, QUERIES, CELLS = 16_384, 32_768, 2_000_000


def _unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class _Tile:
    """Chunks by document and id: their unit vectors, and where each document begins."""

    def __init__(self, chunks: pa.Table) -> None:
        self.table = chunks = chunks.take(pc.sort_indices(chunks, [("label", "ascending"), ("chunk_id", "ascending")]))
        self.n = chunks.num_rows
        self.unit = _unit(chunks.column("vec"), self.n)
        self.ids, of = chunks.column("chunk_id").to_pylist(), chunks.column("label").to_pylist()
        self.begin = np.array([i for i in range(self.n) if not i or of[i] != of[i - 1]], np.int64)
        self.labels = [of[i] for i in self.begin]
        self.size = np.diff(np.append(self.begin, self.n))
        self.place = defaultdict(list)
        for i, c in enumerate(self.ids):
            self.place[c].append(i)

    def blocks(self, queries: pa.Table, digits: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Part of the queries, rounded scores (chunks by queries, a query's own chunk at -inf), and those own chunks and their queries."""
        q, ids = _unit(queries.column("vec"), queries.num_rows), queries.column("query_id").to_pylist()
        step = max(1, CELLS // self.n)
        for a in range(0, len(ids), step):
            s = self.unit @ q[a : a + step].T
            np.round(s, digits, out=s)
            s += 0.0
            own = [(i, j) for j, x in enumerate(ids[a : a + step]) for i in self.place.get(x, ())]
            rows, cols = np.array(own, np.int64).reshape(-1, 2).T
            s[rows, cols] = -np.inf
            yield slice(a, a + step), s, rows, cols

    def pooled(self, s: np.ndarray, rows: np.ndarray, cols: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
        """Documents by queries: the best (`score`) or the mean score (`mean`, to nine places), -inf where the query's own chunk is all there is."""
        out = []
        for kind in kinds:
            if kind == "score":
                out.append(np.maximum.reduceat(s, self.begin, 0))
                continue
            s[rows, cols] = 0
            total, n = np.add.reduceat(s, self.begin, 0), np.repeat(self.size[:, None], s.shape[1], 1).astype(np.float64)
            s[rows, cols] = -np.inf
            np.subtract.at(n, (np.searchsorted(self.begin, rows, "right") - 1, cols), 1)
            mean = np.divide(total, n, out=np.full(n.shape, -np.inf), where=n > 0)
            # Halves away from zero, as round() of Spark and SQL.
            out.append(np.where(n > 0, np.copysign(np.floor(np.abs(mean) * 1e9 + 0.5) / 1e9, mean) + 0.0, -np.inf))
        return out

    def targets(self, queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For each query how many documents come before its target by name, and whether the target is here."""
        at = np.array([bisect_left(self.labels, t) if t is not None else 0 for t in queries.column("target").to_pylist()], np.int64)
        here = np.array([t is not None and i < len(self.labels) and self.labels[i] == t for i, t in zip(at, queries.column("target").to_pylist(), strict=True)], bool)
        return at, here


def _codes(mine: list, theirs: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; null equals nothing."""
    code = {v: i for i, v in enumerate(dict.fromkeys(v for v in mine if v is not None))}
    return np.array([code.get(v, -1) if v is not None else -1 for v in mine]), np.array([code.get(v, -2) if v is not None else -2 for v in theirs])


def _kept(tile: _Tile, queries: pa.Table, modes: tuple[str, ...]) -> Callable[[slice], list]:
    """For a part of the queries which documents each mode leaves (documents by queries; None: all)."""
    equal = {}
    for name, (c, q) in {"country": ("g", "country"), "sector": ("s", "sector")}.items():
        if name in modes or "both" in modes:
            column = tile.table.column(c).to_pylist()
            equal[name] = _codes([column[i] for i in tile.begin], queries.column(q).to_pylist())

    def of(part: slice) -> list:
        got = {k: d[:, None] == q[None, part] for k, (d, q) in equal.items()}
        return [None if m == "none" else got["country"] & got["sector"] if m == "both" else got[m] for m in modes]

    return of


def _own(kinds: tuple[str, ...], modes: tuple[str, ...], digits: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        own, kept = np.full((queries.num_rows, len(kinds)), -np.inf), np.zeros((queries.num_rows, len(modes)), bool)
        if chunks.num_rows and queries.num_rows:
            tile = _Tile(chunks)
            at, here = tile.targets(queries)
            keep = _kept(tile, queries, modes)
            for part, s, rows, cols in tile.blocks(queries, digits):
                j = np.flatnonzero(here[part])
                for k, x in enumerate(tile.pooled(s, rows, cols, kinds)):
                    own[part.start + j, k] = x[at[part][j], j]
                for k, x in enumerate(keep(part)):
                    kept[part.start + j, k] = True if x is None else x[at[part][j], j]
        rows = np.flatnonzero((own > -np.inf).all(1)) if queries.num_rows else np.empty(0, np.int64)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(rows)), "own": pa.array(list(own[rows]), pa.list_(pa.float64())), "kept": pa.array([list(map(bool, x)) for x in kept[rows]], pa.list_(pa.bool_()))})

    return run


def _ahead(kinds: tuple[str, ...], modes: tuple[str, ...], digits: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n = np.zeros((queries.num_rows, len(kinds) * len(modes)), np.int64)
        if chunks.num_rows and queries.num_rows:
            tile = _Tile(chunks)
            at, here = tile.targets(queries)
            keep = _kept(tile, queries, modes)
            own = _lists(queries.column("own"), len(kinds))
            for part, s, rows, cols in tile.blocks(queries, digits):
                kept, j = keep(part), np.flatnonzero(here[part])
                for k, x in enumerate(tile.pooled(s, rows, cols, kinds)):
                    x[at[part][j], j] = -np.inf
                    before = x > own[part, k]
                    r, c = np.nonzero(x == own[part, k])
                    before[r, c] = r < at[part][c]
                    for m, left in enumerate(kept):
                        n[part, k * len(modes) + m] = np.count_nonzero(before if left is None else before & left, 0)
        return pa.table({"query_id": queries.column("query_id"), "n": pa.array(list(n), pa.list_(pa.int64()))})

    return run


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, width)


def _top_documents(k: int, digits: int):
    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), [], np.empty(0))]
        if chunks.num_rows and queries.num_rows:
            tile = _Tile(chunks)
            for part, s, rows, cols in tile.blocks(queries, digits):
                best = tile.pooled(s, rows, cols, ("score",))[0]
                # All that tie with the k-th go on.
                edge = -np.partition(-best, k - 1, 0)[k - 1] if k < len(best) else -np.inf
                d, q = np.nonzero((best >= edge) & (best > -np.inf))
                out.append((q + part.start, [tile.labels[i] for i in d], best[d, q]))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(np.concatenate([o[0] for o in out]))), "label": pa.array([x for o in out for x in o[1]], chunks.schema.field("label").type), "score": np.concatenate([o[2] for o in out])})

    return run


def _first_documents(k: int, digits: int):
    """The k best documents among the allowed chunks, by their first chunk, and all that tie with the k-th."""

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        left = chunks.filter(chunks.column("allowed"))
        if left.num_rows and queries.num_rows:
            tile = _Tile(left)
            for part, s, rows, cols in tile.blocks(queries, digits):
                best = tile.pooled(s, rows, cols, ("score",))[0]
                edge = -np.partition(-best, k - 1, 0)[k - 1] if k < len(best) else -np.inf
                d, q = np.nonzero((best >= edge) & (best > -np.inf))
                # A document's chunks are in the order of their ids, so the first with its score is the one.
                c = np.array([b + np.argmax(s[b : b + n, j] == x) for b, n, j, x in zip(tile.begin[d], tile.size[d], q, best[d, q], strict=True)], np.int64)
                out.append((q + part.start, c, best[d, q]))
            left = tile.table
        q, c, s = (np.concatenate([o[i] for o in out]) for i in range(3))
        named = left.take(pa.array(c))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "label": named.column("label"), "chunk_id": named.column("chunk_id"), "score": s})

    return run


def _before(tile: _Tile, s: np.ndarray, scores: np.ndarray, ids: list, place: np.ndarray) -> np.ndarray:
    """Chunks by queries: whether a chunk comes before the query's given one, by score, then by id. `place` is the order of the chunks' ids."""
    before = s > scores
    r, c = np.nonzero(s == scores)
    at = np.array([bisect_left(tile.by_id, x) if x is not None else 0 for x in ids], np.int64)
    before[r, c] = place[r] < at[c]
    return before


def _by_id(tile: _Tile) -> np.ndarray:
    order = sorted(range(tile.n), key=tile.ids.__getitem__)
    tile.by_id = [tile.ids[i] for i in order]
    place = np.empty(tile.n, np.int64)
    # Chunks of one id share the place of the first.
    place[order] = [bisect_left(tile.by_id, x) for x in tile.by_id]
    return place


def _chunk_places(k: int, digits: int):
    """How many chunks come before each of a query's up to k given ones."""

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n = np.zeros((queries.num_rows, k), np.int64)
        if chunks.num_rows and queries.num_rows:
            tile = _Tile(chunks)
            place = _by_id(tile)
            given = [(x + [{"score": None, "chunk_id": None}] * k)[:k] for x in queries.column("given").to_pylist()]
            for part, s, _, _ in tile.blocks(queries, digits):
                for i in range(k):
                    own = [x[i] for x in given[part]]
                    t = np.array([np.inf if x["score"] is None else x["score"] for x in own])
                    for j, x in enumerate(own):
                        # The given chunk itself, if it is here, doesn't come before itself.
                        for r in tile.place.get(x["chunk_id"], ()):
                            s[r, j] = min(s[r, j], t[j])
                    n[part, i] = np.count_nonzero(_before(tile, s, t, [x["chunk_id"] for x in own], place), 0)
        return pa.table({"query_id": queries.column("query_id"), "n": pa.array(list(n), pa.list_(pa.int64()))})

    return run


def _alike(tile: _Tile, queries: pa.Table) -> Callable[[slice], np.ndarray]:
    mine, theirs = _codes(tile.table.column("s").to_pylist(), queries.column("sector").to_pylist())
    return lambda part: mine[:, None] == theirs[None, part]


def _own_first(digits: int):
    """The first chunk of each query's target among those of the query's sector."""

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        got: list[tuple[int, int, float]] = []
        if chunks.num_rows and queries.num_rows:
            tile = _Tile(chunks)
            at, here = tile.targets(queries)
            alike = _alike(tile, queries)
            for part, s, _, _ in tile.blocks(queries, digits):
                same = alike(part)
                for j in np.flatnonzero(here[part]):
                    b = tile.begin[at[part.start + j]]
                    x = np.where(same[b : b + tile.size[at[part.start + j]], j], s[b : b + tile.size[at[part.start + j]], j], -np.inf)
                    i = int(np.argmax(x))
                    if x[i] > -np.inf:
                        got.append((part.start + j, b + i, x[i]))
            chunks = tile.table
        q, c, s = (np.array([g[i] for g in got], (np.int64, np.int64, np.float64)[i]) for i in range(3))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "chunk_id": chunks.column("chunk_id").take(pa.array(c)), "score": s})

    return run


def _sector_places(digits: int):
    """How many chunks come before the query's given one, and how many documents other than the target have one of the query's sector before it."""

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n = np.zeros((2, queries.num_rows), np.int64)
        if chunks.num_rows and queries.num_rows:
            tile = _Tile(chunks)
            place, (at, here), alike = _by_id(tile), tile.targets(queries), _alike(tile, queries)
            ids, t = queries.column("given_id").to_pylist(), queries.column("given").to_numpy()
            for part, s, _, _ in tile.blocks(queries, digits):
                for j, x in enumerate(ids[part]):
                    for r in tile.place.get(x, ()):
                        s[r, j] = min(s[r, j], t[part.start + j])
                before = _before(tile, s, t[part], ids[part], place)
                n[0, part] = np.count_nonzero(before, 0)
                docs = np.logical_or.reduceat(before & alike(part), tile.begin, 0)
                j = np.flatnonzero(here[part])
                docs[at[part][j], j] = False
                n[1, part] = np.count_nonzero(docs, 0)
        return pa.table({"query_id": queries.column("query_id"), "chunks": n[0], "docs": n[1]})

    return run


class Tiles:
    """Chunks (chunk_id, label, vec and further columns) dealt to tiles by group and document, to be met by queries (query_id, vec and further columns).

    All chunks of a document (of a group) are in one tile of about TILE chunks, so
    what is told per document is told whole by one task, and a tile gives a few rows
    per query. Blocks of QUERIES queries meet each tile by an equi-join; within a task
    CELLS scores are held at a time. The vectors must be usable; rows without a
    group or a document meet nothing.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame, label: str = "document_id", digits: int = 10, group: str | None = None) -> None:
        g = (F.col(group) if group else F.lit(0)).cast("long").alias("g_no")
        self.digits, self.label, self.lt, self.ct, self.qt = digits, label, *(d.schema[c].dataType.simpleString() for d, c in ((chunks, label), (chunks, "chunk_id"), (queries, "query_id")))
        extra = [c for c in chunks.columns if c in ("g", "s", "allowed")]
        chunks = chunks.select("chunk_id", F.col(label).alias("label"), "vec", g, *extra).where("g_no is not null and label is not null")
        most = lambda d: d.groupBy("g_no").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
        rows, groups = most(chunks.select("g_no"))
        self.queries = queries.withColumn("g_no", g).where("g_no is not null")
        self.parts, self.q_blocks = max(1, math.ceil(rows / TILE)), max(1, math.ceil(most(self.queries.select("g_no"))[0] / QUERIES))
        self.tasks = max(1, groups) * self.parts * self.q_blocks
        self.chunks = spread(chunks.withColumn("part", self._part(F.col("label"))).withColumn("qb", self._each(self.q_blocks)), self.tasks, "g_no", "part", "qb")

    def _part(self, label):
        return F.pmod(F.xxhash64(label), F.lit(self.parts)).cast("int")

    def _each(self, n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)

    def _met(self, queries: DataFrame, run, schema: str, own: bool = False) -> DataFrame:
        """What `run` makes of each tile and block of queries; with `own` a query meets only the tile of its target."""
        q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(self.q_blocks)).cast("int"))
        q = q.where("target is not null").withColumn("part", self._part(F.col("target"))) if own else q.withColumn("part", self._each(self.parts))
        q, keys = spread(q, self.tasks, "g_no", "part", "qb"), ["g_no", "part", "qb"]
        return self.chunks.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema)

    def own_scores(self, kinds: tuple[str, ...] = ("score",), modes: tuple[str, ...] = ("none",)) -> DataFrame:
        """query_id, own (the target's score of each kind), kept (whether each mode leaves it); no row for a target without a chunk."""
        return self._met(self.queries, _own(kinds, modes, self.digits), f"query_id {self.qt}, own array<double>, kept array<boolean>", own=True)

    def target_ranks(self, kinds: tuple[str, ...] = ("score",), modes: tuple[str, ...] = ("none",)) -> DataFrame:
        """query_id, target, ranks: the target's rank among the documents by each kind of score (`score`: best chunk, `mean`), for each mode in turn; null where it isn't ranked.

        Ties go by document. A mode leaves the documents whose country (column g of the
        chunks), sector (s) or both are the query's (country, sector).
        """
        own = durable(self.own_scores(kinds, modes), "own-scores")
        ahead = self._met(self.queries.join(own.select("query_id", "own"), "query_id"), _ahead(kinds, modes, self.digits), f"query_id {self.qt}, n array<long>")
        counts = [F.sum(F.col("n")[i]) for i in range(len(kinds) * len(modes))]
        n = ahead.groupBy("query_id").agg(F.array(*counts).alias("n")).join(own.select("query_id", "kept"), "query_id")
        ranks = F.array(*[F.when(F.col("kept")[m], F.col("n")[k * len(modes) + m] + 1) for k in range(len(kinds)) for m in range(len(modes))])
        return self.queries.select("query_id", "target").join(n.select("query_id", ranks.alias("ranks")), "query_id", "left")

    def top_documents(self, k: int) -> DataFrame:
        """query_id, document, score, rank: the k documents with the best chunk, ties by document."""
        near = self._met(self.queries, _top_documents(k, self.digits), f"query_id {self.qt}, label {self.lt}, score double").withColumnRenamed("label", self.label)
        return top_per(near, ["query_id"], [F.col("score").desc(), F.col(self.label).asc()], k)

    def distinct_documents(self, top_docs: int, top_chunks: int = 1000) -> DataFrame:
        """query_id, document, chunk_id, score, chunk_rank, doc_no: of the top chunks per query the first of each allowed document, at most `top_docs` documents.

        The chunks have a column `allowed`. The documents are found first; the places of
        their chunks among all are counted in a second pass over the tiles.
        """
        near = self._met(self.queries, _first_documents(top_docs, self.digits), f"query_id {self.qt}, label {self.lt}, chunk_id {self.ct}, score double")
        first = durable(top_per(near, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], top_docs, name="doc_no"), "first-documents")
        given = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_no", "score", "chunk_id"))), lambda x: F.struct(x["score"].alias("score"), x["chunk_id"].alias("chunk_id"))).alias("given"))
        places = self._met(self.queries.join(given, "query_id"), _chunk_places(top_docs, self.digits), f"query_id {self.qt}, n array<long>")
        n = places.groupBy("query_id").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(top_docs)]).alias("n"))
        ranked = first.join(n, "query_id").withColumn("chunk_rank", (F.get("n", F.col("doc_no") - 1) + 1).cast("int")).where(F.col("chunk_rank") <= top_chunks)
        return ranked.select("query_id", F.col("label").alias(self.label), "chunk_id", "score", "chunk_rank", "doc_no")

    def sector_hits(self, top_docs: int, top_chunks: int = 1000) -> DataFrame:
        """query_id of the queries whose target is among the first `top_docs` documents of the chunks of the query's sector (columns s and sector) that are among its top chunks."""
        own = durable(self._met(self.queries, _own_first(self.digits), f"query_id {self.qt}, chunk_id {self.ct}, score double", own=True), "own-first")
        q = self.queries.join(own.select("query_id", F.col("chunk_id").alias("given_id"), F.col("score").alias("given")), "query_id")
        n = self._met(q, _sector_places(self.digits), f"query_id {self.qt}, chunks long, docs long").groupBy("query_id").agg(F.sum("chunks").alias("chunks"), F.sum("docs").alias("docs"))
        return n.where((F.col("chunks") < top_chunks) & (F.col("docs") < top_docs)).select("query_id")
