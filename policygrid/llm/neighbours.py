"""Most similar vectors for every vector: robust-pruned directed graphs, one per shard, with beam search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.functions.ordering import top_per
from policygrid.session import durable, release, require_columns, spread

#: Vectors of a shard's graph about; a cell with over twice as many is split into leaves.
SHARD = 3000
#: Leaves that a cell is split into at once, cells that are split in one round, and vectors per leaf that the split is fitted on.
LEAVES, SPLITS, LEAF_SAMPLE = 256, 256, 64
#: Cells are fitted on at most so many vectors, of all collections together; every vector is indexed.
FIT_SAMPLE = 40_000
MOST_CELLS = 4096
#: Nearest cells that a vector is searched in; it is indexed in the first.
PROBES = 2
#: Out-degree after pruning, beam width, relaxation of the pruning distance.
DEGREE, BEAM, ALPHA = 16, 32, 1.2
#: Queries that search a graph in step, and nodes they begin at.
_TOGETHER, _ENTRIES = 256, 8


class Graph:
    """A directed graph over unit vectors for greedy search, its edges pruned to differ in direction.

    Vectors are inserted from the first on, in batches as large as the graph so far
    (256 at most). For each a greedy beam search over that graph proposes neighbours;
    robust pruning keeps the nearest and drops those that a kept one is `alpha` times
    nearer to. Edges are made both ways; a node is pruned again when it has twice the
    degree. No vectors are compared but those that a search meets.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> None:
        self.x, self.n = np.ascontiguousarray(x, np.float32), len(x)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        self.out = np.full((self.n, 2 * degree), -1, np.int32)
        self.used = np.zeros(self.n, np.int64)
        order = np.random.default_rng(seed).permutation(self.n)
        # Searches begin at some of the vectors that were inserted first.
        self.entry = order[:_ENTRIES].astype(np.int64)
        done = min(self.n, 1)
        while done < self.n:
            batch = order[done : done + min(done, _TOGETHER)]
            self._link(batch, *self.search(self.x[batch], beam, entry=order[: min(done, _ENTRIES)]))
            done += len(batch)

    def neighbours(self, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the `beam` best met for each of the graph's own vectors, best first.

        The second pass over the vectors: each beam search begins at the vector's own
        node, in the graph of all; what it meets is linked, as vectors that were
        inserted together have not met before.
        """
        ids, sims = np.full((self.n, beam), -1, np.int64), np.full((self.n, beam), -2, np.float32)
        for a in range(0, self.n, _TOGETHER):
            nodes = np.arange(a, min(self.n, a + _TOGETHER))
            i, s = self._search(self.x[nodes], beam, 2, nodes[:, None])
            s[i == nodes[:, None]] = -2
            best = np.argsort(-s, 1, kind="stable")
            ids[nodes], sims[nodes] = np.take_along_axis(i, best, 1), np.take_along_axis(s, best, 1)
            ids[nodes] = np.where(sims[nodes] > -2, ids[nodes], -1)
            self._link(nodes, np.concatenate([ids[nodes], self.out[nodes]], 1), np.concatenate([sims[nodes], self._sims(self.x[nodes], self.out[nodes])], 1))
        return ids, sims

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """For each node at most `degree` of its candidates (-1: none), kept by robust pruning."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for a in range(0, len(nodes), 512):
            c, s = cand[a : a + 512], sims[a : a + 512].copy()
            s[(c < 0) | (c == nodes[a : a + 512, None])] = -2
            v = self.x[np.maximum(c, 0)]
            far = self.alpha * (1 - v @ v.transpose(0, 2, 1))
            own = 1 - s
            rows = np.arange(len(c))
            for j in range(self.degree):
                best = s.argmax(1)
                ok = s[rows, best] > -2
                if not ok.any():
                    break
                out[a : a + 512, j][ok] = c[rows, best][ok]
                s[far[rows, best] <= own] = -2
                s[rows, best] = -2
        return out

    def _link(self, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        kept = self._prune(nodes, cand, sims)
        self.out[nodes, : self.degree] = kept
        self.used[nodes] = (kept >= 0).sum(1)
        # Kept entries come first in each row, so the used part of a row has no holes.
        src = np.repeat(nodes, self.used[nodes])
        dst = kept[kept >= 0].astype(np.int64)
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        at = self.used[dst] + np.arange(len(dst)) - np.searchsorted(dst, dst)
        room = at < 2 * self.degree
        self.out[dst[room], at[room]] = src[room]
        full, extra = np.unique(dst[~room], return_counts=True)
        np.maximum.at(self.used, dst[room], at[room] + 1)
        if len(full):
            more = np.full((len(full), int(extra.max())), -1, np.int64)
            which = np.searchsorted(full, dst[~room])
            more[which, np.arange(len(which)) - np.searchsorted(which, which)] = src[~room]
            c = np.concatenate([self.out[full].astype(np.int64), more], 1)
            kept = self._prune(full, c, self._sims(self.x[full], c))
            self.out[full] = -1
            self.out[full, : self.degree] = kept
            self.used[full] = (kept >= 0).sum(1)

    def _sims(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        s = np.matmul(self.x[np.maximum(c, 0)], q[:, :, None])[:, :, 0]
        s[c < 0] = -2
        return s

    def search(self, queries: np.ndarray, beam: int, width: int = 2, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the `beam` best vectors met, best first; `width` nodes are expanded at a time."""
        ids, sims = [], []
        entry = self.entry if entry is None else entry
        for a in range(0, len(queries), _TOGETHER):
            q = np.ascontiguousarray(queries[a : a + _TOGETHER], np.float32)
            i, s = self._search(q, beam, width, np.broadcast_to(entry, (len(q), len(entry))))
            ids.append(i)
            sims.append(s)
        return (np.concatenate(ids), np.concatenate(sims)) if ids else (np.empty((0, beam), np.int64), np.empty((0, beam), np.float32))

    def _search(self, q: np.ndarray, beam: int, width: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """search() of queries that each begin at the nodes of its row of `entry`."""
        b = len(q)
        seen = np.zeros((b, self.n), np.int32)  # 0: not met; else the place by which it was met
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2, np.float32)
        wait = np.zeros((b, beam), bool)
        m = min(beam, entry.shape[1])
        entry = entry[:, :m]
        ids[:, :m], sims[:, :m], wait[:, :m] = entry, self._sims(q, entry), True
        np.put_along_axis(seen, entry, 1, 1)
        live = np.arange(b)
        place = 1
        while len(live):
            s = np.where(wait[live], sims[live], -3)
            pick = np.argpartition(-s, width - 1, 1)[:, :width] if width < beam else np.broadcast_to(np.arange(beam), s.shape)
            ok = np.take_along_axis(s, pick, 1) > -3
            going = ok.any(1)
            live, pick, ok = live[going], pick[going], ok[going]
            if not len(live):
                break
            wait[live[:, None], pick] = False
            node = np.where(ok, ids[live[:, None], pick], -1)
            row, col = np.nonzero(node >= 0)
            near = self.out[node[row, col]]
            r2, c2 = np.nonzero(near >= 0)
            row, nbr = live[row[r2]], near[r2, c2]
            fresh = seen[row, nbr] == 0
            row, nbr = row[fresh], nbr[fresh]
            mark = np.arange(place + 1, place + 1 + len(row), dtype=np.int32)
            seen[row, nbr] = mark
            once = seen[row, nbr] == mark  # of equal ones met in this step only the last
            place += len(row)
            row, nbr = row[once], nbr[once]
            if not len(row):
                continue
            got = np.einsum("ij,ij->i", q[row], self.x[nbr])
            better = got > sims[row].min(1) if len(row) < 64 else got > sims.min(1)[row]
            row, nbr, got = row[better], nbr[better], got[better]
            if not len(row):
                continue
            order = np.argsort(row, kind="stable")
            row, nbr, got = row[order], nbr[order], got[order]
            who, begin, count = np.unique(row, return_index=True, return_counts=True)
            at = np.arange(len(row)) - np.repeat(begin, count)
            wide = int(count.max())
            k = np.repeat(np.arange(len(who)), count)
            new_s = np.full((len(who), wide), -2, np.float32)
            new_i = np.full((len(who), wide), -1, np.int64)
            new_s[k, at], new_i[k, at] = got, nbr
            all_s = np.concatenate([sims[who], new_s], 1)
            all_i = np.concatenate([ids[who], new_i], 1)
            all_w = np.concatenate([wait[who], new_i >= 0], 1)
            top = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
            sims[who], ids[who], wait[who] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_w, top, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array<float> column that can take part, as unit vectors, and their positions."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(at) else np.empty(0)
    x = flat.reshape(-1, width)
    ok = np.isfinite(x).all(1)
    x, at = x[ok], at[ok]
    scale = np.abs(x).max(1, initial=0)
    x, at = x[scale > 0] / scale[scale > 0][:, None], at[scale > 0]
    return x / np.linalg.norm(x, axis=1, keepdims=True), at


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    n, w = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * w).tobytes()), pa.py_buffer(x.tobytes())])


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def unit_vectors(rows: DataFrame, key: str, embedding: str, width: int, part: int = 0) -> DataFrame:
    """id, vec (unit vector as binary float32), digest, part (the number of the collection, which digests depend on) of the vectors that take part.

    Null vectors, those of another length, all zero, or with a null, NaN or infinite
    element take none. Copies and multiples of a vector have equal digests as far as
    rounding to 1e-5 allows; where it doesn't they are merely neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _matrix(batch.column(1), width)
            rounded = np.round(x * 1e5).astype(np.int32)
            place = pa.array(at)
            own = batch.column(2).take(place)
            digest = [hashlib.blake2b(r.tobytes(), digest_size=16, salt=b"%d" % p).digest() for r, p in zip(rounded, own.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), _binary(x), pa.array(digest, pa.binary()), own], ["id", "vec", "digest", "part"])

    wanted = rows.select(F.col(key).cast("string").alias("id"), F.col(embedding).cast("array<float>").alias("e"), F.lit(part).alias("part")).where("id is not null and e is not null")
    return wanted.mapInArrow(run, "id string, vec binary, digest binary, part int")


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Unit centroids by spherical k-means over a bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 8192] @ c.T).argmax(1) for a in range(0, len(sample), 8192)])
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(c)))
        total = np.add.reduceat(sample[order], np.minimum(starts, len(sample) - 1), axis=0)
        empty = np.bincount(own, minlength=len(c)) == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _assign(centroids: dict[int, tuple[int, np.ndarray]], probes: int, width: int):
    """nid, vec, cells: the nearest cells of each vector, of its own collection; `centroids` holds each one's first cell and matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _vectors(batch.column(1), width), batch.column(2).to_numpy()
            cells: list[list[int]] = [[]] * len(x)
            for part in np.unique(own):
                first, m = centroids[int(part)]
                at = np.flatnonzero(own == part)
                s = x[at] @ m.T
                p = min(probes, s.shape[1])
                top = np.argpartition(-s, p - 1, 1)[:, :p]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1) + first
                for k, row in zip(at.tolist(), top.tolist(), strict=True):
                    cells[k] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))], ["nid", "vec", "cells"])

    return run


def _fit_leaves(shard: int, width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = _vectors(table.column("vec"), width)
        n = table.column("n")[0].as_py()
        c = fit_cells(x[np.argsort(table.column("nid").to_numpy(), kind="stable")], min(LEAVES, math.ceil(n / shard)))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary())})

    return run


def _to_leaves(centroids, width: int):
    """Rows of split cells at their nearest leaf; members at the next nearest too, to be searched there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = {c: (first, np.frombuffer(m, np.float32).reshape(-1, width)) for c, (first, m) in centroids.value.items()}
        for batch in batches:
            x, cell = _vectors(batch.column("vec"), width), batch.column("cell").to_numpy()
            member = batch.column("member").to_numpy(zero_copy_only=False).astype(bool)
            near = np.full((len(x), 2), -1, np.int32)
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                first, m = book[int(c)]
                s = x[at] @ m.T
                near[at, 0] = s.argmax(1) + first
                if len(m) > 1:
                    s[np.arange(len(at)), near[at, 0] - first] = -3
                    near[at, 1] = np.where(member[at], s.argmax(1) + first, -1)
            row = np.concatenate([np.arange(len(x)), np.flatnonzero(near[:, 1] >= 0)])
            to = np.concatenate([near[:, 0], near[near[:, 1] >= 0, 1]])
            own = np.concatenate([member, np.zeros(len(to) - len(x), bool)])
            yield pa.RecordBatch.from_arrays([batch.column("nid").take(pa.array(row)), batch.column("vec").take(pa.array(row)), pa.array(to, pa.int32()), pa.array(own)], ["nid", "vec", "cell", "member"])

    return run


def _leaves(sent: DataFrame, cells: int, shard: int, width: int) -> tuple[DataFrame, int]:
    """`sent` (nid, vec, cell, member) with cells of over two shards' worth of members split, and the number of cells.

    A crowded cell is split by k-means over a bounded sample of its members, and
    its leaves again, until none is crowded. Each vector stays a member of one leaf
    and gains one more to be searched in per split: copies grow with the depth, which
    is the logarithm of the crowd to the base 256. A round splits the 256 largest
    cells at most, so at most 65,536 centroids (16 MB) reach the driver and are
    broadcast; what is left is split in the next round. A split that parts nothing
    (vectors all but equal) ends the splitting of that cell.
    """
    spark = sent.sparkSession
    dense: list[int] = []
    rounds = 0
    while True:
        sizes = sent.where("member").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard)
        crowded = {r["cell"]: r["n"] for r in sizes.where(~F.col("cell").isin(dense)).orderBy(F.desc("n"), "cell").limit(SPLITS).collect()}
        if not crowded:
            return sent, cells
        here = F.col("cell").isin(list(crowded))
        # How many of a cell's members are drawn follows its number of leaves.
        share = F.element_at(F.create_map(*[F.lit(v) for c, n in crowded.items() for v in (c, n)]), F.col("cell"))
        drawn = sent.where(here & F.col("member")).withColumn("n", share).where(F.pmod(F.xxhash64("nid", F.lit(7)), F.col("n")) < LEAF_SAMPLE * F.least(F.lit(LEAVES), F.ceil(F.col("n") / shard)))
        fitted = {r["cell"]: bytes(r["centroids"]) for r in drawn.groupBy("cell").applyInArrow(_fit_leaves(shard, width), "cell int, centroids binary").collect()}
        book, first = {}, cells
        for c, m in sorted(fitted.items()):
            book[c] = (first, m)
            first += len(m) // (4 * width)
        dense += [c for c in crowded if c not in fitted]
        here = F.col("cell").isin(list(book))
        moved = sent.where(here).mapInArrow(_to_leaves(spark.sparkContext.broadcast(book), width), sent.schema)
        before, sent = sent, durable(sent.where(~here).unionByName(moved), "leaves")
        if rounds:
            release(before)
        rounds += 1
        # A leaf that got nearly all of its cell would not get smaller by another split.
        parents = {leaf: c for c, (a, m) in book.items() for leaf in range(a, a + len(m) // (4 * width))}
        largest = {r["cell"]: r["n"] for r in sent.where(F.col("member") & (F.col("cell") >= cells)).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard).orderBy(F.desc("n")).limit(SPLITS).collect()}
        dense += [leaf for leaf, n in largest.items() if n > 0.95 * crowded[parents[leaf]]]
        cells = first


def _shard_search(k: int, width: int, beam: int, least: float | None):
    def run(table: pa.Table) -> pa.Table:
        nid = table.column("nid").to_numpy()
        x = _vectors(table.column("vec"), width)
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(nid[member], kind="stable")  # the graph doesn't depend on the order of arrival
        index, base = np.flatnonzero(member)[order], nid[member][order]
        # Where only high similarity counts a narrower beam does for the graph's own vectors, whose search begins among their like.
        graph = Graph(x[index], beam=3 * beam // 4)
        parts = [(index, *graph.neighbours(beam if least is None else beam // 2))]
        visit = np.flatnonzero(~member)
        parts += [(visit[a : a + 4096], *graph.search(x[visit[a : a + 4096]], beam)) for a in range(0, len(visit), 4096)]
        one, two, value = [], [], []
        for rows, got, s in parts:
            s = np.where((got < 0) | (nid[rows][:, None] == (base[np.maximum(got, 0)] if len(base) else -1)), -2, s)
            top = np.argsort(-s, 1, kind="stable")[:, :k]
            r, c = np.nonzero(np.take_along_axis(s, top, 1) > (-2 if least is None else least - 1e-6))
            at = got[r, top[r, c]]
            # The same products in the same order whichever side asks, so both directions of a pair have equal values.
            exact = np.einsum("ij,ij->i", x[rows[r]].astype(np.float64), graph.x[at].astype(np.float64)).astype(np.float32)
            keep = exact >= (-2 if least is None else least)
            one.append(nid[rows[r]][keep])
            two.append(base[at[keep]])
            value.append(exact[keep])
        a, b, s = (np.concatenate(v) if v else np.empty(0) for v in (one, two, value))
        # A pair counts for both; of each vector only the k best go on, so one that many are near to costs no more.
        a, b, s = np.concatenate([a, b]).astype(np.int64), np.concatenate([b, a]).astype(np.int64), np.concatenate([s, s])
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s = a[fresh], b[fresh], s[fresh]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, s = a[best], b[best], s[best]
        keys, begin = np.unique(a, return_index=True)
        offsets = pa.array(np.append(begin, len(a)).astype(np.int32))
        return pa.table({"nid": keys, "ids": pa.ListArray.from_arrays(offsets, pa.array(b)), "sims": pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.float32)))})

    return run


def similar_classes(vectors: DataFrame, k: int, width: int = 64, probes: int = PROBES, beam: int = BEAM, shard: int = SHARD, least: float | None = None) -> DataFrame:
    """nid, other, similarity: up to k most similar of the different vectors (nid, vec, and part if there are several collections) for each, of its own collection.

    Cells come from k-means over a bounded sample. Each vector is indexed in the
    shard of its nearest cell and searched in its `probes` nearest; a cell that holds
    more than two shards' worth is split into leaves (see _leaves()), so however
    crowded a cell is, a vector goes to few shards. A pair met from either side counts
    for both. With `least` only similarities of at least that are given.
    """
    if "part" not in vectors.columns:
        vectors = vectors.withColumn("part", F.lit(0))
    counts = {r["part"]: r["n"] for r in vectors.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per collection
    if max(counts.values(), default=0) < 2:
        return vectors.sparkSession.createDataFrame([], "nid long, other long, similarity float")
    # Each collection has its part of FIT_SAMPLE, by its size; one vector in `every` is drawn.
    every = max(1, -(-sum(counts.values()) // FIT_SAMPLE))
    picked = vectors.where(F.pmod(F.xxhash64("nid"), F.lit(every)) == 0).select("part", "vec").limit(FIT_SAMPLE).toArrow()
    own, drawn = picked.column("part").to_numpy(), _vectors(picked.column("vec"), width) if picked.num_rows else np.empty((0, width), np.float32)
    centroids, cells = {}, 0
    for p, n in sorted(counts.items()):
        sample = drawn[own == p]
        if not len(sample):
            sample = _vectors(vectors.where(F.col("part") == p).select("vec").limit(1).toArrow().column("vec"), width)
        m = fit_cells(sample, max(1, min(MOST_CELLS, math.ceil(n / shard), len(sample))))
        centroids[p], cells = (cells, m), cells + len(m)
    placed = durable(vectors.select("nid", "vec", "part").mapInArrow(_assign(centroids, probes, width), "nid long, vec binary, cells array<int>"), "cells")
    sent = placed.select("nid", "vec", F.posexplode("cells").alias("rank", "cell")).select("nid", "vec", "cell", (F.col("rank") == 0).alias("member"))
    whole = cells
    sent, cells = _leaves(sent, cells, shard, width)
    if cells > whole:  # the leaves are a table of their own
        release(placed)
    found = spread(sent.select(F.col("cell").alias("shard"), "nid", "vec", "member"), cells, "shard").groupBy("shard").applyInArrow(_shard_search(k, width, beam, least), "nid long, ids array<long>, sims array<float>")
    # At most k rows from each shard that indexes or searches a vector.
    listed = found.select("nid", F.arrays_zip((F.transform("sims", lambda v: -v)).alias("far"), F.col("ids").alias("other")).alias("x"))
    best = listed.groupBy("nid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))), 1, k).alias("x"))
    out = durable(best.select("nid", F.explode("x").alias("e")).select("nid", F.col("e.other").alias("other"), (-F.col("e.far")).alias("similarity")), "near")
    release(placed, sent)
    return out


def most_similar_each(collections: dict[str, tuple[DataFrame, str, str]], k: int = 5, width: int = 64, least: float | None = None, **search) -> DataFrame:
    """collection, id, other_id, similarity, rank: the k vectors of its own collection most similar to each by cosine, ties by id.

    `collections` maps names to a table, its key and its vector column; all go through
    one plan, in which ids begin with the number of their collection.

    Equal vectors form a class that is indexed once; a member's neighbours are the
    other members first, then those of the classes near by, of each the first k by
    id, so a class of any size adds at most k rows per member. With `least`, only
    neighbours of at least that similarity come out (ranks are the same).

    Vectors that can't take part (see unit_vectors) give no rows, nor does a vector
    without a neighbour; keys must be unique; other columns are ignored.
    """
    names = list(collections)
    units = None
    for i, (rows, key, embedding) in enumerate(collections.values()):
        require_columns(rows, key, embedding)
        one = unit_vectors(rows, key, embedding, width, i).withColumn("id", F.concat(F.lit(f"{i}:"), "id"))
        units = one if units is None else units.unionByName(one)
    units = durable(units, "units")
    seen = units.select("id", "digest")
    # Only classes of several members need their ids gathered, and of those only the first k + 1.
    several = seen.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "rep")
    marked = units.join(several, "digest", "left").select("id", "vec", "part", F.coalesce("rep", "id").alias("rep"))
    member = durable(marked.select("id", "rep").where("id <> rep"), "copies")
    reps = durable(marked.where("id = rep").select(F.col("id").alias("rep"), "vec", "part").withColumn("nid", F.monotonically_increasing_id()), "classes")
    release(units)
    near = similar_classes(reps.select("nid", "vec", "part"), k, width, least=least, **search)
    called = reps.select("nid", "rep")
    by_name = near.join(called, "nid").join(called.select(F.col("nid").alias("other"), F.col("rep").alias("other_rep")), "other").select("rep", "other_rep", "similarity")
    copies = member.select("rep", F.col("id")).union(member.select("rep", F.col("rep").alias("id")).distinct())
    # The first k + 1 members of each class, ranked in salted parts first, as a class can hold a large share of all rows.
    leading = top_per(copies, ["rep"], [F.col("id").asc()], k + 1, salt=F.col("id"))
    firsts = leading.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    own = copies.join(firsts, "rep").select("id", F.explode("ids").alias("other_id")).where("id <> other_id").withColumn("similarity", F.lit(1.0))
    others = by_name.join(firsts.select(F.col("rep").alias("other_rep"), "ids"), "other_rep", "left").select("rep", F.col("similarity").cast("double").alias("similarity"), F.explode(F.slice(F.coalesce("ids", F.array("other_rep")), 1, k)).alias("other_id"))
    per_rep = others.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "other_id"))), 1, k).alias("near"))
    lone = per_rep.join(member.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("id"), F.posexplode("near").alias("p", "e")).select("id", "e.other_id", (-F.col("e.far")).alias("similarity"), (F.col("p") + 1).alias("rank"))
    shared = copies.join(per_rep, "rep").select("id", F.explode("near").alias("e")).select("id", "e.other_id", (-F.col("e.far")).alias("similarity")).unionByName(own)
    ranked = shared.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "other_id"))), 1, k).alias("near"))
    multi = ranked.select("id", F.posexplode("near").alias("p", "e")).select("id", "e.other_id", (-F.col("e.far")).alias("similarity"), (F.col("p") + 1).alias("rank"))
    bare = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    number = F.substring_index("id", ":", 1).cast("int")
    return lone.unionByName(multi).select(F.element_at(F.array(*[F.lit(n) for n in names]), number + 1).alias("collection"), bare("id").alias("id"), bare("other_id").alias("other_id"), "similarity", "rank")


def most_similar(rows: DataFrame, key: str, embedding: str, k: int = 5, width: int = 64, least: float | None = None, **search) -> DataFrame:
    """id, other_id, similarity, rank: most_similar_each() of one collection."""
    return most_similar_each({"": (rows, key, embedding)}, k, width, least, **search).drop("collection")


def similar_pairs_each(collections: dict[str, tuple[DataFrame, str, str]], least: float = 0.9, k: int = 5, **search) -> DataFrame:
    """collection, id_a, id_b (id_a < id_b) of which either is among the k most similar of the other, with at least that cosine."""
    near = most_similar_each(collections, k, least=least - 1e-7, **search)
    return near.select("collection", F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def similar_pairs(rows: DataFrame, key: str, embedding: str, least: float = 0.9, k: int = 5, **search) -> DataFrame:
    """id_a, id_b: similar_pairs_each() of one collection."""
    return similar_pairs_each({"": (rows, key, embedding)}, least, k, **search).drop("collection")
