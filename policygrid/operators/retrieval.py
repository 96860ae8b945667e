"""Retrieval over chunks: exact cosine in blocks, BM25, filter cascade, document pooling, traces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions.ordering import top_per
from policygrid.functions.text import tokens
from policygrid.operators.term_tiles import TermTiles
from policygrid.session import durable, spread

#: Rows of a block on either side of a block product.
BLOCK = 2048


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one is all zero. Interpreted: for pairs that are few; block_cosine() for many."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, vector_norm(a) * vector_norm(b)), F.lit(0.0))


def usable_vector(v: Column, width: int) -> Column:
    """Whether a vector has `width` elements, none null, NaN or infinite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == width) & ~F.coalesce(bad, F.lit(True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (ids, labels, unit vectors as bytes, group) from rows of (id, vec, group, label)."""
    for batch in batches:
        groups = batch.column(2).to_numpy(zero_copy_only=False)
        for g in np.unique(groups):
            own = batch.take(pa.array(np.flatnonzero(groups == g)))
            for a in range(0, own.num_rows, BLOCK):
                part = own.slice(a, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                unit = x / np.where(norm > 0, norm, 1)
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, part.column(0)), pa.ListArray.from_arrays(one, part.column(3)), pa.array([unit.tobytes()], pa.binary()), pa.array([g], pa.int64())], ["ids", "labels", "m", "g"])


def _blocks(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, np.ndarray]]:
    """Query ids, chunk ids, chunk labels and rounded scores of each pair of blocks."""
    for batch in batches:
        for r in range(batch.num_rows):
            qi, ci, li = (batch.column(i)[r].values for i in (0, 2, 4))
            if len(qi) and len(ci):
                q = np.frombuffer(batch.column(1)[r].as_buffer(), np.float64).reshape(len(qi), -1)
                c = np.frombuffer(batch.column(3)[r].as_buffer(), np.float64).reshape(len(ci), -1)
                yield qi, ci, li, np.round(q @ c.T, digits) + 0.0


def _products(k: int | None, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, ci, _, s in _blocks(batches, digits):
            n = len(ci) if k is None else min(k, len(ci))
            if n < len(ci):
                # Ties at the edge must not be cut by chance: all of the k-th score go on.
                edge = -np.partition(-s, n - 1, 1)[:, n - 1 : n]
                rows, cols = np.nonzero(s >= edge)
            else:
                rows, cols = np.divmod(np.arange(s.size), len(ci))
            yield pa.RecordBatch.from_arrays([qi.take(pa.array(rows)), ci.take(pa.array(cols)), pa.array(s[rows, cols])], ["query_id", "chunk_id", "score"])

    return run


def _pooled(digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, ci, li, s in _blocks(batches, digits):
            label = li.dictionary_encode()
            at = label.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            begin = np.searchsorted(at[order], np.arange(len(label.dictionary)))
            place = {c: j for j, c in enumerate(ci.to_pylist())}
            same = [(i, place[q]) for i, q in enumerate(qi.to_pylist()) if q in place]
            counted = np.ones(s.shape)
            if same:
                i, j = np.array(same).T
                counted[i, j], s[i, j] = 0, -np.inf
            best = np.maximum.reduceat(s[:, order], begin, 1)
            total = np.add.reduceat(np.where(counted > 0, s, 0)[:, order], begin, 1)
            n = np.add.reduceat(counted[:, order], begin, 1)
            rows, cols = np.nonzero(n > 0)
            yield pa.RecordBatch.from_arrays(
                [qi.take(pa.array(rows)), label.dictionary.take(pa.array(cols)), pa.array(best[rows, cols]), pa.array(total[rows, cols]), pa.array(n[rows, cols].astype(np.int64))], ["query_id", "label", "best", "total", "n"]
            )

    return run


def _block_pairs(queries: DataFrame, chunks: DataFrame, group: str | None, label: str | None) -> tuple[DataFrame, str, str, str]:
    qt, ct = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    # A part is about two blocks of chunks, so tasks follow the number of chunks.
    parts = max(1, math.ceil(chunks.select("chunk_id").count() / (2 * BLOCK)))
    g = (F.col(group) if group else F.lit(0)).cast("long").alias("g")
    own = F.col(label) if label else F.lit(None).cast("string")
    lt = chunks.schema[label].dataType.simpleString() if label else "string"
    q = queries.select("query_id", "vec", g, F.lit(None).cast("string").alias("l")).where("g is not null").mapInArrow(_packed, f"ids array<{qt}>, labels array<string>, m binary, g long")
    c = chunks.select("chunk_id", "vec", g, own.alias("l")).where("g is not null").mapInArrow(_packed, f"ids array<{ct}>, labels array<{lt}>, m binary, g long")
    left = q.select("g", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = c.select("g", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("m").alias("c_m"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(parts)).cast("int").alias("part"))
    tasks = max(parts, queries.sparkSession.sparkContext.defaultParallelism)
    left, right = spread(left, tasks, "g", "part"), spread(right, tasks, "g", "part")
    return left.join(right, ["g", "part"]).select("q_ids", "q_m", "c_ids", "c_m", "c_labels"), qt, ct, lt


def block_cosine(queries: DataFrame, chunks: DataFrame, k: int | None = None, digits: int = 10, group: str | None = None) -> DataFrame:
    """query_id, chunk_id, score of a query set (query_id, vec) against all chunks (chunk_id, vec), exact.

    Both sides are packed into blocks of unit vectors; every query block goes to
    every chunk block by an equi-join on the number of its part of the chunks, and
    a pair is one matrix product. With `group` (a whole-numbered column of both,
    such as the fold) only rows of equal groups meet. With `k` each block pair keeps
    its k best per query and all ties with the k-th. Vectors must be usable.
    """
    pairs, qt, ct, _ = _block_pairs(queries, chunks, group, None)
    return pairs.mapInArrow(_products(k, digits), f"query_id {qt}, chunk_id {ct}, score double")


def block_pool(queries: DataFrame, chunks: DataFrame, label: str = "document_id", digits: int = 10, group: str | None = None) -> DataFrame:
    """query_id, label, score, mean_score, n_chunks: block_cosine() pooled by a column of the chunks.

    A pair of blocks is pooled where it is multiplied, so rows of single chunks are
    never made. A chunk doesn't count for the query that has its id.
    """
    pairs, qt, _, lt = _block_pairs(queries, chunks, group, label)
    part = pairs.mapInArrow(_pooled(digits), f"query_id {qt}, label {lt}, best double, total double, n long")
    return part.groupBy("query_id", F.col("label").alias(label)).agg(F.max("best").alias("score"), (F.sum("total") / F.sum("n")).alias("mean_score"), F.sum("n").alias("n_chunks"))


def _term_products(k: int | None, digits: int):
    def run(postings: pa.Table, weights: pa.Table) -> pa.Table:
        t, tw = postings.column("t").to_numpy(), weights.column("t").to_numpy()
        chunk = postings.column("chunk_id").combine_chunks().dictionary_encode()
        query = weights.column("query_id").combine_chunks().dictionary_encode()
        ids, rows = chunk.dictionary, chunk.indices.to_numpy(zero_copy_only=False)
        q_ids, q_rows = query.dictionary, query.indices.to_numpy(zero_copy_only=False)
        terms = np.unique(tw)
        w, p = weights.column("w").to_numpy(), postings.column("p").to_numpy()
        m = np.zeros((len(terms), len(q_ids)))
        m[np.searchsorted(terms, tw), q_rows] = w
        place = np.minimum(np.searchsorted(terms, t), max(0, len(terms) - 1))
        known = terms[place] == t if len(terms) else np.zeros(len(t), bool)
        rows, place, p = rows[known], place[known], p[known]
        order = np.argsort(rows, kind="stable")
        rows, place, p = rows[order], place[order], p[order]
        out = []
        for a in range(0, len(ids), 512):
            lo, hi = np.searchsorted(rows, (a, a + 512))
            x = np.zeros((min(512, len(ids) - a), len(terms)))
            x[rows[lo:hi] - a, place[lo:hi]] = p[lo:hi]
            s = np.round(x @ m, digits) + 0.0
            # Terms whose weight is 0 count as shared too.
            shared = s != 0 if (w != 0).all() else (x > 0).astype(np.float32) @ (m != 0).astype(np.float32) + ((x > 0).astype(np.float32) @ _zero_weights(m, tw, terms, q_rows, w)) > 0
            if k is not None and k < len(x):
                ranked = np.where(shared, s, -np.inf)
                shared &= ranked >= -np.partition(-ranked, k - 1, 0)[k - 1]
            c, q = np.nonzero(shared)
            out.append((q, c + a, s[c, q]))
        cat = [np.concatenate([o[i] for o in out]) if out else np.empty(0, (np.int64, np.int64, np.float64)[i]) for i in range(3)]
        return pa.table({"query_id": q_ids.take(pa.array(cat[0], pa.int64())), "chunk_id": ids.take(pa.array(cat[1], pa.int64())), "score": pa.array(cat[2], pa.float64())})

    return run


def _zero_weights(m: np.ndarray, tw: np.ndarray, terms: np.ndarray, q_rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """1 where a query has a term of weight 0."""
    out = np.zeros(m.shape, np.float32)
    out[np.searchsorted(terms, tw[w == 0]), q_rows[w == 0]] = 1
    return out


def pool_documents(scores: DataFrame, doc: str = "document_id") -> DataFrame:
    """query_id, document, score: the greatest chunk score of each document."""
    return scores.groupBy("query_id", doc).agg(F.max("score").alias("score"))


def rank_documents(pooled: DataFrame, k: int | None = None, doc: str = "document_id") -> DataFrame:
    """query_id, document, score, rank (by score, ties by document)."""
    order = [F.col("score").desc(), F.col(doc).asc()]
    if k is not None:
        return top_per(pooled, ["query_id"], order, k, salt=F.col(doc))
    return pooled.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def target_ranks(pooled: DataFrame, targets: DataFrame, doc: str = "document_id") -> DataFrame:
    """query_id, rank of each query's target among its pooled documents, null if it isn't there.

    The rank is one more than the documents before the target: a join and a count,
    no sort of all documents.
    """
    goal = targets.select("query_id", F.col("target"))
    own = goal.join(pooled.select("query_id", F.col(doc).alias("target"), F.col("score").alias("own")), ["query_id", "target"], "left")
    ahead = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col(doc) < F.col("target")))
    counted = pooled.join(own.where("own is not null"), "query_id").groupBy("query_id").agg((F.count_if(ahead) + 1).alias("rank"))
    return own.select("query_id", "target").join(counted, "query_id", "left")


def trace(scores: DataFrame, chunk_docs: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """One row per query and chunk rank up to k, with the chunk's document and whether it is the target."""
    ranked = top_per(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k, name="retrieved_rank", salt=F.col("chunk_id"))
    named = ranked.join(chunk_docs, "chunk_id").join(targets.select("query_id", F.col("target").alias("target_doc_id")), "query_id", "left")
    return named.select(
        "query_id", "target_doc_id", F.col("retrieved_rank").cast("long").alias("retrieved_rank"), F.col("document_id").alias("retrieved_doc_id"), F.col("score").alias("retrieved_score"),
        F.coalesce(F.col("document_id") == F.col("target_doc_id"), F.lit(False)).cast("double").alias("is_relevant_doc"), F.col("chunk_id").alias("retrieved_chunk_id"),
    )


def filter_cascade(scores: DataFrame, queries: DataFrame, chunk_meta: DataFrame) -> DataFrame:
    """Rows of the first level that has any per query: same country and sector (1), same country (2), all (3).

    `queries` has query_id, country, sector and `chunk_meta` chunk_id, geography,
    sector. A level counts only if the query's values for it aren't blank.
    """
    q = queries.select("query_id", F.trim("country").alias("_c"), F.trim("sector").alias("_s"))
    m = chunk_meta.select("chunk_id", F.trim("geography").alias("_g"), F.trim(chunk_meta["sector"]).alias("_t"))
    country = F.coalesce((F.col("_c") != "") & (F.col("_c") == F.col("_g")), F.lit(False))
    sector = F.coalesce((F.col("_s") != "") & (F.col("_s") == F.col("_t")), F.lit(False))
    marked = scores.join(q, "query_id").join(m, "chunk_id").withColumn("level", F.when(country & sector, 1).when(country, 2).otherwise(3))
    best = marked.groupBy("query_id").agg(F.min("level").alias("level"))
    return marked.join(best, ["query_id", "level"]).drop("_c", "_s", "_g", "_t")


def cascade_best(queries: DataFrame, chunks: DataFrame, digits: int = 10) -> DataFrame:
    """query_id, level, n_chunks, best_score of the first level of filter_cascade() that has a chunk for the query.

    `queries` has query_id, vec, fold, country, sector and `chunks` chunk_id, vec, fold,
    geography, sector; a query's own chunk doesn't count. Only chunks of the query's
    country are scored, pooled by sector where they are multiplied; all chunks of the
    fold only for queries whose country has none. No row per chunk is made.
    """
    q = queries.select("query_id", "vec", "fold", F.trim("country").alias("_c"), F.trim("sector").alias("_s"))
    c = chunks.select("chunk_id", "vec", "fold", F.trim("geography").alias("_c"), F.coalesce(F.trim("sector"), F.lit("")).alias("label"))
    place = F.xxhash64("fold", "_c").alias("place")
    near = durable(block_pool(q.where("_c <> ''").select("query_id", "vec", place), c.where("_c <> ''").select("chunk_id", "vec", "label", place), "label", digits, "place"), "same-country")
    mine = near.join(q.select("query_id", "_s"), "query_id")
    same = mine.where("_s <> '' and label = _s").select("query_id", F.lit(1).alias("level"), "n_chunks", F.col("score").alias("best_score"))
    country = near.groupBy("query_id").agg(F.lit(2).alias("level"), F.sum("n_chunks").alias("n_chunks"), F.max("score").alias("best_score")).join(same.select("query_id"), "query_id", "left_anti")
    rest = q.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "vec", "fold")
    far = block_pool(rest, c.select("chunk_id", "vec", F.lit("").alias("label"), "fold"), "label", digits, "fold")
    return same.unionByName(country).unionByName(far.select("query_id", F.lit(3).alias("level"), "n_chunks", F.col("score").alias("best_score")))


def distinct_documents(scores: DataFrame, chunk_docs: DataFrame, allowed: DataFrame, top_docs: int, top_chunks: int = 1000) -> DataFrame:
    """Of the top chunks per query the first of each allowed document, at most `top_docs` documents."""
    ranked = top_per(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], top_chunks, name="chunk_rank", salt=F.col("chunk_id"))
    docs = ranked.join(chunk_docs, "chunk_id").join(allowed.select("document_id").distinct(), "document_id", "left_semi")
    first = docs.groupBy("query_id", "document_id").agg(F.min_by(F.struct("chunk_id", "score", "chunk_rank"), F.col("chunk_rank")).alias("x"))
    flat = first.select("query_id", "document_id", "x.*")
    return flat.withColumn("doc_no", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_rank"))).where(F.col("doc_no") <= top_docs)


class BM25:
    """Okapi BM25 over chunks: term statistics are aggregates, scoring is a product of blocks.

    A negative idf is replaced by epsilon times the mean idf of the vocabulary.
    Query terms count as often as they occur; chunks that share no term are not in
    the result (their score is 0).
    """

    def __init__(self, chunks: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, label: str | None = None) -> None:
        """`label` is the column of a chunk's document, needed by target_ranks()."""
        self.k1, self.b, self.epsilon = k1, b, epsilon
        own = F.col(label) if label else F.lit(None).cast("string")
        toks = chunks.select(F.col(key).alias("chunk_id"), own.alias("label"), tokens(F.col(text)).alias("t"))
        self.toks = toks = durable(toks.select("chunk_id", "label", "t", F.size("t").alias("dl")), "tokens")
        self.postings = toks.select("chunk_id", "dl", F.explode("t").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
        row = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        if not row["n"]:
            raise ValueError("empty corpus")
        self.n, self.avgdl = row["n"], row["avgdl"] or 1.0
        # Rows of one id and length are one chunk; where no id comes twice no postings have to be grouped.
        twice = durable(toks.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
        self.once, self.again = toks, None
        if not twice.isEmpty():
            same = F.col("chunk_id").eqNullSafe(F.col("id"))
            self.once, again = toks.join(twice, same, "left_anti"), toks.join(twice, same, "left_semi")
            self.again = again.select("chunk_id", "dl", F.explode("t").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("f"))
        each = self.once.select(F.explode(F.array_distinct("t")).alias("term"))
        each = each if self.again is None else each.unionByName(self.again.select("term"))
        df = durable(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
        raw = df.select("term", (F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        self.mean_idf = raw.agg(F.coalesce(F.avg("idf"), F.lit(0.0))).first()[0]
        self.idf = raw.select("term", F.when(F.col("idf") < 0, F.lit(epsilon * self.mean_idf)).otherwise(F.col("idf")).alias("idf"))

    def target_ranks(self, queries: DataFrame, key: str, text: str, target: str, digits: int = 6, within: int | None = None) -> DataFrame:
        """query_id, target, rank of the target among the documents that share a term with the query, by their best chunk; null if it shares none.

        Chunks are scored in tiles of whole documents, so no row per query and chunk or
        document is made. With `within` ranks beyond it are null.
        """
        goals = queries.select(F.col(key).alias("query_id"), F.col(target).alias("target"))
        terms = queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        weights = terms.join(self.idf, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qf") * F.col("idf")).alias("w")))).alias("x"))
        asked = goals.where("target is not null").distinct().join(weights, "query_id").select("query_id", "target", F.concat_ws(" ", "x.term").alias("words"), F.col("x.w").alias("w"))
        words = self.once.where("dl > 0").select("label", "chunk_id", "dl", F.concat_ws(" ", "t").alias("words"))
        if self.again is not None:
            whole = self.again.groupBy("chunk_id", "dl").agg(F.concat_ws(" ", F.flatten(F.collect_list(F.array_repeat("term", F.col("f").cast("int"))))).alias("words"))
            owners = self.toks.select("chunk_id", "label").distinct()
            words = words.unionByName(whole.join(owners, "chunk_id").select("label", "chunk_id", "dl", "words"))
        words = words.where("chunk_id is not null and label is not null")
        ranks = TermTiles(durable(asked, "asked"), words, self.k1, self.b, self.avgdl, digits).target_ranks(within)
        return goals.join(ranks, ["query_id", "target"], "left")

    def score(self, queries: DataFrame, key: str, text: str, digits: int = 6, k: int | None = None) -> DataFrame:
        """query_id, chunk_id, score of the chunks that share a term with a query; with `k` at least its k best.

        Postings of the terms that queries use are gathered by blocks of chunks, and
        every block meets every block of queries (an equi-join on the two block
        numbers); a pair of blocks is one matrix product over the terms of its
        queries. With `k` each pair of blocks keeps its k best per query and all ties.
        """
        terms = queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        weights = durable(terms.join(self.idf, "term").select("query_id", "term", F.xxhash64("term").alias("t"), (F.col("qf") * F.col("idf")).alias("w")), "weights")
        q_blocks = max(1, math.ceil(weights.select("query_id").distinct().count() / 256))
        c_blocks = max(1, math.ceil(self.n / BLOCK))
        f, dl = F.col("f").cast("double"), F.col("dl")
        part = f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * dl / self.avgdl))
        used = self.postings.join(weights.select("term").distinct(), "term", "left_semi").select(
            "chunk_id", F.xxhash64("term").alias("t"), part.alias("p"), F.pmod(F.xxhash64("chunk_id"), F.lit(c_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
        wanted = weights.select("query_id", "t", "w", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"))
        qt, ct = weights.schema["query_id"].dataType.simpleString(), self.postings.schema["chunk_id"].dataType.simpleString()
        used, wanted = spread(used, c_blocks * q_blocks, "cb", "qb"), spread(wanted, c_blocks * q_blocks, "cb", "qb")
        pairs = used.groupBy("cb", "qb").cogroup(wanted.groupBy("cb", "qb")).applyInArrow(_term_products(k, digits), f"query_id {qt}, chunk_id {ct}, score double")
        return pairs
