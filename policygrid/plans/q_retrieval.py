"""Queries of retrieval, ranking metrics and significance, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.operators import distribution, metrics, models, retrieval, sampling, significance
from policygrid.operators.tiles import Tiles
from policygrid.session import durable, table

WIDTH = 64
CUTS = (1, 5, 10)


def _doc_number(c: str):
    return F.regexp_extract(c, "[0-9]+", 0).try_cast("bigint")


def chunk_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a document, a fold and a usable vector."""
    c = table(spark, sf_dir, "chunk")
    return c.where((F.trim("document_id") != "") & F.col("fold").isNotNull() & retrieval.usable_vector(F.col("embedding"), WIDTH)).withColumnRenamed("embedding", "vec")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks whose number is divisible by 20 as queries; the document of each is its target."""
    q = chunk_set(spark, sf_dir).where(F.regexp_extract("chunk_id", "[0-9]+$", 0).try_cast("bigint") % 20 == 0)
    return q.select(F.col("chunk_id").alias("query_id"), F.col("document_id").alias("target"), "vec", "fold", F.col("geography").alias("country"), "sector")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of the policy documents whose number is divisible by 20; the document is the target."""
    d = table(spark, sf_dir, "policy_document").where((_doc_number("document_id") % 20 == 0) & (F.trim("summary") != ""))
    return d.select(F.col("document_id").alias("query_id"), F.col("document_id").alias("target"), "summary")


def chunk_scores(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    """Each query against the other chunks of its fold."""
    s = retrieval.block_cosine(query_set(spark, sf_dir), chunk_set(spark, sf_dir), None if k is None else k + 1, group="fold")
    return s.where("query_id <> chunk_id")


def tiles(spark: SparkSession, sf_dir: str, **more: DataFrame) -> Tiles:
    """Each query against the other chunks of its fold, by document; `more` takes the place of queries or chunks."""
    q, c = more.get("queries", query_set(spark, sf_dir)), more.get("chunks", chunk_set(spark, sf_dir))
    return Tiles(q, c.where("chunk_id is not null"), group="fold")


def retrieval_metrics_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(tiles(spark, sf_dir).target_ranks().withColumn("rank", F.col("ranks")[0]), CUTS)


def _trace(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = chunk_set(spark, sf_dir).select("chunk_id", "document_id")
    return retrieval.trace(chunk_scores(spark, sf_dir, k), docs, query_set(spark, sf_dir), k)


def retrieval_trace_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir, 10)


def retrieval_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, number of chunks and best score of each query once the cascade has chosen."""
    best = retrieval.cascade_best(query_set(spark, sf_dir), chunk_set(spark, sf_dir))
    return best.select("query_id", F.col("level").cast("bigint").alias("level"), "n_chunks", "best_score")


def retrieval_distinct_docs_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "policy_document").where("approval_year is not null").select("document_id").distinct().withColumn("allowed", F.lit(True))
    c = chunk_set(spark, sf_dir).join(allowed, "document_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    out = tiles(spark, sf_dir, chunks=c).distinct_documents(3)
    return out.select("query_id", "document_id", "chunk_id", "score", F.col("chunk_rank").cast("bigint").alias("chunk_rank"), F.col("doc_no").cast("bigint").alias("doc_no"))


def hit5_by_filter_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@5 of the documents left by each hard filter; a query whose filter leaves none counts as a miss."""
    c = chunk_set(spark, sf_dir)
    meta = c.groupBy("document_id").agg(F.min(F.trim("geography")).alias("g"), F.min(F.trim("sector")).alias("s"))
    q = query_set(spark, sf_dir).withColumns({"country": F.trim("country"), "sector": F.trim("sector")})
    modes = ("none", "country", "sector", "both")
    ranks = tiles(spark, sf_dir, queries=q, chunks=c.join(meta, "document_id")).target_ranks(modes=modes)
    each = ranks.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col("ranks")[i].alias("rank")) for i, m in enumerate(modes)])).alias("x")).select("x.*")
    found = each.groupBy("mode").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(metrics.hit(F.col("rank"), 5)).alias("hit_5"))
    every = spark.createDataFrame([(m,) for m in modes], "mode string")
    return every.join(found, "mode", "left").select("mode", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), F.round("hit_5", 6).alias("hit_5"))


def error_analysis_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with its best document, whether that is the target, and the target's own score."""
    t = tiles(spark, sf_dir)
    best = t.top_documents(1).select("query_id", F.struct("document_id", "score").alias("b"))
    goal = query_set(spark, sf_dir).select("query_id", "target")
    own = t.own_scores().select("query_id", F.col("own")[0].alias("target_score"))
    return best.join(goal, "query_id").join(own, "query_id", "left").select("query_id", F.col("b.document_id").alias("best_document_id"), F.col("b.score").alias("best_score"), "target_score", F.when(F.col("b.document_id") == F.col("target"), "correct").otherwise("incorrect").alias("outcome"))


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, method and metrics of two poolings."""
    ranks = tiles(spark, sf_dir).target_ranks(kinds=("score", "mean"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col("ranks")[i].alias("rank")) for i, m in enumerate(("max_pool", "mean_pool"))]))
    by_query = ranks.join(query_set(spark, sf_dir).select("query_id", "fold"), "query_id").select("fold", each.alias("x")).select("fold", "x.*")
    return metrics.evaluate(by_query, CUTS, ["fold", "method"])


def metrics_by_fold_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_metrics(spark, sf_dir)


def metrics_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summarize(fold_metrics(spark, sf_dir), ["method"])


def paired_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = significance.paired_statistics(fold_metrics(spark, sf_dir), [("mean_pool", "max_pool")], ["hit_10", "ndcg_10", "mrr_10"])
    return s.select("baseline", "candidate", "metric", "n", *[F.round(c, 6).alias(c) for c in ("baseline_mean", "candidate_mean", "mean_diff", "t_stat", "w_stat")])


def paired_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.p_values(fold_metrics(spark, sf_dir), [("mean_pool", "max_pool")], ["hit_10", "ndcg_10", "mrr_10"])


def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds in the place of runs."""
    return metrics.stability(fold_metrics(spark, sf_dir), "ndcg_10", ["method"])


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = distribution.score_histogram(_trace(spark, sf_dir, 50).withColumn("relevant", F.col("is_relevant_doc").cast("bigint")), "retrieved_score", "relevant", 30)
    return h.select("relevant", F.col("bin").cast("bigint").alias("bin"), "n", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"), F.round("density", 6).alias("density"))


def trace_hit1_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = sampling.query_hits(_trace(spark, sf_dir, 10), ["query_id", "target_doc_id"])
    return h.select("query_id", "retrieved_doc_id", "retrieved_score", "hit1", "n_relevant")


def _bm25(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    c = table(spark, sf_dir, "chunk").where("trim(document_id) <> ''")
    return retrieval.BM25(c, "chunk_id", "text").score(text_queries(spark, sf_dir), "query_id", "summary", k=k).join(c.select("chunk_id", "document_id"), "chunk_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.top_per(_bm25(spark, sf_dir, 3), ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], 3, salt=F.col("chunk_id"))
    return top.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that shares no word isn't ranked; ranks beyond the last cut are not told apart, as no metric does."""
    c = table(spark, sf_dir, "chunk").where("trim(document_id) <> ''")
    bm = retrieval.BM25(c, "chunk_id", "text", label="document_id")
    return metrics.evaluate(bm.target_ranks(text_queries(spark, sf_dir), "query_id", "summary", "target", within=max(CUTS)), CUTS)


def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of `embeddings`: the next row of the label is the positive, the first of the next label the negative.

    Shards are 1,000 ids of a label; the last row of each takes the first of the next that has any.
    """
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("neg")).select((F.col("label") - 1).alias("label"), "neg")
    e = e.withColumn("block", F.floor(F.col("vec_id") / 1000))
    heads = e.groupBy("label", "block").agg(F.min_by(F.struct("embedding"), F.col("vec_id")).alias("head"))
    halo = heads.select("label", "block", F.lead("head").over(W.partitionBy("label").orderBy("block")).alias("head"))
    pos = F.lead(F.struct("embedding")).over(W.partitionBy("label", "block").orderBy("vec_id"))
    t = e.withColumn("pos", pos).join(halo, ["label", "block"]).withColumn("pos", F.coalesce("pos", "head")["embedding"]).where("pos is not null").join(first, "label")
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(models.triplet_loss(F.col("embedding"), F.col("pos"), F.col("neg"))), 6).alias("loss"))


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 consecutive rows of `embeddings`; a row's score with itself is the target."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), "vec_id", "embedding")
    s = e.join(e.select("batch", F.col("vec_id").alias("col"), F.col("embedding").alias("other")), "batch").select("batch", F.col("vec_id").alias("row"), "col", retrieval.cosine(F.col("embedding"), F.col("other")).alias("score"))
    return models.contrastive_loss(s, "batch", "row", "col", "score").select(F.col("batch").cast("bigint").alias("batch"), F.round("loss", 6).alias("loss"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_metrics_cosine, retrieval_trace_topk, retrieval_filter_cascade, retrieval_distinct_docs_top3, hit5_by_filter_mode, error_analysis_split, metrics_by_fold_method,
        metrics_by_method, paired_significance, paired_pvalues, stability_summary, score_histogram, trace_hit1_collapse, bm25_topk, bm25_metrics, triplet_loss, contrastive_loss,
    )
}

_OK = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_BASE = f"""
c AS MATERIALIZED (SELECT chunk_id, document_id, CAST(embedding AS DOUBLE[]) AS v, geography, sector, fold FROM chunk WHERE trim(document_id) <> '' AND fold IS NOT NULL AND {_OK}),
q AS MATERIALIZED (SELECT chunk_id AS query_id, document_id AS target, v, fold, geography, sector FROM c WHERE TRY_CAST(regexp_extract(chunk_id, '[0-9]+$') AS BIGINT) % 20 = 0),
s AS MATERIALIZED (SELECT query_id, chunk_id, document_id, round(CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(c.v, c.v) = 0 THEN 0
        ELSE list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) END, 10) AS score FROM q JOIN c ON q.fold = c.fold AND q.query_id <> c.chunk_id),
d AS MATERIALIZED (SELECT query_id, document_id, max(score) AS score, round(avg(score), 9) AS mean_score FROM s GROUP BY ALL)"""
_TRACE = """t AS (SELECT query_id, target AS target_doc_id, rn AS retrieved_rank, document_id AS retrieved_doc_id, score AS retrieved_score,
   CAST(document_id = target AS DOUBLE) AS is_relevant_doc, chunk_id AS retrieved_chunk_id
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s) JOIN q USING (query_id) WHERE rn <= {k})"""


def _metric(r: str = "r") -> str:
    out = []
    for m, e in (("hit", "1.0::DOUBLE"), ("precision", "1.0::DOUBLE / {k}"), ("ndcg", "1 / log2({r} + 1)"), ("mrr", "1.0::DOUBLE / {r}")):
        for k in CUTS:
            out.append(f"round(coalesce(avg(CASE WHEN {r} <= {k} THEN {e.format(k=k, r=r)} ELSE 0 END), 0), 6) AS {m}_{k}")
    return ", ".join(out)


_RANK = """SELECT {q}.query_id, r FROM {q} LEFT JOIN (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY {c} DESC, document_id) AS r FROM {d}) x
   ON x.query_id = {q}.query_id AND x.document_id = {q}.target"""
_FOLDED = f"""rk AS (SELECT 'max_pool' AS method, * FROM ({_RANK.format(c="score", d="d", q="q")}) UNION ALL SELECT 'mean_pool', * FROM ({_RANK.format(c="mean_score", d="d", q="q")})),
fm AS (SELECT fold, method, count(*) AS queries_evaluated, {_metric()} FROM rk JOIN q USING (query_id) GROUP BY fold, method)"""
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_BM25 = f"""tq AS (SELECT document_id AS query_id, document_id AS target, summary FROM policy_document WHERE TRY_CAST(regexp_extract(document_id, '[0-9]+') AS BIGINT) % 20 = 0 AND trim(summary) <> ''),
cc AS (SELECT chunk_id, document_id, {_TOK.format("text")} AS t FROM chunk WHERE trim(document_id) <> ''),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM cc),
p AS (SELECT chunk_id, dl, term, count(*) AS f FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM cc) GROUP BY ALL),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
w AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TOK.format("summary")}) AS term FROM tq) GROUP BY ALL),
b AS MATERIALIZED (SELECT query_id, chunk_id, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM w JOIN idf USING (term) JOIN p USING (term), st GROUP BY ALL)"""

SQL = {
    "retrieval_metrics_cosine": f"WITH {_BASE} SELECT count(*) AS queries_evaluated, {_metric()} FROM ({_RANK.format(c='score', d='d', q='q')})",
    "retrieval_trace_topk": f"WITH {_BASE}, {_TRACE.format(k=10)} SELECT * FROM t",
    "retrieval_filter_cascade": f"""WITH {_BASE}, m AS (SELECT s.query_id, s.score, CASE WHEN trim(q.geography) <> '' AND trim(q.geography) = trim(c.geography) AND trim(q.sector) <> '' AND trim(q.sector) = trim(c.sector) THEN 1
          WHEN trim(q.geography) <> '' AND trim(q.geography) = trim(c.geography) THEN 2 ELSE 3 END AS level FROM s JOIN q USING (query_id) JOIN c USING (chunk_id)), l AS (SELECT query_id, min(level) AS level FROM m GROUP BY query_id)
        SELECT query_id, CAST(level AS BIGINT) AS level, count(*) AS n_chunks, max(score) AS best_score FROM m JOIN l USING (query_id, level) GROUP BY ALL""",
    "retrieval_distinct_docs_top3": f"""WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS chunk_rank FROM s),
        a AS (SELECT * FROM r WHERE chunk_rank <= 1000 AND document_id IN (SELECT document_id FROM policy_document WHERE approval_year IS NOT NULL)),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY chunk_rank) AS k FROM a)
        SELECT * FROM (SELECT query_id, document_id, chunk_id, score, chunk_rank, row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank) AS doc_no FROM o WHERE k = 1) WHERE doc_no <= 3""",
    "hit5_by_filter_mode": f"""WITH {_BASE}, m AS (SELECT document_id, min(trim(geography)) AS g, min(trim(sector)) AS s FROM c GROUP BY document_id),
        x AS (SELECT d.query_id, d.document_id, d.score, a.g, a.s, trim(q.geography) AS qg, trim(q.sector) AS qs FROM d JOIN m a USING (document_id) JOIN q USING (query_id)),
        y AS (SELECT 'none' AS mode, * FROM x UNION ALL SELECT 'country', * FROM x WHERE g = qg UNION ALL SELECT 'sector', * FROM x WHERE s = qs UNION ALL SELECT 'both', * FROM x WHERE g = qg AND s = qs),
        r AS (SELECT mode, query_id, document_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, document_id) AS r FROM y)
        SELECT v.mode, count(*) AS n_queries, round(avg(CASE WHEN r.r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5 FROM (VALUES ('none'), ('country'), ('sector'), ('both')) AS v(mode) CROSS JOIN q
        LEFT JOIN r ON r.mode = v.mode AND r.query_id = q.query_id AND r.document_id = q.target GROUP BY v.mode""",
    "error_analysis_split": f"""WITH {_BASE}, b AS (SELECT query_id, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS r FROM d) WHERE r = 1)
        SELECT b.query_id, b.document_id AS best_document_id, b.score AS best_score, o.score AS target_score, CASE WHEN b.document_id = q.target THEN 'correct' ELSE 'incorrect' END AS outcome
        FROM b JOIN q USING (query_id) LEFT JOIN d o ON o.query_id = b.query_id AND o.document_id = q.target""",
    "metrics_by_fold_method": f"WITH {_BASE}, {_FOLDED} SELECT * FROM fm",
    "metrics_by_method": f"WITH {_BASE}, {_FOLDED} SELECT method, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for m in metrics.METRICS for k in CUTS) + " FROM fm GROUP BY method",
    "paired_significance": f"""WITH {_BASE}, {_FOLDED}, l AS (UNPIVOT (SELECT fold, method, hit_10, ndcg_10, mrr_10 FROM fm) ON hit_10, ndcg_10, mrr_10 INTO NAME metric VALUE v),
        x AS (SELECT metric, fold, a.v AS b, z.v AS c, round(z.v - a.v, 12) AS d FROM l a JOIN l z USING (metric, fold) WHERE a.method = 'mean_pool' AND z.method = 'max_pool'),
        g AS (SELECT metric, count(*) AS n, avg(b) AS bm, avg(c) AS cm, avg(d) AS md, stddev_samp(d) AS sd FROM x GROUP BY metric),
        k AS (SELECT metric, d, avg(k) OVER (PARTITION BY metric, abs(d)) AS r FROM (SELECT metric, d, row_number() OVER (PARTITION BY metric ORDER BY abs(d)) AS k FROM x WHERE d <> 0)),
        w AS (SELECT metric, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM k GROUP BY metric)
        SELECT 'mean_pool' AS baseline, 'max_pool' AS candidate, metric, n, round(bm, 6) AS baseline_mean, round(cm, 6) AS candidate_mean, round(md, 6) AS mean_diff,
        round(CASE WHEN n >= 2 AND sd <> 0 THEN md / (sd / sqrt(n)) END, 6) AS t_stat, round(coalesce(w, 0), 6) AS w_stat FROM g LEFT JOIN w USING (metric)""",
    "stability_summary": f"""WITH {_BASE}, {_FOLDED} SELECT method, count(ndcg_10) AS n_runs, round(avg(ndcg_10), 6) AS mean, round(CASE WHEN count(ndcg_10) > 1 THEN stddev_samp(ndcg_10) ELSE 0 END, 6) AS std,
        round(CASE WHEN avg(ndcg_10) > 0 THEN CASE WHEN count(ndcg_10) > 1 THEN stddev_samp(ndcg_10) ELSE 0 END / avg(ndcg_10) * 100 ELSE 0 END, 2) AS cv_pct, round(min(ndcg_10), 6) AS min, round(max(ndcg_10), 6) AS max FROM fm GROUP BY method""",
    "score_histogram": f"""WITH {_BASE}, {_TRACE.format(k=50)}, e AS (SELECT min(retrieved_score) AS lo, max(retrieved_score) AS hi, (max(retrieved_score) - min(retrieved_score)) / 30 AS w FROM t),
        h AS (SELECT CAST(is_relevant_doc AS BIGINT) AS relevant, CAST(least(floor((retrieved_score - lo) / w), 29) AS BIGINT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM t, e GROUP BY 1, 2)
        SELECT relevant, bin, n, round(lo + bin * w, 8) AS lo, round(lo + (bin + 1) * w, 8) AS hi, round(n / (sum(n) OVER (PARTITION BY relevant) * w), 6) AS density FROM h""",
    "trace_hit1_collapse": f"""WITH {_BASE}, {_TRACE.format(k=10)} SELECT query_id, arg_min(retrieved_doc_id, retrieved_rank) AS retrieved_doc_id, arg_min(retrieved_score, retrieved_rank) AS retrieved_score,
        arg_min(is_relevant_doc, retrieved_rank) > 0 AS hit1, count(*) FILTER (is_relevant_doc > 0) AS n_relevant FROM t GROUP BY query_id HAVING min(retrieved_rank) = 1""",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= 3",
    "bm25_metrics": f"""WITH {_BM25}, bd AS (SELECT query_id, document_id, max(score) AS score FROM b JOIN cc USING (chunk_id) GROUP BY ALL)
        SELECT count(*) AS queries_evaluated, {_metric()} FROM ({_RANK.format(c="score", d="bd", q="tq")})""",
    "triplet_loss": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label - 1 AS label, arg_min(v, vec_id) AS neg FROM e GROUP BY label),
        t AS (SELECT label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM e),
        x AS (SELECT sqrt(list_sum(list_transform(list_zip(v, pos), lambda z: (z[1] - z[2] + 1e-6) * (z[1] - z[2] + 1e-6)))) AS a, sqrt(list_sum(list_transform(list_zip(v, neg), lambda z: (z[1] - z[2] + 1e-6) * (z[1] - z[2] + 1e-6)))) AS b
          FROM t JOIN f USING (label) WHERE pos IS NOT NULL) SELECT count(*) AS n, round(avg(greatest(a - b + 1, 0)), 6) AS loss FROM x""",
    "contrastive_loss": """WITH e AS (SELECT vec_id // 16 AS batch, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        z AS (SELECT a.batch, a.vec_id AS r, b.vec_id AS c, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) / 0.07 AS z FROM e a JOIN e b USING (batch)),
        l AS (SELECT batch, r AS k, max(z) + ln(sum(exp(z - m))) - max(CASE WHEN r = c THEN z END) AS l FROM (SELECT *, max(z) OVER (PARTITION BY batch, r) AS m FROM z) GROUP BY batch, r),
        o AS (SELECT batch, c AS k, max(z) + ln(sum(exp(z - m))) - max(CASE WHEN r = c THEN z END) AS l FROM (SELECT *, max(z) OVER (PARTITION BY batch, c) AS m FROM z) GROUP BY batch, c)
        SELECT batch, round(((SELECT avg(l) FROM l WHERE l.batch = x.batch) + (SELECT avg(l) FROM o WHERE o.batch = x.batch)) / 2, 6) AS loss FROM (SELECT DISTINCT batch FROM e) x""",
}
