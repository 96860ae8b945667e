"""Retrieval in tiles against the same from rows of every query and chunk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from policygrid.functions.ordering import top_per
from policygrid.operators import retrieval, tiles
from policygrid.session import shared_dir
from policygrid.plans import q_retrieval

CHUNK = "chunk_id string, document_id string, vec array<float>, fold int, g string, s string, allowed boolean"


@pytest.fixture(scope="module")
def small(spark):
    """Queries and chunks with equal vectors, a zero vector, a document in two folds and one that holds a third of all; tiles are cut small."""
    r = np.random.default_rng(6)
    vecs = [[float(np.float32(x)) for x in r.normal(size=6)] for _ in range(40)]
    docs = ["hot" if i % 3 == 0 else f"d{i % 17:02d}" for i in range(160)]
    rows = [(f"c{i:03d}", docs[i], [0.0] * 6 if i == 8 else vecs[int(r.integers(40))], i % 2, f"g{len(docs[i]) % 3 + i % 17 % 2}", ["s", "t", None][i % 3 if docs[i] != "hot" else 0], i % 5 > 0) for i in range(160)]
    c = spark.createDataFrame(rows, CHUNK)
    q = spark.createDataFrame([(x[0], "nowhere" if i == 3 else x[1], x[2], x[3], "g1", "s") for i, x in enumerate(rows[::7])], "query_id string, target string, vec array<float>, fold int, country string, sector string")
    before = tiles.TILE, tiles.CELLS
    tiles.TILE, tiles.CELLS = 24, 200
    yield q, c
    tiles.TILE, tiles.CELLS = before


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def written(spark, run):
    """The rows of the largest table that a query keeps in the shared folder."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/policygrid")
    there = lambda: {str(x.getPath()) for x in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)} if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs) else set()
    old = there()
    run().collect()
    return max((spark.read.parquet(p).count() for p in there() - old), default=0)


def test_ranks_by_best_and_mean_are_those_of_all_pairs(small):
    q, c = small
    pooled = retrieval.block_pool(q, c, group="fold").withColumn("mean_score", F.round("mean_score", 9)).cache()
    got = tiles.Tiles(q, c, group="fold").target_ranks(kinds=("score", "mean"))
    for i, name in enumerate(("score", "mean_score")):
        want = plain(retrieval.target_ranks(pooled.select("query_id", "document_id", F.col(name).alias("score")), q).select("query_id", F.coalesce("rank", F.lit(0))))
        assert plain(got.select("query_id", F.coalesce(F.col("ranks")[i], F.lit(0)))) == want
    assert got.where("ranks is null").count() == 1


def test_fold_metrics_keep_no_row_per_query_and_document(spark, sf):
    assert written(spark, lambda: __spark_entry__.queries()["metrics_by_fold_method"](spark, sf)) <= q_retrieval.query_set(spark, sf).count()


def test_cosine_metrics_keep_no_row_per_query_and_document(spark, sf):
    assert written(spark, lambda: __spark_entry__.queries()["retrieval_metrics_cosine"](spark, sf)) <= q_retrieval.query_set(spark, sf).count()


def test_ranks_by_mode_are_those_of_the_filtered_pairs(small):
    q, c = small
    pooled = retrieval.block_pool(q, c, group="fold")
    meta = c.groupBy("document_id").agg(F.min("g").alias("g"), F.min("s").alias("s"))
    both = pooled.join(meta, "document_id").join(q.select("query_id", "country", "sector"), "query_id").cache()
    modes = {"none": "true", "country": "g = country", "sector": "s = sector", "both": "g = country and s = sector"}
    got = tiles.Tiles(q, c.drop("g", "s").join(meta, "document_id"), group="fold").target_ranks(modes=tuple(modes))
    for i, keep in enumerate(modes.values()):
        want = plain(retrieval.target_ranks(both.where(keep), q).select("query_id", F.coalesce("rank", F.lit(0))))
        assert plain(got.select("query_id", F.coalesce(F.col("ranks")[i], F.lit(0)))) == want


def test_filter_modes_keep_no_row_per_query_and_document(spark, sf):
    assert written(spark, lambda: __spark_entry__.queries()["hit5_by_filter_mode"](spark, sf)) <= q_retrieval.query_set(spark, sf).count()


def test_best_document_and_own_score_are_those_of_all_pairs(small):
    q, c = small
    pooled = retrieval.block_pool(q, c, group="fold").cache()
    t = tiles.Tiles(q, c, group="fold")
    assert plain(t.top_documents(1)) == plain(retrieval.rank_documents(pooled.select("query_id", "document_id", "score"), 1))
    own = pooled.join(q.select("query_id", F.col("target").alias("document_id")), ["query_id", "document_id"])
    assert plain(t.own_scores().select("query_id", F.col("own")[0])) == plain(own.select("query_id", "score"))


def test_error_analysis_keeps_no_row_per_query_and_document(spark, sf):
    assert written(spark, lambda: __spark_entry__.queries()["error_analysis_split"](spark, sf)) <= q_retrieval.query_set(spark, sf).count()


def test_document_ranking_keeps_no_row_per_query_and_document(spark, sf, small):
    q, c = small
    want = retrieval.rank_documents(retrieval.block_pool(q, c, group="fold").select("query_id", "document_id", "score"), 10)
    assert plain(tiles.Tiles(q, c, group="fold").top_documents(10)) == plain(want)
    assert written(spark, lambda: __spark_entry__.queries()["document_ranking"](spark, sf)) <= q_retrieval.query_set(spark, sf).count()


@pytest.mark.parametrize("top", [1000, 9])
def test_distinct_documents_are_those_of_all_pairs(small, top):
    q, c = small
    scores = retrieval.block_cosine(q, c, group="fold").where("query_id <> chunk_id")
    named = c.where("allowed").select("chunk_id", "document_id")
    ranked = top_per(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], top, name="chunk_rank").join(named, "chunk_id")
    first = top_per(ranked, ["query_id", "document_id"], [F.col("chunk_rank").asc()], 1)
    want = top_per(first, ["query_id"], [F.col("chunk_rank").asc()], 3, name="doc_no").select("query_id", "document_id", "chunk_id", "score", "chunk_rank", "doc_no")
    assert plain(tiles.Tiles(q, c, group="fold").distinct_documents(3, top)) == plain(want)


@pytest.mark.parametrize("top", [1000, 9])
def test_sector_hits_are_those_of_all_pairs(small, top):
    q, c = small
    scores = retrieval.block_cosine(q, c, group="fold").where("query_id <> chunk_id")
    ranked = top_per(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], top, name="chunk_rank")
    same = ranked.join(c.where("s = 's'").select("chunk_id", "document_id"), "chunk_id")
    first = top_per(same, ["query_id", "document_id"], [F.col("chunk_rank").asc()], 1)
    five = top_per(first, ["query_id"], [F.col("chunk_rank").asc()], 5, name="doc_no").join(q.select("query_id", F.col("target").alias("document_id")), ["query_id", "document_id"])
    want = plain(five.select("query_id"))
    assert plain(tiles.Tiles(q, c, group="fold").sector_hits(5, top)) == want and want


def test_queries_without_a_group_meet_all_chunks(small):
    q, c = small
    pooled = retrieval.block_pool(q, c)
    want = plain(retrieval.target_ranks(pooled, q).select("query_id", F.coalesce("rank", F.lit(0))))
    assert plain(tiles.Tiles(q, c).target_ranks().select("query_id", F.coalesce(F.col("ranks")[0], F.lit(0)))) == want


def test_encoder_metrics_keep_no_row_per_query_and_document(spark, sf):
    q = spark.read.parquet(f"{sf}/policy_document.parquet").count()
    c = spark.read.parquet(f"{sf}/time_series.parquet").count()
    assert written(spark, lambda: __spark_entry__.queries()["encoder_metrics"](spark, sf)) <= max(q, c)


def test_related_chunks_are_those_of_all_pairs(spark):
    from policygrid.operators import generation, models

    words = "reef dune levee grid well barn"
    w = words.split()
    c = spark.createDataFrame([(f"c{i:02d}", f"d{i % 7}", f"{w[i % 6]} {w[i % 4]} {w[i % 5]}") for i in range(40)], "chunk_id string, document_id string, text string")
    t = spark.createDataFrame([("reef dune",), ("well grid barn",)], "analysis string")
    got = generation.related_chunks(t, "analysis", c, models.HashedWords(16))
    assert "mapinarrow" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    q, v = (models.embed_column(d, x, models.HashedWords(16), "vec") for d, x in ((t.withColumnRenamed("analysis", "query_id"), "query_id"), (c, "text")))
    near = retrieval.distinct_documents(retrieval.block_cosine(q, v.select("chunk_id", "vec"), 1000, 6), c.select("chunk_id", "document_id"), c.select("document_id"), 3)
    text = {r[0]: r[2] for r in c.collect()}
    want = {}
    for r in sorted(near.collect(), key=lambda r: r["doc_no"]):
        want.setdefault(r["query_id"], []).append(text[r["chunk_id"]])
    assert {r["analysis"]: r["chunks"] for r in got.collect()} == want
