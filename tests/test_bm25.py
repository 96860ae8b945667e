"""BM25 ranks in tiles against SQL over made tables: equal chunks, ids that come twice, absent ids and texts, weights of 0 and below."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from policygrid.operators import retrieval, term_tiles
from policygrid.plans import q_retrieval
from test_tiles import written

SQL = __spark_entry__.oracle_sql()["bm25_metrics"]


def tables(folder, words, chunks, odd):
    """Chunks of 40 documents, one of which has a quarter of all, and a summary per document."""
    r = np.random.default_rng(words)
    text = lambda n: " ".join(f"w{int(x)}" for x in np.minimum(r.geometric(min(0.9, 6 / words), n), words))
    own = [f"D{20 * (0 if i % 4 == 0 else i % 40):05d}" for i in range(chunks)]
    c = [(f"c{i:04d}", own[i], text(int(r.integers(3, 9)))) for i in range(chunks)]
    if odd:
        c[5:10] = [(*c[5][:2], c[6][2]), c[5], ("c0005", "D00040", "w1 w2 w90"), (None, "D00020", "w1 w3"), (None, "D00020", "w4 w1")]
        c[10:14] = [("c0010", "D00060", None), ("c0011", "  ", "w1 w2"), ("c0012", None, "w2"), ("c0013", "D00080", c[30][2])]
    d = [(f"D{20 * i:05d}", text(12)) for i in range(44)]
    if odd:
        d[1:4] = [(d[0][0], "w9 W1, w1"), (d[2][0], "  "), (d[3][0], "--")]
    con = duckdb.connect()
    for name, columns, rows in (("chunk", "chunk_id VARCHAR, document_id VARCHAR, text VARCHAR", c), ("policy_document", "document_id VARCHAR, summary VARCHAR", d)):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (columns.count(',') + 1))})", rows)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(term_tiles, "TILE", 100)
    monkeypatch.setattr(term_tiles, "QUERIES", 32)


@pytest.mark.parametrize(("words", "chunks", "odd"), [(60, 300, True), (3, 40, False)])
def test_ranks_and_metrics_are_those_of_sql(spark, tmp_path, small_tiles, words, chunks, odd):
    con = tables(tmp_path, words, chunks, odd)
    at = SQL.rfind("SELECT count(*) AS queries_evaluated")
    want = con.sql(f"{SQL[:at]} SELECT query_id, coalesce(r, 0) FROM ({SQL[SQL.index('FROM (', at) + 6 : -1]}) ORDER BY ALL").fetchall()
    assert len({r for _, r in want}) > 10 or words < 10
    c = spark.read.parquet(f"{tmp_path}/chunk.parquet").where("trim(document_id) <> ''")
    bm = retrieval.BM25(c, "chunk_id", "text", label="document_id")
    q = q_retrieval.text_queries(spark, str(tmp_path))
    for within in (None, 3):
        got = bm.target_ranks(q, "query_id", "summary", "target", within=within).select("query_id", F.coalesce("rank", F.lit(0)).alias("rank")).collect()
        assert sorted((x["query_id"], x["rank"]) for x in got) == [(i, r if within is None or r <= within else 0) for i, r in want]
    metrics = q_retrieval.bm25_metrics(spark, str(tmp_path))
    rel = con.sql(SQL)
    assert [metrics.first()[c] for c in rel.columns] == pytest.approx(rel.fetchall()[0], abs=1e-9)


def test_metrics_keep_no_row_per_query_and_document(spark, tmp_path, small_tiles):
    tables(tmp_path, 60, 300, False)
    assert written(spark, lambda: q_retrieval.bm25_metrics(spark, str(tmp_path))) <= 300
