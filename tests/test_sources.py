"""Readers, writers, checkpoints and streams on files made here."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from policygrid.operators import models
from policygrid.session import durable, release
from policygrid.sources import readers, writers
from policygrid.streaming import ingest


@pytest.fixture
def indicators(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "coal.meta.json").write_text('{"dataset": {"title": "Coal",\n "description": "d1"}, "description": "d2"}')
    (tmp_path / "a" / "coal.csv").write_text('location,year,output,note\n"Côte, Verte",2000,1.5,x\nB,1800,2,y\nB,n/a,2,y\n')
    (tmp_path / "rain.meta.json").write_text('{"title": " Rain ", "description": "d3"}')
    (tmp_path / "rain.csv").write_text("country,location,year,mm\nA,z,2001,7\n")
    (tmp_path / "gone.meta.json").write_text("{not json")
    return str(tmp_path)


def test_indicator_tables(spark, indicators):
    found = readers.discover_tables(spark, indicators)
    assert [t for t, _ in found] == ["Coal", "Rain"]
    meta = {r["title"]: r["description"] for r in readers.sidecars(spark, indicators).collect()}
    assert meta == {"Coal": "d1", "Rain": "d3", "gone": None}
    assert [r["title"] for r in readers.title_catalog(spark, indicators).collect()] == ["coal", "gone", "rain"]
    rows = {(r["table_idx"], r["country"], r["year"], r["feature"], r["value"]) for r in readers.read_indicators(spark, found).collect()}
    assert rows == {(0, "Côte, Verte", 2000, "t000__output", 1.5), (1, "A", 2001, "t001__mm", 7.0)}


def test_no_tables_is_an_error(spark, tmp_path):
    (tmp_path / "x.meta.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.discover_tables(spark, str(tmp_path))


def test_records_round_trip(spark, tmp_path):
    rec = {"anchor_summary": "s", "positive_time_series": [[1.0, 2.0], [3.0, 4.0]], "positive_sector": [0, 1], "doc_id": "d", "sector": ["Energy"], "country": "A"}
    (tmp_path / "r.json").write_text(json.dumps([rec, rec]))
    df = readers.read_json_array(spark, str(tmp_path / "r.json"))
    assert df.count() == 2 and df.first().asDict(recursive=True) == rec
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out"), readers.RECORD).count() == 2


def test_traces_with_windows(spark, tmp_path):
    (tmp_path / "window_5").mkdir()
    (tmp_path / "window_5" / "retrieval_traces.csv").write_text("query_text,target_doc_id,rank\nq,d,1\n")
    (tmp_path / "t.jsonl").write_text('{"query_text": "q2", "target_doc_id": "e"}\n')
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    assert {(r["query_text"], r["window"]) for r in readers.read_traces(spark, str(tmp_path)).collect()} == {("q", "5"), ("q2", "unknown")}


def test_chunk_store_and_manifest(spark, tmp_path):
    c = spark.createDataFrame([("c1", 0), ("c2", 1)], "chunk_id string, fold int")
    writers.write_chunk_store(c, str(tmp_path / "store"), "chunks", "hashed", rebuild=True)
    m = writers.write_chunk_store(c, str(tmp_path / "store"), "chunks", "hashed")
    assert m["chunks"] == 4 and readers.read_manifest(str(tmp_path / "store" / "manifest.json"))["collection"] == "chunks" and readers.read_manifest("/none") == {}
    assert readers.collection_name("auto", m) == "chunks" and readers.collection_name("mine", m) == "mine" and readers.collection_name(None, {}) == "chunks"
    assert {r["fold"] for r in readers.read_folds(spark, str(tmp_path / "store" / "chunks")).collect()} == {0, 1}
    assert writers.unique_path(spark, str(tmp_path / "store")).endswith("store_1")
    assert json.loads(writers.manifest_row(c, n=F.count("*")).first()["manifest"]) == {"n": 2}


def test_checkpoint_goes_on(spark, tmp_path):
    seen = []
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    cp = writers.Checkpoint(spark, str(tmp_path / "cp"), "id")

    def step(d):
        seen.append(d.count())
        return models.generate_column(d, "p", models.Extract, "out")

    assert cp.run(df.where("id = 1"), step).count() == 1 and cp.run(df, step).count() == 2 and cp.run(df, step).count() == 2 and seen == [1, 1, 0]


def test_vector_cache_embeds_only_new_texts(spark, tmp_path):
    seen = []

    def embed(d):
        seen.append(d.count())
        return models.embed_column(d, "text", models.HashedWords(8))

    cache = writers.VectorCache(spark, str(tmp_path / "v"))
    a = spark.createDataFrame([("x y",), (None,), ("x y",)], "text string")
    assert cache.get(a, "text", embed).count() == 1
    assert cache.get(a.union(spark.createDataFrame([("z",)], "text string")), "text", embed).count() == 2 and seen == [1, 1]


def test_text_files(spark, tmp_path):
    (tmp_path / "de").mkdir()
    (tmp_path / "de" / "a.txt").write_text("one\ntwo")
    got = readers.read_text_files(spark, str(tmp_path)).collect()
    assert [(r["text_file_path"], r["page_content"]) for r in got] == [("de/a.txt", "one\ntwo")]


def test_catalog_search(spark):
    c = spark.createDataFrame([("t", "energy", "Coal use", ["country", "year"], 1), ("t", "energy", "Coal use 2", ["country", "year"], 2), ("u", "energy", "Old coal", ["year"], 1), ("w", "energy", "coal draft", ["location", "year"], 1)], "table string, namespace string, title string, dimensions array<string>, version int")
    assert [(r["table"], r["title"]) for r in readers.search_catalog(c, ["coal"], ["draft"]).collect()] == [("t", "Coal use 2")]


def test_durable_tables_are_released(spark):
    df = durable(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 10 and df.columns == ["id", "x"]
    release(df)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(src)
    for _ in range(2):
        q = ingest.ingest_new(spark.readStream.schema("id int, v string").parquet(src), str(tmp_path / "t"), str(tmp_path / "cp"), "id")
        q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2]
    e = [(datetime(2024, 1, 1, 0, m), "k", 1.0) for m in (1, 2, 40)] + [(datetime(2024, 1, 1, 9, 0), "k", 1.0)]
    spark.createDataFrame(e, "ts timestamp, k string, value double").write.parquet(str(tmp_path / "ev"))
    stream = lambda: spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "ev"))
    for name, df in (("win", ingest.tumbling(stream(), "ts", "30 minutes", "1 hour", "k")), ("ses", ingest.sessions(stream(), "ts", "10 minutes", "1 hour", "k"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "win" else "append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("win").collect()) == [1, 1, 2] and sorted(r["n"] for r in spark.table("ses").collect()) == [1, 2]
