"""Policy cleaning, table selection by meaning, staged generation, judging, encoders and stores, on small fixtures."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from policygrid.functions import options
from policygrid.operators import folds, generation, graph, metrics, models, overlap_scores, panel, policies, retrieval, sampling, selector, tensors
from policygrid.sources import readers, writers


def test_stemmed_rouge_equals_brute_force(spark):
    rows = [(1, "The policies were adopted nationally", "A policy is adopting national policies"), (2, "relational databases", None), (3, "", "x"), (4, "run run running", "runs run"), (5, "one", "one"), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, g string, h string")

    def grams(t, n):
        w = [overlap_scores.porter(x) if len(x) > 3 else x for x in re.findall("[a-z0-9]+", (t or "").lower())]
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    for n in (1, 2):
        got = {r["k"]: r[f"rouge{n}"] for r in overlap_scores.rouge_n(df, "k", "g", "h", n).collect()}
        for k, g, h in rows:
            a, b = grams(g, n), grams(h, n)
            m = sum(min(a.count(x), b.count(x)) for x in set(a))
            assert got[k] == pytest.approx(2 * m / (len(a) + len(b)) if m else 0.0, abs=1e-6)


def test_metadata_and_table_blocks(spark):
    df = spark.createDataFrame([(" A ;B", None, "k", "", " h")], "s string, i string, k string, t string, h string")
    text = df.select(generation.metadata_text(*[F.col(c) for c in "sikth"]).alias("m")).first()["m"]
    assert text == "Targeted Sector: A ;B\nPolicy Instrument: \nKeywords: k\nTopics: \nHazards: h"
    rows = spark.createDataFrame([("T", [["a", "1.005", " "], ["", None], ["-2.5", " b"]]), ("E", [[" "]]), ("N", None)], "t string, r array<array<string>>")
    got = [r[0] for r in rows.select(generation.table_block(F.col("t"), F.col("r"))).collect()]
    assert got[0] == "[START_OF_TABLE]\nT\n[ROW] a,1.00\n[ROW] -2.50,b\n[END_OF_TABLE]" and got[1] == "" and not got[2]


def test_titles_by_meaning_and_by_answer(spark):
    titles = spark.createDataFrame([("water stress",), ("coal output",), ("wage index",)], "title string")
    texts = spark.createDataFrame([("water and stress",), ("coal",), ("",), ("water and stress",)], "t string")
    got = {}
    for r in sorted(generation.title_matches(texts, "t", titles, models.HashedWords(64), 2).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["t"], []).append(r["title"])
    assert got["water and stress"][0] == "water stress" and got["coal"][0] == "coal output" and got[""] == ["coal output", "wage index"]
    j = selector.selection_json(spark.createDataFrame([(1, 'a"b', 0.5, 2), (1, "c", 0.25, 1)], "k int, title string, score double, rank int"), "k", "title").first()
    assert json.loads(j["selected_titles"]) == ["c", 'a"b'] and json.loads(j["selected_scores"]) == [0.25, 0.5]
    answers = spark.createDataFrame([(1, '["Coal output", "wage"]'), (2, "- water stress\n- coal"), (3, "none of them"), (4, None)], "k int, a string")
    named = {(r["k"], r["rank"]): r["title"] for r in generation.answered_titles(answers, "k", "a", ["water stress", "coal output", "wage index"]).collect()}
    assert named == {(1, 1): "coal output", (1, 2): "wage index", (2, 1): "water stress", (2, 2): "coal output"}


def _fails():
    class Fails(models.Extract):
        """Fails on prompts that hold `bad`."""

        def generate(self, prompt):
            if "bad" in prompt:
                raise ValueError("refused")
            return super().generate(prompt)

    return Fails


def test_generation_falls_back_resumes_and_keeps_order(spark):
    pol = spark.createDataFrame([("d1", "a", "", 2010, "src"), ("d2", "b", "", 2010, "own source text"), ("d3", "c", "", 2010, " "), ("d4", "a", "", 2010, None)], "document_id string, country string, region string, year int, source_text string")
    prompts = spark.createDataFrame([("a", "", 2010, 7, 1, "first water"), ("a", "", 2010, 8, 2, "second coal"), ("b", "", 2010, 7, 1, "bad prompt")], "country string, region string, year int, table_idx int, rank int, prompt string")
    chunks = spark.createDataFrame([(f"c{i}", f"x{i % 4}", t) for i, t in enumerate(["water", "coal", "source text", "bad", "water coal"])], "chunk_id string, document_id string, text string")
    fails = _fails()
    make = lambda: fails(500, last=True)
    clean = chunks.where("text <> 'bad'")
    out = {r["document_id"]: r for r in generation.generate_summaries(pol, prompts, clean, make, models.HashedWords(64)).collect()}
    assert [out[d]["n_analyses"] for d in ("d1", "d2", "d3", "d4")] == [2, 1, 0, 2]
    assert [out[d]["used_fallback"] for d in ("d1", "d2", "d3", "d4")] == [False, True, False, False]
    assert out["d1"]["summary"] == out["d4"]["summary"] and out["d1"]["summary"].index("first water") < out["d1"]["summary"].index("second coal")
    assert out["d3"]["summary"] is None and "own source text" in out["d2"]["summary"] and generation.CHUNK_MARK in out["d1"]["summary"]
    done = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    assert {r["document_id"] for r in generation.generate_summaries(pol, prompts, clean, make, models.HashedWords(64), done).collect()} == {"d3", "d4"}
    none = {r["document_id"]: r for r in generation.generate_summaries(pol, prompts, clean, make, models.HashedWords(64), fallback=False).collect()}
    assert none["d2"]["n_analyses"] == 0 and none["d2"]["summary"] is None
    bad = {r["document_id"]: r for r in generation.generate_summaries(pol, prompts, chunks.where("text = 'bad'"), make, models.HashedWords(64)).collect()}
    assert bad["d1"]["n_analyses"] == 2 and bad["d1"]["n_blends"] == 0 and bad["d1"]["summary"] is None
    assert generation.generate_summaries(pol.limit(0), prompts, clean, make, models.HashedWords(64)).count() == 0


def test_calls_in_flight_and_other_errors(spark):
    fails = _fails()
    df = spark.createDataFrame([(i, f"p{i} word") for i in range(20)] + [(99, "bad")], "k int, p string")
    out = {r["k"]: r["o"] for r in models.generate_column(df, "p", lambda: fails(1), "o", in_flight=4).collect()}
    assert out == {i: f"p{i}" for i in range(20)} | {99: None}


def test_judge_keeps_errors(spark):
    df = spark.createDataFrame([("a", "water plan", "water"), ("a", "water plan", ""), ("b", None, "x")], "kind string, s string, t string")
    rows = models.judge_rows(df, "s", "t", models.SharedWords)
    assert df.columns == ["kind", "s", "t"]
    got = {(r["kind"], r["t"]): r for r in rows.collect()}
    assert got["a", "water"]["score_alignment"] == 1.0 and got["a", "water"]["score_coverage"] == 0.5 and got["a", ""]["error_alignment"] == "no words" and got["a", ""]["score_coverage"] == 0.0
    means = {r["kind"]: r for r in models.judge_means(rows, "kind").collect()}
    assert means["a"]["score_alignment"] == 1.0 and means["a"]["n_errors_alignment"] == 1 and means["b"]["score_coverage"] is None and means["b"]["n_errors_coverage"] == 1


def test_encoder_query_tower(spark):
    e = models.DualEncoder.seeded(4, 3, 5, 6, 2)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [1, 0, 0]), (2, [0.0] * 4, [0, 0, 0])], "k int, s array<double>, o array<int>")
    got = {r["k"]: r["v"] for r in models.encode_queries(df, "s", "o", e, "v").collect()}
    left = np.maximum(np.array([1.0, 2, 3, 4]) @ e.hidden + e.hidden_bias, 0) @ e.series
    want = np.concatenate([left, e.sector[0]]) @ e.join
    assert got[1] == pytest.approx(want / np.linalg.norm(want)) and got[2] == [0.0] * 6
    assert models.input_dims(df, "s", "o") == (4, 3)
    with pytest.raises(ValueError):
        models.input_dims(df.unionByName(spark.createDataFrame([(3, [1.0], [1])], df.schema)), "s", "o")
    nested = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1])], "s array<array<double>>, o array<int>")
    assert models.input_dims(nested, "s", "o") == (4, 1)


def test_policies_are_cleaned_and_loaded(spark):
    rows = [(1, "d", "<p>A&amp;B</p>", "Water;Other", " X ", "2020-05-01", 0), (2, None, "t", "Energy", "Y", "2020-13-01", 1), (3, "e", "t", "Other", "Y", "2020-01-01", None), (4, None, "t", "Energy", "Y", "2021-02-03 10:00", 2), (5, "f", " ", "Energy", "Y", "2021-02-03", 2)]
    df = spark.createDataFrame(rows, "row_id int, document_id string, family_summary string, sector string, geography string, last_event_in_timeline string, fold int")
    got = {r["row_id"]: r for r in policies.clean_policies(df).collect()}
    assert set(got) == {1, 4} and got[1]["family_summary"] == "A&B" and got[1]["sectors"] == ["Water"] and got[1]["geography"] == "X" and got[4]["document_id"] == "" and str(got[4]["event_date"]) == "2021-02-03"
    assert policies.clean_policies(df.drop("document_id")).where("document_id <> ''").count() == 0 and policies.clean_policies(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        policies.clean_policies(df.drop("sector"))
    assert {r["row_id"] for r in policies.load_policies(df, ["fold"]).collect()} == {1, 3, 5} and {r["row_id"] for r in policies.load_policies(df, ["fold"], keep_blank=False).collect()} == {1, 3}
    with pytest.raises(ValueError):
        policies.load_policies(df, ["text_file_path"])
    assert {r["row_id"] for r in policies.trainable(df).collect()} == {1, 2, 4, 5}
    t = spark.createDataFrame([("10",), ("1",)], "window string")
    assert policies.of_window(t, 10).count() == 1 and policies.of_window(t.select(F.col("window").cast("int")), "1").count() == 1


def test_domains_and_names(spark):
    paths = spark.createDataFrame([("socio/b.csv",), ("climate/a.csv",), ("misc/z.csv",)], "path string")
    keys = {r["table_key"]: r["domain"] for r in policies.table_domains(paths).collect()}
    assert keys == {"t000": "climate", "t001": "misc", "t002": "socio"}
    f = spark.createDataFrame([("t000__x",), ("t001__y",), ("t009__q",)], "feature string")
    d = policies.feature_domains(f, policies.table_domains(paths), ("climate", "socio"))
    assert [(r["feature_idx"], r["domain"]) for r in d.orderBy("feature").collect()] == [(0, "climate"), (1, "other"), (2, "other")]
    assert {r["feature"] for r in policies.names_at(d, spark.createDataFrame([(1,), (7,), (-1,)], "feature_idx int")).collect()} == {"t001__y"}


def test_results_are_normalised(spark):
    df = spark.createDataFrame([(1, "mlp", None, 0.5)], "window int, backbone string, loss string, hit_10 double")
    r = policies.normalize_results(df, "run").first()
    assert r["fold"] == 1 and r["method"] == "mlp|nan" and r["experiment"] == "run"
    with pytest.raises(ValueError):
        policies.normalize_results(df.drop("loss"))


def test_cascade_scores_what_the_filter_keeps(spark):
    g = np.random.default_rng(4)
    chunks = [(f"c{i:02d}", [float(x) for x in g.normal(size=8)], i % 2, ["A", "B", None, " "][i % 4], ["s", "t", None][i % 3]) for i in range(40)]
    c = spark.createDataFrame(chunks, "chunk_id string, vec array<double>, fold int, geography string, sector string")
    q = spark.createDataFrame([("c00", chunks[0][1], 0, "A", "s"), ("c02", chunks[2][1], 0, None, "s"), ("c04", chunks[4][1], 0, "A", "none"), ("c05", chunks[5][1], 1, "nowhere", "s")], "query_id string, vec array<double>, fold int, country string, sector string")
    got = {r["query_id"]: (r["level"], r["n_chunks"], round(r["best_score"], 8)) for r in retrieval.cascade_best(q, c).collect()}
    s = retrieval.block_cosine(q, c, group="fold").where("query_id <> chunk_id")
    kept = retrieval.filter_cascade(s, q, c.select("chunk_id", "geography", "sector"))
    want = {r["query_id"]: (r["level"], r["n"], round(r["m"], 8)) for r in kept.groupBy("query_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m")).collect()}
    assert got == want and {v[0] for v in got.values()} == {1, 2, 3}


def test_validation_of_every_fold_is_that_of_one(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(200)], "row_id int, fold int")
    got = {(r["held"], r["row_id"]): r["is_validation"] for r in folds.validation_splits(df, "row_id", 0.2, [0, 1, 2], 7).collect()}
    for f in range(3):
        one = {r["row_id"]: r["is_validation"] for r in folds.validation_split(df.where(F.col("fold") != f), "row_id", 0.2, 7).collect()}
        assert one == {k: v for (h, k), v in got.items() if h == f}


def test_padding_merging_and_options(spark):
    t = spark.createDataFrame([([[1.0, 2.0]],), ([],)], "t array<array<double>>")
    assert [r[0] for r in t.select(tensors.top_padded(F.col("t"), 3)).collect()] == [[[0.0, 0.0], [0.0, 0.0], [1.0, 2.0]], None]
    a = spark.createDataFrame([("x", 2000, 1.0, 5)], "country string, year int, v double, only int")
    b = spark.createDataFrame([("x", 2000, 2.0), ("y", 2001, 3.0)], "country string, year int, v double")
    got = {r["country"]: (r["v_x"], r["v_y"], r["only"]) for r in panel.merge_tables(a, b).collect()}
    assert got == {"x": (1.0, 2.0, 5), "y": (None, 3.0, None)} and panel.extra_columns(a, ["country", "year"]) == ["v", "only"]
    assert options.ints("3, 1,3") == [1, 3] and options.floats("0.5,") == [0.5] and options.strings(" a ,,b") == ["a", "b"] and options.windows("2,1") == [1, 2]
    assert options.truthy(" Yes") and not options.truthy(None) and options.bounded_int("99", 4, 1, 8) == 8 and options.bounded_int("x", 4, 1, 8) == 4
    for bad in (lambda: options.ints(" "), lambda: options.windows("0,1")):
        with pytest.raises(ValueError):
            bad()


def test_small_helpers(spark):
    wide = spark.createDataFrame([(1, None, 2.0)], "country int, a double, b double")
    both = panel.align_columns(wide, spark.createDataFrame([(2, 3.0)], "country int, c double"))
    assert sorted(tuple(r) for r in both.select("country", "a", "b", "c").collect()) == [(1, 0.0, 2.0, 0.0), (2, 0.0, 0.0, 3.0)]
    df = spark.createDataFrame([(" ", "chunk", "meta"), ("series", "chunk", "meta"), (None, None, "meta")], "s string, c string, m string")
    assert [r[0] for r in df.select(sampling.judge_input(F.col("s"), F.col("c"), F.col("m"))).collect()] == ["chunk", "series", "meta"]
    m = spark.createDataFrame([(1, 2, 3, 4)], "`hit@1` int, `mrr@1` int, precision_5 int, other int")
    assert metrics.metric_columns(m) == ["hit@1", "precision_5"] and metrics.metric_columns(m, True) == ["hit@1", "mrr@1", "precision_5"]
    trials = spark.createDataFrame([("k", "b", 0.5), ("k", "a", 0.5), ("k", "c", 0.7)], "by string, params string, val_loss double")
    assert models.best_trial(trials, ["by"]).first()["params"] == "a"
    pooled = spark.createDataFrame([("q", "d2", 0.5), ("q", "d1", 0.5), ("q", "d3", 0.9)], "query_id string, document_id string, score double")
    assert [(r["document_id"], r["rank"]) for r in retrieval.rank_documents(pooled).orderBy("rank").collect()] == [("d3", 1), ("d1", 2), ("d2", 3)]
    assert retrieval.rank_documents(pooled, 2).count() == 2


def test_stores_manifests_and_checkpoints(spark, tmp_path):
    root = str(tmp_path)
    writers.write_manifest(f"{root}/deep/m.json", a=1)
    assert readers.read_manifest(f"{root}/deep/m.json") == {"a": 1} and readers.read_manifest(f"{root}/none.json") == {} and readers.read_manifest(root) == {}
    writers.save_hparams(f"{root}/h.json", {"lr": 0.1}, backbone="mlp")
    assert readers.load_hparams(f"{root}/h.json") == {"lr": 0.1} and readers.load_hparams(f"{root}/none.json") is None
    with pytest.raises(FileNotFoundError):
        readers.resolve_checkpoint(spark, root)
    for k in (2, 3):
        (tmp_path / f"checkpoints/final/trial_00{k}").mkdir(parents=True)
        (tmp_path / f"checkpoints/final/trial_00{k}/best.ckpt").write_text("x")
        if k == 2:
            assert readers.resolve_checkpoint(spark, root).endswith("trial_002/best.ckpt")
    with pytest.raises(RuntimeError):
        readers.resolve_checkpoint(spark, root)
    (tmp_path / "checkpoints/final/trial_001").mkdir()
    (tmp_path / "checkpoints/final/trial_001/best.ckpt").write_text("x")
    assert readers.resolve_checkpoint(spark, root).endswith("trial_001/best.ckpt") and readers.resolve_checkpoint(spark, root, f"{root}/h.json") == f"{root}/h.json"
    with pytest.raises(FileNotFoundError):
        readers.resolve_checkpoint(spark, root, f"{root}/gone")
    (tmp_path / "wide.csv").write_text('country,"a, b",c\nx,1,2\n')
    assert readers.feature_columns(spark, f"{root}/wide.csv") == ["a, b", "c"]
    (tmp_path / "r.json").write_text(json.dumps([{"doc_id": "d", "anchor_summary": "s"}, {"doc_id": "d", "anchor_summary": "s"}, {"anchor_summary": "n"}]))
    assert readers.keyed_records(spark, f"{root}/r.json").count() == 1 and readers.keyed_records(spark, f"{root}/none.json").count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t/window_5_retrieval_traces.csv").write_text("query_text,target_doc_id,retrieved_doc_id\nq,d,e\n")
    (tmp_path / "t/other.csv").write_text("query_text,target_doc_id\nq,d\n")
    assert [(r["window"], r["retrieved_doc_id"]) for r in readers.read_retrieval_traces(spark, f"{root}/t").collect()] == [("5", "e")]
    g = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "k string, fold int, v int")
    writers.write_folds(g, f"{root}/folds")
    assert readers.read_folds(spark, f"{root}/folds").where("fold = 1").first()["k"] == "b"
    writers.write_panel(g.withColumn("split", F.lit("train")), f"{root}/panel")
    assert spark.read.parquet(f"{root}/panel").where("fold = 0 and split = 'train'").count() == 1
    e = graph.edges(g, "A", F.col("k"), "TO", "B", F.col("v"))
    writers.write_graph(e, f"{root}/graph")
    assert spark.read.parquet(f"{root}/graph/nodes").where("label = 'B'").count() == 2 and spark.read.parquet(f"{root}/graph/edges").where("rel = 'TO'").count() == 2
    chunks = spark.createDataFrame([("c1", "water", 0)], "chunk_id string, text string, fold int")
    assert writers.write_chunk_store(chunks, f"{root}/store", "c", "hashed", True, models.HashedWords(8))["chunks"] == 1
    assert len(spark.read.parquet(f"{root}/store/c").first()["embedding"]) == 8


def test_role_agents_read_finished_rows_back(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "s1", "q1"), ("d2", "s2", "q2")], "document_id string, summary string, query_text string")
    contexts = {"climate": "summary", "socio": "query_text", "other": "document_id"}
    kept = writers.Checkpoint(spark, str(tmp_path / "roles"), "cache_key")
    a = generation.role_agent_frame(rows.limit(1), contexts, models.Extract, kept, {"fold": "0", "window": "5"}).collect()
    b = generation.role_agent_frame(rows, contexts, models.Extract, kept, {"fold": "0", "window": "5"}).collect()
    assert len(a) == 1 and len(b) == 2 and kept.done().count() == 2
    assert len(generation.role_agent_frame(rows, contexts, models.Extract, kept, {"fold": "1", "window": "5"}).collect()) == 2 and kept.done().count() == 4
    assert math.isclose(len({r["cache_key"] for r in b}), 2)
