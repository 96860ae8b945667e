"""Operators do the whole job: all tables, all documents, all folds, no row lost between shards."""

import pytest

from policygrid.operators import metrics, selector, tensors
from policygrid.plans import q_panel, q_retrieval


def test_windows_take_features_of_all_tables(spark, sf):
    panel = spark.createDataFrame([(0, "a", 2010, "t0", 3.0), (7, "a", 2009, "t7", 4.0), (7, "b", 2010, "t8", 1.0)], "table_idx int, country string, year int, feature string, value double")
    anchors = spark.createDataFrame([("d", "a", 2010), ("e", "none", 2010)], "doc string, country string, year int")
    got = {(r["country"], r["window"], r["feature"]): (r["n_features"], r["mean"], r["last"]) for r in tensors.window_summary(anchors, panel, [1, 2]).collect()}
    assert got == {
        ("a", 1, "t0"): (1, 3.0, 3.0), ("a", 1, None): (2, 0.0, 0.0), ("a", 2, "t0"): (1, 1.5, 3.0), ("a", 2, "t7"): (1, 2.0, 0.0), ("a", 2, None): (1, 0.0, 0.0),
        ("none", 1, None): (3, 0.0, 0.0), ("none", 2, None): (3, 0.0, 0.0),
    }
    features = q_panel.standard_scale_train_only(spark, sf).select("feature").distinct().count()
    whole = q_panel.window_tensor(spark, sf).groupBy("country", "year", "window", "n_docs").sum("n_features").collect()
    assert sum(r["n_docs"] for r in whole) == 4 * q_panel._anchors(spark, sf).count() and {r[4] for r in whole} == {features}


def test_tensor_signal_is_that_of_the_dense_row(spark):
    import numpy as np

    rows = [("a", 2001, f"f{i}", v) for i, v in ((0, 2.0), (3, -1.0), (4, 5.0), (6, 1.5))] + [("b", 2001, "f5", -2.0), ("c", 1999, "f1", 1.0), ("c", 1999, "f2", 3.0)]
    panel = spark.createDataFrame(rows, "country string, year int, feature string, value double")
    spots = spark.createDataFrame([("a", 2010), ("b", 2010), ("c", 2010), ("gone", 2010)], "country string, year int")
    got = {r["country"]: [r[f"s_{c}"] for c in selector.DESCRIPTOR] for r in selector.tensor_signal(spots, panel, 10).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == [0.0] * 8
    for country in "ab":
        x = np.zeros(7)
        for c, y, f, v in rows:
            if c == country and y == 2001:
                x[int(f[1])] = v
        unit = max(abs(x.mean()), 1e-6)
        assert got[country] == pytest.approx([x.mean(), x.std(), x.min(), x.max(), np.polyfit(np.arange(7), x, 1)[0] / unit, (x[-1] - x[0]) / unit, np.percentile(x, 75), x[-1]])


def test_tables_of_country_region_and_world(spark):
    rows = [(t, p, 2000 + i, f"t{t}", float(i * k)) for t, p, k in ((0, "a", 1), (1, "r", 2), (2, "world", 3)) for i in range(5)]
    long = spark.createDataFrame(rows, "table_idx int, country string, year int, feature string, value double")
    spots = spark.createDataFrame([("a", "r", 2005), ("b", "", 2005), ("a", "r", 2002)], "country string, region string, year int")
    got = {(r["country"], r["year"], r["table_idx"]): r["max"] for r in selector.place_descriptor(long, spots, 10).collect()}
    assert got == {("a", 2005, 0): 4.0, ("a", 2005, 1): 8.0, ("a", 2005, 2): 12.0, ("b", 2005, 2): 12.0, ("a", 2002, 0): 1.0, ("a", 2002, 1): 2.0, ("a", 2002, 2): 3.0}


def test_policies_select_tables_of_their_own(spark, sf):
    got = q_panel.selector_pearson(spark, sf).collect()
    years = {r["document_id"]: r["year"] for r in q_panel._anchors(spark, sf).collect()}
    assert len({r["document_id"] for r in got}) > 1 and len({years[r["document_id"]] for r in got}) > 1
    assert {r["rank"] for r in got} >= {1} and all(r["rank"] <= 8 for r in got)


def test_rendered_columns_are_those_of_the_selected_tables(spark, sf):
    of = {}
    for r in q_panel.cells(spark, sf).select("table_idx", "feature").distinct().collect():
        of.setdefault(r["table_idx"], []).append(r["feature"])
    chosen = {}
    for r in sorted(q_panel.selector_pearson(spark, sf).collect(), key=lambda r: r["rank"]):
        chosen.setdefault(r["document_id"], []).extend(sorted(of[r["table_idx"]]))
    texts = {r["document_id"]: r["text"] for r in q_panel.table_text_render(spark, sf).collect()}
    assert len(texts) == q_panel._anchors(spark, sf).count() and chosen
    for d, text in texts.items():
        lines = text.split("\\n") if text else []
        assert len(lines) == (5 if d in chosen else 0)
        assert all([c.split("=")[0] for c in line.split(", ")] == chosen[d][:22] for line in lines)


def test_triplets_across_shards(spark, tmp_path):
    import numpy as np

    ids = [(5, 0), (999, 0), (1000, 0), (4001, 0), (4002, 0), (7, 1), (2500, 1), (3, 2)]
    rows = [(i, label, [float(i % 7), float(label)]) for i, label in ids]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q_retrieval.triplet_loss(spark, str(tmp_path)).first()
    of = {label: [np.array(v) for i, k, v in sorted(rows) if k == label] for label in (0, 1, 2)}
    d = lambda a, b: np.sqrt(((a - b + 1e-6) ** 2).sum())
    loss = [max(0, d(a, p) - d(a, of[k + 1][0]) + 1) for k in (0, 1) for a, p in zip(of[k], of[k][1:])]
    assert got["n"] == len(loss) == 5 and got["loss"] == pytest.approx(np.mean(loss), abs=1e-6)


def test_every_fold_has_training_records(spark, sf):
    pairs = q_panel.fold_pairs(spark, sf)
    assert {(r["fold"], r["window"]) for r in pairs.select("fold", "window").distinct().collect()} == {(f, w) for f in q_panel._folds(spark, sf) for w in (1, 2, 5, 10)}
    fold = {r["row_id"]: r["fold"] for r in q_panel._policies(spark, sf, q_panel.cells(spark, sf)).collect()}
    assert all(r["fold"] not in (fold[r["anchor"]], fold[r["negative"]]) for r in pairs.collect())
    made, tests, manifest = q_panel.prepare_fold(spark, sf, 1, [1, 5])
    n = sum(f == 1 for f in fold.values())
    for r in manifest.collect():
        same = pairs.where(f"fold = 1 and window = {r['window']}").count()
        assert (r["train_pairs"], r["test_rows"], r["train_policy_rows"]) == (same, n, len(fold) - n) and r["feature_count"] == q_panel.cells(spark, sf).select("feature").distinct().count()
    assert manifest.count() == 2
    one = made.where("window = 5").first()
    assert len(one["positive_time_series"]) == len(one["negative_time_series"]) == 5 and len(one["negative_sector"]) == 22
    assert {"anchor_summary", "positive_time_series", "positive_sector", "doc_id", "sector", "country"} <= set(tests.columns)


def test_any_overlap_of_id_lists(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["c", None]), ([], ["a"]), (None, ["a"]), (["a", None], [None])], "f array<string>, g array<string>")
    assert [r[0] for r in df.select(metrics.any_overlap(df.f, df.g)).collect()] == [1, 0, 0, 0, 0]
