"""Regular grid, packed fields and filling: against brute force, with nulls, empties, ties, repeats and clashing names."""

import math
import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from policygrid.operators import fill_missing, packed_fields, regular_grid
from policygrid.plans import problems

SERIES = "obs_id long, table_idx int, country string, year int, feature string, value double, unit string, loaded_at timestamp"


def _pchip(ts, vs, t, max_gap):
    """The value at t by the same definition, one segment at a time in plain Python."""
    seg = [0]
    for a, b in zip(ts, ts[1:]):
        seg.append(seg[-1] + (b - a > max_gap))
    i = max(k for k in range(len(ts)) if ts[k] <= t)
    if ts[i] == t:
        return vs[i]
    if seg[i] != seg[i + 1]:
        return None
    own = [k for k in range(len(ts)) if seg[k] == seg[i]]
    x, y = [ts[k] for k in own], [vs[k] for k in own]
    h = np.diff(x).astype(float)
    d = np.diff(y) / h
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        for k in range(1, len(x) - 1):
            if d[k - 1] * d[k] > 0:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
        for end, (h0, d0, h1, d1) in ((0, (h[0], d[0], h[1], d[1])), (-1, (h[-1], d[-1], h[-2], d[-2]))):
            e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[end] = 0 if e * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(e) > 3 * abs(d0) else e
    k = own.index(i)
    s = (t - x[k]) / h[k]
    return (1 + 2 * s) * (1 - s) ** 2 * y[k] + s * (1 - s) ** 2 * h[k] * m[k] + s * s * (3 - 2 * s) * y[k + 1] + s * s * (s - 1) * h[k] * m[k + 1]


@pytest.mark.parametrize("shard", [1, 3, 16, 1000])
def test_grid_equals_plain_interpolation(spark, shard):
    rng = random.Random(shard)
    series = {f"s{i}": sorted(rng.sample(range(-20, 60), rng.randrange(1, 30))) for i in range(25)}
    series["far"] = [0, 1, 500, 501, 503]
    rows = [(k, t, round(rng.uniform(-5, 5), 2) if rng.random() < 0.8 else 1.0, "x") for k, ts in series.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, t int, v double, status string")
    got = {(r["k"], r["t"]): (r["v"], r["status"]) for r in regular_grid.regular_grid(df, ["k"], "t", "v", shard, 5).collect()}
    value = defaultdict(dict)
    for k, t, v, _ in rows:
        value[k][t] = v
    assert set(got) == {(k, t) for k, ts in series.items() for t in range(ts[0], ts[-1] + 1)}
    for (k, t), (v, status) in got.items():
        ts = series[k]
        want = _pchip(ts, [value[k][x] for x in ts], t, 5)
        assert status == ("read" if t in value[k] else "missing" if want is None else "filled")
        assert (v is None) == (want is None) and (v is None or v == pytest.approx(want, abs=1e-9))


def test_readings_that_count(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [
        (1, 0, "Côte  Verte", 2000, "f", 1.0, "t", at(1)), (2, 0, "CÔTE VERTE ", 2000, "f", 2.0, "t", at(2)), (3, 0, "côte verte", 2000, "f", 3.0, "t", at(2)), (4, 0, "côte verte", 2000, "f", 9.0, "t", None),
        (5, 0, "Côte Verte", 2001, "f", math.inf, "t", at(1)), (6, 0, "Côte Verte", 2001, "f", math.nan, "t", at(1)), (7, 0, "Côte Verte", 2001, "f", None, "t", at(1)), (8, 0, " ", 2001, "f", 1.0, "t", at(1)),
        (9, 0, None, 2001, "f", 1.0, "t", at(1)), (10, 0, "Côte Verte", None, "f", 1.0, "t", at(1)), (11, 0, "Côte Verte", 9999, "f", 1.0, "t", at(1)), (12, 0, "Côte Verte", 2003, "f", 4.0, "t", at(1)), (13, 0, "Elsewhere", 2003, "f", 4.0, "t", at(1)),
    ]
    df = spark.createDataFrame(rows, SERIES)
    regions = spark.createDataFrame([("Côte Verte", "CV")], "country string, alpha_3 string")
    got = {(r["country"], r["year"]): (r["value"], r["status"]) for r in regular_grid.country_grid(df, regions).collect()}
    assert set(got) == {("Côte Verte", y) for y in range(2000, 2004)} | {("elsewhere", 2003)} and got["Côte Verte", 2000] == (3.0, "read") and got["Côte Verte", 2001][1] == "filled"
    assert regular_grid.country_grid(df.limit(0), regions).count() == 0


# --- packed fields

VALUES = ["Energy", "Water", "Trade; customs and duties", "Forests, peat and wetlands", 'the "last mile" supply', "women's groups", "R&D", "Health"]


def _pack(rng, values):
    style = rng.choice(["csv", "json", "list", "bullet", "lines", "mixed"])
    quote = lambda v, d: '"' + v.replace('"', '""') + '"' if d in v or '"' in v or "," in v or ";" in v or rng.random() < 0.1 else v
    if style == "json":
        return "[" + ", ".join('"' + v.replace('"', '\\"') + '"' for v in values) + "]"
    if style == "list":
        return "[" + ", ".join(repr(v) for v in values) + "]"
    if style == "bullet":
        return "\n".join("• " + quote(v, "\n") for v in values)
    if style == "lines":
        return rng.choice(["\n", "\r\n"]).join(quote(v, "\n") for v in values) + rng.choice(["", "\n"])
    if style == "mixed":
        return "".join(quote(v, ";") + (rng.choice([";", "; ", "；", "\n", " / "]) if i + 1 < len(values) else "") for i, v in enumerate(values))
    d = rng.choice(["; ", ";", ", ", " | ", "、", "\t"])
    return d.join(quote(v, d.strip() or d) for v in values) + rng.choice(["", d])


def test_dialects_of_a_packed_table(spark):
    rng = random.Random(11)
    truth = [[rng.choice(VALUES) for _ in range(rng.randrange(1, 5))] for _ in range(700)]
    named = [f"name {i}|type {i % 3}" for i in range(9)] + ["bare"]
    rows = [(i, _pack(rng, v), ";".join(rng.sample(named, 2))) for i, v in enumerate(truth)]
    rows += [(9000, None, None), (9001, "", ""), (9002, " ; ; ", named[0]), (9003, "Energy", ";".join([named[0], named[0], named[4]]))] + [(9100 + i, "Energy;Water", None) for i in range(200)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "row_id long, sector string, instrument string, item string")
    got = defaultdict(list)
    for r in sorted(packed_fields.unpack_fields(df, "row_id", ["sector", "instrument"]).collect(), key=lambda r: r["item_no"]):
        got[r["row_id"], r["field_name"]].append((r["item_no"], r["item"], r["n_items"]))
    right = sum([v for _, v, _ in got[i, "sector"]] == t for i, t in enumerate(truth))
    assert right >= 0.98 * len(truth)
    assert not any((i, "sector") in got for i in (9000, 9001, 9002)) and got[9003, "sector"] == [(1, "Energy", 1)] and [v for _, v, _ in got[9100, "sector"]] == ["Energy", "Water"]
    assert got[9003, "instrument"] == [(1, named[0], 3), (2, named[0], 3), (3, named[4], 3)]
    assert packed_fields.unpack_fields(df.limit(0), "row_id", ["sector"]).count() == 0
    with pytest.raises(ValueError):
        packed_fields.unpack_fields(df, "row_id", ["nothing"])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab;,"\'|/\n\t[]•- ', max_size=40))
def test_parses_never_fail_and_hold_no_blank(raw):
    for values in packed_fields.parses(raw):
        assert all(v and v == v.strip() for v in values)


def test_quoted_values():
    split = packed_fields.split_field
    assert split('"""last mile"" supply"; x', frozenset(";"), True) == ['"last mile" supply', "x"]
    assert split('["a, b", "c \\"d\\""]', frozenset(","), True) == ["a, b", 'c "d"'] and split("['it', \"it's\"]", frozenset(","), True) == ["it", "it's"]
    assert split('a "b; c" d; e', frozenset(";"), True) == ['a "b', 'c" d', "e"]


# --- filling


def test_fill_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        f = rng.randrange(8)
        rows.append((i, f % 3, rng.choice(["A", " a", "B", "c", None, " "]), rng.choice([None, *range(2000, 2006)]), f"f{f}", rng.choice([None, math.nan, math.inf, *[round(rng.uniform(0, 9), 3)] * 4]) if f else None, rng.choice([None, "", " n/a", "Unknown", f"u{f}", f"u{f}"]) if f != 7 else None, None))
    df = spark.createDataFrame(rows, SERIES).withColumnRenamed("loaded_at", "unit_source")
    out = {r["obs_id"]: r for r in fill_missing.fill_series(df).collect()}
    assert len(out) == len(rows)
    by = defaultdict(list)
    for i, _, c, y, f, v, u, _ in rows:
        c = (c or "").strip().lower()
        v = v if v is not None and math.isfinite(v) else None
        u = u if u and u.strip().lower() not in ("", "n/a", "unknown") else None
        by["rows"].append((i, c, y, f, v, u))
        for k in ([("c", f, c)] if c else []) + ([("y", f, y)] if y else []):
            by[k].append((v, u))
    want = set()
    for i, c, y, f, v, u in by["rows"]:
        groups = [by.get(k, []) for k, ok in ((("c", f, c), c), (("y", f, y), y)) if ok]
        r = out[i]
        means = [[x for x, _ in g if x is not None] for g in groups]
        mean = next((sum(m) / len(m) for m in means if m), None)
        if v is None:
            assert (r["value"] is None) == (mean is None) and (mean is None or r["value"] == pytest.approx(mean)) and r["value_filled"] == (mean is not None)
            want |= {(i, "value")} if mean is not None else set()
        else:
            assert r["value"] == v and r["value_source"] == "read"
        if u is None and any(x for g in groups for _, x in g):
            want.add((i, "unit"))
        assert r["unit"] == (u or (f"u{f[1:]}" if f != "f7" else None))
    assert {(r[0], r[1]) for r in fill_missing.filled_cells(fill_missing.fill_series(df)).collect()} == want
    assert fill_missing.fill_series(df.limit(0)).count() == 0


def test_units_fall_back_where_no_dependency_holds(spark):
    rows = [(1, 0, "A", 2000, "f", 1.0, "t", None), (2, 0, "A", 2001, "f", 1.0, "t", None), (3, 0, "A", 2002, "f", 1.0, "kg", None), (4, 0, "A", 2002, "f", 1.0, None, None), (5, 0, "B", 2002, "f", 1.0, None, None), (6, 0, "B", 2050, "f", 1.0, None, None), (7, 1, "A", 2000, "f", 1.0, "lb", None), (8, 0, "A", 2002, "f", 1.0, "t", None)]
    got = {r["obs_id"]: (r["unit"], r["unit_source"]) for r in fill_missing.fill_series(spark.createDataFrame(rows, SERIES)).collect()}
    assert got[4] == ("t", "country") and got[5][1] == "year" and got[6] == (None, "none") and got[1] == ("t", "read")


def test_all_dependencies_that_hold_fill_and_groups_where_they_do_not(spark):
    # country and year each decide the unit; the dictionary of years is the smaller, and neither knows the last two rows.
    rows = [(i, 0, "ABCD"[i % 4], 2000 + i % 2, "fg"[i // 8], 1.0, "uv"[i % 2], None) for i in range(16)]
    rows += [(20, 0, "A", None, "h", 1.0, None, None), (22, 0, None, 2001, "h", 1.0, None, None), (23, 0, "E", None, "k", 1.0, None, None), (24, 1, " ", None, "k", 1.0, None, None)]
    got = {r["obs_id"]: (r["unit"], r["unit_source"]) for r in fill_missing.fill_series(spark.createDataFrame(rows, SERIES)).collect()}
    assert got[20] == ("u", "dependency") and got[22] == ("v", "dependency") and got[23] == (None, "none") and got[24] == (None, "none")


def test_groups_fill_units_that_a_dictionary_lacks(spark):
    # Years decide the unit; the last row has no year, so its country's most frequent unit stands in.
    rows = [(i, i % 3, "A", 2000 + i % 2, "f", 1.0, "uv"[i % 2], None) for i in range(9)] + [(10, 0, "A", None, "f", 1.0, None, None)]
    got = {r["obs_id"]: (r["unit"], r["unit_source"]) for r in fill_missing.fill_series(spark.createDataFrame(rows, SERIES)).collect()}
    assert got[10] == ("u", "country")


def test_dependencies_are_verified_on_all_records(spark):
    df = spark.createDataFrame([("a", "x", "u"), ("a", "x", "u"), ("b", "x", "v"), ("b", "y", "v"), (None, "y", "w"), ("c", "y", None)], "k string, l string, t string")
    got = {d.determinant: d for d in fill_missing.mine_dependencies(df, ["k", "l"], ["t"])}
    assert not got["l",].holds and got["l",].violations == 2 and got["k",].holds and ("k", "l") not in got
    assert fill_missing.best_determinant(list(got.values()), "t").determinant == ("k",)


def test_dependencies_on_two_columns_and_on_nothing(spark):
    df = spark.createDataFrame([(a, b, f"{a}{b}", a * 10 + b, None) for a in (1, 2, 3) for b in (1, 2) for _ in range(3)], "a int, b int, t string, id int, none string")
    mined = fill_missing.mine_dependencies(df, ["a", "b", "none"], ["t"])
    assert [d.determinant for d in mined if d.holds] == [("a", "b")] and len(mined) == 6
    assert next(d for d in mined if d.determinant == ("none",)) == fill_missing.Dependency(("none",), "t", 0, 0, 0)
    assert not any(d.holds for d in fill_missing.mine_dependencies(df.limit(0), ["a", "b"], ["t"]))


@pytest.mark.parametrize("shard", [1, 4, 16])
def test_grid_over_empty_shards(spark, shard):
    rows = [("s", t, float(t)) for t in (0, 1, 40, 41, 42, 300, 301, 303, 9000)] + [("one", 7, 1.0)]
    got = {(r["k"], r["t"]): (r["v"], r["status"]) for r in regular_grid.regular_grid(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v", shard, 3).collect()}
    read = {(k, t) for k, t, _ in rows}
    assert set(got) == {("s", t) for t in range(9001)} | {("one", 7)}
    assert all(s == ("read" if k in read else "filled" if k == ("s", 302) else "missing") for k, (_, s) in got.items()) and abs(got["s", 302][0] - 302) < 1e-9


def test_found_columns(spark, sf):
    want = {"p3_found": {"country": "string", "feature": "string", "year": "int"}, "p6_found": {"row_id": "bigint", "field_name": "string", "item_no": "int", "item": "string"}, "p7_found": {"obs_id": "bigint", "field_name": "string"}}
    for name, cols in want.items():
        df = problems.QUERIES[name](spark, sf)
        assert dict(df.dtypes) == cols and df.count() == df.distinct().count()
