"""Irregular readings onto a regular grid: monotone cubic interpolation over time shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions.text import evened_words
from policygrid.session import require_columns


def usable_readings(series: DataFrame, first: int = 1970, last: int = 2024) -> DataFrame:
    """Readings with a finite value, a country and a year in [first, last], one per country, feature and year.

    Repeated and revised readings of a year give way to the one loaded last, ties
    to the greater obs_id. The choice is a max over a struct, so it is made on the
    map side first and one hot series or year can't overload a task.
    """
    require_columns(series, "country", "feature", "year", "value", "loaded_at", "obs_id")
    ok = series.select(
        evened_words(F.col("country")).alias("country_key"), "feature", F.col("year").cast("int").alias("year"),
        F.struct(F.col("loaded_at"), F.col("obs_id"), F.col("value").cast("double").alias("v")).alias("pick"),
    ).where(
        (F.col("country_key") != "") & F.col("feature").isNotNull() & F.col("year").between(first, last)
        & F.col("pick.v").isNotNull() & ~F.isnan("pick.v") & (F.abs("pick.v") < F.lit(float("inf")))
    )
    return ok.groupBy("country_key", "feature", "year").agg(F.max("pick")["v"].alias("value"))


def _inner_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Weighted harmonic mean of the neighbouring secants, 0 where they disagree in sign."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when((d0 * d1) <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))


def _end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Three-point slope at the end of a segment, limited so that the shape is kept."""
    raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(raw * d0 <= 0, F.lit(0.0))
        .when((d0 * d1 < 0) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0)
        .otherwise(raw)
    )


def regular_grid(readings: DataFrame, keys: list[str], time: str, value: str, shard: int = 16, max_gap: int = 5) -> DataFrame:
    """One row per step from the first to the last reading of each series.

    `readings` has one row per key and whole-numbered `time`. A series is cut into
    time shards of `shard` steps (at least `max_gap`), each one row with its sorted
    readings. A shard sends its last reading to the two shards after it and its
    first two to the two before (the halo), and rows are grouped by key and shard, so
    no task holds a whole series. Between two readings at most `max_gap` steps apart
    the value is that of the monotone cubic (Fritsch-Carlson with harmonic slopes); a
    longer gap ends the segment and its steps come out as `missing` with a null
    value. Where no shard near by has a reading, the gap runs from an open end to the
    next open start; only those ends, not the readings, are ordered per series.

    Result: keys, time, value, status in (`read`, `filled`, `missing`). Defined
    cases: no readings give no rows; a single reading gives one row; rows with a
    null key, time or value must be left out before (usable_readings does).
    """
    require_columns(readings, *keys, time, value)
    shard = max(shard, max_gap, 1)
    by_shard = (
        readings.select(*keys, F.floor(F.col(time) / shard).alias("_shard"), F.struct(F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v")).alias("_r"))
        .groupBy(*keys, "_shard").agg(F.sort_array(F.collect_list("_r")).alias("own"))
    )
    none = F.array().cast("array<struct<t:bigint,v:double>>")
    send = lambda by, own, halo: F.struct((F.col("_shard") + by).alias("to"), own.alias("own"), halo.alias("halo"))
    first, last = F.slice("own", 1, 2), F.slice("own", -1, 1)
    sent = by_shard.select(*keys, F.explode(F.array(send(0, F.col("own"), none), send(-1, none, first), send(-2, none, first), send(1, none, last), send(2, none, last))).alias("x"))
    met = sent.groupBy(*keys, F.col("x.to").alias("_shard")).agg(F.flatten(F.collect_list("x.own")).alias("own"), F.array_sort(F.flatten(F.collect_list("x.halo"))).alias("halo")).where(F.size("own") > 0)
    begin = F.col("_shard") * shard
    seen = met.select(
        *keys, "own", F.size("own").alias("n"), F.slice(F.filter("halo", lambda r: r["t"] < begin), -1, 1).alias("before"),
        F.slice(F.filter("halo", lambda r: r["t"] >= begin + shard), 1, 2).alias("after"),
    )
    # Ends that no shard near by goes on from, and starts that none near by leads to.
    ends = F.filter(F.array(F.when(F.size("before") == 0, F.col("own")[0]["t"]), F.when(F.size("after") == 0, F.get("own", F.col("n") - 1)["t"])), lambda t: t.isNotNull())
    edge = seen.where("size(before) = 0 or size(after) = 0").select(*keys, (F.size("before") == 0).alias("opens"), (F.size("after") == 0).alias("closes"), ends.alias("e"))
    edge = edge.select(*keys, "closes", F.col("e")[0].alias("from"), F.element_at("e", -1).alias("to"), "opens")
    far = edge.withColumn("next", F.lead(F.when(F.col("opens"), F.col("from"))).over(W.partitionBy(*keys).orderBy("from"))).where("closes and next is not null")
    gone = far.select(*keys, F.explode(F.sequence(F.col("to") + 1, F.col("next") - 1)).alias("t"))
    seen = seen.select(*keys, F.size("before").alias("b"), "n", F.concat("before", "own", "after").alias("a"))
    at = lambda i: F.get(F.col("a"), i)
    steps = seen.select(*keys, "a", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("n") - 1)).alias("i"))
    i = F.col("i")
    p = steps.select(*keys, *[at(i + k).alias(name) for k, name in ((-1, "p0"), (0, "p1"), (1, "p2"), (2, "p3"))])
    # A neighbour beyond a long gap belongs to another segment.
    close = lambda a, b: (F.col(b)["t"] - F.col(a)["t"]) <= max_gap
    linked = p.select(
        *keys, F.col("p1.t").alias("t1"), F.col("p1.v").alias("v1"), F.col("p2.t").alias("t2"), F.col("p2.v").alias("v2"), F.coalesce(close("p1", "p2"), F.lit(False)).alias("joined"),
        F.when(close("p0", "p1"), (F.col("p1.t") - F.col("p0.t")).cast("double")).alias("h0"), F.when(close("p0", "p1"), (F.col("p1.v") - F.col("p0.v")) / (F.col("p1.t") - F.col("p0.t"))).alias("d0"),
        (F.col("p2.t") - F.col("p1.t")).cast("double").alias("h1"), ((F.col("p2.v") - F.col("p1.v")) / (F.col("p2.t") - F.col("p1.t"))).alias("d1"),
        F.when(close("p2", "p3"), (F.col("p3.t") - F.col("p2.t")).cast("double")).alias("h2"), F.when(close("p2", "p3"), (F.col("p3.v") - F.col("p2.v")) / (F.col("p3.t") - F.col("p2.t"))).alias("d2"),
    )
    h0, d0, h1, d1, h2, d2 = (F.col(c) for c in ("h0", "d0", "h1", "d1", "h2", "d2"))
    left = F.when(h0.isNotNull(), _inner_slope(h0, d0, h1, d1)).when(h2.isNotNull(), _end_slope(h1, d1, h2, d2)).otherwise(d1)
    right = F.when(h2.isNotNull(), _inner_slope(h1, d1, h2, d2)).when(h0.isNotNull(), _end_slope(h1, d1, h0, d0)).otherwise(d1)
    sloped = linked.select(*keys, "t1", "v1", "t2", "v2", "h1", "joined", F.when(F.col("joined"), left).alias("m1"), F.when(F.col("joined"), right).alias("m2"))
    grid = sloped.withColumn("t", F.explode(F.sequence(F.col("t1"), F.coalesce(F.col("t2") - 1, F.col("t1")))))
    s = (F.col("t") - F.col("t1")) / F.col("h1")
    curve = (
        (1 + 2 * s) * (1 - s) * (1 - s) * F.col("v1") + s * (1 - s) * (1 - s) * F.col("h1") * F.col("m1")
        + s * s * (3 - 2 * s) * F.col("v2") + s * s * (s - 1) * F.col("h1") * F.col("m2")
    )
    here = F.col("t") == F.col("t1")
    kind = readings.schema[time].dataType
    unread = gone.select(*keys, F.col("t").cast(kind).alias(time), F.lit(None).cast("double").alias(value), F.lit("missing").alias("status"))
    return grid.select(
        *keys, F.col("t").cast(kind).alias(time),
        F.when(here, F.col("v1")).when(F.col("joined"), curve).alias(value),
        F.when(here, F.lit("read")).when(F.col("joined"), F.lit("filled")).otherwise(F.lit("missing")).alias("status"),
    ).unionByName(unread)


def with_country_names(df: DataFrame, regions: DataFrame) -> DataFrame:
    """`country_key` replaced by the spelling of the region table; a key it lacks stays as it is.

    The region table is broadcast only if Spark's own size estimate is under the
    session's threshold; it is a fixed list of countries.
    """
    names = regions.groupBy(evened_words(F.col("country")).alias("country_key")).agg(F.min(F.trim("country")).alias("_spelled"))
    return df.join(names, "country_key", "left").withColumn("country", F.coalesce("_spelled", "country_key")).drop("country_key", "_spelled")


def country_grid(series: DataFrame, regions: DataFrame, shard: int = 16, max_gap: int = 5) -> DataFrame:
    """The yearly grid of every country and feature of an indicator table: country, feature, year, value, status."""
    grid = regular_grid(usable_readings(series), ["country_key", "feature"], "year", "value", shard, max_gap)
    return with_country_names(grid, regions).select("country", "feature", "year", "value", "status")
