"""Filling missing values from verified dependencies, then from records of the same group."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import evened_words, is_stand_in
from policygrid.session import require_columns


@dataclass(frozen=True)
class Dependency:
    """`determinant` decides `target`: the complete records that bear it out and those against it."""

    determinant: tuple[str, ...]
    target: str
    groups: int
    support: int
    violations: int

    @property
    def holds(self) -> bool:
        return self.violations == 0 and self.support > self.groups


def _level(records: DataFrame, dets: list[tuple[str, ...]], targets: list[str]) -> DataFrame:
    """det (number in `dets`), and of each target the groups of complete records, the records in them, and the groups that disagree."""
    known = lambda c: F.col(c).isNotNull()
    # A record takes part in each determinant it has all columns of; all are counted in one pass, on the map side first.
    keys = [F.when(reduce(lambda x, y: x & y, [known(c) for c in d]), F.struct(F.lit(i).alias("det"), F.xxhash64(*d).alias("key"))) for i, d in enumerate(dets)]
    seen = records.select(F.explode(F.array_compact(F.array(*keys))).alias("k"), *[F.when(known(t), F.xxhash64(t)).alias(t) for t in targets])
    groups = seen.groupBy("k.det", "k.key").agg(*[f for t in targets for f in (F.min(t).alias(f"lo_{t}"), F.max(t).alias(f"hi_{t}"), F.count(t).alias(f"n_{t}"))])
    return groups.groupBy("det").agg(*[f for t in targets for f in (F.count_if(F.col(f"n_{t}") > 0).alias(f"groups_{t}"), F.coalesce(F.sum(f"n_{t}"), F.lit(0)).alias(f"support_{t}"), F.count_if(F.col(f"lo_{t}") != F.col(f"hi_{t}")).alias(f"bad_{t}"))])


def mine_dependencies(records: DataFrame, columns: list[str], targets: list[str], most: int = 2) -> list[Dependency]:
    """All minimal dependencies of `targets` on up to `most` of `columns`, and the candidates that fail, over all complete records.

    The lattice of determinants is walked level by level: single columns, then
    pairs, and so on; one that holds a verified determinant of the target is left
    out, as it holds too and says no more. A record is complete for a candidate if none of
    its columns is null. A level is one pass over the records (a row per record and
    determinant, aggregated on the map side); one row of counts per determinant reaches
    the driver. A dependency holds if no group has two values and groups are shared
    by several records (a key decides everything and predicts nothing). Groups are
    told apart by 64-bit hashes: two that collide could at worst hide a dependency.
    """
    found: list[Dependency] = []
    for size in range(1, most + 1):
        open_for = {d: [t for t in targets if t not in d and not any(f.holds and f.target == t and set(f.determinant) <= set(d) for f in found)] for d in combinations(columns, size)}
        dets = [d for d, t in open_for.items() if t]
        if not dets:
            break
        rows = {dets[r["det"]]: r for r in _level(records, dets, targets).collect()}
        for d in dets:
            for t in open_for[d]:
                found.append(Dependency(d, t, *((rows[d][f"{c}_{t}"] for c in ("groups", "support", "bad")) if d in rows else (0, 0, 0))))
    return found


def held_determinants(mined: list[Dependency], target: str) -> list[Dependency]:
    """The dependencies of `target` that hold: fewest columns first, then the smallest dictionary, then by name."""
    return sorted((d for d in mined if d.holds and d.target == target), key=lambda d: (len(d.determinant), d.groups, d.determinant))


def best_determinant(mined: list[Dependency], target: str) -> Dependency | None:
    """The first of held_determinants(), None if none holds."""
    return next(iter(held_determinants(mined, target)), None)


#: Columns of an indicator table that values and units may depend on.
DETERMINANTS = ["table_idx", "ckey", "feature", "year"]


def _mode(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    """The most frequent value of `col` per key, ties to the smaller; counted before it is compared."""
    counted = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(name))


def present_value(c: Column) -> Column:
    """A finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def series_base(series: DataFrame) -> DataFrame:
    """An indicator table with ckey, the evened country, and with absent countries, values and units as null."""
    key = evened_words(F.col("country"))
    return series.select(
        "obs_id", "table_idx", "country", "feature", "year", F.when(key != "", key).alias("ckey"), present_value(F.col("value")).alias("value"),
        F.when(~is_stand_in(F.col("unit")), F.trim("unit")).alias("unit"),
    )


def _looked_up(lacking: DataFrame, base: DataFrame, held: list[Dependency], target: str) -> tuple[DataFrame, Column]:
    """`lacking` with the entries of the dictionaries of `held` joined, and what the first that has one says."""
    found = [F.lit(None).cast(base.schema[target].dataType)]
    for i, dep in reversed(list(enumerate(held))):
        book = base.where(F.col(target).isNotNull()).dropna(subset=list(dep.determinant)).groupBy(*dep.determinant).agg(F.min(target).alias(f"d_{target}{i}"))
        lacking = lacking.join(book, list(dep.determinant), "left")
        found.insert(0, F.col(f"d_{target}{i}"))
    return lacking, F.coalesce(*found)


def fill_series(series: DataFrame) -> DataFrame:
    """Every row of an indicator table with its absent values and units filled where others allow it.

    Dependencies of `value` and `unit` on up to two of table, country, feature and
    year are mined over the complete records. The dictionaries of those that hold
    fill first, the simplest before the others (`dependency`); then the mean (value) or most
    frequent (unit) of the same feature and country (`country`), then of the same
    feature and year (`year`). Only rows that lack something are joined; complete
    rows pass through.

    Added columns: value_filled, value_source, unit_filled, unit_source (source is
    `read`, `dependency`, `country`, `year` or `none`), value_like and unit_like
    (whether a row of the same feature and the same country or year has one).
    Null or blank countries and null years belong to no group; a null feature is no
    feature. Repeated rows count as often as they occur. Empty input gives no rows.
    """
    require_columns(series, "obs_id", "table_idx", "country", "feature", "year", "value", "unit")
    kept = ["obs_id", "table_idx", "country", "feature", "year"]
    base = series_base(series)
    # All groups are far fewer than the readings of a feature; each is one row after a map-side aggregate.
    by_country = base.where("ckey is not null and feature is not null").groupBy("feature", "ckey").agg(F.avg("value").alias("c_value"), F.count("unit").alias("c_units"))
    by_year = base.where("year is not null and feature is not null").groupBy("feature", "year").agg(F.avg("value").alias("y_value"), F.count("unit").alias("y_units"))
    mined = mine_dependencies(base, DETERMINANTS, ["value", "unit"])
    lacking = base.where(F.col("value").isNull() | F.col("unit").isNull())
    filled = lacking.join(by_country, ["feature", "ckey"], "left").join(by_year, ["feature", "year"], "left")
    none = F.lit(None)
    filled, d_unit = _looked_up(filled, base, held_determinants(mined, "unit"), "unit")
    filled, d_value = _looked_up(filled, base, held_determinants(mined, "value"), "value")
    if any(d.determinant == ("feature",) for d in mined if d.holds and d.target == "unit"):
        # A feature with a unit anywhere is in that dictionary, so its groups add nothing.
        c_unit = y_unit = none.cast("string")
    else:
        filled = filled.join(_mode(base.where("ckey is not null and feature is not null"), ["feature", "ckey"], "unit", "c_unit"), ["feature", "ckey"], "left")
        filled = filled.join(_mode(base.where("year is not null and feature is not null"), ["feature", "year"], "unit", "y_unit"), ["feature", "year"], "left")
        c_unit, y_unit = F.col("c_unit"), F.col("y_unit")

    def pick(own: Column, dep: Column, country: Column, year: Column, name: str) -> list[Column]:
        source = F.when(own.isNotNull(), "read").when(dep.isNotNull(), "dependency").when(country.isNotNull(), "country").when(year.isNotNull(), "year").otherwise("none")
        return [F.coalesce(own, dep, country, year).alias(name), (own.isNull() & F.coalesce(dep, country, year).isNotNull()).alias(f"{name}_filled"), source.alias(f"{name}_source")]

    out = filled.select(
        *kept, *pick(F.col("value"), d_value, F.col("c_value"), F.col("y_value"), "value"), *pick(F.col("unit"), d_unit, c_unit, y_unit, "unit"),
        (F.col("c_value").isNotNull() | F.col("y_value").isNotNull()).alias("value_like"),
        (F.coalesce(F.col("c_units") > 0, F.lit(False)) | F.coalesce(F.col("y_units") > 0, F.lit(False))).alias("unit_like"),
        F.col("value").isNull().alias("value_absent"), F.col("unit").isNull().alias("unit_absent"),
    )
    no, read, yes = F.lit(False), F.lit("read"), F.lit(True)
    whole = base.where(F.col("value").isNotNull() & F.col("unit").isNotNull()).select(
        *kept, "value", no.alias("value_filled"), read.alias("value_source"), "unit", no.alias("unit_filled"), read.alias("unit_source"),
        yes.alias("value_like"), yes.alias("unit_like"), no.alias("value_absent"), no.alias("unit_absent"),
    )
    return whole.unionByName(out)


def filled_cells(filled: DataFrame) -> DataFrame:
    """Of fill_series(): one row obs_id, field_name per cell filled that others of its country or year could fill."""
    rows = filled.where("value_filled or unit_filled")
    cells = F.array(
        F.when(F.col("value_filled") & F.col("value_like"), F.lit("value")),
        F.when(F.col("unit_filled") & F.col("unit_like"), F.lit("unit")),
    )
    return rows.select("obs_id", F.explode(F.array_compact(cells)).alias("field_name"))
