"""The queries of the general data-processing problems: p3, p6 and p7."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policygrid.operators.fill_missing import DETERMINANTS, fill_series, filled_cells, mine_dependencies, series_base
from policygrid.operators.packed_fields import unpack_fields
from policygrid.operators.regular_grid import country_grid
from policygrid.functions.text import NO_VALUE_EVEN
from policygrid.plans.q_panel import SPACES, even
from policygrid.session import table

PACKED = ["sector", "keyword", "instrument"]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return country_grid(table(spark, sf_dir, "time_series"), table(spark, sf_dir, "country_region"))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid; filled values are rounded to nine places."""
    return _grid(spark, sf_dir).withColumn("value", F.when(F.col("status") == "filled", F.round("value", 9)).otherwise(F.col("value")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).where("status <> 'read'").select("country", "feature", "year")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_fields(table(spark, sf_dir, "all_data_en"), "row_id", PACKED)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_values(spark, sf_dir).where("n_items >= 2").select("row_id", "field_name", F.col("item_no").cast("int").alias("item_no"), "item")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings; filled values are rounded to six places."""
    out = fill_series(table(spark, sf_dir, "time_series"))
    return out.select("obs_id", F.when(F.col("value_filled"), F.round("value", 6)).otherwise(F.col("value")).alias("value"), "value_filled", "value_source", "unit", "unit_filled", "unit_source")


def p7_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The determinants looked at for value and unit, with what bears them out; at most twenty rows."""
    mined = mine_dependencies(series_base(table(spark, sf_dir, "time_series")), DETERMINANTS, ["value", "unit"])
    rows = [(",".join(d.determinant), d.target, d.groups, d.support, d.violations, d.holds) for d in mined]
    return spark.createDataFrame(rows, "determinant string, target string, n_groups bigint, n_records bigint, n_violations bigint, holds boolean")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(fill_series(table(spark, sf_dir, "time_series")))


QUERIES = {"p3_grid": p3_grid, "p3_found": p3_found, "p6_values": p6_values, "p6_found": p6_found, "p7_fill": p7_fill, "p7_dependencies": p7_dependencies, "p7_found": p7_found}

_READ = f"""r AS (SELECT c, feature, year, arg_max(value, (coalesce(loaded_at, TIMESTAMP '0001-01-01'), obs_id)) AS v FROM (SELECT *, {even("country")} AS c FROM time_series) WHERE c <> '' AND year BETWEEN 1970 AND 2024 AND isfinite(value) GROUP BY ALL),
   k AS (SELECT {even("country")} AS c, min(trim(country)) AS country FROM country_region GROUP BY 1)"""
_HARMONIC = "CASE WHEN {d0} * {d1} <= 0 THEN 0 ELSE (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) END"
_END = "CASE WHEN e{i} * {d0} <= 0 THEN 0 WHEN {d0} * {d1} < 0 AND abs(e{i}) > 3 * abs({d0}) THEN 3 * {d0} ELSE e{i} END"
_UNIT = f"CASE WHEN unit IS NOT NULL AND lower(regexp_replace(unit, '{SPACES}', '', 'g')) NOT IN ({', '.join(chr(39) + v + chr(39) for v in NO_VALUE_EVEN)}) THEN trim(unit) END"
_FILL = f"""b AS MATERIALIZED (SELECT obs_id, table_idx, feature, year, nullif({even("country")}, '') AS c, CASE WHEN isfinite(value) THEN value END AS v, {_UNIT} AS u FROM time_series),
   bc AS (SELECT feature, c, avg(v) AS v, count(u) AS n FROM b WHERE c IS NOT NULL GROUP BY ALL), yc AS (SELECT feature, year, avg(v) AS v, count(u) AS n FROM b WHERE year IS NOT NULL GROUP BY ALL)"""
_SQL_COLUMNS = {"table_idx": "table_idx", "ckey": "c", "feature": "feature", "year": "year"}


def _dependency(d: tuple[str, ...], target: str, level: int) -> str:
    cols, v = ", ".join(_SQL_COLUMNS[c] for c in d), {"value": "v", "unit": "u"}[target]
    complete = " AND ".join(f"{_SQL_COLUMNS[c]} IS NOT NULL" for c in d)
    return f"""SELECT {level} AS level, '{",".join(d)}' AS determinant, '{target}' AS target, count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_records, count(*) FILTER (k > 1) AS n_violations
        FROM (SELECT count(*) AS n, count(DISTINCT {v}) AS k FROM b WHERE {complete} AND {v} IS NOT NULL GROUP BY {cols})"""


def _dependencies() -> str:
    """All candidates of up to two columns; those above one that holds are left out."""
    all_of = [_dependency(d, t, k) for t in ("value", "unit") for k in (1, 2) for d in combinations(DETERMINANTS, k)]
    above = "s.level = 1 AND s.target = o.target AND s.holds AND list_contains(string_split(o.determinant, ','), s.determinant)"
    return f"""WITH {_FILL}, o AS (SELECT *, n_violations = 0 AND n_records > n_groups AS holds FROM ({" UNION ALL ".join(all_of)}))
        SELECT determinant, target, n_groups, n_records, n_violations, holds FROM o WHERE level = 1 OR NOT EXISTS (SELECT 1 FROM o s WHERE {above})"""


SQL = {
    "p7_dependencies": _dependencies(),
    "p3_grid": f"""WITH {_READ}, n AS (SELECT *, lead(year) OVER w AS y2, lead(v) OVER w AS v2, lag(year) OVER w AS y0, lag(v) OVER w AS v0, lead(year, 2) OVER w AS y3, lead(v, 2) OVER w AS v3 FROM r WINDOW w AS (PARTITION BY c, feature ORDER BY year)),
        s AS (SELECT c, feature, year, v, y2, v2, y2 - year <= 5 AS joined, CAST(y2 - year AS DOUBLE) AS h1, (v2 - v) / (y2 - year) AS d1, CASE WHEN year - y0 <= 5 THEN CAST(year - y0 AS DOUBLE) END AS h0, CASE WHEN year - y0 <= 5 THEN (v - v0) / (year - y0) END AS d0,
          CASE WHEN y3 - y2 <= 5 THEN CAST(y3 - y2 AS DOUBLE) END AS h2, CASE WHEN y3 - y2 <= 5 THEN (v3 - v2) / (y3 - y2) END AS d2 FROM n),
        e AS (SELECT *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) AS e1, ((2 * h1 + h0) * d1 - h1 * d0) / (h1 + h0) AS e2 FROM s),
        m AS (SELECT *, CASE WHEN h0 IS NOT NULL THEN {_HARMONIC.format(h0="h0", d0="d0", h1="h1", d1="d1")} WHEN h2 IS NOT NULL THEN {_END.format(i=1, d0="d1", d1="d2")} ELSE d1 END AS m1,
          CASE WHEN h2 IS NOT NULL THEN {_HARMONIC.format(h0="h1", d0="d1", h1="h2", d1="d2")} WHEN h0 IS NOT NULL THEN {_END.format(i=2, d0="d1", d1="d0")} ELSE d1 END AS m2 FROM e),
        g AS (SELECT *, CAST(unnest(range(year, coalesce(y2, year + 1))) AS INTEGER) AS t FROM m), q AS (SELECT *, (t - year) / h1 AS s FROM g)
        SELECT coalesce(k.country, q.c) AS country, feature, t AS year, CASE WHEN t = q.year THEN v WHEN joined THEN round((1 + 2 * s) * (1 - s) * (1 - s) * v + s * (1 - s) * (1 - s) * h1 * m1 + s * s * (3 - 2 * s) * v2 + s * s * (s - 1) * h1 * m2, 9) END AS value,
        CASE WHEN t = q.year THEN 'read' WHEN joined THEN 'filled' ELSE 'missing' END AS status FROM q LEFT JOIN k USING (c)""",
    "p3_found": f"""WITH {_READ}, s AS (SELECT c, feature, CAST(unnest(range(min(year), max(year))) AS INTEGER) AS year FROM r GROUP BY c, feature)
        SELECT coalesce(k.country, c) AS country, feature, year FROM s LEFT JOIN k USING (c) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c = s.c AND r.feature = s.feature AND r.year = s.year)""",
    "p7_fill": f"""WITH {_FILL}, un AS (SELECT feature, min(u) AS u FROM b WHERE u IS NOT NULL GROUP BY feature)
        SELECT obs_id, CASE WHEN b.v IS NOT NULL THEN b.v ELSE round(coalesce(bc.v, yc.v), 6) END AS value, b.v IS NULL AND coalesce(bc.v, yc.v) IS NOT NULL AS value_filled,
        CASE WHEN b.v IS NOT NULL THEN 'read' WHEN bc.v IS NOT NULL THEN 'country' WHEN yc.v IS NOT NULL THEN 'year' ELSE 'none' END AS value_source, coalesce(b.u, un.u) AS unit, b.u IS NULL AND un.u IS NOT NULL AS unit_filled,
        CASE WHEN b.u IS NOT NULL THEN 'read' WHEN un.u IS NOT NULL THEN 'dependency' ELSE 'none' END AS unit_source
        FROM b LEFT JOIN bc ON bc.feature = b.feature AND bc.c = b.c LEFT JOIN yc ON yc.feature = b.feature AND yc.year = b.year LEFT JOIN un ON un.feature = b.feature""",
    "p7_found": f"""WITH {_FILL}, x AS (SELECT obs_id, b.v IS NULL AND (bc.v IS NOT NULL OR yc.v IS NOT NULL) AS v, b.u IS NULL AND (coalesce(bc.n, 0) > 0 OR coalesce(yc.n, 0) > 0) AS u
        FROM b LEFT JOIN bc ON bc.feature = b.feature AND bc.c = b.c LEFT JOIN yc ON yc.feature = b.feature AND yc.year = b.year)
        SELECT obs_id, 'value' AS field_name FROM x WHERE v UNION ALL SELECT obs_id, 'unit' FROM x WHERE u""",
}
