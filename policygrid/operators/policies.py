"""Policy tables as the later steps read them: cleaned, loaded for chunking and baselines, filtered, and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import clean_html, clean_keywords, clean_text, split_sectors
from policygrid.session import require_columns


def to_date(c: Column) -> Column:
    """A date in the form 2020-01-31, with or without a time after it; anything else is null."""
    return F.when(F.trim(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.substring(F.trim(c), 1, 10).try_cast("date"))


def with_default(df: DataFrame, name: str, default: str = "") -> Column:
    """The column `name`, or the default where the table lacks it; null counts as the default."""
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def clean_policies(df: DataFrame) -> DataFrame:
    """Policies that can be trained on: row_id, document_id, family_summary, sectors, geography, event_date.

    Mark-up and white space go from summaries; rows with a blank summary, no sector
    (besides Other), a blank geography or no valid date are left out. A missing document id is empty.
    """
    require_columns(df, "row_id", "family_summary", "sector", "geography", "last_event_in_timeline")
    out = df.select(
        "row_id", with_default(df, "document_id").alias("document_id"), clean_html(F.col("family_summary")).alias("family_summary"), split_sectors(F.col("sector")).alias("sectors"),
        F.trim("geography").alias("geography"), to_date(F.col("last_event_in_timeline")).alias("event_date"),
    )
    return out.where("family_summary <> '' and size(sectors) > 0 and geography <> '' and event_date is not null")


def load_policies(df: DataFrame, required: list[str], keep_blank: bool = True, keywords: bool = False) -> DataFrame:
    """The policies a step reads: row_id, fold, document_id, cleaned family_summary, geography, sector (and keyword), those with a document id.

    Missing `required` columns raise ValueError; geography and sector may be absent.
    With `keep_blank` off rows with a blank summary are left out.
    """
    require_columns(df, "row_id", *required)
    cols = [F.col("fold").cast("int").alias("fold"), with_default(df, "document_id").alias("document_id"), clean_text(F.col("family_summary")).alias("family_summary"), clean_text(with_default(df, "geography")).alias("geography"), clean_text(with_default(df, "sector")).alias("sector")]
    if keywords:
        cols.append(clean_keywords(F.col("keyword")).alias("keyword"))
    out = df.select("row_id", *cols).where("document_id <> ''")
    return out if keep_blank else out.where("family_summary <> ''")


def in_countries(df: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """Rows whose country (trimmed) is in the list `countries` (country): a semi join, broadcast by Spark if the list is small."""
    return df.join(countries.select(F.trim("country").alias("_c")).distinct(), F.trim(column) == F.col("_c"), "left_semi")


def trainable(df: DataFrame) -> DataFrame:
    """Rows with a sector other than exactly `Other` and with a date."""
    return df.where("sector is not null and sector <> 'Other' and last_event_in_timeline is not null")


def of_window(traces: DataFrame, window: str) -> DataFrame:
    """Traces of one window, compared as text, whatever type the column has."""
    return traces.where(F.col("window").cast("string") == F.lit(str(window)))


def table_domains(paths: DataFrame, column: str = "path") -> DataFrame:
    """table_key (t and the number in path order, from 0), domain (the first step of the path) of every table file.

    The catalogue has one row per table, so one task numbers it.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(column)) - 1
    return paths.select(column).distinct().select(F.format_string("t%03d", place).alias("table_key"), F.split_part(column, F.lit("/"), F.lit(1)).alias("domain"))


def feature_domains(features: DataFrame, domains: DataFrame, kinds: tuple[str, ...], other: str = "other") -> DataFrame:
    """feature, feature_idx (in order, from 0), domain of features named `key__column`; a domain that isn't one of `kinds`, or is unknown, is `other`.

    The features are the columns of a panel, so one task numbers them.
    """
    from pyspark.sql import Window as W

    named = features.select("feature").distinct().select("feature", (F.row_number().over(W.orderBy("feature")) - 1).alias("feature_idx"), F.split_part("feature", F.lit("__"), F.lit(1)).alias("table_key"))
    known = F.when(F.col("domain").isin(*kinds), F.col("domain")).otherwise(other)
    return named.join(domains, "table_key", "left").select("feature", "feature_idx", known.alias("domain"))


def names_at(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """feature_idx, feature of the wanted indices; those out of bounds have no row."""
    return wanted.select("feature_idx").join(features.select("feature_idx", "feature"), "feature_idx")


def test_rows(rows: DataFrame, policies: DataFrame, queries: DataFrame) -> DataFrame:
    """`rows` (document_id) with the summary of the document's last policy row and its first query text that isn't blank; what is missing is empty."""
    summary = policies.groupBy("document_id").agg(F.max_by("family_summary", "row_id").alias("summary"))
    query = queries.where(F.trim("query_text") != "").groupBy("document_id").agg(F.min_by("query_text", "query_no").alias("query_text"))
    out = rows.join(summary, "document_id", "left").join(query, "document_id", "left")
    return out.withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("query_text", F.coalesce("query_text", F.lit("")))


test_rows.__test__ = False  # not a test, whatever its name


def normalize_results(rows: DataFrame, experiment: str | None = None) -> DataFrame:
    """Result rows with `fold` (from `window` where there is none), `method` (from backbone and loss) and, if given, `experiment`.

    Raises ValueError where a method can't be told.
    """
    if "fold" not in rows.columns and "window" in rows.columns:
        rows = rows.withColumnRenamed("window", "fold")
    if "method" not in rows.columns:
        require_columns(rows, "backbone", "loss")
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        rows = rows.withColumn("method", F.concat_ws("|", text("backbone"), text("loss")))
    return rows if experiment is None else rows.withColumn("experiment", F.lit(experiment))
