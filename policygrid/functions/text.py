"""Text expressions that stay inside the JVM, and two Arrow functions that can't."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: Unicode white space and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"

#: Spellings that stand for "no value", after lower-casing, trimming and (for titles) dropping punctuation. Fixed values.
NO_VALUE = (
    "", "-", "--", "?", "??", ".", "n/a", "n.a.", "na", "nan", "nil", "no data", "no title", "none", "not applicable",
    "not available", "null", "tba", "tbd", "undefined", "unknown", "untitled", "(untitled)", "(none)", "(unknown)", "missing", "#n/a", "<na>", "nd", "n.d.",
)


def squeeze(c: Column) -> Column:
    """Runs of white space of any kind as one space, none outside; null stays null."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def clean_text(c: Column) -> Column:
    """squeeze(), null as the empty string."""
    return F.coalesce(squeeze(c), F.lit(""))


def strip_space(c: Column) -> Column:
    """White space of any kind taken from both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def evened(c: Column) -> Column:
    """Without case and without white space of any kind."""
    return F.lower(F.regexp_replace(c, f"{SPACE}+", ""))


def evened_words(c: Column) -> Column:
    """Without case, runs of white space as one space."""
    return F.lower(squeeze(c))


def evened_title(c: Column) -> Column:
    """evened(), punctuation and format characters left aside as well."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s\p{P}\p{C}]+", ""))


#: The stand-ins as evened_title() leaves them, for values that have been evened.
NO_VALUE_BARE = tuple(sorted({"".join(ch for ch in v if ch.isalnum()) for v in NO_VALUE}))
NO_VALUE_EVEN = tuple(sorted({v.replace(" ", "") for v in NO_VALUE}))


def value_or_null(c: Column, stand_ins: tuple[str, ...] = NO_VALUE_EVEN) -> Column:
    """Null where an evened string is blank or a stand-in."""
    return F.when(c.isin(*stand_ins), F.lit(None).cast("string")).otherwise(c)


def is_stand_in(c: Column) -> Column:
    """True for null, blank and spellings of "no value"."""
    return c.isNull() | evened(c).isin(*NO_VALUE_EVEN)


def clean_keywords(c: Column) -> Column:
    """The parts of a `;` list, cleaned, blank ones dropped, joined by a space."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), squeeze)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def split_sectors(c: Column, drop: str = "Other") -> Column:
    """The parts of a `;` list, trimmed, without blank ones and `drop`; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (p != drop))


def split_plain(c: Column) -> Column:
    """Split at `;` without trimming; null gives an empty array."""
    return F.coalesce(F.split(c, ";"), F.array().cast("array<string>"))


def instrument_name(c: Column) -> Column:
    """`name` of `name|type`."""
    return F.nullif(F.trim(F.split_part(c, F.lit("|"), F.lit(1))), F.lit(""))


def instrument_type(c: Column) -> Column:
    """`type` of `name|type`, null if there is none."""
    return F.nullif(F.trim(F.split_part(c, F.lit("|"), F.lit(2))), F.lit(""))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def safe_filename(c: Column, default: str = "unknown") -> Column:
    """Runs of other than letters, digits, dot, underscore and hyphen as `_`, none outside."""
    out = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def ascii_only(c: Column) -> Column:
    """Runs of characters beyond ASCII as one space."""
    return F.regexp_replace(c, r"[^\x00-\x7F]+", " ")


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def path_window(path: Column) -> Column:
    """The number of `window_<n>` in a path, else `unknown`."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"window_(\d+)", 1), F.lit("")), F.lit("unknown"))


def strip_tags(c: Column) -> Column:
    """Mark-up tags as one space each."""
    return F.regexp_replace(c, "<[^>]+>", " ")


def xml_entities(c: Column) -> Column:
    """The five XML entities and nbsp resolved, `&amp;` last so that nothing is resolved twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _unescape(s: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or t != t else html.unescape(t) for t in s], index=s.index, dtype=object)


def all_entities(c: Column) -> Column:
    """All HTML entities resolved, Arrow batch by Arrow batch."""
    return F.pandas_udf(_unescape, "string")(c)


def clean_html(c: Column, full: bool = False) -> Column:
    """Tags as spaces, entities resolved, white space squeezed; null as the empty string.

    full=False stays in the JVM and knows the XML entities; full=True resolves
    every HTML entity in Python, only for values that have an `&`.
    """
    bare = strip_tags(c)
    resolved = F.when(bare.contains("&"), all_entities(bare)).otherwise(bare) if full else xml_entities(bare)
    return clean_text(resolved)


def policy_year(c: Column) -> Column:
    """The whole number before the first hyphen, null if it is none (or has more than nine digits)."""
    head = F.trim(F.split_part(c, F.lit("-"), F.lit(1)))
    return F.when(head.rlike("^[+]?[0-9]{1,9}$"), head.cast("int"))


def first_non_blank(*cols: Column) -> Column:
    """The first value that isn't null or blank, trimmed; else the empty string."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def normal_path(c: Column) -> Column:
    """A path without outer white space, leading slashes and `.`/`..` steps, slashes of one kind and one at a time."""
    one = F.regexp_replace(strip_space(c), r"[/\\]+", "/")
    return F.nullif(F.regexp_replace(one, r"^(?:/|\.{1,2}(?=/|$))+", ""), F.lit(""))
