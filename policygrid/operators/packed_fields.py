"""Several values packed in one field: the dialect of each field by minimum description length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.session import durable, fresh_name, release, require_columns

#: Delimiters a dialect may use. Fixed values; a line end is one delimiter in all its spellings.
DELIMITERS = (";", "；", ",", "，", "、", "|", "/", "\t", "\n")
#: Closing marks of the quotes a value may be put in. Fixed values.
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}
_BULLET = re.compile(r"(?:[•‣◦▪●·*–—-]\s+|[•‣◦▪●]|\(?\d{1,3}[.)]\s+)")
_QUOTED = re.compile("[" + "".join(QUOTES) + "]")
_EDGE = re.compile(r"^[\s\x1c-\x1f​﻿]+|[\s\x1c-\x1f​﻿]+$")
#: Bits of a character spelled out in a field, of one in the book of known values (whose words recur), and of a delimiter declared.
CHAR_BITS, BOOK_BITS, DIALECT_BITS = 6.0, 2.0, 1.5


def _trim(s: str) -> str:
    return _EDGE.sub("", s)


def _quoted_end(s: str, at: int) -> int:
    """Where the quoted value that begins at `at` ends (after its closing mark), -1 if it doesn't."""
    close, i, n = QUOTES[s[at]], at + 1, len(s)
    while i < n:
        if s[i] == "\\" and i + 1 < n and s[i + 1] in (close, "\\"):
            i += 2
        elif s[i] == close:
            if close == s[at] and i + 1 < n and s[i + 1] == close:
                i += 2
            else:
                return i + 1
        else:
            i += 1
    return -1


def _unquote(s: str) -> str:
    """A trimmed value without quoting that goes around all of it; doubled and escaped inner marks once."""
    while len(s) >= 2 and s[0] in QUOTES and _quoted_end(s, 0) == len(s):
        close = QUOTES[s[0]]
        s = _trim(s[1:-1].replace("\\" + close, close).replace("\\\\", "\\").replace(close * 2, close) if close == s[0] else s[1:-1])
    return s


@lru_cache(maxsize=1024)
def _cutter(delimiters: frozenset[str]) -> re.Pattern:
    return re.compile("([" + "".join(map(re.escape, sorted(delimiters))) + ("\\r" if "\n" in delimiters else "") + "])")


def _pieces(s: str, delimiters: frozenset[str]) -> Iterator[str]:
    """The stretches between delimiters, without the list mark of one that begins a line."""
    cut = _cutter(delimiters).split(s) if delimiters else [s]
    for k in range(0, len(cut), 2):
        piece = cut[k]
        bare = piece.lstrip()
        gap = len(piece) - len(bare)
        before = piece[gap - 1] if gap else cut[k - 1] if k else "\n"
        mark = _BULLET.match(bare) if before in "\r\n" else None
        yield bare[mark.end() :] if mark else piece


def split_field(raw: str, delimiters: frozenset[str], quoting: bool) -> list[str]:
    """The values of `raw`, trimmed, without quotes and list marks; blank ones left out."""
    s = _trim(raw)
    if quoting and len(s) >= 2 and (s[0], s[-1]) in (("[", "]"), ("{", "}"), ("(", ")")) and ("," in delimiters or ";" in delimiters):
        s = s[1:-1]
    elif len(s) >= 2 and s[0] == "[" and s[-1] == "]":
        s = s[1:-1]
    if not (quoting and _QUOTED.search(s)):
        return [v for v in map(_trim, _pieces(s, delimiters)) if v]
    parts, start, i, n, fresh = [], 0, 0, len(s), True
    while i < n:
        c = s[i]
        c = "\n" if c == "\r" else c
        if c in delimiters:
            parts.append(s[start:i])
            start, fresh = i + 1, True
        elif fresh and not c.isspace():
            if (i == 0 or s[i - 1] in "\r\n") and (bullet := _BULLET.match(s, i)):
                i = start = bullet.end()
                continue
            fresh = False
            if quoting and c in QUOTES and (end := _quoted_end(s, i)) > 0:
                rest = end
                while rest < n and s[rest].isspace() and s[rest] not in "\r\n\t":
                    rest += 1
                if rest == n or ("\n" if s[rest] == "\r" else s[rest]) in delimiters:
                    i = rest
                    continue
        i += 1
    parts.append(s[start:])
    out = (_trim(p) for p in parts)
    return [v for v in (_unquote(p) if quoting else p for p in out) if v]


def dialects(raw: str) -> list[tuple[frozenset[str], bool]]:
    """The dialects that can matter to `raw`: sets of the delimiters it holds, with quoting if it has a quote.

    At most 2^9 sets, as there are nine delimiters; nearly all fields hold one or two.
    """
    text = raw.replace("\r", "\n")
    here = [d for d in DELIMITERS if d in text]
    modes = (True, False) if any(q in raw for q in QUOTES) else (True,)
    return [(frozenset(c), q) for k in range(len(here) + 1) for c in combinations(here, k) for q in modes]


def parses(raw: str) -> dict[tuple[str, ...], tuple[frozenset[str], bool]]:
    """The different results of the dialects of `raw`, each with the simplest dialect that gives it."""
    out: dict[tuple[str, ...], tuple[frozenset[str], bool]] = {}
    for d in dialects(raw):
        out.setdefault(tuple(split_field(raw, *d)), d)
    return out


#: Texts that hold no delimiter, quote, bracket or list mark are one value in every dialect.
_PLAIN = r"^ *\p{L}(?:[\p{L}\p{M}\p{N} .&%:+_-]*[\p{L}\p{M}\p{N}.])? *$"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each field text its different parses, and how many delimiters the dialect of each declares."""
    for pdf in batches:
        found = [parses(raw) for raw in pdf["raw"]]
        yield pd.DataFrame({"field_name": pdf["field_name"], "cell": pdf["cell"], "parses": [[list(p) for p in f] for f in found], "declared": [[len(d[0]) for d in f.values()] for f in found]})


def _code_lengths(counts: DataFrame) -> DataFrame:
    """item, bits of counts (field_name, item, size, w): -log2 of the value's share of the field's values and its part of the book entry that spells it once.

    Spelling it out on the spot is the bound; a value that occurs once gains
    nothing from a code book and isn't in it. Values are told apart by hashes of
    field and value; two that collide would only share a code length.
    """
    totals = counts.groupBy("field_name").agg(F.sum("w").alias("total"))
    book = counts.where("w > 1").join(F.broadcast(totals), "field_name")  # one row per field name
    spelled = F.lit(CHAR_BITS) * (F.col("size") + 1)
    bits = F.least(F.log2(F.col("total") / F.col("w")) + F.lit(BOOK_BITS) * (F.col("size") + 1) / F.col("w"), spelled)
    return book.groupBy("item").agg(F.min(bits).alias("bits"))


def unpack_fields(df: DataFrame, row_id: str, fields: list[str], rounds: int = 2) -> DataFrame:
    """One row per value of the packed string columns `fields`: row_id, field_name, item_no, item, n_items.

    Equal field texts are parsed once and vote once, however many rows share them
    (else a packed text repeated often would look like one value). Round one counts
    the values of all parses of every text over the whole table, each text's vote
    spread over its parses; the counts give code lengths, and each
    text takes the dialect (delimiters and quoting) of fewest bits. Later rounds
    count only the chosen parses, which sharpens the code. A text is parsed once, in
    Python unless it is plain words; its parses are rated by sums in the JVM. item_no
    counts from 1 over values that aren't blank, repeats included.

    Null, blank and delimiter-only fields give no rows; a field with one value gives
    one row; a column that is missing raises ValueError.
    """
    require_columns(df, row_id, *fields)
    name, value = fresh_name(df.columns, "field_name"), fresh_name(df.columns, "raw")
    long = df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias(name), F.col(f).cast("string").alias(value)) for f in fields])).alias("x"))
    long = long.select("row_id", F.col(f"x.{name}").alias("field_name"), F.col(f"x.{value}").alias("raw")).where(F.trim("raw") != "")
    long = long.withColumn("cell", F.unhex(F.md5(F.concat_ws("\x00", "field_name", "raw"))))
    cells = long.groupBy("field_name", "cell").agg(F.first("raw").alias("raw"))
    plain = F.col("raw").rlike(_PLAIN)
    shape = "field_name string, cell binary, parses array<array<string>>, declared array<int>"
    whole = cells.where(plain).select("field_name", "cell", F.array(F.array(F.trim("raw"))).alias("parses"), F.array(F.lit(0)).alias("declared"))
    cand = durable(cells.where(~plain).mapInPandas(_parse, shape).unionByName(whole), "packed-cells")
    # A row per value of each parse, the value as a hash and its length; a parse without a value has one row without a hash.
    each = cand.select("field_name", "cell", "declared", F.size("parses").alias("n"), F.posexplode("parses").alias("p", "items"))
    items = each.select("field_name", "cell", "n", "p", F.get("declared", F.col("p")).alias("d"), F.explode_outer("items").alias("item"))
    items = items.select("field_name", "cell", "n", "p", "d", F.when(F.col("item").isNotNull(), F.xxhash64("field_name", "item")).alias("item"), F.length("item").alias("size"))
    counts = items.where("item is not null").groupBy("field_name", "item", "size").agg(F.sum(1 / F.col("n")).alias("w"))
    chosen = None
    for _ in range(rounds):
        spelled = F.when(F.col("item").isNull(), 0.0).otherwise(F.lit(CHAR_BITS) * (F.col("size") + 1))
        rated = items.where("n > 1").join(_code_lengths(counts), "item", "left").select("cell", "p", "d", F.coalesce("bits", spelled).alias("bits"))
        length = rated.groupBy("cell", "p", "d").agg(F.sum("bits").alias("bits")).withColumn("bits", F.round(F.col("bits") + DIALECT_BITS * F.col("d"), 6))
        best = length.groupBy("cell").agg(F.min(F.struct("bits", "d", "p"))["p"].alias("p"))
        before, chosen = chosen, durable(cand.join(best, "cell", "left").select("field_name", "cell", F.get("parses", F.coalesce("p", F.lit(0))).alias("items")), "packed-chosen")
        if before is not None:
            release(before)
        picked = chosen.select("field_name", F.explode("items").alias("item"))
        counts = picked.groupBy("field_name", F.xxhash64("field_name", "item").alias("item"), F.length("item").alias("size")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    parsed = long.select("row_id", "field_name", "cell").join(chosen.select("cell", "items"), "cell")
    return parsed.select("row_id", "field_name", F.posexplode("items").alias("p", "item"), F.size("items").alias("n_items")).select("row_id", "field_name", (F.col("p") + 1).alias("item_no"), "item", "n_items")
