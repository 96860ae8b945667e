"""ROUGE between generated and human texts: n-gram counts in the JVM, longest common subsequence in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import tokens


def f1(shared: Column, a: Column, b: Column) -> Column:
    """F1 of `shared` of a and b items, 0 where one side is empty."""
    p, r = F.try_divide(shared.cast("double"), a), F.try_divide(shared.cast("double"), b)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _stemmed(long: DataFrame) -> DataFrame:
    """`long` (side, word, ...) with words as their stems: each different word of the table is stemmed once."""
    stem = F.pandas_udf(lambda s: pd.Series([porter(w) if len(w) > 3 else w for w in s], index=s.index, dtype=object), "string")
    book = long.select("word").distinct().withColumn("stem", stem("word"))
    return long.join(book, "word").drop("word").withColumnRenamed("stem", "word")


def rouge_n(pairs: DataFrame, key: str, generated: str, human: str, n: int, stem: bool = True) -> DataFrame:
    """key, rouge<n>: F1 of clipped n-gram counts of stemmed words (`stem` off: of words as they stand). Null texts count as empty.

    Words are joined to the dictionary of stems one by one and n-grams counted by
    (key, n-gram), so a long text is spread by its words.
    """
    long = pairs.select(key, F.lit(0).alias("side"), F.posexplode(tokens(F.col(generated))).alias("pos", "word")).union(pairs.select(key, F.lit(1), F.posexplode(tokens(F.col(human)))))
    if stem:
        long = _stemmed(long)
    # The words of an n-gram meet under the place it begins at.
    spread = long.select(key, "side", F.explode(F.array(*[F.struct((F.col("pos") - k).alias("at"), F.struct(F.lit(k).alias("k"), "word").alias("w")) for k in range(n)])).alias("g")) if n > 1 else None
    if spread is None:
        grams = long.select(key, "side", F.col("word").alias("x"))
    else:
        parts = spread.groupBy(key, "side", "g.at").agg(F.array_sort(F.collect_list("g.w")).alias("x"))  # n words at most
        grams = parts.where((F.size("x") == n) & (F.col("at") >= 0)).select(key, "side", F.array_join("x.word", " ").alias("x"))
    per = grams.groupBy(key, "x").agg(F.count_if(F.col("side") == 0).alias("cg"), F.count_if(F.col("side") == 1).alias("ch"))
    shared = per.groupBy(key).agg(F.sum(F.least("cg", "ch")).alias("m"), F.sum("cg").alias("ng"), F.sum("ch").alias("nh"))
    score = F.round(F.coalesce(f1(F.col("m"), F.col("ng"), F.col("nh")), F.lit(0.0)), 6)
    return pairs.select(key).join(shared, key, "left").select(key, score.alias(f"rouge{n}"))


_STEPS2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEPS3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEPS4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(w: str) -> str:
    """The published Porter stemmer; words of up to three letters stay."""
    if len(w) <= 3:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (end := next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)) is not None:
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEPS2, _STEPS3):
        for end in sorted(steps, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + steps[end]
                break
    for end in sorted((*_STEPS4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _words(text: str | None, stem: bool) -> list[str]:
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return [porter(w) if len(w) > 3 else w for w in words] if stem else words


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit vectors: one big-integer step per word of b."""
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        hit = row & place.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, key: str, generated: str, human: str, stem: bool = True) -> DataFrame:
    """key, rougeL: F1 of the longest common subsequence of words. Null texts count as empty."""

    def score(g: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(g, h, strict=True):
            a, b = _words(x if isinstance(x, str) else None, stem), _words(y if isinstance(y, str) else None, stem)
            n = lcs_length(a, b) if a and b else 0
            out.append(round(2 * n / (len(a) + len(b)), 6) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return pairs.select(key, F.pandas_udf(score, "double")(F.col(generated), F.col(human)).alias("rougeL"))
