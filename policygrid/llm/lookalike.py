"""Visually identical text in one form: look-alike classes by union-find, rewritten by an automaton."""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policygrid.session import durable, require_columns

#: Letters of other scripts that look like a Latin letter, as pairs of the letter and its look-alikes. Fixed values.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ь", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιɩⅰ", "j": "јϳ", "k": "κ", "l": "ӏⅼ", "m": "ⅿ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵⅴ", "w": "ԝա", "x": "хχⅹ", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹⅭ", "D": "Ⅾ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀⅠ", "J": "ЈͿ", "K": "КΚ", "L": "Ⅼ", "M": "МΜⅯ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "ѴⅤ", "W": "Ԝ", "X": "ХΧⅩ", "Y": "УΥҮ", "Z": "Ζ",
    "ß": "β", "μ": "µ", "Ø": "Ѳ",
}
#: Characters that show nothing though their category doesn't say so. Fixed values.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"
_SAME_LOOK = ("wide", "narrow", "noBreak", "initial", "medial", "final", "isolated")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while (p := self.up.setdefault(root, root)) != root:
            root = p
        while self.up[s] != root:
            self.up[s], s = root, self.up[s]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a

    def members(self) -> list[list[str]]:
        groups: dict[str, list[str]] = defaultdict(list)
        for s in self.up:
            groups[self.find(s)].append(s)
        return [sorted(g) for g in groups.values() if len(g) > 1]


def unseen(c: str) -> bool:
    """Whether a character shows nothing: format characters, variation selectors, and a few others."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F, 0x8E2) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or c in UNSEEN or (unicodedata.category(c) == "Cc" and c not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85")


def same_look(c: str) -> str:
    """What a width or presentation form, non-breaking variant or ligature stands for; empty for other characters."""
    kind, _, to = unicodedata.decomposition(c).partition("> ")
    tied = kind == "<compat" and ("LIGATURE" in unicodedata.name(c, "") or "DIGRAPH" in unicodedata.name(c, ""))
    return "".join(chr(int(x, 16)) for x in to.split()) if tied or kind[:1] == "<" and kind[1:] in _SAME_LOOK else ""


@lru_cache(maxsize=1)
def classes() -> Classes:
    """The look-alike classes over strings in decomposed form, from the Unicode database's rules and LOOK_ALIKES.

    Width and presentation forms and non-breaking variants join what they
    decompose to, ligatures the letters they tie, spaces of any kind the space,
    unseen characters the empty string. Superscripts, circled and styled letters
    look different and stay.
    """
    found = Classes()
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if unseen(c):
            found.union(c, "")
        elif category == "Zs":
            found.union(c, " ")
        else:
            if to := same_look(c):
                found.union(unicodedata.normalize("NFD", c), unicodedata.normalize("NFD", to))
    for o in [x for x in range(0x20) if x not in (9, 10, 11, 12, 13, 28, 29, 30, 31)] + [0x7F]:
        found.union(chr(o), "")
    for letter, others in LOOK_ALIKES.items():
        for c in others:
            found.union(letter, c)
    return found


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """For each member that isn't the representative of its class, that representative.

    The most frequent member stands for its class, ties to what isn't a variant
    form, then to the shorter, then to the smaller. A string of several letters
    counts as often as its rarest letter. What shows nothing stays nothing and
    spaces become the space, however often others occur.
    """
    out = {}
    for group in classes().members():
        rate = {s: min((counts.get(c, 0) for c in s), default=0) for s in group}
        best = "" if "" in group else " " if " " in group else min(group, key=lambda s: (-rate[s], sum(bool(same_look(c)) for c in s), len(s), s))
        out |= {s: best for s in group if s != best}
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting of class members by their representatives: a multi-pattern automaton over decomposed text.

    The automaton reads UTF-8 bytes (each as one character), so that its states have
    few ways out; as no character's bytes begin inside another's, matches are the
    same as over characters.
    """

    def __init__(self, to: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for s, r in to.items():
            if s:
                self.automaton.add_word(_bytes(s), (len(s.encode()), _bytes(r)))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        """The canonical form. Rewriting can bring a letter and an accent together, so accents are composed last."""
        if not len(self.automaton):
            return unicodedata.normalize("NFC", text)
        flat = _bytes(unicodedata.normalize("NFD", text))
        out, at = [], 0
        for end, (n, r) in self.automaton.iter_long(flat):
            out.append(flat[at : end - n + 1])
            out.append(r)
            at = end + 1
        return unicodedata.normalize("NFC", "".join([*out, flat[at:]]).encode("latin-1").decode())


def _bytes(s: str) -> str:
    return s.encode().decode("latin-1")


def _canonical(to: dict[str, str]):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        rewrite = _rewriter(tuple(to.items()))
        return pd.Series([None if t is None or t != t else rewrite(t) for t in texts], index=texts.index, dtype=object)

    return run


@lru_cache(maxsize=2)
def _rewriter(items: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(dict(items))


@lru_cache(maxsize=1)
def _counted() -> frozenset[str]:
    return frozenset(c for g in classes().members() if "" not in g and " " not in g for s in g for c in s)


def _member_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the characters of class members in each batch's texts, decomposed."""
    wanted = sorted(map(ord, _counted()))
    total = np.zeros(sys.maxunicode + 1, np.int64)
    for pdf in batches:
        text = "".join(pdf["text"])
        flat = text if unicodedata.is_normalized("NFD", text) else unicodedata.normalize("NFD", text)
        part = np.bincount(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32))
        total[: len(part)] += part
    found = [o for o in wanted if total[o]]
    if found:
        yield pd.DataFrame({"member": [chr(o) for o in found], "n": total[found]})


def member_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each character of look-alike classes occurs in the whole corpus; at most one number per character reaches the driver."""
    some = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull())
    rows = some.mapInPandas(_member_counts, "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r["member"]: r["n"] for r in rows}


def canonical_text(docs: DataFrame, text: str = "text", to: dict[str, str] | None = None) -> DataFrame:
    """`docs` with the column `canonical`: texts that look the same are equal in it, others differ.

    Case, accents, punctuation, digits and line ends stay. Null stays null, a text
    of unseen characters becomes empty. A text of printable ASCII is its own
    canonical form unless a class has another representative than the ASCII member,
    in which case the automaton reads it too.
    """
    require_columns(docs, text)
    to = representatives(member_counts(docs, text)) if to is None else to
    # Without a pattern of ASCII alone there is nothing to rewrite in such a text.
    plain = F.col(text).isNull() if any(s and s.isascii() and s.isprintable() for s in to) else F.col(text).isNull() | ~F.col(text).rlike(r"[^\t\n\r -~]")
    return docs.withColumn("canonical", F.when(plain, F.col(text)).otherwise(_canonical(to)(F.when(~plain, F.col(text)))))


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a, doc_id_b of different texts with the same canonical form that show something.

    Texts travel as digests. Pairs are formed between the different spellings of a
    class, then members are put in their place, so copies of one spelling never
    meet each other.
    """
    visible = F.col("canonical").rlike(r"(?U)[^\s\p{C}]")
    marked = canonical_text(docs.select(key, text), text).where(visible).select(F.col(key).alias("doc_id"), F.md5("canonical").alias("look"), F.md5(text).alias("spelling"))
    marked = durable(marked, "looks")
    spellings = durable(marked.select("look", "spelling").distinct(), "spellings")
    several = spellings.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    pairs = spellings.join(several, "look", "left_semi").join(spellings.select("look", F.col("spelling").alias("other")), "look").where("spelling <> other")
    a = marked.select(F.col("doc_id").alias("doc_id_a"), "spelling")
    b = marked.select(F.col("doc_id").alias("doc_id_b"), F.col("spelling").alias("other"))
    return pairs.join(a, "spelling").join(b, "other").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def canonical_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, canonical of every document."""
    return canonical_text(docs.select("doc_id", "text")).select("doc_id", "canonical")
