"""Same or near-same records across splits: compressed full-text indexes of evaluation shards, searched backwards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import all_entities, xml_entities
from policygrid.session import durable, fresh_name, require_columns, spread

THRESHOLD = 0.8
#: Different word sets whose seeds make one index shard, about.
SHARD_SETS = 4096
#: Sets that share one seed are worked off in pairs of blocks of about so many.
HOT = 20_000
#: Words of a seed at most, and seeds that two like sets must share where they have enough.
SEED, COMMON = 3, 2


#: An entity that is none of those resolved in the JVM.
_OTHER_ENTITY = r"&(?!(?:nbsp|lt|gt|quot|#39|amp);)[#A-Za-z]"


def with_word_set(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the different words (runs of letters and digits) of a text without case, mark-up removed and entities resolved.

    Python resolves entities only where there is one besides the XML ones and nbsp.
    """
    bare, plain = fresh_name(df.columns, "_bare"), fresh_name(df.columns, "_plain")
    c = F.col(text)
    marked = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"</?[A-Za-z!?][^<>]*>", " ")
    df = df.withColumn(bare, F.when(c.contains("<"), marked).otherwise(c))
    b = F.col(bare)
    other = b.contains("&") & b.rlike(_OTHER_ENTITY)
    df = df.withColumn(plain, F.when(other, all_entities(F.when(other, b))).when(b.contains("&"), xml_entities(b)).otherwise(b))
    words = F.split(F.lower(plain), r"[^\p{L}\p{N}]+")
    return df.withColumn(name, F.array_distinct(F.array_remove(words, ""))).drop(bare, plain)


class _Bits:
    """A bit vector with rank: the bits in 64-bit words, and a count of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        room = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        room[: len(bits)] = bits
        self.words = np.packbits(room, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & _BELOW[at & 63])

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each position, and the ones before it."""
        w, k = at >> 6, at & 63
        word = self.words[w]
        return (word & _AT[k]) != 0, self.before[w] + np.bitwise_count(word & _BELOW[k])


#: For each place in a word, its bit and all bits before it.
_AT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BELOW = _AT - np.uint64(1)


class FullTextIndex:
    """FM-index over sequences of symbols: the Burrows-Wheeler transform as a wavelet matrix with rank blocks.

    A symbol takes as many bits as the alphabet needs and half of that again for
    ranks. No suffix array is kept: an occurrence is located by walking back to the
    start of its sequence, of which one number each is stored, so the walk is as
    long as the occurrence's offset. A batch of searches steps at once.
    """

    def __init__(self, sequences: list[np.ndarray]) -> None:
        """`sequences` hold symbols from 1; 0 ends each."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        self._build(np.concatenate(sequences).astype(np.int64) if len(sequences) else np.empty(0, np.int64), lengths)

    @classmethod
    def of(cls, flat: np.ndarray, lengths: np.ndarray) -> FullTextIndex:
        """The index of sequences that lie one after the other in `flat`."""
        self = cls.__new__(cls)
        self._build(flat.astype(np.int64), lengths.astype(np.int64))
        return self

    def _build(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths + 1) - 1
        self.n = n = int(ends[-1]) + 1 if len(ends) else 0
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = flat
        order = self._suffixes(text, ends)
        last = text[order - 1] if n else text  # the symbol before each suffix, cyclic
        begin = ends - lengths
        number = np.full(n, -1, np.int32)
        number[begin] = np.arange(len(ends))
        self.starts = number[order[last == 0]] if n else number  # sequences in the order of the rows that begin them
        self.top = int(text.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))]).astype(np.int64)
        self.levels: list[tuple[int, _Bits, int]] = []
        for level in range(max(1, self.top.bit_length()) - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.levels.append((level, _Bits(bit), int(n - bit.sum())))
            last = np.concatenate([last[~bit], last[bit]])
        symbols = np.arange(self.top + 1)
        self.base = self._down(symbols, np.zeros(len(symbols), np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling the length that ranks stand for; each end is a symbol of its own."""
        n, k = len(text), 1
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else 0
            if k >= n or fresh[order[-1]] == n - 1:
                return order
            rank, k = fresh, 2 * k

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where `at` comes to lie on the way of `symbol` through the levels."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches lengthened by `symbol` (from 1; 0: unknown) before them."""
        known = np.where((symbol > 0) & (symbol <= self.top), symbol, 0)
        shift = self.first[known] - self.base[known]
        lo, hi = self._down(known, lo) + shift, self._down(known, hi) + shift
        return lo, np.where(known > 0, hi, lo)

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of single symbols; unknown ones (0) have an empty interval."""
        known = np.where((symbols > 0) & (symbols <= self.top), symbols, 0)
        lo = self.first[known]
        return lo, np.where(known > 0, self.first[known + 1], lo)

    def before(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before the suffix of each row, and the row of the suffix that begins with it (of 0: the number of the sequence)."""
        symbol, at = np.zeros(len(rows), np.int64), rows
        for level, bits, zeros in self.levels:
            bit, ones = bits.look(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol[bit] |= 1 << level
        at = at - self.base[symbol]
        back = self.first[symbol] + at
        begins = symbol == 0
        back[begins] = self.starts[at[begins]]
        return symbol, back

    def walk(self, symbol: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the suffixes that before() was asked for, by going on to the start."""
        sequence, offset = np.where(symbol == 0, back, -1), np.zeros(len(symbol), np.int64)
        todo = np.flatnonzero(symbol)
        at, steps = back[todo], 1
        while len(todo):
            s, b = self.before(at)
            done = s == 0
            sequence[todo[done]], offset[todo[done]] = b[done], steps
            todo, at, steps = todo[~done], b[~done], steps + 1
        return sequence, offset

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all suffixes of the intervals: number of the interval, sequence, offset in it."""
        which, rows = _rows(lo, hi)
        return which, *self.walk(*self.before(rows))


def _rows(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of intervals, with the number of the interval."""
    counts = hi - lo
    which = np.repeat(np.arange(len(lo)), counts)
    return which, lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


#: Located matches that are worked off at a time.
_BLOCK = 1_000_000


def maximal_matches(index: FullTextIndex, flat: np.ndarray, lengths: np.ndarray, least: int):
    """Streams sequences through backward search; yields (sequence, offset, length, indexed sequence, its offset) of matches.

    From each end position the interval is lengthened to the left as long as it
    holds a suffix. A suffix is given out at the length at which the symbol before
    it differs from the streamed one, so each match of `least` symbols or more is
    as long as can be to the left; of those with one start the longest is maximal.
    """
    own = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    end = np.flatnonzero(place >= least - 1)
    lo, hi = index.search(flat[end])
    for k in range(1, least):
        lo, hi = index.step(lo, hi, flat[end - k])
        some = hi > lo
        end, lo, hi = end[some], lo[some], hi[some]
    length = least
    while len(end):
        more = place[end] >= length
        prev = np.where(more, flat[np.where(more, end - length, 0)], -1)
        counts, at = np.cumsum(hi - lo), 0
        while at < len(end):
            stop = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + _BLOCK, side="right")))
            which, rows = _rows(lo[at:stop], hi[at:stop])
            symbol, back = index.before(rows)
            out = symbol != prev[at:stop][which]
            sequence, offset = index.walk(symbol[out], back[out])
            e = end[at:stop][which[out]]
            yield own[e], place[e] - length + 1, np.full(len(e), length), sequence, offset
            at = stop
        end, lo, hi, prev = end[more], lo[more], hi[more], prev[more]
        lo, hi = index.step(lo, hi, prev)
        some = hi > lo
        end, lo, hi, length = end[some], lo[some], hi[some], length + 1


def lost_rate(threshold: float, words: int) -> float:
    """Seeds of `words` neighbouring words that a set of n words loses at most to one of that similarity, by n.

    A word of its own breaks as many seeds as it has words, a word the other has
    between breaks one less; n words allow a own and b foreign ones with
    a + threshold b <= (1 - threshold) n.
    """
    return max(words, (words - 1) / threshold) * (1 - threshold)


def shortest_set(threshold: float, words: int) -> int:
    """The size from which on every set has a seed of `words` words left that it shares with any set of that similarity."""
    rate = lost_rate(threshold, words)
    if rate >= 1:
        return 1 << 31
    enough = math.ceil((words + 1) / (1 - rate)) + 1
    return 1 + max((n for n in range(1, enough) if math.floor(rate * n + 1e-9) + 1 > n - words + 1), default=0)


def _pieces(owner: np.ndarray, pos: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds that follow each other in a set as one sequence: (symbols of all, lengths, owners, first positions)."""
    order = np.lexsort((pos, owner))
    owner, pos, words = owner[order], pos[order], words[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (pos[1:] != pos[:-1] + 1)
    take = np.zeros(words.shape, bool)
    take[:, -1] = True
    take[new] = True
    lengths = np.add.reduceat(take.sum(1), np.flatnonzero(new)) if len(owner) else np.empty(0, np.int64)
    return words[take], lengths, owner[new], pos[new]


def matches_in_shard(shard: dict[str, np.ndarray], words: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared seeds) of the pairs of sets, a < b by number, that match in a shard and that sizes and bitmaps allow to be similar.

    `shard` holds per seed set_id, n, b0, b1, lo, hi (lowest and highest split of
    the set), pos, block and mixed; `words` the symbols of the seeds, one row each.
    For each split its sets are indexed and those with a higher split streamed.
    Nothing is left out however often a seed occurs.
    """
    ids, once, me = np.unique(shard["set_id"], return_index=True, return_inverse=True)
    n, lo, hi, block, mixed = (shard[c][once].astype(np.int64) for c in ("n", "lo", "hi", "block", "mixed"))
    b0, b1 = shard["b0"][once].astype(np.uint64), shard["b1"][once].astype(np.uint64)
    flat, lengths, owner, begin = _pieces(me, shard["pos"].astype(np.int64), words)
    flat = np.unique(flat, return_inverse=True)[1] + 1
    of = np.repeat(np.arange(len(lengths)), lengths)
    found = []
    for split in np.unique(lo):
        held, other = lo[owner] == split, hi[owner] > split
        if not other.any():
            continue
        index = FullTextIndex.of(flat[held[of]], lengths[held])
        e_owner, e_begin, t_owner, t_begin = owner[held], begin[held], owner[other], begin[other]
        for seq, off, length, hit, place in maximal_matches(index, flat[other[of]], lengths[other], words.shape[1]):
            t, e = t_owner[seq], e_owner[hit]
            small, large = np.minimum(n[t], n[e]), np.maximum(n[t], n[e])
            # Words not in common are at most (1 - t) / (1 + t) of both sizes together.
            most = np.floor((1 - threshold) / (1 + threshold) * (n[t] + n[e]) + 1e-9)
            apart = np.bitwise_count(b0[t] ^ b0[e]).astype(np.int64) + np.bitwise_count(b1[t] ^ b1[e])
            keep = (t != e) & (small >= threshold * large - 1e-9) & (apart <= most) & ((mixed[t] == 0) | (block[t] != block[e]))
            t, e, length = t[keep], e[keep], length[keep]
            start = np.where(t < e, (t_begin[seq] + off)[keep], (e_begin[hit] + place)[keep])
            found.append(np.stack([np.minimum(t, e), np.maximum(t, e), start, length - words.shape[1] + 1]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    a, b, start, seeds = np.concatenate(found, 1)
    # Matches with one start are spans of the longest; a pair met from both sides counts once.
    order = np.lexsort((-seeds, start, b, a))
    a, b, start, seeds = a[order], b[order], start[order], seeds[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (start[1:] != start[:-1])
    a, b, seeds = a[fresh], b[fresh], seeds[fresh]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return ids[a[new]], ids[b[new]], np.add.reduceat(seeds, np.flatnonzero(new)) if len(a) else seeds


_SENT = ("set_id", "n", "b0", "b1", "lo", "hi", "pos", "block", "mixed")


def _shard(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        of = table.column("seed").to_numpy()
        parts = []
        for words in np.unique(of):
            part = table.filter(pa.array(of == words))
            flat = part.column("words").combine_chunks().flatten().to_numpy().reshape(-1, words)
            parts.append((words, *matches_in_shard({c: part.column(c).to_numpy() for c in _SENT}, flat, threshold)))
        a, b, seeds = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3))
        return pa.table({"a": a, "b": b, "seed": np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts]), "seeds": seeds})

    return run


def _slices(k: int):
    return lambda i: F.struct(F.slice("words", i, k).alias("words"), F.element_at("sets", i).alias("most"))


def _seeds(ordered: DataFrame, threshold: float) -> DataFrame:
    """Of each set the seeds among which those shared with a similar set must be: seed (its number of words), pos, words, key, most.

    `most` is the number of sets that have the seed's rarest word. Longer seeds are for sets that are sure to keep one; smaller sets and those that
    can be like them have shorter ones.
    """
    least = {k: shortest_set(threshold, k) for k in range(1, SEED + 1)}
    parts = []
    for k in range(1, SEED + 1):
        to = (least[k + 1] - 1) / threshold if k < SEED and least[k + 1] < 1 << 31 else math.inf
        if k < SEED and least[k] > to:
            continue
        fits = (F.col("n") >= least[k]) & (F.col("n") <= to if to < math.inf else F.lit(True))
        many = F.least(F.col("n") - (k - 1), F.floor(F.col("n") * lost_rate(threshold, k) + 1e-9).cast("int") + COMMON)
        grams = F.transform(F.sequence(F.lit(1), many), _slices(k))
        parts.append(ordered.where(fits).select("set_id", "n", "b0", "b1", "lo", "hi", F.lit(k).alias("seed"), F.posexplode(grams).alias("pos", "g")).select("*", "g.words", "g.most").drop("g"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("key", F.xxhash64("words"))


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, shard_sets: int = SHARD_SETS, hot: int = HOT) -> DataFrame:
    """a, b, similarity of all pairs of different sets (set_id, words) whose words share at least `threshold` of their union.

    With columns lo and hi (lowest and highest split of a set) only pairs with
    members in different splits count. Every set is written as a sequence in one
    order, rarest word first (counted over all sets). What two similar sets have in
    common lies in few runs, as only a foreign word ends one, so they share runs of
    `SEED` words, and some of these among the first of each (see lost_rate()): no
    pair is lost. These runs are dealt to shards by hash; those that follow each other
    in a shard are one sequence. In a shard each split's sequences are indexed and
    the others streamed through backward search to maximal matches, whose spans are
    merged and counted per pair. What has enough of them, and sizes and bitmaps
    allow, is then counted exactly.

    The number of shards follows the number of sets. The sets of a run that more
    than `hot` have are dealt to blocks, and each pair of blocks is a shard of its
    own. Symbols are 32 bits of a word's hash: two words with one symbol can only
    add a candidate.
    """
    require_columns(sets, "set_id", "words")
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold must be in [0.5, 1)")
    splits = [F.col(c).cast("int") for c in ("lo", "hi")] if {"lo", "hi"} <= set(sets.columns) else [F.lit(0), F.lit(1)]
    long = sets.select("set_id", splits[0].alias("lo"), splits[1].alias("hi"), F.explode("words").alias("word")).select("set_id", "lo", "hi", F.xxhash64("word").alias("w"))
    counts = long.groupBy("w").agg(F.count(F.lit(1)).alias("m"))
    bit = F.expr("shiftleft(1L, cast(w & 63 as int))")
    half = lambda h: F.bit_or(F.when(F.col("w").bitwiseAND(64) == h, bit).otherwise(F.lit(0).cast("long")))
    ordered = long.join(counts, "w").groupBy("set_id").agg(
        F.sort_array(F.collect_list(F.struct("m", "w"))).alias("x"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), half(0).alias("b0"), half(64).alias("b1"))
    # A smaller set is like no different one.
    ordered = ordered.select("set_id", "lo", "hi", "b0", "b1", F.size("x").alias("n"), F.col("x.w").alias("words"), F.col("x.m").alias("sets")).where(F.col("n") >= math.ceil(threshold / (1 - threshold) - 1e-9))
    ordered = durable(ordered, "word-sets")
    seeds = _seeds(ordered.withColumn("words", F.transform("words", lambda w: w.bitwiseAND(0x7FFFFFFF).cast("int"))), threshold)
    # No more sets share a seed than have its rarest word, so only seeds of words in many sets are counted and can be dealt.
    wide = seeds.where(F.col("most") > hot)
    full = wide.groupBy("key").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") > hot)
    dealt = seeds.where(F.col("most") <= hot).withColumn("shared", F.lit(1).cast("long")).unionByName(wide.join(full, "key", "left"), allowMissingColumns=True)
    shards = max(1, math.ceil(ordered.count() / shard_sets))
    dealt = dealt.withColumn("blocks", F.ceil(F.coalesce("shared", F.lit(1)) / hot).cast("long")).withColumn("block", F.pmod(F.xxhash64("set_id", "key"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    alone = F.pmod("key", F.lit(shards)).cast("long")
    paired = -1 - F.shiftrightunsigned(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")), 1)
    sent = dealt.select(F.when(F.col("blocks") == 1, alone).otherwise(paired).alias("shard"), "set_id", "n", "b0", "b1", "lo", "hi", "pos", "block", (F.col("block") != F.col("other")).cast("int").alias("mixed"), "seed", "words")
    hits = spread(sent, shards, "shard").groupBy("shard").applyInArrow(_shard(threshold), "a long, b long, seed int, seeds long")
    found = hits.groupBy("a", "b", "seed").agg(F.sum("seeds").alias("seeds"))
    side = lambda k: ordered.select(F.col("set_id").alias(k), F.col("words").alias(f"w_{k}"), F.col("n").alias(f"n_{k}"))
    kept = F.create_map(*[x for k in range(1, SEED + 1) for x in (F.lit(k), F.lit(lost_rate(threshold, k)))])
    left = lambda n: n - F.col("seed") + 1 - F.floor(n * kept[F.col("seed")] + 1e-9)
    enough = F.col("seeds") >= F.least(F.lit(COMMON), left(F.col("n_a")), left(F.col("n_b")))
    both = found.join(side("a"), "a").join(side("b"), "b").where(enough)
    shared = F.size(F.array_intersect("w_a", "w_b"))
    exact = both.select("a", "b", (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity"))
    return exact.where(F.col("similarity") >= threshold - 1e-12).distinct()


def cross_fold_classes(records: DataFrame) -> DataFrame:
    """row_id, fold, source, set_id, words: records with a fold and words; equal word sets share the set_id (their smallest row_id)."""
    require_columns(records, "row_id", "fold", "source", "family_summary")
    rows = with_word_set(records.where("fold is not null and family_summary is not null").select("row_id", "fold", "source", "family_summary"), "family_summary", "words")
    rows = rows.select("row_id", "fold", "source", F.sort_array("words").alias("words"))
    # The filter comes after the written table: before it, it would be pushed down and the words be made twice.
    rows = durable(rows.withColumn("digest", F.unhex(F.md5(F.array_join("words", " ")))), "summaries").where(F.size("words") > 0)
    ids = rows.groupBy("digest").agg(F.min("row_id").alias("set_id"))
    return rows.join(ids, "digest").drop("digest")


def cross_fold_links(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (row_id, fold, source, set_id) and links (a, b, similarity) between sets, each with itself included.

    Copies are one set; they meet only where pairs of rows are asked for.
    """
    member = durable(cross_fold_classes(records), "members")
    splits = member.groupBy("set_id").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    sets = member.where("row_id = set_id").select("set_id", "words").join(splits, "set_id")
    near = similar_sets(sets, threshold)
    # A set with itself counts where its copies lie in different folds.
    same = member.groupBy("set_id").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo <> hi").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("similarity"))
    return member.drop("words"), durable(near.unionByName(same), "links")


def cross_fold_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row_id_a, row_id_b, fold_a, fold_b, source_a, source_b, similarity of the records of different folds that are the same or nearly so.

    Null folds, null and blank summaries and those without a word take no part;
    records of equal words have similarity 1.
    """
    member, links = cross_fold_links(records, threshold)
    side = lambda s, k: member.select(F.col("set_id").alias(k), *[F.col(c).alias(f"{c}_{s}") for c in ("row_id", "fold", "source")])
    both = links.join(side("x", "a"), "a").join(side("y", "b"), "b").where("fold_x <> fold_y and (a <> b or row_id_x < row_id_y)")
    turned = F.col("row_id_x") > F.col("row_id_y")
    return both.select(
        *[F.when(turned, F.col(f"{c}_{q}")).otherwise(F.col(f"{c}_{p}")).alias(f"{c}_{s}") for c in ("row_id", "fold", "source") for s, p, q in (("a", "x", "y"), ("b", "y", "x"))],
        "similarity",
    )


def overlap_report(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """fold, source, n_records with a like in another fold, n_same with an equal one; counted from sets, without row pairs.

    For every set the folds it and its likes occur in are gathered first (at most as
    many as there are folds), then each record looks whether one of them isn't its own.
    """
    member, links = cross_fold_links(records, threshold)
    folds = member.groupBy("set_id").agg(F.collect_set("fold").alias("folds"))
    both = links.select("a", "b").union(links.where("a <> b").select(F.col("b"), F.col("a")))
    near = both.join(folds.withColumnRenamed("set_id", "b"), "b").select("a", F.explode("folds").alias("f")).groupBy("a").agg(F.collect_set("f").alias("near"))
    rows = member.join(near.withColumnRenamed("a", "set_id"), "set_id").join(folds, "set_id")
    other = lambda c: F.exists(c, lambda x: x != F.col("fold"))
    return rows.groupBy("fold", "source").agg(F.count_if(other("near")).alias("n_records"), F.count_if(other("folds")).alias("n_same")).where("n_records > 0")
