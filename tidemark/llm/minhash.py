"""MinHash bands over word shingles, and exact links between the sets that collide.

Keys that few sets share are compared pair by pair. Those that many share, such as that of a template and its edited
copies, are split without losing a pair, whatever other keys their sets have. With |x ^ y| for the shingles that only one
of two sets has, sets are similar where 9 |x ^ y| <= |x| + |y|. Let c be any set of shingles, and a the member of the group with the least
9 |a ^ c| - |a|. Then of two similar members x and y

- either x ^ c and y ^ c have a shingle in common,
- or |x ^ y| = |x ^ c| + |y ^ c|, from which 9 |x ^ a| <= 9 |x ^ c| + 9 |a ^ c| <= |x| + |a| follows, and the same for y:
  both are similar to a, and linked by it.

So members are linked to a, and those that may have another link besides meet under the shingles of their differences
from c. There the common shingles of the group have gone: c holds what most of a sample of the members have, which
only decides how fast groups shrink, never what is found. Of the differences, a prefix in one order is enough: if
|x ^ c| <= |y ^ c|, at most |x ^ y| / 2 of x's are not y's, and at most |x ^ y| of y's are not x's. Groups that are
still large are split again. Those that one task can hold, by sets and by shingles, are not split: all their pairs are
compared there, which takes one shuffle where splitting takes a dozen a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, release, stored, trim

SHINGLE, SIMILARITY = 5, 0.8
#: SIMILARITY in whole numbers: sets of |x| + |y| shingles are similar where at most a ninth of them is not shared.
PARTS = 9
#: Twelve bands of four rows: a pair of similarity 0.8 shares a key with probability 0.998, one of 0.3 with 0.09.
BANDS, ROWS = 12, 4
#: Up to so many sets of one key are compared with each other, and up to so many of one shingle of the differences, where fewer
#: pairs remain; larger groups are compared in one task each or split.
PAIRED, PAIRED_AGAIN = 32, 64
#: Groups of up to so many sets, with up to so many shingles in all, are compared in one task; beyond either they are split.
#: It changes the work, not the result.
HELD, HELD_SHINGLES = 2048, 1 << 21
#: Shingles of up to so many sets of a held group are counted pair by pair, the others by matrix products.
RARE = 8
#: About so many members of a group choose what its centre holds.
SAMPLED = 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` values."""
    made, done, powers = {1: values}, 1, {1: _BASE}
    while 2 * done <= length:
        made[2 * done] = made[done][: len(made[done]) - done] * powers[done] + made[done][done:]
        powers[2 * done] = np.uint64(pow(int(powers[done]), 2, 1 << 64))
        done *= 2
    out, at = made[done], done
    for size in sorted((s for s in made if s & (length - done)), reverse=True):
        n = len(values) - at - size + 1
        out = out[:n] * powers[size] + made[size][at : at + n]
        at += size
    return mixed(out)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The band keys of each of the sets whose hashes follow each other, counts[i] of them, none of 0."""
    starts = np.cumsum(counts) - counts
    rows = [np.minimum.reduceat(mixed(hashes * a + b), starts) for a, b in zip(_FACTORS, _OFFSETS, strict=True)]
    keys = np.zeros((len(counts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        keys[:, band] = band
        for row in rows[band * ROWS : (band + 1) * ROWS]:
            keys[:, band] = keys[:, band] * _BASE + row
    return mixed(keys).view(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def word_shingles(words: str) -> Column:
    """The sorted distinct hashes of SHINGLE words each of a column of 32-bit word hashes, as bytes; of fewer words, of them all."""
    starts = f"sequence(0, greatest(0, octet_length({words}) div 4 - {SHINGLE}))"
    return F.expr(f"array_sort(array_distinct(transform({starts}, i -> xxhash64(substring({words}, 4 * i + 1, {4 * SHINGLE})))))")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of sets that are similar."""
    named = pairs.join(sets.select(F.col("hash").alias("a"), F.col("shingles").alias("x")), "a")
    named = named.join(sets.select(F.col("hash").alias("b"), F.col("shingles").alias("y")), "b")
    alone = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    return named.where(PARTS * alone <= F.size("x") + F.size("y")).select("a", "b")


def _pairs(members: DataFrame, *kept: str, where: str = "true") -> DataFrame:
    """The distinct pairs (a, b) of the hashes of a key, under a condition on the columns l_ and r_ of those kept."""
    left, right = (members.select("key", F.col("hash").alias(end), *[F.col(c).alias(f"{side}_{c}") for c in kept]) for end, side in ("al", "br"))
    return left.join(right, "key").where(f"a < b AND ({where})").select("a", "b").distinct()


def _common(owners: np.ndarray, shingles: np.ndarray, m: int) -> np.ndarray:
    """How many shingles the sets a < b of 0 to m - 1 have in common, at [a, b]; owners ascend."""
    _, ids, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    found = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    by_shingle, firsts = owners[order], np.cumsum(counts) - counts
    for size in range(2, RARE + 1):
        sets = by_shingle[firsts[counts == size][:, None] + np.arange(size)]
        for a in range(size):
            for b in range(a + 1, size):
                np.add.at(found, (sets[:, a], sets[:, b]), 1)
    often = np.cumsum(counts > RARE) - 1
    kept = counts[ids] > RARE
    rows, columns = owners[kept], often[ids[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, 1024):
        cut = slice(*np.searchsorted(columns, (start, start + 1024)))
        block = np.zeros((m, 1024), dtype=np.float32)
        block[rows[cut], columns[cut] - start] = 1
        found += block @ block.T
    return found


def _spanning(table: pa.Table) -> pa.Table:
    """Links (a, b) of similar sets that connect the same sets of one group as all its links do."""
    hashes, lists = table["hash"].combine_chunks().to_numpy(), table["shingles"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    m = len(hashes)
    total = (sizes[:, None] + sizes[None, :]).astype(np.float32)
    alone = _common(np.repeat(np.arange(m), sizes), lists.flatten().to_numpy(), m)
    alone *= -2
    alone += total
    alone *= PARTS
    similar = np.triu(alone <= total, 1)
    similar |= similar.T
    left, a, b = similar.any(axis=1), [], []
    for first in np.flatnonzero(left).tolist():
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            own = todo.pop()
            met = np.flatnonzero(similar[own] & left)
            left[met] = False
            a.append(np.full(len(met), hashes[own]))
            b.append(hashes[met])
            todo += met.tolist()
    none = np.zeros(0, dtype=np.int64)
    del total, alone, similar, lists
    trim()
    return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})


def _held(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect the sets of each key as all links of its sets do."""
    return members.select("key", "hash").join(sets, "hash").groupBy("key").applyInArrow(_spanning, "a long, b long")


def _grouped(waiting: DataFrame) -> DataFrame:
    """g, g_size, hash, n, label: the keys as groups, those of one parent and one leader merged.

    The leader is a key's most frequent set. At first all its keys become one group. Later ones do if the group is smaller than
    the one it comes from (parent_size; null at first), so that groups shrink at every round, and either has hardly more
    members than its largest key or has each of them under four keys.
    """
    leaders = waiting.groupBy("key").agg(F.max(F.struct("n", "hash"))["hash"].alias("leader"))
    led = checkpoint(waiting.join(leaders, "key").withColumn("merged", F.xxhash64("parent", "leader")))
    sizes = led.groupBy("merged", "parent_size").agg(F.count_distinct("hash").alias("m"), F.count("*").alias("rows"), F.max("k").alias("k"))
    sizes = sizes.select("merged", F.expr("parent_size IS NULL OR 4 * m <= 3 * parent_size AND (4 * m <= 5 * k OR rows >= 4 * m)").alias("alike"))
    chosen = led.join(sizes, "merged").select(F.when(F.col("alike"), F.col("merged")).otherwise(F.col("key")).alias("g"), "hash", "n", "label")
    rows = checkpoint(chosen.groupBy("g", "hash").agg(F.max("n").alias("n"), F.min("label").alias("label")))
    return rows.join(rows.groupBy("g").agg(F.count("*").alias("g_size")), "g")


def _measured(groups: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """groups with size |x|, d = |x ^ c| and the first |x| / 4 + 1 shingles of x ^ c: those that c lacks, then those of c."""
    chosen = groups.where(F.expr(f"pmod(xxhash64(hash, g, {turn}), greatest(1, g_size div {SAMPLED})) = 0"))
    sampled = chosen.join(sets, "hash").select("g", F.explode("shingles").alias("shingle"))
    counted = sampled.groupBy("g", "shingle").agg(F.count("*").alias("k"))
    often = counted.join(chosen.groupBy("g").agg(F.count("*").alias("of")), "g").where("2 * k > of")
    centres = often.groupBy("g").agg(F.sort_array(F.collect_list("shingle")).alias("c"))
    named = groups.join(centres, "g", "left").join(sets, "hash")
    without = F.expr("coalesce(c, slice(shingles, 1, 0))")
    parted = named.withColumn("outside", F.array_except("shingles", without)).withColumn("missing", F.array_except(without, F.col("shingles")))
    first = F.expr("slice(concat(outside, missing), 1, size(shingles) div 4 + 1)")
    return parted.select("g", "g_size", "hash", "n", "label", F.size("shingles").alias("size"), (F.size("outside") + F.size("missing")).alias("d"), first.alias("differ"))


def _split(waiting: DataFrame, sets: DataFrame, turn: int, used: list[str]) -> tuple[DataFrame, DataFrame]:
    """The links of members to their group's a, and the rows under the shingles where further links may be.

    Members of one label are linked already. first is set where a row stands for the set of fewer differences of a pair.
    """
    rows = stored(_measured(_grouped(waiting), sets, turn), used)
    best = rows.groupBy("g").agg(F.min(F.struct((PARTS * F.col("d") - F.col("size")).alias("v"), "hash", "d", "size", "label")).alias("a"))
    named = rows.join(best.select("g", F.col("a.hash").alias("a"), F.col("a.d").alias("a_d"), F.col("a.size").alias("a_size"), F.col("a.label").alias("a_label")), "g")
    may = named.where(f"hash != a AND {PARTS} * abs(d - a_d) <= size + a_size")
    release(sets.sparkSession)
    tied = checkpoint(_verified(may.select("a", F.col("hash").alias("b")).distinct(), sets))
    ties = tied.select("a", F.col("b").alias("hash"), F.lit(True).alias("tied"))
    named = named.join(ties, ["a", "hash"], "left").withColumn("tied", F.expr("hash = a OR coalesce(tied, false)"))
    named = checkpoint(named.withColumn("label", F.expr("if(tied, a_label, label)")))
    open_ = named.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.expr("if(tied, NULL, d)")).alias("open_d"), F.max("size").alias("most")).where("low != high").select("g", "open_d", "most")
    # of a pair, the set of fewer differences needs half the shingles that similar sets of these sizes may have alone, the
    # other twice as many; one that is tied to a only has partners that aren't, which bounds it by its own d
    alone = f"ceil(({PARTS} * (d + a_d) + size - a_size) / {2 * PARTS})"
    both = "(size + least(5 * size div 4, most))"
    half = f"{both} div {2 * PARTS} + 1"
    named = named.join(open_, "g").withColumn("fewer", F.expr(f"if(tied, least({alone}, {half}), {half})"))
    named = checkpoint(named.withColumn("differ", F.expr(f"slice(differ, 1, if(tied AND d < coalesce(open_d, d + 1), greatest(0, cast(fewer AS int)), {both} div {PARTS} + 1))")))
    keyed = named.select("g", "hash", "label", "size", "fewer", F.posexplode("differ").alias("at", "shingle"))
    keyed = keyed.select("g", "hash", "label", "size", F.expr("xxhash64(g, shingle)").alias("key"), F.expr("at < fewer").alias("first"))
    met = keyed.groupBy("key").agg(F.count("*").alias("k"), F.sum("size").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("first").alias("any_first")).where("low != high AND any_first").select("key", "k", "weight")
    rows = keyed.select("g", "hash", "key", "first").join(met, "key").join(named.select("g", "g_size", "hash", "n", "label", "size", "d"), ["g", "hash"])
    return tied, checkpoint(rows)


def similar_links(sets_of: DataFrame, counts: DataFrame, used: list[str], of: str = "shingles", shingles: Column | None = None) -> DataFrame:
    """Edges (a, b) between the hashes of similar sets, by which those that share a key are connected.

    Under every key, whatever its size, all pairs of its sets are looked for.

    sets_of has rows (hash, bands, shingles), equal ones repeated as often as they stand; shingles are distinct and in
    one order. Where the column `of` holds something shorter, `shingles` makes them of it once only the sets wanted are
    left. counts (hash, n) says how often. Only the sets of hashes that share a key with another are kept, by
    one exchange at every size, in which equal sets are one. The edges read the tables that are named in `used`.
    """
    banded = sets_of.select("hash", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low != high").select("key")
    members = stored(banded.join(shared, "key").distinct(), used)
    wanted = stored(members.select("hash").distinct().join(counts, "hash"), used)
    single = sets_of.select("hash", of).dropDuplicates(["hash"]).join(wanted.hint("merge"), "hash", "left_semi")
    sets = stored(single.select("hash", (F.col(of) if shingles is None else shingles).alias("shingles")), used)
    release(sets.sparkSession)
    sizes = members.groupBy("key").agg(F.count("*").alias("k"))
    members = checkpoint(members.join(sizes, "key"))
    release(sets.sparkSession)
    edges = _verified(_pairs(members.where(F.col("k") <= PAIRED)), sets)
    small = f"k <= {HELD} AND weight <= {HELD_SHINGLES}"
    many = checkpoint(members.where(F.col("k") > PAIRED).join(sets.select("hash", F.size("shingles").alias("size")), "hash"))
    many = checkpoint(many.join(many.groupBy("key").agg(F.sum("size").alias("weight")), "key"))
    edges = edges.union(_held(many.where(small), sets))
    waiting = many.where(f"NOT ({small})").join(wanted, "hash")
    waiting = waiting.select("key", "k", "hash", "n", F.col("hash").alias("label"), F.lit(0).cast("long").alias("parent"), F.lit(None).cast("long").alias("parent_size"))
    turn = 0
    near = f"l_label != r_label AND (l_first OR r_first) AND {PARTS} * abs(l_d - r_d) <= l_size + r_size AND 5 * least(l_size, r_size) >= 4 * greatest(l_size, r_size)"
    while waiting.take(1):
        tied, rows = _split(waiting, sets, turn, used)
        few = _pairs(rows.where(F.col("k") <= PAIRED_AGAIN), "label", "first", "d", "size", where=near)
        rows = rows.where(F.col("k") > PAIRED_AGAIN)
        edges = edges.union(tied).union(checkpoint(_verified(few, sets))).union(_held(rows.where(small), sets))
        waiting = rows.where(f"NOT ({small})").select("key", "k", "hash", "n", "label", F.col("g").alias("parent"), F.col("g_size").alias("parent_size"))
        turn += 1
        release(edges.sparkSession)
    return edges
