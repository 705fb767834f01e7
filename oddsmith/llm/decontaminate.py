"""Benchmark decontamination: SimHash windows of item size, multi-index Hamming blocks.

Windows as long as an item slide over each text at every place. Those that hold
too few shingles of the benchmark to reach the threshold, whatever their order,
are left out; that is exact. A window's fingerprint has 256 bits and counts only
shingles that the benchmark has, so that unrelated words between copied ones do
not move it. Fingerprints are cut into 16 blocks of 16 bits. Two that differ by
RADIUS bits or fewer differ by NEAR or fewer in some block (pigeonhole), so
items are indexed under every block value within NEAR bits of their own, and an
equi-join on (size, block, value) finds them all; random pairs meet in 3 of 100
cases. Then the exact weighted similarity of the shingles decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, cut, let, small

K = 5
THRESHOLD = 0.75
WORDS, BLOCK_BITS = 4, 16  # longs of a fingerprint; bits of a block
BLOCKS = WORDS * 64 // BLOCK_BITS
NEAR = 2  # bits of a block that may differ
RADIUS = BLOCKS * (NEAR + 1) - 1  # 47; at similarity 0.75 between random words the expected distance is 32, its deviation 5
MAX_BITS = 1 << 23  # of the bitmap of benchmark shingles: 1 MB
ROW_BYTES = 100  # of a row of the fingerprint index in a broadcast table
LANE = 65_535  # shingles that a lane of 16 bits can count


def normal_words(text: Column) -> Column:
    """Runs of letters and digits in lower case: case, punctuation and mark-up noise do not hide a copy."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles, in order. The words are bound to a lambda
    variable: the optimizer would put the split into the lambda over them."""
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - K + 1), lambda i: F.xxhash64(F.slice(w, i, K)))
    return let(normal_words(text), lambda w: F.when(F.size(w) >= K, hashes(w)).otherwise(F.array().cast("array<bigint>")))


def _majority(x: str, width: int) -> str:
    """SQL of a long: each bit is 1 if more than half of the elements of the array named x have it.
    Sum j counts, in lanes of `width` bits, the bits j, j + width and so on."""
    lanes, lane = sum(1 << k for k in range(0, 64, width)), (1 << width) - 1
    sums = ", ".join(f"aggregate({x}, 0L, (a, h) -> a + (shiftrightunsigned(h, {j}) & {lanes}L))" for j in range(width))
    one = lambda n: "(-9223372036854775807L - 1L)" if n == 63 else f"{1 << n}L"
    bits = " | ".join(f"if(2 * (shiftrightunsigned(s[{n % width}], {n - n % width}) & {lane}L) > size({x}), {one(n)}, 0L)" for n in range(64))
    return f"transform(array(array({sums})), s -> {bits})[0]"


def simhash(w: str) -> Column:
    """array of WORDS longs: the 256-bit SimHash of the array<long> that the SQL expression w gives. Lanes of
    16 bits count up to LANE shingles; longer windows take lanes of 32, which no array overflows."""
    word = lambda r: f"transform(array({f'transform(w, h -> xxhash64(h, {r}))' if r else 'w'}), x -> if(size(x) <= {LANE}, {_majority('x', 16)}, {_majority('x', 32)}))[0]"
    return F.expr(f"transform(array({w}), w -> array({', '.join(map(word, range(WORDS)))}))[0]")


def distance(f: Column, g: Column) -> Column:
    return sum((F.bit_count(F.get(f, F.lit(r)).bitwiseXOR(F.get(g, F.lit(r)))) for r in range(1, WORDS)), F.bit_count(F.get(f, F.lit(0)).bitwiseXOR(F.get(g, F.lit(0)))))


def blocks(f: Column) -> Column:
    return F.array(*(F.shiftrightunsigned(F.get(f, F.lit(b * BLOCK_BITS // 64)), b * BLOCK_BITS % 64).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for b in range(BLOCKS)))


def _masks() -> list[int]:
    return [sum(1 << b for b in c) for k in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), k)]


def _tagged(w: Column) -> Column:
    """w without repeats: the k-th occurrence of a shingle gets a hash of its own, so that
    sets of these intersect as multisets of shingles do. Linear but for the sort."""
    runs = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    again = lambda s, a, i: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(a, i + 1), F.size(s)) - F.get(a, i) - 1), lambda k: F.when(k == 0, F.get(s, F.get(a, i))).otherwise(F.xxhash64(F.get(s, F.get(a, i)), k)))
    spread = lambda s: let(runs(s), lambda a: F.flatten(F.transform(a, lambda _, i: again(s, a, i))))
    return F.when(F.size(F.array_distinct(w)) == F.size(w), w).otherwise(let(F.sort_array(w), spread))


def _bitmap(hashes: DataFrame, n: int):
    """A test whether a hash is among `hashes` (h), by a bitmap as a literal of bounded size; it may
    only let too many pass, so larger benchmarks lose speed alone."""
    bits = 1 << 16
    while bits < min(MAX_BITS, 16 * n):
        bits *= 2
    h = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.groupBy(F.shiftright(h, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63L as int))")).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    word = lambda h: F.get(table, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
    return lambda h: F.call_function("shiftrightunsigned", word(h), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _least(size: Column, other: Column, percent: int) -> Column:
    """Shingles that two windows of these sizes must share to reach the threshold."""
    return F.floor((percent * (size + other) + (99 + percent)) / (100 + percent)).cast("int")


def _starts(p: Column, n: Column, m: Column, percent: int) -> Column:
    """Ascending ranges (array of arrays) of all starts of windows of m in n shingles that hold enough of
    the places p, which ascend. A window whose first place is p[j] holds enough if p[j + need - 1]
    lies in it too. A text shorter than m is one window."""
    need = _least(m, m, percent)
    low = lambda j: F.greatest(F.coalesce(F.get(p, j - 1) + 1, F.lit(0)), F.get(p, j + need - 1) - m + 1, F.lit(0))
    high = lambda j: F.least(F.get(p, j), n - m)
    none = F.array().cast("array<int>")
    ranges = F.transform(F.sequence(F.lit(0), F.size(p) - need), lambda j: F.when(low(j) <= high(j), F.sequence(low(j), high(j))).otherwise(none))
    short = F.when(F.size(p) >= _least(n, m, percent), F.array(F.array(F.lit(0)))).otherwise(F.array(none))
    return F.when(n < m, short).when(F.size(p) >= need, ranges).otherwise(F.array(none))


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start_word, n_words): the best window of each document and item.

    A text and an item are compared by the five-word shingles of their letters
    and digits in lower case, in any order; a shingle weighs as often as it occurs. Items and texts of fewer than
    five words, null or empty ones match nothing; null ids are dropped. Repeated rows count once, the rows of one
    doc_id are one document, other columns are ignored. Of equally similar windows the one of least distance, then the first, is named. Very long texts are
    handled by pieces of twice an item's length.
    """
    percent = round(100 * threshold)
    items = benchmark.where("item_id is not null").select("item_id", shingles(F.col("text")).alias("s"))
    items = cut(items.where("size(s) > 0").distinct().withColumn("m", F.size("s")))
    hashes = items.select("m", F.explode("s").alias("h")).distinct()
    n = hashes.count()
    held = _bitmap(hashes.select("h").distinct(), n)  # shingles of any item
    own = _bitmap(hashes.select(F.xxhash64("h", "m").alias("h")), n)  # shingles of items of one size
    sizes = F.expr("cast(array(" + ", ".join(str(r["m"]) for r in items.select("m").distinct().orderBy("m").collect()) + ") as array<int>)")  # as many as the longest item has words at most
    places = lambda s: F.filter(F.transform(s, lambda h, i: F.when(held(h), i)), lambda i: i.isNotNull())
    of_size = lambda s, p, m: F.filter(p, lambda i: own(F.xxhash64(F.get(s, i), m)))

    # Pieces of a text: the starts from one multiple of m to the next, with all shingles that their windows reach.
    def pieces(s, p):
        of = lambda m, g: F.struct(m.alias("m"), (g * m).alias("base"), F.slice(s, g * m + 1, 2 * m - 1).alias("seg"))
        starts = lambda m: let(of_size(s, p, m), lambda q: _starts(q, F.size(s), m, percent))
        parts = lambda m: F.array_distinct(F.flatten(F.transform(starts(m), lambda r: F.transform(r, lambda i: F.floor(i / m).cast("int")))))
        return F.flatten(F.transform(sizes, lambda m: F.transform(parts(m), lambda g: of(m, g))))

    found = let(shingles(F.col("text")), lambda s: let(places(s), lambda p: pieces(s, p)))
    laid = documents.where("doc_id is not null").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    laid = cut(laid.withColumns({"k1": F.xxhash64("m", "seg"), "k2": F.xxhash64(F.lit(7), "seg")}))
    # Copies of a piece are looked up once.
    segs = laid.groupBy("m", "k1", "k2").agg(F.first("seg").alias("seg"))
    inside = lambda p: F.filter(F.flatten(_starts(p, F.size("seg"), F.col("m"), percent)), lambda i: i < F.col("m"))
    every = F.sequence(F.lit(0), F.size("seg") - 1)
    windows = segs.select("m", "k1", "k2", "seg", F.explode(let(of_size(F.col("seg"), every, F.col("m")), inside)).alias("at"))
    # Fingerprint and similarity depend on the shingles that items have and on the size alone: equal ones are looked up once.
    known = F.filter(F.slice("seg", F.col("at") + 1, F.col("m")), lambda h: own(F.xxhash64(h, "m")))
    windows = windows.select("m", "k1", "k2", "at", F.least(F.size("seg"), "m").alias("n"), known.alias("known"))
    windows = cut(windows.withColumns({"w1": F.xxhash64("m", "n", "known"), "w2": F.xxhash64(F.lit(7), "n", "known")}))
    lookup = cut(windows.groupBy("m", "w1", "w2").agg(F.first("n").alias("n"), F.first("known").alias("known")))
    lookup = lookup.withColumn("f", simhash("known"))
    mine = lookup.select("m", "w1", "w2", "n", "known", "f", F.posexplode(blocks(F.col("f"))).alias("block", "bits"))
    items = cut(items.withColumn("g", simhash("s")).withColumn("s", _tagged(F.col("s"))).withColumn("item", F.xxhash64("item_id", "s")))
    masks = F.expr("array(" + ", ".join(f"{k}L" for k in _masks()) + ")")
    near = F.transform(blocks(F.col("g")), lambda v: F.transform(masks, lambda k: v.bitwiseXOR(k)))
    index = items.select("m", "item", F.posexplode(near).alias("block", "values")).select("m", "item", "block", F.explode("values").alias("bits"))
    bound = F.broadcast if items.count() * BLOCKS * len(_masks()) * ROW_BYTES <= MAX_BROADCAST_BYTES else lambda x: x.hint("merge")  # its size, which Spark would take for that of the items
    met = mine.join(bound(index), ["m", "block", "bits"]).join(small(items.select("item", "item_id", "s", "g")), "item")
    met = met.withColumn("distance", distance(F.col("f"), F.col("g"))).where(F.col("distance") <= RADIUS)
    # A pair counts at the first block in which it is near.
    first = F.array_position(F.zip_with(blocks(F.col("f")), blocks(F.col("g")), lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= NEAR), True) - 1
    both = F.size(F.array_intersect(_tagged(F.col("known")), F.col("s")))
    similarity = both.cast("double") / (F.col("n") + F.size("s") - both)
    met = met.where(F.col("block") == first).withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    met = cut(met.select("m", "w1", "w2", "item_id", "similarity", "distance").distinct())
    rank = lambda at: F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col(at)).alias("s"), "n")
    best = windows.select("m", "k1", "k2", "at", "n", "w1", "w2").join(small(met), ["m", "w1", "w2"])
    best = cut(best.groupBy("m", "k1", "k2", "item_id").agg(F.max(rank("at")).alias("x")))
    back = laid.select("doc_id", "m", "base", "k1", "k2").join(small(best), ["m", "k1", "k2"])
    back = back.select("doc_id", "item_id", "x.similarity", (-F.col("x.d")).alias("distance"), (F.col("base") - F.col("x.s")).alias("start"), "x.n")
    best = back.groupBy("doc_id", "item_id").agg(F.max(rank("start")).alias("x"))
    return best.select("doc_id", "item_id", F.round("x.similarity", 6).alias("similarity"), (-F.col("x.d")).alias("distance"), (-F.col("x.s")).cast("long").alias("start_word"), (F.col("x.n") + K - 1).cast("long").alias("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark item. Rows with a null doc_id are not searched and stay; columns stay as they are."""
    found = cut(contaminated(documents, benchmark).select("doc_id").distinct())
    return documents.join(small(found), "doc_id", "left_anti")
