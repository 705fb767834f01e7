"""N-gram Jaccard join with filters under several global token orders.

Sets are the distinct five-word shingles of a text. Two texts link when
100 * intersection >= percent * union. Equal sets form one class, so copies are
never expanded. If two sets link, then under *any* global token order the first
`n // 4 + 1` tokens of each have one in common. Three orders are used:

* order 1, over all texts: tokens of a fixed hash range by document frequency,
  then the others by hash. A token of one text only fills the prefix but cannot
  be shared; texts whose prefix holds nothing else have no partner and leave.
* order 2, over the texts that stay: all their tokens by (frequency, hash). It
  gives the posting lists; the smaller set of a pair must be found in its still
  shorter prefix of `n // 7 + 1` tokens.
* order 3: by hash alone.

A candidate must pass all three, besides the bounds of size and of tokens that
can be shared at all; then its whole sets are compared. Each posting list is
compared with one centre first. Lists that still span components after that are
gathered by the member of least hash: lists of one passage mostly have the same
one, so that a pair meets once or a few times, not once for each token in common.
Gathered lists are compared by blocks of bounded size, by products of matrices.
That gives the components. Links are counted after it: where some pair of a
component is not a known link, all its pairs of sets are compared, in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, cut, hasher, mix, slices, text_buffer
from .components import components

SAMPLED = int(0.28 * 2**63)  # hashes below this form the range whose frequencies are counted
K = 5
BLOCK, LEAST = 200_000, 100  # tokens of a block of a component, each set counted as LEAST at least
_CELLS_AT_ONCE = 1 << 22


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each row."""
    data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
    h, own = hasher().words(data, at)
    s, own = hasher().shingles(h, own, batch.num_rows, K)
    ends = np.searchsorted(own, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        x = np.sort(s[ends[i] : ends[i + 1]])
        if len(x):
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            x = x[keep]
        yield i, x


def _key(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix(x + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
        b = (mix(x ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64)
    pair = np.array([a, b], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


def _shape(x: np.ndarray) -> tuple[int, int]:
    """Size; tokens in the sampled range."""
    return len(x), int(np.searchsorted(x, np.uint64(SAMPLED)))


def _classes(batches):
    for whole in batches:
        for b in slices(whole):
            rows = [(*_shape(x), *(_key(x) if len(x) else (0, 0))) for _, x in _sets(b)]
            cols = zip(*rows)
            types = [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n", "n_sampled", "k1", "k2"])


def _emit(batches):
    for whole in batches:
        for b in slices(whole):
            seen, tokens, keys = set(), [], []
            for _, x in _sets(b):
                if not len(x):
                    continue
                k = _key(x)
                if k in seen:
                    continue
                seen.add(k)
                n, m = _shape(x)
                x = x[: max(n // 4 + 1, m)]
                tokens.append(x)
                keys.append(np.full(len(x), k[0], np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys))], ["token", "k1"])


def _whole(batches):
    for whole in batches:
        for b in slices(whole):
            sets = [x for _, x in _sets(b)]
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            keys = pa.array([_key(x)[0] for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), keys, pa.ListArray.from_arrays(lengths, np.concatenate(sets).view(np.int64))], ["rep", "k1", "tokens"])


def _sharing(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id): representatives that order 1 leaves with a shared token in the prefix."""
    emitted = docs.mapInArrow(_emit, "token long, k1 long")
    # Cut, so that the files of this count are gone when the join writes its own; joined alike at every size.
    shared = cut(emitted.groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("token"))
    own = emitted.join(shared.hint("merge"), "token").groupBy("k1").agg(F.collect_set("token").alias("t")).join(classes, "k1")
    inside = F.size(F.filter("t", lambda s: s < SAMPLED))
    # When the range holds fewer tokens than the prefix, the prefix is all that was emitted.
    return own.where((F.col("n_sampled") < F.expr("n div 4 + 1")) | (F.expr("n div 4 + 1") > F.col("n_sampled") - inside)).select(F.col("rep").alias("doc_id")).distinct()


def _whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, tokens): whole sets of the texts named; texts themselves are not shuffled."""
    if ids.count() <= MAX_BROADCAST_ROWS:
        sets = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_whole, "rep long, k1 long, tokens array<long>")
    else:
        sets = docs.mapInArrow(_whole, "rep long, k1 long, tokens array<long>").join(ids.withColumnRenamed("doc_id", "rep"), "rep", "left_semi")
    return sets.where("size(tokens) > 0").dropDuplicates(["rep", "k1"]).drop("k1")


def _heads(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, cap, probe, n_index, low): cap: tokens that others have too;
    probe: shared tokens within the order-2 prefix; n_index: how many of them
    count if the other set is the larger; low: shared tokens within the order-3 prefix."""
    tokens = sets.select("rep", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"), F.expr("get(tokens, size(tokens) div 4)").alias("edge"))
    shared = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    own = tokens.join(shared.hint("merge"), "token").groupBy("rep", "n", "edge").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    own = own.withColumn("cap", F.size("t").cast("long")).withColumn("alone", F.col("n") - F.col("cap"))
    own = own.withColumn("room", F.expr(f"n - ({percent} * n + 99) div 100 + 1 - alone")).where("room > 0")
    return own.select(
        "rep", "n", "cap",
        F.transform(F.slice("t", 1, F.col("room").cast("int")), lambda s: s["token"]).alias("probe"),
        F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1 - alone").alias("n_index"),
        F.filter(F.transform("t", lambda s: s["token"]), lambda s: s <= F.col("edge")).alias("low"),
    ).where("size(low) > 0")


def _possible(percent: int):
    """Bounds for rows with n_a, n_b, cap_a and cap_b."""
    return F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * least(cap_a, cap_b) >= {percent} * (n_a + n_b)")


def _verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that pass order 3, then the exact condition on the whole sets."""
    low = lambda s: heads.select(F.col("rep").alias(s), F.col("low").alias(f"low_{s}"))
    pairs = pairs.join(low("a"), "a").join(low("b"), "b").where(F.arrays_overlap("low_a", "low_b")).select("a", "b")
    whole = lambda s: sets.select(F.col("rep").alias(s), F.col("tokens").alias(f"t_{s}"))
    j = pairs.join(whole("a"), "a").join(whole("b"), "b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    return j.where(100 * both >= percent * (F.size("t_a") + F.size("t_b") - both)).select("a", "b")


def _overlaps(ta, ra, na: int, tb, rb, nb: int) -> np.ndarray:
    """Sizes of the intersections of na with nb sets, given as tokens (small integers)
    and rows: a product of matrices for frequent tokens, pairs of rows for the others."""
    m = 1 + max(ta.max(initial=-1), tb.max(initial=-1))
    fa, fb = np.bincount(ta, minlength=m), np.bincount(tb, minlength=m)
    out = np.zeros(na * nb)
    hot = 64 * fa * fb > na * nb
    at = np.where(hot, np.cumsum(hot) - 1, -1)
    step = max(1, _CELLS_AT_ONCE // (na + nb))
    for lo in range(0, int(hot.sum()), step):

        def dense(t, r, n):
            keep = (at[t] >= lo) & (at[t] < lo + step)
            z = np.zeros((n, min(step, int(hot.sum()) - lo)), np.float32)
            z[r[keep], at[t[keep]] - lo] = 1
            return z

        out += (dense(ta, ra, na) @ dense(tb, rb, nb).T).ravel()
    rb = rb[np.argsort(tb, kind="stable")]
    start = np.cumsum(fb) - fb
    cold = ~hot[ta] & (fb[ta] > 0)
    ta, ra = ta[cold], ra[cold]
    part = np.cumsum(fb[ta]) // _CELLS_AT_ONCE
    for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side=x) for x in ("left", "right"))):
        t, k = ta[lo:hi], fb[ta[lo:hi]]
        other = rb[np.repeat(start[t] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        out += np.bincount(np.repeat(ra[lo:hi], k) * nb + other, minlength=na * nb)
    return out.reshape(na, nb)


class _Blocks:
    """Rows (rep, second, tokens) of a pair of blocks, or of one block (second is 0 for all), to be compared with each other."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.rep, second = (table.column(c).to_numpy() for c in ("rep", "second"))
        tokens = pa.concat_arrays(table.column("tokens").chunks)
        self.size = np.diff(tokens.offsets.to_numpy())
        self.tokens = np.unique(tokens.flatten().to_numpy(), return_inverse=True)[1]
        self.a, self.b = np.flatnonzero(second == 0), np.flatnonzero(second == 1)
        self.alone = not len(self.b)
        if self.alone:
            self.b = self.a

    def overlaps(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common tokens of rows a and b, of the first `most` tokens of each row."""
        end = np.cumsum(self.size)
        sides = []
        for rows in (a, b):
            k = most[rows]
            own = np.repeat(np.arange(len(rows)), k)
            sides += [self.tokens[np.repeat((end - self.size)[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum())], own, len(rows)]
        return _overlaps(*sides)

    def linked(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        both = self.overlaps(a, b, self.size)
        return 100 * both >= percent * (self.size[a][:, None] + self.size[b][None, :] - both)


def _block_counts(percent: int):
    """(rep, n_links): the links of each row to the other block; rows of one block only: to the others of that block."""

    def run(table: pa.Table) -> pa.Table:
        x = _Blocks(table)
        linked = x.linked(x.a, x.b, percent)
        if x.alone:
            np.fill_diagonal(linked, False)
        counts = [(x.rep[x.a], linked.sum(1))] + ([] if x.alone else [(x.rep[x.b], linked.sum(0))])
        return pa.table({"rep": np.concatenate([r for r, _ in counts]), "n_links": np.concatenate([n for _, n in counts]).astype(np.int64)})

    return run


def _block_joins(percent: int):
    """(a, b): for each two components that links between the blocks join, one such link. Rows have a component too."""

    def run(table: pa.Table) -> pa.Table:
        x, component = _Blocks(table), table.column("component").to_numpy()
        # Order 3: tokens of a row are sorted by hash. Of the rows that it leaves with a candidate, whole sets are compared.
        fits = x.overlaps(x.a, x.b, x.size // 4 + 1) > 0
        fits &= component[x.a][:, None] != component[x.b][None, :]
        small, large = (f(x.size[x.a][:, None], x.size[x.b][None, :]) for f in (np.minimum, np.maximum))
        fits &= 100 * small >= percent * large
        a, b = x.a[fits.any(1)], x.b[fits.any(0)]
        if len(a):
            i, j = np.nonzero(x.linked(a, b, percent) & fits[np.ix_(fits.any(1), fits.any(0))])
            a, b = a[i], b[j]
            pairs = np.sort(np.stack([component[a], component[b]]), axis=0)
            first = np.unique(pairs, axis=1, return_index=True)[1]
            a, b = a[first], b[first]
        return pa.table({"a": np.minimum(x.rep[a], x.rep[b]), "b": np.maximum(x.rep[a], x.rep[b])})

    return run


def _block_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (grp, rep, n, more columns) with their tokens, for each pair of blocks of a group:
    (grp, block_a, block_b, second). Groups are laid in blocks by size, and pairs of blocks
    whose sizes allow no link are left out. Members of one size are dealt by hash."""
    weight = F.sum(F.greatest("n", F.lit(LEAST)))
    # Sizes a third apart have no links: a band of sizes meets its neighbours only.
    whole = members.groupBy("grp").agg(weight.alias("weight"))
    band = F.when(F.col("weight") <= BLOCK, 0).otherwise(F.floor(F.log("n") / math.log(4 / 3)))
    placed = cut(members.join(whole, "grp").withColumn("band", band.cast("long")).drop("weight"))
    parts = placed.groupBy("grp", "band").agg(F.ceil(weight / BLOCK).alias("parts"))
    placed = cut(placed.join(parts, ["grp", "band"]).withColumn("block", F.expr("(band << 32) + pmod(xxhash64(rep), parts)")).drop("band", "parts"))
    ends = placed.groupBy("grp", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = lambda s: ends.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi")))
    pairs = side("a").join(side("b"), "grp").where(f"block_a <= block_b and 100 * hi_a >= {percent} * lo_b")
    pairs = pairs.select("grp", "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    rows = pairs.join(placed, ["grp", "block"]).join(sets.select("rep", "tokens"), "rep")
    return rows.withColumn("second", (F.col("block") != F.col("block_a")).cast("long")).drop("block", "n")


def _across(posts: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components `found` (node, component), from posting lists
    that hold members of several. Lists are gathered by their member of least hash."""
    placed = posts.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    inside = F.max(F.col("pos") < F.col("n_index"))  # the smaller set of a pair has the token in its shorter prefix
    apart = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), inside.alias("any"), F.min(F.struct(F.xxhash64("rep"), "rep")).alias("least"))
    apart = apart.where("lo < hi and any").select("token", F.col("least.rep").alias("grp"))
    members = cut(placed.join(apart, "token").select("grp", "rep", "n", "component").distinct())
    rows = _block_pairs(members, sets, percent)
    return rows.groupBy("grp", "block_a", "block_b").applyInArrow(_block_joins(percent), "a long, b long").distinct()


def _link_counts(links: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n_links): all links of each set. links: some of them, once each, that make
    the components `found` (rep, component). A component of which every pair is among
    them is counted from them. In any other, every pair of its sets is compared."""
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    members = cut(found.join(ends, "rep").join(sets.select("rep", F.size("tokens").cast("long").alias("n")), "rep"))
    loose = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_links").alias("l")).where("l < m * (m - 1)").select("component")
    known = members.join(loose, "component", "left_anti").select("rep", "n_links")
    rows = _block_pairs(members.join(loose, "component").select(F.col("component").alias("grp"), "rep", "n"), sets, percent)
    compared = rows.groupBy("grp", "block_a", "block_b").applyInArrow(_block_counts(percent), "rep long, n_links long")
    return known.unionByName(compared.groupBy("rep").agg(F.sum("n_links").alias("n_links")))


def _of_one_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): representatives of different sets that rows of one doc_id have."""
    several = rows.where("n > 0").groupBy("doc_id").agg(*(f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)))
    several = cut(several.where("min_k1 < max_k1 or min_k2 < max_k2").select("doc_id"))
    mine = rows.join(several, "doc_id").join(classes, ["k1", "k2", "n"]).select("doc_id", "rep")
    return mine.join(mine.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()


def ngram_jaccard_join(documents: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, class_id) for each row of documents.

    class_id is the least doc_id with the same set, component_id the least one
    that links reach, n_links the number of all classes that the row's class links
    to (null without `count_links`, which spares the count).
    Null or blank text: no shingles, its own component. Rows with a null id are
    dropped; repeated rows give repeated rows; the rows of one doc_id are one document, so that
    what any of its texts links to is in its component. Other columns are ignored. Texts are taken whole, however long.
    `percent` must be 75 or more, as prefixes are a quarter of a set.
    """
    if percent < 75:
        raise ValueError("prefixes are sized for a similarity of 0.75 or more")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = cut(docs.mapInArrow(_classes, "doc_id long, n long, n_sampled long, k1 long, k2 long"))
    classes = rows.where("n > 0").groupBy("k1", "k2", "n", "n_sampled").agg(F.min("doc_id").alias("rep"))
    sets = cut(_whole_sets(docs, cut(_sharing(docs, classes))))
    heads = cut(_heads(sets, percent))
    posts = cut(heads.select("rep", "n", "cap", "n_index", F.posexplode("probe").alias("pos", "token")))
    index = posts.where("pos < n_index")
    centres = index.groupBy("token").agg(F.min(F.struct(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("cap").alias("cap_a"))).alias("c")).select("token", "c.*")
    star = posts.join(centres, "token").select("a", "n_a", "cap_a", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("cap").alias("cap_b"))
    # A centre need not be the least of its list: pairs are put in order, so that each is tested and counted once.
    star = cut(star.where("a <> b").where(_possible(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = cut(_verified(star, heads, sets, percent))
    same = cut(_of_one_document(rows, classes))
    found = cut(components(links.unionByName(same), "a", "b"))
    more = cut(_across(posts, found, sets, percent))
    links = links.unionByName(more)
    found = components(links.unionByName(same), "a", "b").withColumnRenamed("node", "rep")
    if count_links:
        counts, none = _link_counts(links, found, sets, percent), F.lit(0)
    else:
        counts, none = found.select("rep", F.lit(None).cast("long").alias("n_links")).limit(0), F.lit(None).cast("long")
    placed = classes.join(found, "rep", "left").join(counts, "rep", "left").select("k1", "k2", "n", "rep", "component", "n_links")
    return rows.join(placed, ["k1", "k2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
        F.coalesce("n_links", none).alias("n_links"),
        F.coalesce("rep", "doc_id").alias("class_id"),
    )
