"""Exact quantiles of groups of any size, by narrowing histograms around the wanted ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

BINS = 1024  # of a pass, for each interval that is still too wide
LIMIT = 4096  # values of an interval that are sorted in one place at most


def _same(a: str, b: str, by) -> list:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]


def exact_quantiles(df: DataFrame, by: list[str], col: str, probs: list[float]) -> DataFrame:
    """(*by, quantiles array<double>): of each group the quantiles of `probs`, in their order, between neighbouring values in proportion, as
    `percentile` gives them.

    A pass counts the values of the intervals that hold a wanted rank in BINS bins, with partial sums, and keeps each rank's bin, until
    its values are all equal or LIMIT at most; those are sorted. So no task holds the values of a group, however hot it is: the state
    is a row for each group, rank and bin. Nulls and NaN are left out; groups of nothing else give no row; a null key is a group.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("quantiles are wanted at shares between 0 and 1")
    value = F.col(col).cast("double")
    x = cut(df.where(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("v")))
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = lambda p: p * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in map(F.lit, probs)))))
    sizes = cut(sizes)
    wanted = sizes.select(*by, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > LIMIT)
    ready = []
    while True:
        wanted = cut(wanted)
        ready.append(wanted.where(~wide))
        rest = wanted.where(wide)
        spans = rest.select(*by, "lo", "hi", "below").distinct()
        if spans.isEmpty():
            break
        held = x.alias("x").join(spans.alias("s"), [*_same("x", "s", by), F.col("x.v") >= F.col("s.lo"), F.col("x.v") <= F.col("s.hi")])
        held = held.select(*(F.col(f"s.{c}") for c in by), "lo", "hi", "below", "v")
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        bins = held.groupBy(*by, "lo", "hi", "below", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("c").over(Window.partitionBy(*by, "lo", "hi", "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        bins = bins.withColumn("before", F.col("below") + before)
        y = rest.alias("r").join(bins.alias("b"), [*_same("r", "b", [*by, "lo", "hi"]), F.col("r.rank") >= F.col("b.before"), F.col("r.rank") < F.col("b.before") + F.col("b.c")])
        wanted = y.select(*(F.col(f"r.{c}") for c in by), F.col("r.rank"), F.col("b.a").alias("lo"), F.col("b.b").alias("hi"), F.col("b.before").alias("below"), F.col("b.c").alias("inside"))
    done = ready[0]
    for r in ready[1:]:
        done = done.unionByName(r)
    done = cut(done)
    spans = done.where("lo < hi").select(*by, "lo", "hi", "below").distinct()
    held = x.alias("x").join(spans.alias("s"), [*_same("x", "s", by), F.col("x.v") >= F.col("s.lo"), F.col("x.v") <= F.col("s.hi")])
    lists = held.groupBy(*(F.col(f"s.{c}") for c in by), "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("values"))  # LIMIT values each at most
    y = done.alias("d").join(lists.alias("l"), _same("d", "l", [*by, "lo", "hi"]), "left")
    found = F.coalesce(F.get("l.values", (F.col("d.rank") - F.col("d.below")).cast("int")), F.col("d.lo"))
    y = y.select(*(F.col(f"d.{c}") for c in by), F.col("d.rank").alias("rank"), found.alias("v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    y = sizes.alias("n").join(y.alias("y"), _same("n", "y", by)).select(*(F.col(f"n.{c}") for c in by), "n", "m")

    def quantile(p):
        low = F.try_element_at("m", F.floor(at(p)))
        return low + (F.try_element_at("m", F.ceil(at(p))) - low) * (at(p) - F.floor(at(p)))

    return y.select(*by, F.array(*(quantile(F.lit(p)) for p in probs)).alias("quantiles"))
