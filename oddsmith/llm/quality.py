"""Quality rules: statistics of a text, and a decision list learned by sequential covering.

Rules are conjunctions of thresholds. Each is grown on two thirds of the
labelled rows by FOIL's gain, pruned on the other third, and kept if it is
precise there; the rows it covers leave before the next one is grown. The list
becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words

MAX_LABELLED = 20_000  # labelled rows used for fitting at most: those of least hash
MAX_RULES, MAX_CONDITIONS = 8, 3  # of the list; of a rule
MIN_COVER, MIN_PRECISION = 5, 0.98  # rejected labelled rows of a rule at least; share of rightly rejected ones
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(w: Column, size: int = 8) -> Column:
    """Words in windows of `size` words that occur twice or more."""

    def covered(h):
        def of(s):
            # Sorted by (hash, place), equal windows are neighbours.
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("total"))
            return F.aggregate(places, zero, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(size), p - a["last"])).alias("total")), lambda a: a["total"])

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(w) < size, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a struct column `_quality`. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    only = lambda c: F.length(F.regexp_replace(t, f"[^{c}]+", ""))

    def stats(w, lines):
        return F.struct(
            *(
                v.cast("long").alias(k)
                for k, v in {
                    "n_words": F.size(w),
                    "word_chars": F.length(F.array_join(w, "")),
                    "n_symbols": only(SYMBOLS),
                    "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
                    "n_repeat_words": _repeated(w),
                    "n_lines": F.size(lines),
                    "n_capitals": only("A-Z"),
                    "n_digits": only("0-9"),
                    "n_bangs": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
                }.items()
            )
        )

    # Bound to lambda variables: the optimizer would put the split into the lambdas over its own words.
    lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumn("_quality", let(words(F.col(text)), lambda w: let(lines, lambda x: stats(w, x))))


def features(q: Column) -> dict[str, Column]:
    words_, chars, lines = (F.greatest(q[k], F.lit(1)).cast("double") for k in ("n_words", "word_chars", "n_lines"))
    return {
        "n_words": q["n_words"].cast("double"),
        "word_length": q["word_chars"] / words_,
        "symbols_per_word": q["n_symbols"] / words_,
        "duplicate_lines": q["n_dup_lines"] / lines,
        "repeated_words": q["n_repeat_words"] / words_,
        "words_per_line": q["n_words"] / lines,
        "capitals": q["n_capitals"] / chars,
        "digits": q["n_digits"] / chars,
        "bangs_per_word": q["n_bangs"] / words_,
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] > self.cut if self.above else f[self.feature] <= self.cut


def _count(rows, rule):
    hit = [r for r in rows if all(c.holds(r) for c in rule)]
    p = sum(r["bad"] for r in hit)
    return p, len(hit) - p


def _grow(rows, names, cuts, most):
    rule, inside = [], rows
    while len(rule) < most:
        p = sum(r["bad"] for r in inside)
        if p == len(inside):
            break
        best, gain = None, 1e-9
        for f in names:
            ordered = sorted((r[f], r["bad"]) for r in inside)
            at, bad, total = 0, 0, len(ordered)
            for cut in cuts[f]:
                while at < total and ordered[at][0] <= cut:
                    bad += ordered[at][1]
                    at += 1
                for above, pos, n in ((False, bad, at), (True, p - bad, total - at)):
                    if pos >= MIN_COVER and n < total:
                        g = pos * (math.log2(pos / n) - math.log2(p / total))
                        if g > gain:
                            best, gain = Condition(f, above, cut), g
        if best is None:
            break
        rule.append(best)
        inside = [r for r in inside if best.holds(r)]
    return rule


def sequential_covering(rows: list[dict], names: list[str], max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[list[Condition]]:
    """rows: feature values, `bad` 0 or 1, `fold` 0, 1 or 2 (2: for pruning). The list ends
    with max_rules rules, or when the next one is not precise enough or covers too few bad rows."""
    rules: list[list[Condition]] = []
    cuts = {}
    for f in names:
        values = sorted({r[f] for r in rows if r["fold"] < 2})
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]  # every gap of the rows that rules grow on
    while len(rules) < max_rules and sum(r["bad"] for r in rows) >= MIN_COVER:
        grow, prune = [r for r in rows if r["fold"] < 2], [r for r in rows if r["fold"] == 2]
        rule = _grow(grow, names, cuts, max_conditions)
        if not rule:
            break
        worth = lambda k: (lambda p, n: (p - n) / max(1, p + n))(*_count(prune, rule[:k]))
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        p, n = _count(rows, rule)
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def learn(documents: DataFrame, labels: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[list[Condition]]:
    """Rules that reject, from labels (doc_id, quality 0 or 1). At most MAX_LABELLED labelled ids
    are used, those of least hash; of an id with several labels or texts the least counts. Other labels, and ids without a text, are left out."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    known = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by MAX_LABELLED
    known = cut(known.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))  # written, so that statistics are taken of these rows alone, once
    q = F.col("_quality")
    f = features(q)
    rows = with_statistics(known).where(~base_failed(q)).select((1 - F.col("quality")).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("fold"), *(c.alias(k) for k, c in f.items()))
    return sequential_covering([r.asDict() for r in rows.collect()], list(f), max_rules, max_conditions)  # MAX_LABELLED rows of ten numbers at most


def kept(rules: list[list[Condition]], q: Column) -> Column:
    """The decision list as one conditional expression."""
    f = features(q)
    out = F.when(base_failed(q), False)
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(f)
        out = out.when(test, False)
    return out.otherwise(True)


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with `_quality` (statistics), `base_failed` and `kept`.

    Null or empty texts have no words and fail. Without labels no rule is
    learned and the base alone decides. Null ids have no label and are decided like others. Repeated rows stay repeated; other
    columns stay, but for those with the three names, which are replaced. Of the learner, MAX_LABELLED bounds
    the sample, MAX_RULES the list and MAX_CONDITIONS each rule; statistics and decisions cover all rows and whole texts.
    """
    rules = learn(documents, labels)
    q = F.col("_quality")
    return with_statistics(documents).withColumn("base_failed", base_failed(q)).withColumn("kept", kept(rules, q))
