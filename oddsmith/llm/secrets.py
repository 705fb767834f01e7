"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: text that matches
must satisfy it. The index holds the postings of the trigrams that queries name,
as bit maps: a row for each trigram and range of 64 ids. Queries are intersections
and unions of these bit maps; only the texts that they leave are scanned. Rules
without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small


@dataclass(frozen=True)
class Rule:
    """group: the part whose length must be `least` code points or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    needs: str = ""  # a cheap test that every match passes, for rules that scan fully


# The three base rules, in the order in which kinds are listed.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
]
MORE_RULES = [
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),  # begins a run, so that each run is tried once
]
MOST = 64  # strings in an exact set

# A query is True, a trigram, ("and", ...) or ("or", ...).


def _join(how: str, parts):
    parts = list(dict.fromkeys(parts))
    if how == "or" and True in parts:
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (how, *parts)


def _of_strings(strings):
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items):
    """(exact set of strings or None, query) of a sequence of parsed items."""
    run, queries, exact = {""}, [], True

    def flush():
        nonlocal run, exact
        queries.append(_of_strings(run))
        run, exact = {""}, False

    for op, arg in items:
        options = None
        if op is C.LITERAL:
            options = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            options = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            options, query = _walk(arg[3])
            if options is None:
                queries.append(query)
        elif op is C.BRANCH:
            found = [_walk(x) for x in arg[1]]
            options = None if any(o is None for o, _ in found) else set().union(*(o for o, _ in found))
            if options is None:
                queries.append(_join("or", [q if o is None else _of_strings(o) for o, q in found]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            if inner is not None and (low, high) in ((0, 1), (1, 1)):
                options = inner | ({""} if low == 0 else set())
            elif low:
                queries.append(query if inner is None else _of_strings(inner))
        if options is not None and len(run) * len(options) <= MOST:
            run = {a + b for a in run for b in options}
        else:
            flush()
            if options is not None:
                run = set(options)
    if exact:
        return run, _of_strings(run)
    flush()
    return None, _join("and", queries)


def trigram_query(regex: str):
    """The Boolean query over lower-case trigrams that each match satisfies; True if there is none."""
    return _walk(P.parse(regex))[1]


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1:]))


def _key() -> Column:
    """doc_id, with a value of its own for null."""
    return F.coalesce(F.col("doc_id"), F.lit(-(2**63)))


def postings(documents: DataFrame, vocabulary: set[str]) -> DataFrame:
    """(trigram, block, bits): for each trigram of the vocabulary and each range of 64 ids, the texts that hold it."""
    low = documents.select(_key().alias("key"), F.lower("text").alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(vocabulary))))
    each = low.where("low is not null").select(F.shiftright("key", 6).alias("block"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"), F.explode(has).alias("trigram"))
    return each.groupBy("trigram", "block").agg(F.bit_or("bit").alias("bits"))


def _intersected(query, bits: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return bits[query]
    parts = [_intersected(q, bits) for q in query[1:]]
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseAND(x) if query[0] == "and" else out.bitwiseOR(x)
    return out


def candidates(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, _kinds): the rules whose query each text satisfies, by intersecting postings."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}
    vocabulary = sorted(set().union(*(trigrams(q) for q in queries.values())))
    if not vocabulary:
        return documents.select(_key().alias("key"), F.array().cast("array<string>").alias("_kinds")).limit(0)
    lists = postings(documents, set(vocabulary)).groupBy("block").agg(*(F.coalesce(F.bit_or(F.when(F.col("trigram") == t, F.col("bits"))), F.lit(0).cast("long")).alias(f"t{i}") for i, t in enumerate(vocabulary)))
    bits = {t: F.col(f"t{i}") for i, t in enumerate(vocabulary)}
    found = lists.select("block", F.array(*(_intersected(q, bits) for q in queries.values())).alias("found"))
    any_ = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    held = lambda x, n: F.call_function("shiftrightunsigned", x, n).bitwiseAND(F.lit(1)) == 1
    n = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda n: held(any_, n))).alias("n")
    found = found.where(any_ != 0).select("block", "found", n)
    kinds = F.array_compact(F.array(*(F.when(held(F.get("found", F.lit(i)), F.col("n")), F.lit(k)) for i, k in enumerate(queries))))
    return found.select((F.shiftleft("block", 6) + F.col("n")).alias("key"), kinds.alias("_kinds"))


def _running(a: str, join: str, longest: int = 31) -> str:
    """SQL of the running totals of an array of numbers, `join` combining x and y: as many passes as the length has bits."""
    for k in range(longest):
        step = 1 << k
        a = f"transform(array({a}), a -> if(size(a) > {step}, transform(a, (x, i) -> if(i < {step}, x, {join.format(x='x', y=f'get(a, i - {step})')})), a))[0]"
    return a


def _lengths(rule: Rule, text: Column) -> Column:
    """Lengths in code points of all matches, of the parts that are measured, and of the gaps before each match."""
    all_ = lambda g: F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(g)), F.length)
    return F.struct(all_(0).alias("m"), all_(rule.group).alias("g"), F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"))


NO_SPANS = "cast(array() as array<struct<start:int,order:int,kind:string,end:int>>)"


def secret_spans(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """documents with `_spans`: array of (start, order, kind, end), by start, then rule.

    Matches are leftmost and do not overlap within a rule. Null and empty texts have none. Rows with a null or
    repeated doc_id are scanned like any other. A text is scanned whole, however long, and as many
    matches as it has, in time near its length. Other columns stay; one named `_spans` is replaced.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    found = small(cut(candidates(documents, rules)))
    keep = [c for c in documents.columns if c != "_spans"]
    x = documents.select(*keep).withColumn("_key", _key()).join(found.withColumnRenamed("key", "_key"), "_key", "left")
    text, n = F.coalesce("text", F.lit("")), range(len(rules))
    test = lambda r: text.rlike(r.needs or r.regex) if trigram_query(r.regex) is True else F.array_contains("_kinds", r.kind)
    x = x.select(*keep, *(F.when(test(r), _lengths(r, text)).alias(f"_r{k}") for k, r in enumerate(rules)))
    # A match ends after all gaps and matches up to it.
    total = lambda k: _running(f"transform(_r{k}.m, (l, i) -> l + get(_r{k}.gap, i))", "{x} + {y}")
    x = x.select("*", *(F.expr(f"if(_r{k} is null, null, {total(k)})").alias(f"_e{k}") for k in n))

    def spans(k, r):
        one = f"struct(e - get(_r{k}.m, i) as start, {k} as order, '{r.kind}' as kind, e as end)"
        return F.expr(f"if(_e{k} is null, {NO_SPANS}, filter(transform(_e{k}, (e, i) -> if(get(_r{k}.g, i) >= {r.least}, {one}, null)), s -> s is not null))")

    return x.select(*keep, F.sort_array(F.concat(*(spans(k, r) for k, r in enumerate(rules)))).alias("_spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 1024  # code points of the pieces of which slices of a text are made


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with each secret replaced by the mark (overlapping spans by one mark), n_chars by the new length.

    Null texts stay null. The text is put together once from its parts, so that many secrets in
    a long text take time near its length. Columns stay as they are."""
    x = secret_spans(documents.withColumnRenamed("_spans", "_own_spans"))
    names = x.columns
    hit = "size(_spans) > 0"
    x = x.withColumn("_ends", F.expr(f"if({hit}, {_running('transform(_spans, s -> s.end)', 'greatest({x}, {y})')}, null)"))
    x = x.withColumn("_pieces", F.expr(f"if({hit}, regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0), null)"))
    # A part of the text from a up to b, from the pieces that hold it.
    part = lambda a, b: f"if({b} <= {a}, '', substring(array_join(slice(_pieces, ({a}) div {PIECE} + 1, ({b} - 1) div {PIECE} - ({a}) div {PIECE} + 1), ''), ({a}) % {PIECE} + 1, {b} - ({a})))"
    before = "coalesce(get(_ends, i - 1), 0)"
    kept = f"transform(_spans, (s, i) -> if(s.start >= {before}, concat({part(before, 's.start')}, '{mark}'), ''))"
    rest = part("element_at(_ends, -1)", "length(text)")
    x = x.withColumn("text", F.expr(f"if({hit}, concat(array_join({kept}, ''), {rest}), text)"))
    if "n_chars" in names:
        x = x.withColumn("n_chars", F.when(F.expr(hit), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return x.drop("_spans").withColumnRenamed("_own_spans", "_spans").select(*documents.columns)
