"""Conversation structure repair: each distinct sequence of roles and faults is solved once.

A conversation becomes a signature, a character a row; least costly edits of a signature are found by memoised
recursion, joined back, and replayed over the rows in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, small

SPACES = " \t\n\x0b\x0c\r"
# Costs of the edits, which are written Delete, Insert, Keep, Rerole; what a truncated row adds where it stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# Letters of a signature: the role's initial, or o; in capitals where the row is truncated; x: it must go.
MUST_GO, OTHER = "x", "o"
# What each initial does to the states of (s?(ua)+)?: what may follow.
_NEXT = {("start", "s"): "ready", ("start", "u"): "asked", ("ready", "u"): "asked", ("asked", "a"): "answered", ("answered", "u"): "asked"}
_NAMES = {"u": "user", "a": "assistant"}
_NOTHING = hashlib.sha256(b"").hexdigest()


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, a letter each; among equally cheap audits the ASCII-least.

    Edits that can come next differ in their letters, so the least letter among the cheapest gives the least audit
    and the recursion over (place, state, inserts that may still follow here) need not compare audits. Two inserts in a row at most are of use. Its
    results are filled from the end, so it never goes deep: time and memory grow with the length.
    """
    known: dict = {}

    def best(i: int, state: str, inserts: int) -> tuple[int, str, str]:
        """(cost, first letter, state after it) from row i on."""
        key = (i, state, inserts)
        if key not in known:
            ways = [(0, "", state)] if i == len(signature) and state in ("start", "answered") else []
            if i < len(signature):
                c = signature[i]
                low, extra = c.lower(), TRUNCATED * c.isupper()
                ways.append((DELETE + best(i + 1, state, 2)[0], "D", state))
                if c != MUST_GO:
                    if (state, low) in _NEXT:
                        ways.append((extra + best(i + 1, _NEXT[state, low], 2)[0], "K", _NEXT[state, low]))
                    to = _NEXT[state, _turn(state)]
                    ways.append((REROLE + extra + best(i + 1, to, 2)[0], "R", to))
            if inserts:
                to = _NEXT[state, _turn(state)]
                ways.append((INSERT + best(i, to, inserts - 1)[0], "I", to))
            known[key] = min(ways, default=(float("inf"), "", state))
        return known[key]

    for i in range(len(signature), -1, -1):
        for state in ("start", "ready", "asked", "answered"):
            best(i, state, 2)
    i, state, inserts, audit = 0, "start", 2, []
    cost = best(0, "start", 2)[0]
    while True:
        _, letter, to = best(i, state, inserts)
        if not letter:
            return cost, "".join(audit)
        audit.append(letter)
        i, state, inserts = (i, to, inserts - 1) if letter == "I" else (i + 1, to, 2)


def _turn(state: str) -> str:
    """The role that inserts and new roles take in a state."""
    return "a" if state == "asked" else "u"


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) damaged by a hash of conversation and turn: dropped (`gone`), emptied, without
    ends of sentences, repeated, or said by the user. Null roles and texts, and nulls in what is hashed, count as one space."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), value("role").alias("role"), value("text").alias("text"))
    kind = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    x = x.withColumn("kind", kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return x.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def marked(rows: DataFrame) -> DataFrame:
    """A written table of the rows with k, fault, letter, illegal and new_turn. k numbers the rows of a conversation by turn (nulls
    first), then role and text; rows that are `gone` come last and have no letter. fault: blank, duplicate or truncated, the first that
    holds; letter: of the signature; illegal: the initials of the row before and this one are no su, ua or au. One shuffle
    by conversation; windows stream and spill, so no conversation is held in memory."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    x = rows.select("conv_id", "turn", "role", "text", gone.alias("gone"), F.substring("role", 1, 1).alias("initial")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    pair = F.concat(F.lag("initial").over(order), "initial")
    x = x.select("*", F.row_number().over(order).cast("long").alias("k"), (~pair.isin("su", "ua", "au")).alias("illegal"), (~F.lag("turn").over(order).eqNullSafe(F.col("turn"))).alias("new_turn"))
    x = x.withColumn("digest", F.unhex(F.md5("text")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", F.octet_length("text"), "gone").orderBy("k")) > 1
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(seen, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(OTHER)
    x = x.withColumn("fault", fault)
    letter = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return cut(x.select("conv_id", "k", "turn", "role", "text", "gone", "fault", letter.alias("letter"), "illegal", "new_turn"))


def signatures(table: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of every conversation, from narrow columns only."""
    stays = lambda c: F.when(~F.col("gone"), c)
    count = lambda c: F.count(stays(F.when(c, 1)))
    turn = stays(F.col("turn"))
    letters = F.sort_array(F.collect_list(stays(F.struct("k", "letter"))))
    return table.groupBy("conv_id").agg(
        F.array_join(F.transform(letters, lambda r: r["letter"]), "").alias("signature"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new_turn") & F.col("turn").isNotNull()), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
    )


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit), a row for each distinct signature."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            cost, audit = zip(*map(solve, names)) if names else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string")


def audited(table: DataFrame) -> DataFrame:
    """signatures() with cost and audit. Audits are broadcast while they are few; beyond that
    the join is shuffled, and partitions of frequent signatures are split."""
    found = cut(signatures(table))
    return found.join(small(cut(solved(found))), "signature")


def replayed(table: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, k, role, text): the repaired rows, in order, each conversation in one partition. edit: K, R or I.

    The audit travels as the first row of its conversation; rows stream past it, so
    a task holds one audit and one batch, however long a conversation is."""
    head = audits.select("conv_id", F.lit(0).cast("long").alias("k"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = head.unionByName(table.where("not gone").select("conv_id", "k", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "k")

    def run(batches):
        audit, at, state, conv, place = "", 0, "start", None, 0
        out: list = []

        def put(letter, k, initial, role, text):
            nonlocal place, state
            state, place = _NEXT[state, initial], place + 1
            out.append((conv, place, letter, k, role, text))

        def inserts():
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", None, _turn(state), _NAMES[_turn(state)], "")
                at += 1

        for batch in batches:
            for part in slices(batch):
                for c, k, role, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if k == 0:
                        inserts()  # of the conversation before
                        audit, at, state, conv, place = text, 0, "start", c, 0
                        continue
                    inserts()
                    letter = audit[at]
                    at += 1
                    if letter == "K":
                        put("K", k, role[0], role, text)
                    elif letter == "R":
                        put("R", k, _turn(state), _NAMES[_turn(state)], text)
                yield _batch(out)
                out.clear()
        inserts()
        yield _batch(out)

    return rows.mapInArrow(run, ROWS)


ROWS = "conv_id long, place long, edit string, k long, role string, text string"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], [c.split()[0] for c in ROWS.split(", ")])


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as `replayed` gives them: role:text, joined by newlines. The digest is fed row by row."""

    def run(batches):
        conv, h = None, None
        for b in batches:
            out = []
            for c, place, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "place", "role", "text"))):
                if place == 1:
                    if h:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield _pairs(out)
        if h:
            yield _pairs([(conv, h.hexdigest())])

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of rows (conv_id, turn, role, text) without null roles and texts.

    Rows go by turn (null turns first), ties by role and text; repeated rows are duplicates. Rows with a null conv_id
    make one conversation. Initials of a role decide what it is; a role that is empty, or begins with anything but s, u or a, cannot be kept
    as it is. A blank row or a duplicate is always deleted. A conversation whose rows all go has an empty audit, or Deletes only, and no
    repaired rows. An empty table gives empty tables; other columns are ignored. A conversation's signature, a character a row, and
    its audit are one value each; its texts are never together in memory.
    """
    table = marked(rows)
    audits = cut(audited(table))
    return audits, replayed(table, audits)
