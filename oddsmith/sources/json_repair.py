"""Repair of damaged JSON: a pushdown automaton over the tokens of one text, and its use as a Spark expression."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = re.compile(r"(?:\s++|//[^\n]*+|\#[^\n]*+|/\*.*?(?:\*/|\Z))++", re.S)
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
_BARE = re.compile(r"[^\s,:{}\[\]\"'“‘`]++(?:[ \t]++[^\s,:{}\[\]\"'“‘`/#]++)*+")
_NUMBER = re.compile(r"[+-]?+(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?+\d++)?+")
_STOPS = re.compile(r"[\\\"'”’`]")
_ENDS = frozenset(",:}]")
_WORDS = {"true": "true", "false": "false", "null": "null", "none": "null", "nan": "null", "undefined": "null"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that begins at a quote, and where it ends. A quote inside closes it only if what follows can follow a
    string; without such a quote the string reaches to the end."""
    close, out = _QUOTES[text[at]], []
    at += 1
    while m := _STOPS.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "\\":
            c = text[at : at + 1]
            at += 1
            if c == "u":
                code = re.compile(r"[0-9a-fA-F]{4}").match(text, at)
                if code:
                    out.append(chr(int(code[0], 16)))
                    at = code.end()
            else:
                out.append(_ESCAPES.get(c, c))
        elif m[0] == close:
            after = _SKIP.match(text, at)
            k = after.end() if after else at
            if k >= len(text) or text[k] in _ENDS or text[k] in _QUOTES or "\n" in text[at:k]:
                return "".join(out), at
            out.append(m[0])
        else:
            out.append(m[0])
    return "".join(out) + text[at:], len(text)


def _quoted(value: str) -> str:
    """As JSON; pairs of surrogates are joined and lone ones replaced."""
    return json.dumps(value.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), ensure_ascii=False)


def _scalar(word: str) -> str:
    if word.lower() in _WORDS:
        return _WORDS[word.lower()]
    m = _NUMBER.fullmatch(word.rstrip("eE+-") if _NUMBER.match(word) else word)
    if not m:
        return _quoted(word)
    sign, rest = ("-" if m[0][0] == "-" else ""), m[0].lstrip("+-")
    mantissa, e, power = rest.lower().partition("e")
    whole, dot, part = mantissa.partition(".")
    return f"{sign}{whole.lstrip('0') or '0'}" + (f".{part or '0'}" if dot else "") + (f"e{power}" if e else "")


def repaired(text: str | None) -> str | None:
    """Strict JSON for a text that may be cut off, or have bare or single-quoted names, Python's words, comments, missing or spare commas,
    quotes within strings, or brackets that do not match. None if it holds no value; null stays None.

    What stands before the first bracket and after its end is left out; a text without brackets is one scalar. A closing bracket that
    matches an outer one closes those within; one that matches none is left out. A name without value gets null. What a cut has halved (a number, an
    escape) counts as far as it goes. Time and memory grow with the length, whatever the depth."""
    if text is None:
        return None
    first = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if first < 0:
        m = _SKIP.match(text)
        at = m.end() if m else 0
        if at >= len(text):
            return None
        return _quoted(_string(text, at)[0]) if text[at] in _QUOTES else _scalar(text[at:].strip().rstrip(",;"))
    out: list[str] = []
    stack: list[str] = []  # open brackets
    # What an object waits for: a name, its colon, its value; an array waits for values only.
    waits, at = "value", first

    def lead():
        if stack and out[-1] not in ("{", "[") and not (stack[-1] == "{" and out[-1] == ":"):
            out.append(",")

    def close():
        nonlocal waits
        if stack[-1] == "{" and waits in ("colon", "value"):
            out.append(":null" if waits == "colon" else "null")
        out.append("}" if stack.pop() == "{" else "]")
        waits = "name" if stack and stack[-1] == "{" else "value"

    while at < len(text):
        if m := _SKIP.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if c in "{[":
            if waits == "name":  # a value without a name has no place in an object
                out.append("," if out[-1] != "{" else "")
                out.append('""')
                out.append(":")
            elif waits == "colon":
                out.append(":")
            lead()
            out.append(c)
            stack.append(c)
            waits, at = ("name" if c == "{" else "value"), at + 1
        elif c in "}]":
            want = "{" if c == "}" else "["
            at += 1
            if want in stack:
                while stack[-1] != want:
                    close()
                close()
                if not stack:
                    break
        elif c == ",":
            at += 1
            if stack[-1] == "{" and waits in ("colon", "value"):
                out.append(":null" if waits == "colon" else "null")
                waits = "name"
        elif c == ":":
            at += 1
            if waits == "colon":
                out.append(":")
                waits = "value"
        else:
            if c in _QUOTES:
                value, at = _string(text, at)
                value = _quoted(value)
            else:
                m = _BARE.match(text, at)
                if not m:
                    at += 1
                    continue
                at = m.end()
                value = _scalar(m[0].strip()) if waits != "name" else _quoted(m[0].strip())
            if waits == "colon":  # a value right after a name
                out.append(":")
                waits = "value"
            lead()
            out.append(value)
            if stack[-1] == "{":
                waits = "colon" if waits == "name" else "name"
    while stack:
        close()
    return "".join(out)


def repaired_column(text: Column) -> Column:
    """repaired() over a column, by Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(values):
        return values.map(repaired, na_action="ignore")

    return run(text)


def tolerant_json(text: Column, schema: str, said: Column | None = None) -> Column:
    """from_json of a text that may be damaged. What Spark's own parser reads (of `said`, the text as other expressions have made
    it readable) never leaves the JVM; only the others are sent to Python. A text that is JSON as it stands is read as it stands, and
    `said` is not worked out for it."""
    options = {"allowSingleQuotes": "true"}
    fine = F.from_json(text, "variant", options).isNotNull()
    if said is None:
        bad = ~fine & text.isNotNull()
        return F.from_json(F.when(fine, text).otherwise(repaired_column(F.when(bad, text))), schema, options)
    bad = F.when(fine | text.isNull(), False).otherwise(F.from_json(said, "variant", options).isNull())
    mended = repaired_column(F.when(bad, text))
    return F.from_json(F.when(fine, text).when(mended.isNotNull() | bad, mended).otherwise(said), schema, options)
