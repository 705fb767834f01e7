"""Damaged JSON: known damages, every truncation, and what random edits leave."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from oddsmith.sources.json_repair import repaired, tolerant_json
from oddsmith.sources.loaders import lenient_json

KNOWN = [
    ('{"a": 1', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "b', {"a": "b"}), ("{a: 1, b_c: x y}", {"a": 1, "b_c": "x y"}), ("{'a': 'it'}", {"a": "it"}),
    ("{'a': True, 'b': None, 'c': [1,],}", {"a": True, "b": None, "c": [1]}), ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ('["a" "b", , "c"]', ["a", "b", "c"]),
    ('{"a": 1, // one\n "b": /* two */ 2 # three\n}', {"a": 1, "b": 2}), ('Here it is: ```json\n{"a": 1}\n``` done', {"a": 1}), ('{"a": "he said "hi" to me", "b": 1}', {"a": 'he said "hi" to me', "b": 1}),
    ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": 1]}', {"a": 1}), ('{"a"', {"a": None}), ('{"a":', {"a": None}), ('{"a", "b": 1}', {"a": None, "b": 1}),
    ("[1., .5, +2, 007, 1e, -3.5e2]", [1.0, 0.5, 2, 7, 1, -350.0]), ('{"a": 1} {"b": 2}', {"a": 1}), ("“a”", "a"), ("12", 12), ("NaN", None), ("{“a”: “b”}", {"a": "b"}), ('{"a": "x\\u00e9\\n\\q', {"a": "xé\nq"}),
    ('{"a": "\\ud83d\\ude00 \\ud83d"}', {"a": "😀 �"}), ("{}", {}), ("[", []), ('{"a": {"b"}}', {"a": {"b": None}}), ("[[[", [[[]]]), ('{"a":"b" "c"}', {"a": "b", "c": None}), ("{1: 2}", {"1": 2}),
]


@pytest.mark.parametrize("text, value", KNOWN)
def test_known_damages(text, value):
    assert json.loads(repaired(text)) == value


def value_of(r, depth=3):
    kinds = ["n", "s", "w"] + ["o", "a"] * (depth > 0)
    k = r.choice(kinds)
    word = lambda: "".join(r.choice('abc é"\\\n,:{}[]/#\'') for _ in range(r.randint(0, 8)))
    return {
        "n": lambda: r.choice([0, -1, 2.5, 1e10, r.randint(-999, 999)]), "s": word, "w": lambda: r.choice([True, False, None]),
        "o": lambda: {f"k{j}" + word(): value_of(r, depth - 1) for j in range(r.randint(0, 4))}, "a": lambda: [value_of(r, depth - 1) for _ in range(r.randint(0, 4))],
    }[k]()


def plain_of(r):
    """A value whose strings hold no quotes or brackets, so that every reading of it is the same."""
    return {f"k{j}": r.choice([r.randint(0, 9999), "text of words", True, None, [1, "b", {"c": 2.5}], {"d": {"e": []}}]) for j in range(r.randint(1, 5))}


def begins(part, whole):
    """Whether part is what is left of whole when its text is cut off."""
    if isinstance(whole, dict) and isinstance(part, dict):
        return all(k in whole and (begins(v, whole[k]) or v is None) or any(w.startswith(k) for w in whole) for k, v in part.items())
    if isinstance(whole, list) and isinstance(part, list):
        return len(part) <= len(whole) and all(begins(p, w) for p, w in zip(part, whole))
    if isinstance(whole, str) and isinstance(part, str):
        return whole.startswith(part)
    if isinstance(whole, bool) or whole is None:
        return part == whole or isinstance(part, str) and json.dumps(whole).startswith(part)
    return part == whole or str(whole).startswith(str(part)) or str(part) in str(whole)


def test_sound_json_stays():
    r = random.Random(1)
    for _ in range(3000):
        v = {"x": value_of(r)} if r.random() < 0.5 else [value_of(r)]
        assert json.loads(repaired(json.dumps(v, ensure_ascii=r.random() < 0.5))) == v


def test_every_truncation():
    r = random.Random(2)
    for _ in range(200):
        v = plain_of(r)
        text = json.dumps(v, indent=r.choice([None, 1]))
        for k in range(1, len(text) + 1):
            assert begins(json.loads(repaired(text[:k])), v), text[:k]
        assert json.loads(repaired(text)) == v


def test_random_edits_give_json():
    r = random.Random(3)
    for _ in range(4000):
        t = list(json.dumps(value_of(r)))
        for _ in range(r.randint(1, 6)):
            t[r.randrange(len(t) + 1) : r.randrange(len(t) + 1)] = r.choice(['"', "{", "}", "[", "]", ",", ":", "\\", "/*", "#", "'", ""])
        got = repaired("".join(t))
        if got is not None:
            json.loads(got)


@pytest.mark.parametrize("piece", ["[", "{", '"', "\\", '{"a":', "/*", "a ", '" ', "}", "1", '"a" b ', "'\"", "# "])
def test_hostile_texts_take_linear_time(piece):
    t = time.perf_counter()
    for begin in ("", "[", '{"a": "'):
        got = repaired(begin + piece * (300_000 // len(piece)))
        assert got is None or got[:1]
    assert time.perf_counter() - t < 10


def test_tolerant_json(spark):
    rows = [(0, '{"a": 1, "b": "x"}'), (1, '{"a": 2, "b": "y'), (2, "{a: 3, b: z}"), (3, None), (4, ""), (5, "no json"), (6, "{'a': 4, 'b': 'w'}"), (7, '{"a": 5, "b": "v",}')]
    df = spark.createDataFrame(rows, "k int, t string")
    x = df.select("k", tolerant_json(F.col("t"), "a int, b string").alias("j"), lenient_json(F.col("t"), "a int, b string").alias("l"))
    got = {r["k"]: (r["j"] and tuple(r["j"])) for r in x.collect()}
    assert got == {0: (1, "x"), 1: (2, "y"), 2: (3, "z"), 3: None, 4: None, 5: (None, None), 6: (4, "w"), 7: (5, "v")}
    lenient = {r["k"]: (r["l"] and tuple(r["l"])) for r in x.collect()}
    assert all(lenient[k] == got[k] for k in (0, 1, 2, 3, 6, 7))
