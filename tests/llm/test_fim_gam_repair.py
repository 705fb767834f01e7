"""Fill-in-middle, the additive quality model and conversation repair, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("oddsmith.llm")
import numpy as np  # noqa: E402

from oddsmith.llm import fim, gam, repair  # noqa: E402
from oddsmith.llm import queries as Q  # noqa: E402
from oddsmith.llm.common import text_buffer  # noqa: E402

D = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# -- fill-in-middle ---------------------------------------------------------


def fim_want(i, t):
    t = t or ""
    n, h = len(t), sha(f"1:{'' if i is None else i}")
    r = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90:
        return n, "plain", None, None, t
    x, y, z = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if r[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_fim_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "a", "<P>", "<", "a<P", "S>x<S", "\x00\x00é😀\n\r", "x" * 64, "y" * 63, "z" * 65, "é" * 128, "<" * 300_000]
    texts += ["".join(r.choice("ab<>PSM\n\x00é😀́‍") for _ in range(r.choice([3, 20, 63, 64, 65, 127, 128, 129, 500]))) for _ in range(600)]
    rows = [(None if k == 5 else k, t, "clash", 1) for k, t in enumerate(texts)] + [(7, texts[7], "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    out = fim.transform(df).select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    want = Counter((i, *fim_want(i, t), t or "") for i, t, *_ in rows)
    assert Counter(tuple(x) for x in out) == want and {x["form"] for x in out} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).collect() == []


def test_fim_options(spark):
    df = spark.createDataFrame([(k, f"text {k} it's") for k in range(40)], "doc_id long, text string")
    own = fim.Options(marks=("{p'}", "{s}", "{m}"), plain=0, spm=100, seed="it's")
    out = fim.transform(df, own).select("*", fim.restored(F.col("output"), F.col("form"), own).alias("back")).collect()
    assert all(r["form"] == "spm" and r["output"].startswith("{s}") and r["back"] == f"text {r['doc_id']} it's" for r in out)
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "P>x", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.Options(marks=marks)


# -- additive model ---------------------------------------------------------


def plain_features(t):
    b = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    low = [x.lower() for x in w]
    n, chars = len(w), max(1, sum(map(len, w)))
    lines = [tuple(x.lower().split()) for x in b.split(b"\n") if x.split()]
    count = lambda cs: sum(c in cs for c in b)
    same = [0] + [int(a == c) for a, c in zip(low, low[1:])]
    parts = [range(k, min(k + 64, n)) for k in range(0, n, 64) if min(64, n - k) >= 32]
    worst = lambda v: max((sum(v[i] for i in p) / len(p) for p in parts), default=0)
    byte = Counter(c for x in low for c in x)
    m, ln = max(1, n), max(1, len(lines))
    return {
        "log_words": math.log1p(n), "word_length": sum(map(len, w)) / m, "long_words": sum(len(x) > 20 for x in w) / m, "symbols": count(b"#*$%&|<>") / m,
        "capitals": sum(65 <= c <= 90 for c in b) / chars, "digits": count(b"0123456789") / chars, "bangs": count(b"!") / m, "pipes": count(b"|") / m, "stops": count(b".?") / m, "commas": count(b",;:") / m,
        "other_marks": count(b"()[]{}\"'=+/\\_~^`@-") / chars, "not_ascii": sum(c >= 192 for c in b) / chars, "distinct_words": len(set(low)) / m, "repeated_neighbours": sum(same) / m,
        "log_lines": math.log1p(len(lines)), "words_per_line": n / ln, "repeated_lines": (len(lines) - len(set(lines))) / ln, "most_frequent_word": max(Counter(low).values(), default=0) / m,
        "byte_entropy": -sum(v / chars * math.log2(v / chars) for v in byte.values()), "worst_symbols": worst([sum(c in b"#*$%&|<>" for c in x) for x in w]),
        "worst_capitals": worst([sum(65 <= c <= 90 for c in x) for x in w]), "worst_repeats": worst(same),
    }


def test_gam_features_against_plain_counts():
    r = random.Random(5)
    pieces = ["wort", "Wort", "ÜBER", "a", "x" * 30, "###", "!!", "5", "|", "\n", "\n\n", " ", ".", ",", "\t", "é", "wort wort"]
    texts = [None, "", " \n ", "one", "\n a \n a", "A" * 100_000, "spam " * 50_000] + ["".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.choice([1, 5, 40, 400]))) for _ in range(120)] + ["", None]
    with np.errstate(over="ignore"):
        got = gam.features(*text_buffer(pa.array(texts, pa.string())))
    for t, row in zip(texts, got):
        want = plain_features(t)
        assert list(want) == gam.FEATURES
        for name, v in zip(gam.FEATURES, row):
            assert v == pytest.approx(want[name], abs=1e-9), (name, t and t[:80])


def test_gam_scores_are_sums_of_looked_up_values():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)  # only a pair can tell
    model = gam.fit(x, y)
    s = model.scores(x)
    assert ((s > 0.5) == y).mean() > 0.97 and max(abs(t).max() for t in model.tables[2:]) < max(abs(p[2]).max() for p in model.pairs)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    bin_of = lambda e, v: sum(c <= v for c in e)
    for k in range(0, 900, 37):
        b = [bin_of(e, v) for e, v in zip(model.edges, x[k])]
        total = model.intercept + sum(t[i] for t, i in zip(model.tables, b)) + sum(t[b[i], b[j]] for i, j, t in model.pairs)
        assert s[k] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)
    assert np.array_equal(gam.fit(x, y).scores(x), s)


def test_gam_cuts_against_all_places():
    r = np.random.default_rng(8)
    for _ in range(30):
        g, h, n = r.normal(size=9), r.random(9) + 0.1, np.full(9, 10.0)
        gain = lambda k: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + gam.RIDGE) for a, b in ((0, k), (k, 9)))
        best = max(range(1, 9), key=gain)
        assert best in gam._cuts(g, h, n) or gain(best) - g.sum() ** 2 / (h.sum() + gam.RIDGE) < 1e-6


def test_gam_held_out(spark):
    x = Q.op12_quality_gam(spark, "/root/testdata/sf0.01")
    rows = x.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0} and len(rows) > 50
    bad, good = [r["score"] for r in rows if r["quality"] == 0], [r["score"] for r in rows if r["quality"] == 1]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad)
    assert auc > 0.97 and sum(s >= 0.3 for s in good) / len(good) > 0.95 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_gam_edge_cases(spark):
    rows = [(k, f"good text number {k} of many words. " * 8 if k % 2 else "### $$$ %%% " * 20, 9.0, "x") for k in range(60)]
    rows += [(None, "a text", 9.0, "x"), (100, None, 9.0, "x"), (101, "", 9.0, "x"), (3, rows[3][1], 9.0, "x"), (102, "long " * 200_000, 9.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, f string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(60)] + [(3, 0, 1), (None, 1, 1), (5, None, 1), (7, 7, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    out = gam.score(docs, gam.learn(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[100] == by[101] and by[11] > 0.8 > 0.2 > by[10]
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert len({r["score"] for r in gam.score(docs, gam.learn(docs, some)).collect()}) == 1
    assert gam.score(docs.limit(0), gam.learn(docs.limit(0), labels)).collect() == []


# -- conversation repair ----------------------------------------------------


def all_edits(signature):
    """(cost, audit) by trying every sequence of edits, with two inserts in a row at most."""

    @lru_cache(None)
    def from_(i, state, inserts):
        out = [(0, "")] if i == len(signature) and state in ("start", "answered") else []
        step = lambda cost, letter, to, j, k: [(cost + c, letter + a) for c, a in from_(j, to, k)]
        turn = {"start": "asked", "ready": "asked", "asked": "answered", "answered": "asked"}[state]
        if inserts:
            out += step(2, "I", turn, i, inserts - 1)
        if i < len(signature):
            c = signature[i]
            out += step(3, "D", state, i + 1, 2)
            if c != "x":
                out += step(2 + c.isupper(), "R", turn, i + 1, 2)
                to = {("start", "s"): "ready", ("start", "u"): "asked", ("ready", "u"): "asked", ("asked", "a"): "answered", ("answered", "u"): "asked"}.get((state, c.lower()))
                if to:
                    out += step(int(c.isupper()), "K", to, i + 1, 2)
        return tuple(out)

    return min(from_(0, "start", 2))


def test_solve_against_all_edits():
    r = random.Random(2)
    seen = {""} | {"".join(r.choice("suaoSUAOx") for _ in range(r.randint(1, 5))) for _ in range(400)}
    for s in seen:
        assert repair.solve(s) == all_edits(s), s
    assert repair.solve("s") == (3, "D") and repair.solve("ua" * 30_000) == (0, "K" * 60_000)


def random_turns(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "u", None, "user", "assistant"]
    texts = [None, "", " \n", "Hi.", "no end", "What?", "a.b", "x \x0b", "é!"]
    return [(r.choice([None, *range(40)]), r.choice([None, 0, 1, 2, 3, 4, 5, 9]), r.choice(roles), r.choice(texts)) for _ in range(n)]


def plain_repair(rows):
    """The whole contract over lists of rows."""
    out = {}
    sp = lambda v: " " if v is None else str(v)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[c] += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, got in by.items():
        got.sort()
        seen, letters, faults = set(), "", Counter()
        for _, _, role, text in got:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            f = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[f] += 1
            c0 = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if f in ("blank", "duplicate") else c0.upper() if f else c0
        cost, audit = repair.solve(letters)
        turns = [t for known, t, *_ in got if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        said, i, state = [], 0, "start"
        for e in audit:
            if e == "K":
                state = "ready" if got[i][2][0] == "s" else "asked" if got[i][2][0] == "u" else "answered"
                said.append(f"{got[i][2]}:{got[i][3]}")
            elif e in "RI":
                name, state = ("assistant", "answered") if state == "asked" else ("user", "asked")
                said.append(f"{name}:{got[i][3] if e == 'R' else ''}")
            i += e != "I"
        out[c] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(said)))
    return out


@pytest.mark.parametrize("rows", [random_turns(3, 500), random_turns(4, 60), [(7, k, "user" if k % 3 else "assistant", f"turn {k}" + "." * (k % 2)) for k in range(6000)] + [(8, 0, "user", "x" * 500_000)]], ids=["many", "few", "hot"])
def test_repair_against_plain_version_and_sql(spark, rows, tmp_path):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, k long").repartition(5)
    path = str(tmp_path / "conversations.parquet")
    table.write.parquet(path)
    got = {r["conv_id"]: tuple(r)[1:] for r in Q.op13_repair(spark, str(tmp_path)).collect()}
    assert got == plain_repair(rows)
    if len(rows) < 1000:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
        assert {r[0]: r[1:] for r in con.sql(Q.OP13_SQL).fetchall()} == got


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Yes."), (2, None, "user", "Hi?"), (2, None, "user", "Hi?"), (3, 5, "system", "Be."), (4, 1, "user", " ")]
    audits, fixed = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in audits.collect()} == {1: ("IK", 2), 2: ("KDI", 5), 3: ("D", 3), 4: ("D", 3)}
    out = sorted((r["conv_id"], r["place"], r["edit"], r["k"], r["role"], r["text"]) for r in fixed.where("conv_id = 1").collect())
    assert out == [(1, 1, "I", None, "user", ""), (1, 2, "K", 1, "assistant", "Yes.")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits, fixed = repair.repair(repair.damaged(empty))
    assert audits.collect() == [] and fixed.collect() == []


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_repair"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = Q.queries()[name](spark, D)
    rel = con.sql(Q.oracle_sql()[name])
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


# -- time in the length of hostile texts ------------------------------------


@pytest.mark.parametrize("piece", ["eyJabcdefgh", "token="])
def test_secrets_in_hostile_texts(spark, piece):
    import time

    from oddsmith.llm import secrets

    text = piece * ((1 << 20) // len(piece))
    df = spark.createDataFrame([(1, text + " x.eyJ")], "doc_id long, text string")
    t = time.perf_counter()
    got = secrets.secret_spans(df).select(F.size("_spans")).first()[0]
    assert time.perf_counter() - t < 60 and got >= 0  # most of it planning


def test_signed_tokens_begin_a_run(spark):
    from oddsmith.llm import secrets

    token = "eyJabcdefgh1.eyJabcdefgh2.abcdefghij"
    df = spark.createDataFrame([(1, f"x {token} ({token}) eyJ eyJabcdefgh1.x {token}")], "doc_id long, text string")
    got = secrets.secret_spans(df).select(F.filter("_spans", lambda s: s["kind"] == "signed_token")).first()[0]
    assert [(s["start"], s["end"]) for s in got] == [(2, 38), (40, 76), (97, 133)]


@pytest.mark.parametrize("piece", ["<html ", "<script", "</script "])
def test_language_of_hostile_pages(spark, piece):
    import time

    from oddsmith.llm import language

    documents = spark.createDataFrame([(k, "le la les une dans pour" if k % 2 else "und der die das ist nicht", "fr" if k % 2 else "de") for k in range(20)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.de/", piece * ((1 << 20) // len(piece)))], "page_id long, url string, html string")
    t = time.perf_counter()
    assert len(language.identify(pages, documents).collect()) == 1 and time.perf_counter() - t < 30


def test_bpe_of_chinese_texts():
    from tokenizers import Tokenizer

    from oddsmith.llm import bpe

    path = Q.vocabulary()
    codec, plain, r = bpe.Codec(path), Tokenizer.from_file(path), random.Random(4)
    some = [chr(r.randrange(0x4E00, 0xA000)) for _ in range(300)] + list("䷀鿿ア・한a1 é")
    texts = ["".join(r.choice(some) if r.random() < 0.92 else r.choice("。，、！？；：「」.,'s 　") for _ in range(r.choice([50, 600, 3000]))) for _ in range(200)]
    texts.append("".join(chr(r.randrange(0x5000, 0x9F00)) if r.random() < 0.95 else "。" for _ in range(100_000)))
    rows = list(bpe._rows(codec, pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), more=True))
    assert all(plain.encode(t, add_special_tokens=False).ids == ids.tolist() for t, (ids, _, _) in zip(texts, rows)) and rows[-1][1] > 100
