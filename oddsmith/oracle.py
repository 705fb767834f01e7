"""The same results in SQL for another engine, written from the definitions."""

from __future__ import annotations

_M = """
m AS (
  SELECT f.forecaster, f.e AS event_ticker, f.rnd AS round, f.category, f.close_time, f.snapshot_time, k.mkt,
    CAST((((f.e * 7 + f.r * 13 + f.rnd * 5 + k.mkt * 29) % 101) * (5 - f.r) + (CASE WHEN (f.e * 3 + k.mkt * 11) % 5 < 2 THEN 1 ELSE 0 END) * 100 * f.r) // 5 AS DOUBLE) / 100 AS p,
    CASE WHEN (f.e * 3 + k.mkt * 11) % 5 < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o,
    CAST(5 + (f.e * 17 + f.rnd * 3 + k.mkt * 31) % 91 AS DOUBLE) / 100 AS q,
    CAST(100 + (f.e + k.mkt) % 6 - 1 - (5 + (f.e * 17 + f.rnd * 3 + k.mkt * 31) % 91) AS DOUBLE) / 100 AS n
  FROM f JOIN (VALUES (0), (1), (2), (3)) AS k(mkt) ON k.mkt <= f.e % 4
)"""
_F = """
f AS (
  SELECT r.r_name AS forecaster, r.r_regionkey AS r, o.o_orderkey AS e, k.rnd, o.o_orderpriority AS category, o.o_orderdate AS close_time,
    o.o_orderdate - to_hours(CAST(1 + (o.o_orderkey + k.rnd * 7) % 60 AS INTEGER)) AS snapshot_time
  FROM orders o CROSS JOIN region r CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(rnd)
  WHERE (o.o_orderkey + r.r_regionkey * 3 + k.rnd) % 7 < 4
)"""
_D = """
d AS (
  SELECT forecaster, e, rnd FROM (
    SELECT *, row_number() OVER (PARTITION BY forecaster, e ORDER BY abs(rnd - md), rnd) AS k
    FROM (SELECT forecaster, e, rnd, median(rnd) OVER (PARTITION BY forecaster, e) AS md FROM f)
  ) WHERE k = 1
)"""
_L = """
l AS (SELECT m.*, max(q + n) OVER (PARTITION BY forecaster, event_ticker, round) AS spread FROM m),
x AS (SELECT l.* FROM l JOIN d ON l.forecaster = d.forecaster AND l.event_ticker = d.e AND l.round = d.rnd WHERE spread <= 1.03::DOUBLE)"""
_S = """
s AS (SELECT forecaster, event_ticker, round, category, close_time, CAST(count(*) AS DOUBLE) AS weight, avg((p - o) * (p - o)) AS score FROM x GROUP BY ALL)"""
_B = """
b AS (
  SELECT *, CASE WHEN p > q THEN p - q ELSE 1 - p - n END AS shares, CASE WHEN p > q THEN q ELSE n END AS price, CASE WHEN p > q THEN o = 1 ELSE o = 0 END AS won
  FROM x WHERE NOT (p >= 1 - n AND p <= q) AND p <> q
), t AS (
  SELECT forecaster, event_ticker, round, 1.0::DOUBLE AS weight, sum(shares * price) AS cost, sum((CASE WHEN won THEN shares ELSE 0 END) - shares * price) AS score
  FROM b GROUP BY forecaster, event_ticker, round
)"""
_E = """
e1 AS (SELECT event_ticker, min((forecaster, round)) AS pick FROM m GROUP BY event_ticker),
fe AS (SELECT l.* FROM l JOIN e1 ON l.event_ticker = e1.event_ticker AND l.forecaster = e1.pick[1] AND l.round = e1.pick[2])"""
_C = """
c0 AS (SELECT forecaster, event_ticker, CAST(epoch(snapshot_time) AS BIGINT) * 10 + round AS seq, category, close_time, snapshot_time, mkt, o, p AS u, p + 0.01::DOUBLE AS v, least(0.995::DOUBLE, greatest(0.005::DOUBLE, q)) AS q, least(0.995::DOUBLE, greatest(0.005::DOUBLE, n)) AS n FROM m),
c AS (
  SELECT *, CASE WHEN abs(sum(v) OVER w - 1) <= 1e-6 THEN v ELSE v / sum(v) OVER w END AS p, count(*) OVER w AS k, sum(o) OVER w AS wins
  FROM c0 WINDOW w AS (PARTITION BY forecaster, event_ticker, seq)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


_base = _with(_F, _M, _D, _L)
_brier = _with(_F, _M, _D, _L, _S)
_bet = _with(_F, _M, _D, _L, _B)
_event = _with(_F, _M, _D, _L, _E)
_chal = _with(_F, _M, _C)
_edges = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]::DOUBLE[]"


def _rank(source: str, score: str = "sum(score * weight) / sum(weight)", how: str = "", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"SELECT {cols}forecaster, round(v, 6) AS score, k AS n_predictions, rank() OVER ({part}ORDER BY round(v, 9) {how}) AS rank FROM (SELECT {cols}forecaster, {score} AS v, count(*) AS k FROM {source} GROUP BY {cols}forecaster)"


def _rule(score: str, weight: str = "") -> str:
    """Ordinal ranks of the challenge form; score: from the market rows of a forecast."""
    scaled = "v * pw" if weight else "v"
    join = "JOIN pw USING (event_ticker)" if weight else ""
    return (
        _chal
        + (f", {weight} " if weight else "")
        + f""", y AS (SELECT forecaster, event_ticker, seq, {score} AS v FROM c WHERE wins > 0 GROUP BY forecaster, event_ticker, seq),
g AS (SELECT forecaster, avg({scaled}) AS v, count(*) AS k, min(seq) AS seen FROM y {join} GROUP BY forecaster)
SELECT forecaster AS username, round(v, 6) AS score, k AS n_predictions, row_number() OVER (ORDER BY round(v, 9) DESC, seen, forecaster) AS rank FROM g"""
    )


_earn_tail = """
yl AS (SELECT forecaster, event_ticker, arg_max(v, seq) AS v, max(seq) AS seq FROM y GROUP BY ALL),
g AS (SELECT forecaster, avg(v) AS v, count(*) AS k, min(seq) AS seen FROM yl GROUP BY forecaster)
SELECT forecaster AS username, round(v, 6) AS score, k AS n_predictions, row_number() OVER (ORDER BY round(v, 9) DESC, seen, forecaster) AS rank FROM g"""
_last = ", yl AS (SELECT forecaster, event_ticker, arg_max(v, seq) AS v FROM y GROUP BY forecaster, event_ticker)"
_flip = """, z AS (SELECT *, (1 - u) / n - u / q > 1e-9 AS flip FROM c),
z2 AS (SELECT *, CASE WHEN flip THEN 1 - u ELSE u END AS fp, CASE WHEN flip THEN n ELSE q END AS fq, CASE WHEN flip THEN 1 - o ELSE o END AS fo FROM z)"""
_log_y = """y AS (SELECT forecaster, event_ticker, seq, sum(fp / fq * fo) / sum(fp / fq * fq) AS v FROM z2 GROUP BY forecaster, event_ticker, seq)"""
_z = "1.959963984540054::DOUBLE"
_skills = _chal.replace("WITH", "WITH RECURSIVE", 1) + """, b AS (SELECT forecaster, event_ticker, arg_max(p, seq) AS p FROM (SELECT forecaster, event_ticker, seq, coalesce(arg_min(p, mkt) FILTER (WHERE o = 1), 0) AS p FROM c WHERE wins > 0 GROUP BY ALL) GROUP BY ALL),
t AS (
  SELECT 0 AS it, forecaster, 1.0::DOUBLE AS th, 1e9::DOUBLE AS far FROM (SELECT DISTINCT forecaster FROM b)
  UNION ALL
  SELECT it + 1, forecaster, th2, max(abs(th2 - th)) OVER () FROM (
    SELECT it, forecaster, th, v * count(*) OVER () / sum(v) OVER () AS th2 FROM (
      SELECT any_value(it) AS it, forecaster, any_value(th) AS th, sum(CASE WHEN tp <> 0 THEN th * p / tp ELSE 0 END) / sum(1 / tt) AS v FROM (
        SELECT t.it, b.forecaster, t.th, b.p, sum(t.th * b.p) OVER e AS tp, sum(t.th) OVER e AS tt FROM b JOIN t ON t.forecaster = b.forecaster WHERE it < 100 AND far >= 1e-3 WINDOW e AS (PARTITION BY b.event_ticker)
      ) GROUP BY forecaster
    )
  )
)
"""


def _fill(p: str, q: str, source: str) -> str:
    """st: source with `stake`, the approximate stakes at a risk aversion of 0.5."""
    return f""", w1 AS (SELECT *, round(least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, {p})) / {q} - 1, 12) AS a, least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, {p})) * (1 - least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, {p}))) / ({q} * {q}) AS b FROM {source}),
w2 AS (SELECT *, first_value(a) OVER (PARTITION BY forecaster, event_ticker, seq ORDER BY mkt) AS a0, max(a) OVER (PARTITION BY forecaster, event_ticker, seq) AS top, arg_max(mkt, (a, -mkt)) OVER (PARTITION BY forecaster, event_ticker, seq) AS best, count(*) OVER (PARTITION BY forecaster, event_ticker, seq) AS kk FROM w1),
w3 AS (SELECT *, max(abs(a - a0)) OVER (PARTITION BY forecaster, event_ticker, seq) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(a0) AS alike,
  (sum(CASE WHEN a > 0 THEN a / b END) OVER s - 0.5::DOUBLE) / sum(CASE WHEN a > 0 THEN 1 / b END) OVER s AS lam, lead(a) OVER s AS next, row_number() OVER s AS pos FROM w2 WINDOW s AS (PARTITION BY forecaster, event_ticker, seq ORDER BY a DESC, mkt ROWS UNBOUNDED PRECEDING)),
w4 AS (SELECT *, min(CASE WHEN a > 0 AND (next IS NULL OR next <= 0 OR next <= lam) THEN pos END) OVER (PARTITION BY forecaster, event_ticker, seq) AS stop FROM w3),
w5 AS (SELECT *, max(CASE WHEN pos = stop THEN lam END) OVER (PARTITION BY forecaster, event_ticker, seq) AS level FROM w4),
w6 AS (SELECT *, CASE WHEN pos <= stop AND a > level THEN (a - level) / (0.5::DOUBLE * b) ELSE 0 END AS x FROM w5),
st AS (SELECT *, CASE WHEN alike THEN 1.0::DOUBLE / kk WHEN top <= 0 OR forecaster = 'market-baseline' THEN CASE WHEN mkt = best THEN 1 ELSE 0 END ELSE x / sum(x) OVER (PARTITION BY forecaster, event_ticker, seq) END AS stake FROM w6)"""


def _other_rule(how: str) -> str:
    return (
        _chal
        + f""", y AS (SELECT forecaster, event_ticker, seq, 1 - avg((p - o) * (p - o)) AS v FROM c WHERE wins > 0 GROUP BY forecaster, event_ticker, seq),
g AS (SELECT forecaster, {how} AS v, count(*) AS k, min(seq) AS seen FROM y GROUP BY forecaster)
SELECT forecaster AS username, round(v, 6) AS score, k AS n_predictions, row_number() OVER (ORDER BY round(v, 9) DESC, seen, forecaster) AS rank FROM g"""
    )


# Events that are not late where they arrive: `final` is the watermark at the end, `wm` that of a row's batch.
_arrived = """WITH e AS (SELECT *, floor((epoch_us(ts) / 1e6 + event_id % 97 * 3600) / 864000) AS arrival, epoch_us(ts) // 1000 AS ms FROM events),
m AS (SELECT arrival, max(ms) AS top FROM e GROUP BY arrival),
w AS (SELECT arrival, max(top) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 172800000 AS wm, max(top) OVER () - 172800000 AS final FROM m),
k AS (SELECT e.*, final FROM e JOIN w USING (arrival) WHERE wm IS NULL OR ms >= wm)"""


def _mixed(x: str, out: str) -> str:
    """Columns that end in `out`, the 32-bit finaliser of x."""
    low = "4294967295::UBIGINT"
    return f"{x} AS {out}0, xor({out}0, {out}0 >> 16) * 2246822507::UBIGINT & {low} AS {out}1, xor({out}1, {out}1 >> 13) * 3266489909::UBIGINT & {low} AS {out}2, xor({out}2, {out}2 >> 16) AS {out}"


def _draws(source: str, how: str = "mean") -> str:
    """ci: intervals of rows (forecaster, score, weight, cost) of whole weights: draw j of resample b takes the slot
    that its hash names, a row having as many slots as its weight. 1,000 resamples; the 950th least deviation; seed 42."""
    weyl, low = "2654435769::UBIGINT", "4294967295::UBIGINT"
    top, bottom = {"mean": ("s * w", "w"), "roi": ("s", "c")}[how]
    value = {"mean": "sum(top) / nullif(sum(low), 0)", "roi": "CASE WHEN sum(low) > 0 THEN sum(top) / sum(low) ELSE 0 END"}[how]
    point, cost = {"mean": ("sum(s * w) / sum(w)", "0.0::DOUBLE"), "roi": ("sum(s) / sum(c)", "cost")}[how]
    name = "CAST('0x' || substr(md5(forecaster), 1, 8) AS UBIGINT)"
    return f""", i AS (SELECT forecaster, round(score, 9) AS s, weight AS w, {cost} AS c FROM {source}),
sl AS MATERIALIZED (SELECT forecaster, row_number() OVER (PARTITION BY forecaster ORDER BY s, w, c) - 1 AS slot, {top} AS top, {bottom} AS low FROM (SELECT *, unnest(range(CAST(w AS BIGINT))) FROM i)),
st AS (SELECT forecaster, count(*) AS n, sum(w)::UBIGINT AS total FROM i GROUP BY forecaster),
sd AS (SELECT {_mixed("42::UBIGINT", "h")}),
k0 AS (SELECT forecaster, n, total, {_mixed(f"xor({name}, h)", "p")}, {_mixed("p", "q")} FROM st, sd),
k1 AS MATERIALIZED (SELECT forecaster, n, total, b, {_mixed(f"(b::UBIGINT * {weyl} + q + 1) & {low}", "a")}, {_mixed("xor(a, 1540483477::UBIGINT)", "z")} FROM k0, range(1000) AS r(b)),
dr AS (SELECT forecaster, b, total, {_mixed(f"(j::UBIGINT * {weyl} + a) & {low}", "u")}, {_mixed("xor(u, z)", "v")} FROM k1, LATERAL (SELECT unnest(range(n)) AS j)),
re AS (SELECT forecaster, b, {value} AS v FROM (SELECT forecaster, b, (v * total >> 32)::BIGINT AS slot FROM dr) JOIN sl USING (forecaster, slot) GROUP BY forecaster, b),
po AS (SELECT forecaster, {point} AS score, count(*) AS n_predictions FROM i GROUP BY forecaster),
ci AS (SELECT forecaster, any_value(score) AS score, any_value(n_predictions) AS n_predictions, stddev_samp(v) AS se, list_sort(list(abs(v - score)))[950] AS margin FROM re JOIN po USING (forecaster) GROUP BY forecaster)"""


def _resampled(source: str, how: str = "mean") -> str:
    return _draws(source, how) + """
SELECT forecaster, round(score, 6) AS score, round(se, 6) AS se, round(margin, 6) AS ci_margin, round(score - margin, 6) AS low, round(score + margin, 6) AS high, n_predictions FROM ci"""


_pw = """q0 AS (SELECT DISTINCT event_ticker, CAST(1 + event_ticker % 17 AS DOUBLE) AS a FROM c WHERE wins > 0),
q1 AS (SELECT quantile_cont(a, 0.25) AS lo, quantile_cont(a, 0.75) AS hi FROM q0),
q2 AS (SELECT event_ticker, greatest(lo, least(hi, a)) AS a FROM q0, q1),
pw AS (SELECT event_ticker, a * (SELECT count(*) FROM q2) / (SELECT sum(a) FROM q2) AS pw FROM q2)"""
_hours = "CAST(epoch_us(close_time) - epoch_us(snapshot_time) AS DOUBLE) / 3.6e9"
_bin = "CASE WHEN h < 3 THEN 0 WHEN h < 6 THEN 1 WHEN h < 12 THEN 2 WHEN h < 24 THEN 3 WHEN h < 48 THEN 4 ELSE 5 END"
_bin_name = "['0-3h', '3-6h', '6-12h', '12-24h', '24-48h', '48h+'][bin_ord + 1]"
_both_ranks = _with(_F, _M, _D, _L, _S, _B) + f""", ra AS ({_rank('s')}), rb AS ({_rank('t', 'sum(score) / sum(cost)', 'DESC')}),
r AS (SELECT ra.forecaster, ra.rank AS a, rb.rank AS b FROM ra JOIN rb USING (forecaster))
"""
_base_m = """
bl AS (SELECT event_ticker, round, min(forecaster) AS forecaster FROM m GROUP BY event_ticker, round),
m2 AS (
  SELECT forecaster, event_ticker, round, mkt, p, o, q, n FROM m
  UNION ALL SELECT 'market-baseline', m.event_ticker, m.round, mkt, q, o, q, n FROM m JOIN bl USING (event_ticker, round, forecaster)
),
f2 AS (SELECT DISTINCT forecaster, event_ticker, round FROM m2),
d2 AS (
  SELECT forecaster, event_ticker, round FROM (
    SELECT *, row_number() OVER (PARTITION BY forecaster, event_ticker ORDER BY abs(round - md), round) AS k
    FROM (SELECT *, median(round) OVER (PARTITION BY forecaster, event_ticker) AS md FROM f2)) WHERE k = 1
),
s2 AS (
  SELECT forecaster, event_ticker, round, CAST(count(*) AS DOUBLE) AS weight, avg((p - o) * (p - o)) AS score
  FROM m2 JOIN d2 USING (forecaster, event_ticker, round) GROUP BY ALL HAVING max(q + n) <= 1.03::DOUBLE
)"""


def _days(days: int, by: str = "") -> str:
    part, cols, using = (f"PARTITION BY {by}, day", f"{by}, ", f"USING ({by})") if by else ("PARTITION BY day", "", "ON true")
    same = f"s.{by} = g.{by} AND " if by else ""
    return (
        _brier
        + f""", sp AS (SELECT {cols}min(close_time) AS lo, (epoch_us(max(close_time)) - epoch_us(min(close_time))) // 86400000000 // {days} AS last FROM s {'GROUP BY ' + by if by else ''}),
cut AS (SELECT {cols}lo, unnest(range(0, last + 1)) AS k FROM sp),
g AS (SELECT {cols}k, lo + to_days(CAST(k * {days} AS INTEGER)) AS at FROM cut),
a AS (SELECT {('g.' + by + ', ') if by else ''}s.forecaster, g.k * {days} AS day, sum(score * weight) / sum(weight) AS v, count(*) AS n FROM g JOIN s ON {same}s.close_time <= g.at GROUP BY ALL)
SELECT {cols}forecaster, day, round(v, 6) AS score, n AS n_predictions, rank() OVER ({part} ORDER BY round(v, 9)) AS rank FROM a"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "brier_rank_event": _brier + _rank("s"),
        "brier_market_level": _base + _rank("x", "avg((p - o) * (p - o))"),
        "brier_by_category": _brier + f", u AS (SELECT category, forecaster, score, weight FROM s UNION ALL SELECT '(overall)', forecaster, score, weight FROM s) {_rank('u', by='category')}",
        "brier_normalized_by_round": _with(_F, _M, "l AS (SELECT forecaster, event_ticker, round, CAST(count(*) AS DOUBLE) AS w, avg((p - o) * (p - o)) AS score FROM m GROUP BY ALL HAVING max(q + n) <= 1.03::DOUBLE)", "s AS (SELECT forecaster, score, w / count(*) OVER (PARTITION BY forecaster, event_ticker) AS weight FROM l)") + _rank("s"),
        "market_brier_global": _event + "SELECT round(sum(((q - o) * (q - o) + (n - (1 - o)) * (n - (1 - o))) / 2) / count(*), 6) AS score, count(*) AS n_markets FROM fe WHERE spread <= 1.03::DOUBLE",
        "market_brier_per_forecaster": _event + ", ev AS (SELECT event_ticker, sum(((q - o) * (q - o) + (n - (1 - o)) * (n - (1 - o))) / 2) AS s, count(*) AS k FROM fe WHERE spread <= 1.03::DOUBLE GROUP BY event_ticker) SELECT forecaster, round(sum(s) / sum(k), 6) AS score FROM d JOIN ev ON d.e = ev.event_ticker GROUP BY forecaster",
        "market_brier_individualized": _base + ", y AS (SELECT l.* FROM l JOIN d ON l.forecaster = d.forecaster AND l.event_ticker = d.e AND l.round = d.rnd), s AS (SELECT forecaster, event_ticker, CAST(count(*) AS DOUBLE) AS weight, avg(CASE WHEN p > q THEN (q - o) * (q - o) ELSE (n - (1 - o)) * (n - (1 - o)) END) AS score FROM y GROUP BY forecaster, event_ticker HAVING NOT bool_or(p >= 1 - n AND p <= q)) " + _rank("s"),
        "market_distance": _base + "SELECT forecaster, round(avg(CASE WHEN p > q THEN (p - q) * (p - q) ELSE (1 - p - n) * (1 - p - n) END), 6) AS score, count(*) AS n_markets FROM x WHERE NOT (p >= 1 - n AND p <= q) GROUP BY forecaster",
        "market_baseline": _with(_F, _M, _base_m) + _rank("s2"),
        "individualized_baseline": _with(_F, _M, _base_m) + ", u AS (SELECT forecaster, score, weight FROM s2 UNION ALL SELECT r.forecaster || '-market-baseline', b.score, r.weight FROM s2 r JOIN s2 b ON b.forecaster = 'market-baseline' AND r.forecaster <> 'market-baseline' AND r.event_ticker = b.event_ticker AND r.round = b.round) " + _rank("u"),
        "avg_return_event": _bet + _rank("t", how="DESC"),
        "avg_return_market": _bet + _rank("b", "sum((CASE WHEN won THEN shares ELSE 0 END) - shares * price)", "DESC"),
        "roi_rank": _bet + _rank("t", "sum(score) / sum(cost)", "DESC"),
        "return_legacy_all_in": _base + ", y AS (SELECT l.*, greatest(p / q, (1 - p) / n) AS edge FROM l JOIN d ON l.forecaster = d.forecaster AND l.event_ticker = d.e AND l.round = d.rnd), s AS (SELECT forecaster, event_ticker, 1.0::DOUBLE AS weight, CASE WHEN p / q > (1 - p) / n THEN o / q ELSE (1 - o) / n END AS score FROM (SELECT *, row_number() OVER (PARTITION BY forecaster, event_ticker ORDER BY edge DESC, mkt) AS k FROM y) WHERE k = 1) " + _rank("s", how="DESC"),
        "return_legacy_even": _base + ", y AS (SELECT l.* FROM l JOIN d ON l.forecaster = d.forecaster AND l.event_ticker = d.e AND l.round = d.rnd), s AS (SELECT forecaster, event_ticker, 1.0::DOUBLE AS weight, avg(CASE WHEN p / q > (1 - p) / n THEN o / q ELSE (1 - o) / n END) AS score FROM y GROUP BY forecaster, event_ticker) " + _rank("s", how="DESC"),
        "sharpe_ratio": _bet + ", s AS (SELECT forecaster, score / cost AS v FROM t WHERE cost > 0) " + _rank("s", "avg(v) / stddev_samp(v)", "DESC"),
        "sharpe_ratio_by_round": _bet + ", s AS (SELECT forecaster, event_ticker, sum(score / cost * weight) / sum(weight) AS v FROM t WHERE cost > 0 GROUP BY forecaster, event_ticker) " + _rank("s", "avg(v) / stddev_samp(v)", "DESC"),
        "ece_uniform": _with(_F, _M) + f", y AS (SELECT forecaster, greatest(0, least(len(list_filter({_edges}, lambda e: p >= e)) - 1, 9)) AS bin, p, o FROM m), z AS (SELECT forecaster, bin, avg(p) AS a, avg(o) AS b, count(*) AS k FROM y GROUP BY ALL) SELECT forecaster, round(sum(abs(a - b) * k) / sum(k), 6) AS score FROM z GROUP BY forecaster",
        "ece_event_weighted": _with(_F, _M) + f", w0 AS (SELECT forecaster, p, o, 1.0::DOUBLE / count(*) OVER (PARTITION BY forecaster, event_ticker, round) AS w FROM m), w1 AS (SELECT *, w * count(*) OVER (PARTITION BY forecaster) / sum(w) OVER (PARTITION BY forecaster) AS ww FROM w0), y AS (SELECT forecaster, greatest(0, least(len(list_filter({_edges}, lambda e: p >= e)) - 1, 9)) AS bin, p, o, ww FROM w1), z AS (SELECT forecaster, bin, sum(p * ww) / sum(ww) AS a, sum(o * ww) / sum(ww) AS b, floor(round(sum(ww), 9)) AS k, count(*) AS n FROM y GROUP BY ALL) SELECT forecaster, round(sum(abs(a - b) * k) / sum(n), 3) AS score FROM z GROUP BY forecaster",
        "reliability_bins": _with(_F, _M) + f", y AS (SELECT forecaster, greatest(0, least(len(list_filter({_edges}, lambda e: p >= e)) - 1, 9)) AS bin, p, o FROM m) SELECT forecaster, bin, round(avg(p), 6) AS confidence, round(avg(o), 6) AS accuracy, count(*) AS count FROM y GROUP BY forecaster, bin",
        "ece_quantile": _with(_F, _M) + ", qs AS (SELECT forecaster, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM m GROUP BY forecaster), y AS (SELECT forecaster, greatest(0, least(len(list_filter(edges, lambda e: p >= e)) - 1, len(edges) - 2)) AS bin, p, o FROM m JOIN qs USING (forecaster)), z AS (SELECT forecaster, bin, avg(p) AS a, avg(o) AS b, count(*) AS k FROM y GROUP BY ALL) SELECT forecaster, round(sum(abs(a - b) * k) / sum(k), 6) AS score FROM z GROUP BY forecaster",
        "kish_ci": _brier + ", mu AS (SELECT forecaster, sum(score * weight) / sum(weight) AS m FROM s GROUP BY forecaster), y AS (SELECT forecaster, any_value(m) AS v, count(*) AS k, sum(weight) AS w, sum(weight) * sum(weight) / sum(weight * weight) AS ne, sum(weight * (score - m) * (score - m)) AS ss FROM s JOIN mu USING (forecaster) GROUP BY forecaster) SELECT forecaster, round(v, 6) AS score, k AS n_predictions, round(1.959963984540054 * sqrt(ss / w * ne / (ne - 1) / ne), 6) AS ci_margin, rank() OVER (ORDER BY round(v, 9)) AS rank FROM y",
        "time_rank": _with(_F) + "SELECT forecaster, e AS event_ticker, rnd AS round, CAST(rank() OVER (PARTITION BY forecaster, e ORDER BY rnd DESC) - 1 AS DOUBLE) AS time_rank FROM f",
        "first_n": _with(_F) + "SELECT forecaster, e AS event_ticker, rnd AS round FROM f QUALIFY row_number() OVER (PARTITION BY forecaster, e ORDER BY rnd) <= 2",
        "last_n": _with(_F) + "SELECT forecaster, e AS event_ticker, max(rnd) AS round FROM f GROUP BY forecaster, e",
        "exponential_weight": _with(_F) + ", y AS (SELECT forecaster, exp(-0.5 * (rank() OVER (PARTITION BY forecaster, e ORDER BY rnd DESC) - 1)) AS w FROM f) SELECT forecaster, round(sum(w), 6) AS weight, count(*) AS n FROM y GROUP BY forecaster",
        "time_to_last": _with(_F) + f"SELECT forecaster, e AS event_ticker, rnd AS round, round({_hours}, 6) AS hours FROM f WHERE {_hours} >= 6 AND {_hours} < 24",
        "time_bins": _with(_F) + f", y AS (SELECT forecaster, {_hours} AS h FROM f), z AS (SELECT *, {_bin} AS bin_ord FROM y) SELECT forecaster, bin_ord, {_bin_name} AS time_bin, count(*) AS n, round(avg(h), 6) AS mean_hours FROM z GROUP BY ALL",
        "median_round_dedup": _with(_F, _D) + "SELECT forecaster, e AS event_ticker, rnd AS round FROM d",
        "rule_brier": _rule("1 - avg((p - o) * (p - o))"),
        "rule_log": _rule("avg(ln(greatest(p, 0.01::DOUBLE))) FILTER (WHERE o = 1)"),
        "rule_spherical": _rule("sum(p * o) / sqrt(sum(p * p))"),
        "weighted_brier": _rule("1 - avg((p - o) * (p - o))", _pw),
        "rule_by_category": _chal + f", s AS (SELECT forecaster, event_ticker, seq, category, avg((p - o) * (p - o)) AS score, 1.0::DOUBLE AS weight FROM c WHERE wins > 0 GROUP BY ALL), u AS (SELECT category, forecaster, score, weight FROM s UNION ALL SELECT '(overall)', forecaster, score, weight FROM s) {_rank('u', by='category')}",
        "crowd_probs": _chal + "SELECT event_ticker AS problem_id, mkt AS option, round(avg(p), 6) AS crowd_prob FROM c GROUP BY ALL",
        "bets_neutral_stakes": _chal + ", y AS (SELECT forecaster, mkt, CASE WHEN row_number() OVER (PARTITION BY forecaster, event_ticker, seq ORDER BY round(p / q + 3.3e-10, 9) DESC, mkt) = 1 THEN 1 / q ELSE 0 END AS v FROM c) SELECT forecaster AS username, mkt AS option, round(avg(v), 6) AS bet, count(*) AS n FROM y GROUP BY forecaster, mkt",
        "bets_log_stakes": _chal + ", y AS (SELECT forecaster, mkt, p / q AS v FROM c) SELECT forecaster AS username, mkt AS option, round(avg(v), 6) AS bet, count(*) AS n FROM y GROUP BY forecaster, mkt",
        "bets_crra_stakes": _chal + ", y AS (SELECT forecaster, mkt, p * p / q / sum(p * p / q) OVER (PARTITION BY forecaster, event_ticker, seq) / q AS v FROM c) SELECT forecaster AS username, mkt AS option, round(avg(v), 6) AS bet, count(*) AS n FROM y GROUP BY forecaster, mkt",
        "avg_return_binary_reduction": _chal + _flip + ", y AS (SELECT forecaster, event_ticker, seq, fo / fq AS v FROM z2 QUALIFY row_number() OVER (PARTITION BY forecaster, event_ticker, seq ORDER BY round(fp / fq + 3.3e-10, 9) DESC, mkt) = 1)," + _earn_tail,
        "avg_return_binary_log": _chal + _flip + ", " + _log_y + "," + _earn_tail,
        "avg_return_market_two_way": _chal + ", y AS (SELECT forecaster, event_ticker, seq, avg(CASE WHEN o = 1 THEN u / q ELSE (1 - u) / n END) AS v FROM c GROUP BY forecaster, event_ticker, seq)," + _earn_tail,
        "sharpe_of_earnings": _chal + _flip + ", " + _log_y + _last + " SELECT forecaster AS username, round((avg(v) - 1) / (stddev_pop(v) + 1e-8), 6) AS score FROM yl GROUP BY forecaster",
        "spearman": _both_ranks + "SELECT round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS correlation FROM r",
        "kendall_tau_a": _both_ranks + "SELECT round(sum(CAST(sign(x.a - y.a) * sign(x.b - y.b) AS DOUBLE)) / any_value((SELECT count(*) * (count(*) - 1) / 2.0 FROM r)), 6) AS correlation FROM r x JOIN r y ON x.forecaster < y.forecaster",
        "stream_every_k_days": _days(180),
        "stream_every_k_days_by_category": _days(365, "category"),
        "stream_batches_cumulative": _chal + """, pr AS (SELECT event_ticker, (row_number() OVER (ORDER BY event_ticker) - 1) // 1000 AS batch FROM (SELECT DISTINCT event_ticker FROM c WHERE wins > 0)),
y AS (SELECT forecaster, batch, event_ticker, seq, 1 - avg((p - o) * (p - o)) AS v FROM c JOIN pr USING (event_ticker) GROUP BY ALL),
g AS (SELECT b.batch, y.forecaster, avg(v) AS v, count(*) AS n FROM (SELECT DISTINCT batch FROM y) b JOIN y ON y.batch <= b.batch GROUP BY ALL)
SELECT batch, forecaster AS username, round(v, 6) AS score, n, rank() OVER (PARTITION BY batch ORDER BY round(v, 9) DESC) AS rank FROM g""",
        "filter_min_counts": _with(_F) + ", y AS (SELECT e, forecaster || '/' || (e % 500) AS username FROM f), a AS (SELECT e FROM y GROUP BY e HAVING count(*) >= 12), b AS (SELECT username FROM y JOIN a USING (e)) SELECT username, count(*) AS n FROM b GROUP BY username HAVING count(*) >= 40",
        "num_markets_distribution": _with(_F) + "SELECT e % 4 + 1 AS num_markets, count(*) AS n_events FROM (SELECT DISTINCT e FROM f) GROUP BY ALL",
        "brier_by_num_markets": _brier + "SELECT CAST(weight AS INTEGER) AS num_markets, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(stddev_samp(score) / sqrt(count(*)), 6) AS sem FROM s GROUP BY ALL",
        "dilution_regression": _base + ", y AS (SELECT forecaster, event_ticker, avg(o) AS g, avg((p - o) * (p - o)) AS v FROM x GROUP BY ALL) SELECT forecaster, round(regr_slope(v, g), 6) AS slope, round(regr_intercept(v, g), 6) AS intercept, round(regr_r2(v, g), 6) AS r2, count(*) AS n FROM y GROUP BY forecaster",
        "score_over_round": _with(_F, _M) + ", a AS (SELECT forecaster, event_ticker, round, avg((p - o) * (p - o)) AS v FROM m GROUP BY ALL), b AS (SELECT forecaster, round, avg(v) AS v FROM a GROUP BY ALL) SELECT forecaster, (round - 1) // 2 AS bucket, round(avg(v), 6) AS score FROM b GROUP BY ALL",
        "score_over_time_bins": _with(_F, _M) + f", a AS (SELECT forecaster, event_ticker, round, {_hours} AS h, avg((p - o) * (p - o)) AS v FROM m GROUP BY ALL), z AS (SELECT *, {_bin} AS bin_ord FROM a) SELECT forecaster, bin_ord, {_bin_name} AS time_bin, round(avg(v), 6) AS score, count(*) AS n FROM z GROUP BY ALL",
        "gap_histogram": _with(_F) + f"SELECT CAST(floor({_hours} / 5) AS BIGINT) AS bin, count(*) AS n, round(avg({_hours}), 6) AS mean_hours FROM f GROUP BY ALL",
        "rebalanced_events": _with(_F) + """, ev AS (SELECT DISTINCT e, category FROM f), q(category, share) AS (VALUES ('1-URGENT', 0.4::DOUBLE), ('2-HIGH', 0.3::DOUBLE), ('3-MEDIUM', 0.2::DOUBLE), ('5-LOW', 0.1::DOUBLE)),
n AS (SELECT min(CAST(floor(k / share) AS BIGINT)) AS lowest FROM (SELECT category, share, (SELECT count(*) FROM ev WHERE ev.category = q.category) AS k FROM q)),
o AS (SELECT e, category, share, row_number() OVER (PARTITION BY category ORDER BY (e * 48271 + 7) % 1000003, e) AS k FROM ev JOIN q USING (category)),
kept AS (SELECT e, category FROM o, n WHERE k <= CAST(floor(lowest * share) AS BIGINT))
SELECT category, count(*) AS n_events, CAST(sum(e * (SELECT count(*) FROM f WHERE f.e = kept.e)) AS BIGINT) AS id_sum FROM kept GROUP BY category""",
        "json_props_parse": "SELECT event_type, count(CAST(json_extract(props, '$.k') AS BIGINT)) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
        "live_windows": "SELECT date_trunc('day', ts) AS window_start, event_type AS forecaster, round(sum(value) / count(*), 6) AS score, count(*) AS n FROM events GROUP BY ALL",
        "problem_violations": _with(_F, _M) + "SELECT 'weight is negative' AS rule, count(*) AS n FROM (SELECT DISTINCT forecaster, event_ticker, round FROM m WHERE event_ticker % 10 = 3)",
        "rule_median": _chal + """, y AS (SELECT forecaster, event_ticker, seq, 1 - avg((p - o) * (p - o)) AS v FROM c WHERE wins > 0 GROUP BY forecaster, event_ticker, seq),
g AS (SELECT forecaster, median(v) AS v, count(*) AS k, min(seq) AS seen FROM y GROUP BY forecaster)
SELECT forecaster AS username, round(v, 6) AS score, k AS n_predictions, row_number() OVER (ORDER BY round(v, 9) DESC, seen, forecaster) AS rank FROM g""",
        "first_option_brier": _chal + """, y AS (SELECT forecaster, event_ticker, seq, arg_min(p, mkt) FILTER (WHERE o = 1) AS p FROM c WHERE wins > 0 GROUP BY forecaster, event_ticker, seq),
g AS (SELECT forecaster, avg((1 - p) * (1 - p)) AS v, count(*) AS k, min(seq) AS seen FROM y GROUP BY forecaster)
SELECT forecaster AS username, round(v, 6) AS score, k AS n_predictions, row_number() OVER (ORDER BY round(v, 9), seen, forecaster) AS rank FROM g""",
        "avg_return_event_bets": _chal + ", y AS (SELECT forecaster, event_ticker, seq, sum(u / q * o) AS v FROM c GROUP BY forecaster, event_ticker, seq)," + _earn_tail,
        "calibration_ranking": _chal + f", y AS (SELECT forecaster, greatest(0, least(len(list_filter({_edges}, lambda e: u >= e)) - 1, 9)) AS bin, u, o FROM c), z AS (SELECT forecaster, bin, avg(u) AS a, avg(o) AS b, count(*) AS k FROM y GROUP BY ALL), r AS (SELECT forecaster, sum(abs(a - b) * k) / sum(k) AS v FROM z GROUP BY forecaster) SELECT forecaster AS username, round(v, 6) AS score, row_number() OVER (ORDER BY round(v, 9), forecaster) - 1 AS rank FROM r",
        "reliability_details": _with(_F, _M) + f", y AS (SELECT forecaster, greatest(0, least(len(list_filter({_edges}, lambda e: p >= e)) - 1, 9)) AS bin, p, o FROM m) SELECT forecaster, bin, round(avg(p), 6) AS confidence, round(avg(o), 6) AS accuracy, count(*) AS count, round((bin + 0.5::DOUBLE) / 10, 6) AS center, 0.1::DOUBLE AS width, round(count(*) / sum(count(*)) OVER (PARTITION BY forecaster), 6) AS share FROM y GROUP BY forecaster, bin",
        "correlation_grid": _chal + """, y AS (SELECT forecaster, event_ticker, seq, 1 - avg((p - o) * (p - o)) AS brier, avg(ln(greatest(p, 0.01::DOUBLE))) FILTER (WHERE o = 1) AS log, sum(p * o) / sqrt(sum(p * p)) AS spherical FROM c WHERE wins > 0 GROUP BY forecaster, event_ticker, seq),
g AS (UNPIVOT (SELECT forecaster, avg(brier) AS brier, avg(log) AS log, avg(spherical) AS spherical FROM y GROUP BY forecaster) ON brier, log, spherical INTO NAME method VALUE v),
s AS (SELECT forecaster, min(seq) AS seen FROM y GROUP BY forecaster),
r AS (SELECT method, forecaster, CAST(row_number() OVER (PARTITION BY method ORDER BY round(v, 9) DESC, seen, forecaster) AS DOUBLE) AS rank FROM g JOIN s USING (forecaster)),
ab AS (SELECT a.method AS method_a, b.method AS method_b, forecaster, a.rank AS a, b.rank AS b FROM r a JOIN r b USING (forecaster) WHERE a.method < b.method),
sp AS (SELECT method_a, method_b, count(*) AS n, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS rho FROM ab GROUP BY ALL),
kt AS (SELECT x.method_a, x.method_b, CAST(sum(sign(x.a - y.a) * sign(x.b - y.b)) AS DOUBLE) AS t FROM ab x JOIN ab y ON x.method_a = y.method_a AND x.method_b = y.method_b AND x.forecaster < y.forecaster GROUP BY ALL)
SELECT method_a, method_b, n, round(rho, 6) AS spearman, round(t / (n * (n - 1) / 2), 6) AS kendall FROM sp JOIN kt USING (method_a, method_b)""",
        "dilution_correlation": _event + """, e AS (SELECT event_ticker, CAST(count(*) AS DOUBLE) AS x, avg(o) AS y FROM fe GROUP BY event_ticker),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM e),
c AS (SELECT count(*) AS n, corr(x, y) AS a, corr(rx, ry) AS b FROM r)
SELECT n, CASE WHEN abs(a) < 5e-7 THEN 0.0::DOUBLE ELSE round(a, 6) END AS pearson, CASE WHEN abs(b) < 5e-7 THEN 0.0::DOUBLE ELSE round(b, 6) END AS spearman FROM c""",
        "dilution_band": _base + """, y AS (SELECT forecaster, event_ticker, avg(o) AS g, avg((p - o) * (p - o)) AS v FROM x GROUP BY ALL),
s AS (SELECT regr_count(v, g) AS n, regr_slope(v, g) AS k, regr_intercept(v, g) AS c, regr_avgx(v, g) AS mx, regr_sxx(v, g) AS sxx, regr_syy(v, g) AS syy FROM y)
SELECT t.x AS x, round(c + k * t.x, 6) AS fit, round(1.96::DOUBLE * sqrt((syy - k * k * sxx) / (n - 2) * (1.0::DOUBLE / n + (t.x - mx) * (t.x - mx) / sxx)), 6) AS margin FROM s, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS x) t""",
        "market_count_bins": _event + ", e AS (SELECT event_ticker, count(*) AS k, avg(o) AS y FROM fe GROUP BY event_ticker) SELECT ['(0, 1]', '(1, 2]', '(2, 3]', '(3, inf]'][k] AS market_bin, count(*) AS n_events, round(avg(y), 6) AS mean_dilution FROM e GROUP BY ALL",
        "market_scatter": _with(_F, _M, _base_m) + """, b1 AS (SELECT event_ticker, min(round) AS round FROM f2 WHERE forecaster = 'market-baseline' GROUP BY event_ticker), e1 AS (SELECT event_ticker, min(round) AS round FROM f2 WHERE forecaster = 'EUROPE' GROUP BY event_ticker),
bm AS (SELECT m2.* FROM m2 JOIN b1 USING (event_ticker, round) WHERE forecaster = 'market-baseline' AND o = 1), em AS (SELECT m2.* FROM m2 JOIN e1 USING (event_ticker, round) WHERE forecaster = 'EUROPE')
SELECT event_ticker, mkt AS market_index, round(bm.p, 6) AS market_prob, round(em.p, 6) AS model_prob FROM bm JOIN em USING (event_ticker, mkt) WHERE bm.p BETWEEN 0.01::DOUBLE AND 0.99::DOUBLE AND em.p BETWEEN 0.01::DOUBLE AND 0.99::DOUBLE""",
        "event_rollup": _brier + "SELECT event_ticker, CAST(max(weight) AS INTEGER) AS num_markets, round(avg(score), 6) AS mean_score, count(*) AS n FROM s GROUP BY event_ticker",
        "gap_bins": _with(_F) + f"SELECT CAST(least(50, floor({_hours} / 2) + 1) AS BIGINT) AS bin, count(*) AS n FROM f WHERE {_hours} BETWEEN 0 AND 100 GROUP BY ALL",
        "frequent_forecasters": _with(_F) + "SELECT forecaster || '/' || (e % 97) AS forecaster, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 36",
        "dataset_counts": _with(_F) + "SELECT (SELECT count(DISTINCT forecaster) FROM f) AS n_forecasters, (SELECT count(*) FROM f) AS n_submissions, count(*) AS n_events, CAST(sum(e % 4 + 1) AS BIGINT) AS n_markets FROM (SELECT DISTINCT e FROM f)",
        "time_bin_pivot": _with(_F) + f", y AS (SELECT forecaster, {_hours} AS h FROM f), z AS (SELECT *, {_bin} AS k FROM y) SELECT forecaster, " + ", ".join(f"count(*) FILTER (WHERE k = {k}) AS bin_{k}" for k in range(6)) + " FROM z GROUP BY forecaster",
        "stream_roi_every_k_days": _bet + """, s AS (SELECT t.*, o.o_orderdate AS close_time FROM t JOIN orders o ON o.o_orderkey = t.event_ticker),
sp AS (SELECT min(close_time) AS lo, (epoch_us(max(close_time)) - epoch_us(min(close_time))) // 86400000000 // 180 AS last FROM s),
g AS (SELECT k, lo + to_days(CAST(k * 180 AS INTEGER)) AS at FROM (SELECT lo, unnest(range(0, last + 1)) AS k FROM sp)),
a AS (SELECT s.forecaster, g.k * 180 AS day, sum(score) / sum(cost) AS v, count(*) AS n FROM g JOIN s ON s.close_time <= g.at GROUP BY ALL)
SELECT forecaster, day, round(v, 6) AS score, n AS n_predictions, rank() OVER (PARTITION BY day ORDER BY round(v, 9) DESC) AS rank FROM a""",
        "sql_functions": _with(_F, _M) + "SELECT forecaster, round(avg(v), 6) AS score, count(*) AS n FROM (SELECT forecaster, event_ticker, round, avg((p - o) * (p - o)) AS v FROM m GROUP BY ALL HAVING max(q + n) <= 1.03::DOUBLE) GROUP BY forecaster",
        "live_sessions": """WITH a AS (SELECT event_type, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, event_type AS forecaster, round(avg(value), 6) AS score, count(*) AS n FROM b GROUP BY event_type, g""",
        "stream_over_time_buckets": _with(_F).replace("WITH", "WITH RECURSIVE", 1) + """, c AS (SELECT d, count(*) AS n FROM (SELECT DISTINCT e, CAST(close_time AS DATE) AS d FROM f) GROUP BY d),
x AS (SELECT min(d) AS first, max(d) AS last FROM c),
w AS (
  SELECT first - 1 AS lo, first + 7 AS hi, (SELECT sum(n) FROM c WHERE d <= (SELECT first + 7 FROM x)) AS held FROM x
  UNION ALL
  SELECT v.lo, v.hi, coalesce((SELECT sum(n) FROM c WHERE d > v.lo AND d <= v.hi), 0)
  FROM (SELECT CASE WHEN held >= 50 THEN hi ELSE lo END AS lo, hi + 7 AS hi FROM w, x WHERE hi < x.last) v
)
SELECT hi AS window_end, CAST(held AS BIGINT) AS n_problems FROM w, x WHERE held >= 50 OR (hi >= x.last AND held > 0)""",
        "crra_waterfill": _chal + _fill("p", "q", "c") + " SELECT forecaster AS username, event_ticker AS problem_id, seq AS forecast_seq, mkt AS option, round(stake, 6) AS stake FROM st",
        "avg_return_binary_approx": _chal + _flip + _fill("fp", "fq", "z2") + ", y AS (SELECT forecaster, event_ticker, seq, sum(stake / fq * fo) / sum(stake / fq * fq) AS v FROM st GROUP BY forecaster, event_ticker, seq)," + _earn_tail,
        "avg_return_binary_baseline": _chal + """, ca AS (SELECT forecaster, event_ticker, seq, mkt, o, u, q, n FROM c UNION ALL SELECT 'market-baseline', event_ticker, -1, mkt, any_value(o), avg(q), avg(q), avg(n) FROM c GROUP BY event_ticker, mkt)""" + _flip.replace("FROM c)", "FROM ca)").replace("(1 - u) / n -", "(1 - u) / CASE WHEN forecaster = 'market-baseline' THEN 1 - q ELSE n END -") + _fill("fp", "fq", "z2") + ", y AS (SELECT forecaster, event_ticker, seq, sum(stake / fq * fo) / sum(stake / fq * fq) AS v FROM st GROUP BY forecaster, event_ticker, seq)," + _earn_tail,
        "sharpe_relative": _chal + _flip + ", " + _log_y + _last + ", r AS (SELECT y.forecaster, y.v - b.v AS v FROM yl AS y JOIN yl AS b ON b.event_ticker = y.event_ticker AND b.forecaster = 'EUROPE') SELECT forecaster AS username, round(avg(v) / (stddev_pop(v) + 1e-8), 6) AS score FROM r GROUP BY forecaster",
        "rule_max": _other_rule("max(v)"),
        "rule_own_aggregate": _other_rule("quantile_cont(v, 0.9)"),
        "rank_auto": _brier + _rank("s", "avg(score)"),
        "problems_of_forecaster": _chal + " SELECT category, count(*) AS n, CAST(sum(event_ticker) AS BIGINT) AS id_sum FROM (SELECT DISTINCT event_ticker, category FROM c WHERE forecaster = 'EUROPE') GROUP BY category",
        "first_problems": _chal + " SELECT event_ticker AS problem_id, CAST(k AS INTEGER) AS n_options, category FROM (SELECT DISTINCT event_ticker, k, category FROM c) ORDER BY event_ticker LIMIT 50",
        "stream_roi_by_category": _bet + """, s AS (SELECT t.*, o.o_orderdate AS close_time, o.o_orderpriority AS category FROM t JOIN orders o ON o.o_orderkey = t.event_ticker),
sp AS (SELECT category, min(close_time) AS lo, (epoch_us(max(close_time)) - epoch_us(min(close_time))) // 86400000000 // 365 AS last FROM s GROUP BY category),
g AS (SELECT category, k, lo + to_days(CAST(k * 365 AS INTEGER)) AS at FROM (SELECT category, lo, unnest(range(0, last + 1)) AS k FROM sp)),
a AS (SELECT s.category, s.forecaster, g.k * 365 AS day, sum(score) / sum(cost) AS v, count(*) AS n FROM g JOIN s ON s.category = g.category AND s.close_time <= g.at GROUP BY ALL)
SELECT category, forecaster, day, round(v, 6) AS score, n AS n_predictions, rank() OVER (PARTITION BY category, day ORDER BY round(v, 9) DESC) AS rank FROM a""",
        "load_nightly": _with(_F, _M) + """, y AS (SELECT forecaster, event_ticker, round, category, any_value(close_time) AS close_time, sum(q + n) AS asks, count(*) AS k FROM m WHERE forecaster <> 'ASIA' GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY forecaster, event_ticker ORDER BY round DESC) - 1 AS tr FROM y)
SELECT forecaster, category, count(*) AS n, round(sum(asks), 5) AS asks, CAST(sum(k) AS BIGINT) AS n_markets, round(avg(tr), 5) AS time_rank, max(close_time) AS last_close FROM z GROUP BY forecaster, category""",
        "load_json_challenge": _chal + """, y AS (SELECT forecaster, event_ticker, seq, any_value(close_time) AS close_time, 1 - sum((p - CASE WHEN mkt = fw THEN 1 ELSE 0 END) ** 2) / any_value(k) AS v FROM (SELECT *, min(CASE WHEN o = 1 THEN mkt END) OVER (PARTITION BY forecaster, event_ticker, seq) AS fw FROM c) WHERE wins > 0 GROUP BY forecaster, event_ticker, seq)
SELECT forecaster AS username, round(avg(v), 6) AS score, count(*) AS n, max(CAST(close_time AS DATE)) AS last_end FROM y GROUP BY forecaster""",
        "load_csv_challenge": _chal + """, f1 AS (SELECT forecaster, event_ticker, seq, any_value(wins) AS wins, arg_min(q, mkt) AS q, arg_min(n, mkt) AS n, arg_min(u, mkt) AS u FROM c GROUP BY forecaster, event_ticker, seq),
b AS (SELECT 'market-baseline' AS forecaster, event_ticker, 0 AS seq, any_value(wins) AS wins, avg(q) AS q, avg(n) AS n, avg(q) AS u FROM f1 GROUP BY event_ticker)
SELECT forecaster AS username, count(*) AS n, CAST(sum(wins) AS BIGINT) AS n_won, round(avg(q), 6) AS odds, round(avg(n), 6) AS no_odds, round(avg(u), 6) AS said FROM (FROM f1 UNION ALL FROM b) GROUP BY forecaster""",
        "dilution_regression_full": _base + f""", y AS (SELECT forecaster, event_ticker, avg(o) AS g, CAST(count(*) AS DOUBLE) AS k, avg((p - o) * (p - o)) AS v FROM x GROUP BY ALL),
a AS (SELECT *, avg(g) OVER w AS mg, avg(k) OVER w AS mk, avg(v) OVER w AS mv FROM y WINDOW w AS (PARTITION BY forecaster)),
s AS (SELECT forecaster, count(*) AS n, any_value(mg) AS mg, any_value(mk) AS mk, any_value(mv) AS mv, sum((g - mg) ** 2) AS gg, sum((k - mk) ** 2) AS kk, sum((g - mg) * (k - mk)) AS gk, sum((g - mg) * (v - mv)) AS gv, sum((k - mk) * (v - mv)) AS kv, sum((v - mv) ** 2) AS vv FROM a GROUP BY forecaster),
b AS (SELECT *, gg * kk - gk * gk AS det, (gv * kk - kv * gk) / (gg * kk - gk * gk) AS b1, (kv * gg - gv * gk) / (gg * kk - gk * gk) AS b2, CAST(n - 3 AS DOUBLE) AS df FROM s),
e AS (SELECT *, vv - b1 * gv - b2 * kv AS sse FROM b),
t AS (
  SELECT forecaster, 'intercept' AS term, mv - b1 * mg - b2 * mk AS b, sqrt(sse / df * (1.0::DOUBLE / n + (mg * mg * kk + mk * mk * gg - 2 * mg * mk * gk) / det)) AS se FROM e
  UNION ALL SELECT forecaster, 'dilution', b1, sqrt(sse / df * kk / det) FROM e
  UNION ALL SELECT forecaster, 'num_markets', b2, sqrt(sse / df * gg / det) FROM e
),
u AS (SELECT t.*, e.n, df, 1 - sse / vv AS r2, (vv - sse) / 2 / (sse / df) AS f, least(abs(b / se), 60.0::DOUBLE) AS z, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c FROM t JOIN e USING (forecaster)),
-- Simpson's rule for the p-value; the quantile by its expansion around the normal one
v AS (SELECT *, 1 - 2 * c * z / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (i * z / 4000) ** 2 / df) ** (-(df + 1) / 2))) AS p,
  {_z} + ({_z} ** 3 + {_z}) / (4 * df) + (5 * {_z} ** 5 + 16 * {_z} ** 3 + 3 * {_z}) / (96 * df ** 2) + (3 * {_z} ** 7 + 19 * {_z} ** 5 + 17 * {_z} ** 3 - 15 * {_z}) / (384 * df ** 3) AS q FROM u)
SELECT forecaster, term, round(b, 6) AS estimate, round(se, 6) AS se, round(greatest(p, 0), 6) AS p_value, round(b - q * se, 6) AS low, round(b + q * se, 6) AS high, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / df, 6) AS adjusted_r2, round(f, 6) AS f_statistic, round((1 + 2 * f / df) ** (-df / 2), 6) AS f_p_value, n FROM v""",
        "stream_windows_by_category": _chal.replace("WITH", "WITH RECURSIVE", 1) + """, dd AS (SELECT category, d, count(*) AS n FROM (SELECT DISTINCT event_ticker, category, CAST(close_time AS DATE) AS d FROM c WHERE wins > 0) GROUP BY ALL),
x AS (SELECT category, min(d) AS first, max(d) AS last FROM dd GROUP BY category),
w AS (
  SELECT category, first - 1 AS lo, first + 30 AS hi, (SELECT sum(n) FROM dd WHERE dd.category = x.category AND d <= first + 30) AS held FROM x
  UNION ALL
  SELECT v.category, v.lo, v.hi, coalesce((SELECT sum(n) FROM dd WHERE dd.category = v.category AND d > v.lo AND d <= v.hi), 0)
  FROM (SELECT w.category, CASE WHEN held >= 200 THEN hi ELSE lo END AS lo, hi + 30 AS hi FROM w JOIN x ON x.category = w.category WHERE hi < x.last) v
),
ww AS (SELECT w.* FROM w JOIN x ON x.category = w.category WHERE held >= 200 OR (hi >= x.last AND held > 0)),
y AS (SELECT forecaster, event_ticker, seq, category, CAST(any_value(close_time) AS DATE) AS d, 1 - avg((p - o) * (p - o)) AS v FROM c WHERE wins > 0 GROUP BY forecaster, event_ticker, category, seq),
pt AS (SELECT y.category, hi, forecaster, sum(v) AS s, count(*) AS k FROM y JOIN ww ON ww.category = y.category AND d > lo AND d <= hi GROUP BY ALL),
us AS (SELECT category, forecaster, min(hi) AS since FROM pt GROUP BY ALL), lb AS (SELECT DISTINCT category, hi FROM pt),
r AS (SELECT lb.category, lb.hi, us.forecaster, sum(s) / sum(k) AS v, CAST(sum(k) AS BIGINT) AS n FROM lb JOIN us ON us.category = lb.category AND since <= lb.hi JOIN pt ON pt.category = lb.category AND pt.forecaster = us.forecaster AND pt.hi <= lb.hi GROUP BY ALL)
SELECT category, hi AS window_end, forecaster AS username, round(v, 6) AS score, n, rank() OVER (PARTITION BY category, hi ORDER BY round(v, 9) DESC) AS rank FROM r""",
        "live_daily_totals": _arrived + """, d AS (SELECT user_id, ms // 86400000 AS day, sum(value) AS s, count(*) AS n, any_value(final) AS final FROM k GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS forecaster, DATE '1970-01-01' + CAST(day AS INTEGER) AS day, round(sum(s) OVER u / sum(n) OVER u, 6) AS score, CAST(sum(n) OVER u AS BIGINT) AS n
FROM d WHERE (day + 1) * 86400000 <= final WINDOW u AS (PARTITION BY user_id ORDER BY day)""",
        "live_first_forecasts": _arrived + """, f AS (SELECT user_id || '/' || event_type AS forecast_id, any_value(final) AS final, min({'t': epoch_us(ts), 'seq': event_id, 'score': value}) AS b FROM k GROUP BY ALL)
SELECT forecast_id, b.seq AS seq, b.score AS score FROM f WHERE b.t // 1000 + 1 <= final""",
        "json_repair_props": "SELECT event_type, event_id % 6 AS damage, count(k) AS n, CAST(sum(k) AS BIGINT) AS k_sum, CAST(sum(CASE WHEN event_id % 6 = 4 THEN 2 ELSE 0 END) AS BIGINT) AS \"left\", count(*) FILTER (event_id % 6 = 5) AS notes FROM (SELECT event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL",
        "sql_stakes": _chal + ", y AS (SELECT forecaster, mkt, q, p * p / q / sum(p * p / q) OVER (PARTITION BY forecaster, event_ticker, seq) AS v FROM c) SELECT forecaster AS username, mkt AS option, round(avg(v), 6) AS stake, round(avg(v / q), 6) AS bet, count(*) AS n FROM y GROUP BY forecaster, mkt",
        "paged_source": "SELECT page_id // 100 AS page, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS id_sum, CAST(sum(length(html)) AS BIGINT) AS n_chars, max(url) AS last_url FROM pages GROUP BY ALL",
        "gap_statistics": _with(_F) + f", y AS (SELECT forecaster, {_hours} AS h FROM f), z AS (SELECT *, {_bin} AS bin_ord FROM y) SELECT {_bin_name} AS time_bin, count(*) AS n, round(avg(h), 6) AS mean, round(median(h), 6) AS median, round(min(h), 6) AS low, round(max(h), 6) AS high FROM z GROUP BY ALL",
        "event_mean_by_num_markets": _base + ", y AS (SELECT event_ticker, forecaster, count(*) AS num_markets, avg((p - o) * (p - o)) AS v FROM x GROUP BY ALL), e AS (SELECT event_ticker, num_markets, avg(v) AS v FROM y GROUP BY ALL) SELECT CAST(num_markets AS INTEGER) AS num_markets, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM e GROUP BY num_markets",
        "return_curves": _chal + _flip + """, y AS (
  SELECT 0.0::DOUBLE AS g, forecaster, event_ticker, seq, fo / fq AS v FROM z2 QUALIFY row_number() OVER (PARTITION BY forecaster, event_ticker, seq ORDER BY round(fp / fq + 3.3e-10, 9) DESC, mkt) = 1
  UNION ALL SELECT 0.5, forecaster, event_ticker, seq, sum(fp * fp / fq / fq * fo) / sum(fp * fp / fq) FROM z2 GROUP BY forecaster, event_ticker, seq
  UNION ALL SELECT 1.0, forecaster, event_ticker, seq, sum(fp / fq * fo) / sum(fp / fq * fq) FROM z2 GROUP BY forecaster, event_ticker, seq),
yl AS (SELECT g, forecaster, event_ticker, arg_max(v, seq) AS v FROM y GROUP BY ALL),
pr AS (SELECT event_ticker, (row_number() OVER (ORDER BY event_ticker) - 1) // 500 AS batch FROM (SELECT DISTINCT event_ticker FROM c)),
pa AS (SELECT g, forecaster, batch, sum(v) AS s, count(*) AS n FROM yl JOIN pr USING (event_ticker) GROUP BY ALL),
cu AS (SELECT pa.g AS risk_aversion, b.batch, pa.forecaster, sum(s) / sum(n) AS v, CAST(sum(n) AS BIGINT) AS n FROM (SELECT DISTINCT batch FROM pr) AS b JOIN pa ON pa.batch <= b.batch GROUP BY ALL)
SELECT risk_aversion, batch, forecaster AS username, round(v, 6) AS score, n, rank() OVER (PARTITION BY risk_aversion, batch ORDER BY round(v, 9) DESC) AS rank FROM cu""",
        "rank_with_interval": _with(_F, _M, _base_m) + """, mu AS (SELECT forecaster, sum(score * weight) / sum(weight) AS m FROM s2 GROUP BY forecaster),
y AS (SELECT forecaster, any_value(m) AS v, count(*) AS k, sum(weight) AS w, sum(weight) * sum(weight) / sum(weight * weight) AS ne, sum(weight * (score - m) * (score - m)) AS ss FROM s2 JOIN mu USING (forecaster) GROUP BY forecaster)
SELECT rank() OVER (ORDER BY round(v, 9)) AS rank, forecaster, round(v, 6) AS score, '±' || printf('%.4f', 1.6448536269514722 * sqrt(ss / w * ne / (ne - 1) / ne)) AS "90.0% ci", k AS "# predictions" FROM y""",
        "rank_with_bootstrap": _brier.rstrip() + _draws("(SELECT forecaster, 1.0::DOUBLE AS weight, (p - o) * (p - o) AS score FROM x)") + """, g AS (SELECT forecaster, sum(score * weight) / sum(weight) AS v, count(*) AS k FROM s GROUP BY forecaster)
SELECT rank() OVER (ORDER BY round(v, 9)) AS rank, g.forecaster AS forecaster, round(v, 6) AS score, '±' || printf('%.4f', margin) AS "95.0% ci", k AS "# predictions" FROM g JOIN ci ON ci.forecaster = g.forecaster""",
        "rank_finished": _with(_F, _M) + f", y AS (SELECT forecaster, greatest(0, least(len(list_filter({_edges}, lambda e: p >= e)) - 1, 9)) AS bin, p, o FROM m), z AS (SELECT forecaster, bin, avg(p) AS a, avg(o) AS b, count(*) AS k FROM y GROUP BY ALL), r AS (SELECT forecaster, sum(abs(a - b) * k) / sum(k) AS v FROM z GROUP BY forecaster) SELECT rank() OVER (ORDER BY round(v, 9)) AS rank, forecaster, round(v, 6) AS score FROM r",
        "bootstrap_ci": _brier.rstrip() + _resampled("s"),
        "bootstrap_market_level": _base.rstrip() + _resampled("(SELECT forecaster, 1.0::DOUBLE AS weight, (p - o) * (p - o) AS score FROM x)"),
        "bootstrap_roi": _bet.rstrip() + _resampled("t", "roi"),
        "bradley_terry": _skills + "SELECT forecaster AS username, round(th, 6) AS score, row_number() OVER (ORDER BY th DESC, forecaster) AS rank FROM t WHERE it = (SELECT max(it) FROM t)",
        "bradley_terry_trajectory": _skills + "SELECT it AS iteration, forecaster AS username, round(th, 6) AS score FROM t",
    }
