"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fim, gam, html_text, language, licenses, ngram_join, quality, repair, secrets, urls
from .common import read

# Fixed value: the conversation that is added to the table.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), vocabulary(), digest=True)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    x = chat.format_conversations(turns.unionByName(spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")))
    back, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("segments"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = x.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return x.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    return urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return x.select("doc_id", *(F.col(f"_quality.{c}").alias(c) for c in quality.BASE), "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secrets.secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("_spans", lambda s: s["kind"].isin(*base))
    return x.select("doc_id", *(count(k) for k in base), F.sha2(secrets.listed(own), 256).alias("base_sha256"), secrets.listed(F.col("_spans")).alias("spans"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fim.transform(read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = gam.learn(docs.where(~held_out), read(spark, sf_dir, "labels").where(~held_out))
    x = gam.score(docs, model)
    return x.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits, rows = repair.repair(repair.damaged(read(spark, sf_dir, "conversations")))
    a, d = audits.alias("a"), repair.digests(rows).alias("d")
    x = a.join(d, F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    sha = F.coalesce("d.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return x.select("a.conv_id", "a.gaps", "a.blank", "a.duplicate", "a.truncated", "a.illegal", "a.cost", "a.audit", sha.alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_bpe, op2_ngram_join, op3_decontamination, op4_chat, op5_licenses, op6_language, op7_url_filter, op8_quality, op9_secrets, op10_html, op11_fill_in_middle, op12_quality_gam, op13_repair, pipeline)
    return {f.__name__: f for f in own}


_ESCAPED = r"replace(replace(replace(replace({}, '\', '\e'), '<', '\l'), '[', '\b'), '|', '\p')"

OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
walk AS (
  SELECT conv_id, k, count(*) OVER w AS n, role, lag(role) OVER w AS prior,
    CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN prior = 'user' THEN role = 'assistant'
         WHEN prior = 'system' THEN k = 2 AND role = 'user' WHEN prior = 'assistant' THEN role = 'user' ELSE false END AS fine
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM n) WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), v AS (SELECT conv_id, bool_and(fine) AND arg_max(role, k) = 'assistant' AS valid FROM walk GROUP BY conv_id)
SELECT n.conv_id AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')}) + 7 + CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 8 WHEN 'assistant' THEN 13
    ELSE 9 + length({_ESCAPED.format('role')}) END) AS BIGINT) AS formatted_chars,
  any_value(valid) AS valid
FROM n JOIN v ON n.conv_id IS NOT DISTINCT FROM v.conv_id GROUP BY n.conv_id
"""

OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, 'allow') AS verdict FROM p LEFT JOIN LATERAL (
  SELECT h || q AS rule, action FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, q, action)
  WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) ORDER BY length(h) + length(q) DESC LIMIT 1
) AS r ON true
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS whole, CAST('0x' || h[25:32] AS BIGINT) % 100 AS turned FROM t),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR whole >= 90 THEN 'plain' WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT)),
    lambda a, c: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, c)), 4294967295), 4294967295) % 20 AS kind FROM t
), g AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, (VALUES (1), (2)) AS n(times) WHERE kind <> 0 AND (times = 1 OR kind = 3)
), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM g),
f AS (
  SELECT *, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) AS pair,
    CASE WHEN rtrim(text, e' \t\n\x0b\x0c\r') = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, e' \t\n\x0b\x0c\r'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM k
), c AS (
  SELECT conv_id, count(f.k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN (SELECT conv_id AS id, * EXCLUDE conv_id FROM f) AS f ON o.conv_id IS NOT DISTINCT FROM f.id GROUP BY conv_id
), ins(state, pre, mid, price, said) AS (VALUES
  ('start', '', 'start', 0, ''), ('ready', '', 'ready', 0, ''), ('asked', '', 'asked', 0, ''), ('answered', '', 'answered', 0, ''),
  ('start', 'I', 'asked', 2, e'\nuser:'), ('ready', 'I', 'asked', 2, e'\nuser:'), ('asked', 'I', 'answered', 2, e'\nassistant:'), ('answered', 'I', 'asked', 2, e'\nuser:'),
  ('start', 'II', 'answered', 4, e'\nuser:\nassistant:'), ('ready', 'II', 'answered', 4, e'\nuser:\nassistant:'), ('asked', 'II', 'asked', 4, e'\nassistant:\nuser:'), ('answered', 'II', 'answered', 4, e'\nuser:\nassistant:')
), act(mid, letter, initial, price, target, name) AS (VALUES
  ('start', 'D', '', 3, 'start', ''), ('ready', 'D', '', 3, 'ready', ''), ('asked', 'D', '', 3, 'asked', ''), ('answered', 'D', '', 3, 'answered', ''),
  ('start', 'K', 's', 0, 'ready', ''), ('start', 'K', 'u', 0, 'asked', ''), ('ready', 'K', 'u', 0, 'asked', ''), ('asked', 'K', 'a', 0, 'answered', ''), ('answered', 'K', 'u', 0, 'asked', ''),
  ('start', 'R', '', 2, 'asked', 'user'), ('ready', 'R', '', 2, 'asked', 'user'), ('asked', 'R', '', 2, 'answered', 'assistant'), ('answered', 'R', '', 2, 'asked', 'user')
), dp(conv_id, i, state, cost, audit, said) AS (
  SELECT conv_id, 0, 'start', 0, '', '' FROM c
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.said FROM (
    SELECT d.conv_id, d.i + 1 AS i, a.target AS state,
      min({'cost': d.cost + n.price + a.price + CASE WHEN a.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': d.audit || n.pre || a.letter,
        'said': d.said || n.said || CASE a.letter WHEN 'D' THEN '' WHEN 'K' THEN e'\n' || f.role || ':' || f.text ELSE e'\n' || a.name || ':' || f.text END}) AS best
    FROM dp AS d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.k = d.i + 1 JOIN ins AS n ON n.state = d.state JOIN act AS a ON a.mid = n.mid
    WHERE (a.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (a.initial = '' OR a.initial = substr(f.role, 1, 1)) GROUP BY ALL)
), ended AS (
  SELECT d.conv_id, min({'cost': d.cost + n.price, 'audit': d.audit || n.pre, 'said': d.said || n.said}) AS best
  FROM dp AS d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i JOIN ins AS n ON n.state = d.state AND n.mid IN ('start', 'answered') GROUP BY d.conv_id
)
SELECT c.conv_id AS conv_id, gaps, blank, duplicate, truncated, illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
FROM c JOIN ended AS e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op7_url_filter": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op13_repair": OP13_SQL}
