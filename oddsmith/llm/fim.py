"""Fill-in-middle transformation: two seeded cuts a text, by DuckDB over Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass
from string import Template

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

BLOCK = 64  # code points of a block; only the blocks that hold a cut are split into single ones
BATCH = 4 << 20  # bytes of text that one statement sees at most, or one longer text


@dataclass(frozen=True)
class Options:
    """marks: of prefix, suffix and middle; plain: of 100 texts, how many stay whole; spm: of 100
    others, how many have the suffix first; seed: begins what is hashed with an id."""

    marks: tuple = ("<P>", "<S>", "<M>")
    plain: int = 10
    spm: int = 20
    seed: str = "1"

    def __post_init__(self):
        """Marks must not overlap, or a mark and what stands beside it could read as another mark."""
        if not all(self.marks) or any(b.startswith(a[k:]) or a[k:].startswith(b) for i, a in enumerate(self.marks) for j, b in enumerate(self.marks) for k in range(i == j, len(a))):
            raise ValueError("no mark may begin, hold or overlap another one")


DEFAULT = Options()

_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s).{1,$block}') AS blocks,
    sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch
), sized AS (
  SELECT *, CAST(coalesce($block * (len(blocks) - 1) + length(blocks[-1]), 0) AS BIGINT) AS n,
    list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM cut
), placed AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR r[3] % 100 >= 100 - $plain THEN 'plain'
      WHEN r[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM sized
), parted AS (
  SELECT *, CASE WHEN form <> 'plain' THEN piece(blocks, 0, a) END AS prefix, CASE WHEN form <> 'plain' THEN piece(blocks, a, b) END AS middle,
    CASE WHEN form <> 'plain' THEN piece(blocks, b, n) END AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM parted
"""

# Code points a to b of a text from its blocks.
_MACROS = r"""
CREATE MACRO chars(t, a, b) AS coalesce(array_to_string(list_slice(regexp_extract_all(coalesce(t, ''), '(?s).'), a + 1, b), ''), '');
CREATE MACRO piece(blocks, a, b) AS CASE WHEN a // {0} = b // {0} THEN chars(blocks[a // {0} + 1], a % {0}, b % {0})
  ELSE chars(blocks[a // {0} + 1], a % {0}, {0}) || coalesce(array_to_string(list_slice(blocks, a // {0} + 2, b // {0}), ''), '') || chars(blocks[b // {0} + 1], 0, b % {0}) END;
"""


def _connection():
    """One connection a worker: a thread, no files of its own."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute(_MACROS.format(BLOCK))
    return con


def transform(documents: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row (doc_id, text).

    n: code points of the text. Cuts, and whether a text is changed, hang on doc_id alone, so they are the
    same in every run and partitioning. A null text counts as empty, and an empty text stays plain, as one that holds a
    mark does. A null doc_id is hashed as an empty name; repeated rows give equal rows; other columns are ignored.
    A row depends on itself only: nothing is shuffled, and a worker holds one batch of BATCH bytes, or one longer text.
    """
    texts = {"p": options.marks[0], "s": options.marks[1], "m": options.marks[2], "seed": options.seed}
    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in texts.items()}
    sql = Template(_SQL).substitute(quoted, block=BLOCK, plain=int(options.plain), spm=int(options.spm))

    def run(batches):
        con = kept("fim", _connection)
        for batch in batches:
            for part in slices(batch, most=BATCH):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column, options: Options = DEFAULT) -> Column:
    """The text, from the output and its form alone. No text with a mark was cut, so the first of each mark is the one that was put in."""
    p, s, m = options.marks

    def between(a, b=None):
        rest = F.substring(output, F.instr(output, a) + len(a), F.length(output))
        return F.substring_index(rest, b, 1) if b else rest

    psm, spm = F.concat(between(p, s), between(m), between(s, m)), F.concat(between(p, m), between(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
