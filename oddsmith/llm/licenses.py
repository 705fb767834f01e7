"""License scans: winnowed fingerprints pick templates and diagonals, a banded alignment measures them.

Fingerprints of a template are hashes of GRAM words; of each WINDOW neighbours the
least is kept (winnowing), in templates and texts alike, so any run of GRAM + WINDOW - 1
equal words has one in common. A template of more than SHORT words that is changed
in a fifth of its words still has such a run. Shorter ones keep every word as a fingerprint,
and a place needs as many of them as the coverage does. An inverted index leads from a
fingerprint to templates and places in them. Each candidate diagonal is aligned.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mix, slices
from .license_texts import TELLING, templates

BAND, COVERAGE = 4, 0.8
GRAM, WINDOW, SHORT = 3, 2, 15
_TOKEN = re.compile(r"[^\W_]+")
_NONE = np.uint64(2**64 - 1)


def align(doc: list[str], template: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last): the longest common subsequence of the template and
    the words of doc within `band` of the diagonal; ties go to the later start."""
    best: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for d in range(-band, band + 1):
            j = diagonal + i + d
            cell = max(best.get(d + 1, (0, 0, 0)), row.get(d - 1, (0, 0, 0)))
            if 0 <= j < len(doc) and doc[j] == w:
                n, s, _ = best.get(d, (0, 0, 0))
                cell = max(cell, (n + 1, s if n else -j - 1, j))
            row[d] = cell
        best = row
    n, s, e = max(best.values())
    return n, -s - 1, e


def telling(words: list[str]) -> list[str]:
    """The words that tell licences apart, and numbers."""
    return [w for w in words if w in TELLING or w.isdecimal()]


def winnowed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) kept of a sequence of word numbers; -1 is a word of no template, and grams with it are none."""
    m = len(ids) - GRAM + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    fine, code = np.ones(m, bool), np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            fine &= ids[k : k + m] >= 0
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m].astype(np.uint64) + np.uint64(1)
        code = np.where(fine, mix(code) >> np.uint64(1), _NONE)
    if m >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(code, WINDOW).argmin(axis=1) + np.arange(m - WINDOW + 1)
        at = np.unique(least)
    else:
        at = np.array([code.argmin()])
    at = at[code[at] != _NONE]
    return at, code[at]


class Notices:
    """Templates with their inverted index."""

    def __init__(self, texts: dict[str, str]):
        self.words = {k: w for k, t in texts.items() if (w := [w.lower() for w in _TOKEN.findall(t)])}
        self.telling = {k: telling(w) for k, w in self.words.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.need = {k: max(1, math.ceil(COVERAGE * len(w) - 1e-9)) for k, w in self.words.items()}
        self.number = {w: i for i, w in enumerate(sorted(set().union(*self.words.values())))}
        self.tells = np.array([bool(telling([w])) for w in self.number], bool)
        self.told = {k: frozenset(self.number[x] for x in w) for k, w in self.telling.items()}
        self.short = {k: frozenset(self.number[x] for x in w) for k, w in self.words.items() if len(w) <= SHORT}
        self.index: dict[int, list[tuple[str, int]]] = {}
        for k, w in self.words.items():
            if k not in self.short:
                for at, code in zip(*winnowed(np.array([self.number[x] for x in w]))):
                    self.index.setdefault(int(code), []).append((k, int(at)))

    def _crowded(self, name: str, doc: list[str], at: np.ndarray, ids: np.ndarray) -> set[int]:
        """Diagonals of a short template whose windows hold as many of its words as the coverage needs."""
        need, size = self.need[name], len(self.words[name])
        held = self.short[name]
        q = at[np.array([i in held for i in ids.tolist()])]
        if len(q) < need:
            return set()
        first, last = q[: len(q) - need + 1], q[need - 1 :]
        near = np.flatnonzero(last - first < size + 2 * BAND)
        found = {d for i in near for d in range(int(last[i]) - size - BAND + 1, int(first[i]) + BAND + 1)}
        return {d for d in found if (Counter(doc[max(0, d - BAND) : d + size + BAND]) & self.counts[name]).total() >= need}

    def candidates(self, doc: list[str]) -> dict[str, set[int]]:
        """template -> diagonals to be aligned."""
        ids = np.array([self.number.get(w, -1) for w in doc])
        out: dict[str, set[int]] = {}
        for place, code in zip(*(x.tolist() for x in winnowed(ids))):
            for name, at in self.index.get(code, ()):
                # The fingerprint lies on the path of an alignment, which may wander by BAND from its diagonal.
                out.setdefault(name, set()).update(range(place - at - BAND, place - at + BAND + 1))
        at = np.flatnonzero(ids >= 0)
        known = ids[at]
        said = frozenset(known[self.tells[known]].tolist())
        for name in self.short:
            if len(at) >= self.need[name] and said >= self.told[name]:
                if found := self._crowded(name, doc, at, known):
                    out[name] = found
        return out


def find(text: str, notices: Notices) -> list[tuple[str, str, float, int, int]]:
    """(licence, template, coverage, start, end in code points) of each place, by start. Of places of
    a licence that share more than half of the shorter one, the one with most matched words stays; a place
    inside a better one of another licence goes."""
    low = text.lower()
    # Lower case that changes the length may change where words end.
    doc = _TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in _TOKEN.findall(text)]
    spans = []
    for name, diagonals in notices.candidates(doc).items():
        words = notices.words[name]
        for n, s, e in {align(doc, words, d) for d in diagonals}:
            if n >= notices.need[name] and telling(doc[s : e + 1]) == notices.telling[name]:
                spans.append((-n, e - s, s, e, name))
    if not spans:
        return []
    places, taken, found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)], [], []
    for n, _, s, e, name in sorted(spans):
        licence, _, template = name.partition(" ")
        if any((b <= s and e <= f) or (who == licence and 2 * (min(e, f) - max(s, b) + 1) > min(e - s, f - b) + 1) for who, b, f in taken):
            continue
        taken.append((licence, s, e))
        found.append((licence, template, round(-n / len(notices.words[name]), 4), places[s][0], places[e][1]))
    return sorted(found, key=lambda x: (x[3], x[0], x[1]))


def scan(documents: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, template, coverage, start, end): a row for each notice that a text holds.

    coverage: the share of the template's words found in order near one diagonal, COVERAGE at least; start
    and end in code points. The words that tell licences apart (numbers, and such as `sharealike`) must be those of
    the template. Null and empty texts give no rows, repeated rows repeated ones, null ids rows with a null id; other columns are
    ignored. Texts are scanned whole, in time near their length times the number of places.
    """
    table = templates() if texts is None else texts

    def run(batches):
        notices = kept(f"notices {hash(tuple(table.items()))}", lambda: Notices(table))
        for whole in batches:
            for b in slices(whole):
                rows = [(i, *x) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for x in find(text, notices)]
                if rows:
                    types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "license", "template", "coverage", "start", "end"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, license string, template string, coverage double, start long, end long")
