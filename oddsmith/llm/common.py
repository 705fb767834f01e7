"""Shared helpers of the training-data operators.

Kernels here are vectorised over a whole Arrow batch; none keeps state that
grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut  # noqa: F401

WORD_GAP = r"[\x20\x09-\x0D]+"
MAX_BROADCAST_ROWS = 1_000_000  # of small fixed size each: ids take about 40 MB as a hashed relation
MAX_BROADCAST_BYTES = 16 << 20  # of rows written out as JSON; the driver holds several times as much while it builds the table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that body reads it without computing it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if both its rows and their bytes are few. Others are left to
    Spark, which shuffles both sides and splits partitions of frequent keys."""
    if table.count() > MAX_BROADCAST_ROWS:
        return table
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if size <= MAX_BROADCAST_BYTES else table


def words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


# -- numpy kernels ---------------------------------------------------------

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEGMENT + 1, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class Hasher:
    """Polynomial hashes of words: one pass over the bytes, whatever the word lengths."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        with np.errstate(over="ignore"):
            self.byte = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
            self.power = _powers(self.BASE)
            self.inverse = _powers(pow(self.BASE, -1, 1 << 64))
            self.place = mix(np.arange(1, 17, dtype=_U) * _U(0x2545F4914F6CDD1D)) | _U(1)

    def words(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document index of every word of a batch. data: the bytes of
        all texts; offsets: where each begins, and the end."""
        hashes, owners = [], []
        begin = 0
        ends = offsets[1:]
        total = int(offsets[-1])
        begin = int(offsets[0])
        while begin < total:
            end = min(total, begin + _SEGMENT)
            if end < total:  # go back to a gap or to the end of a text
                gap = np.flatnonzero(SPACE[data[begin:end]])
                k = int(np.searchsorted(ends, end, side="right"))
                stop = max(begin + int(gap[-1]) + 1 if len(gap) else 0, int(ends[k - 1]) if k else 0)
                if stop <= begin:  # one word fills the segment
                    h, end = self._long(data, begin, int(ends[k]), lower)
                    hashes.append(h)
                    owners.append(np.searchsorted(offsets, [begin], side="right") - 1)
                    begin = end
                    continue
                end = stop
            h, at = self._segment(data[begin:end], lower, offsets[(offsets > begin) & (offsets < end)] - begin)
            hashes.append(h)
            owners.append(np.searchsorted(offsets, at + begin, side="right") - 1)
            begin = end
        if not hashes:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(owners)

    def _segment(self, data, lower, breaks):
        space = SPACE[data]
        first = ~space
        first[1:] &= space[:-1]
        last = ~space
        last[:-1] &= space[1:]
        for b in breaks:  # texts touch here
            if not space[b]:
                first[b] = True
            if not space[b - 1]:
                last[b - 1] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, _U)
            np.cumsum(self.byte[LOWER[data] if lower else data] * self.power[: len(data)], out=total[1:], dtype=_U)
            return mix((total[e] - total[s]) * self.inverse[s]), s

    def _long(self, data, begin, limit, lower):
        """Hash and end of the word that begins at `begin`, read by pieces."""
        total, at, gap = 0, begin, ()
        with np.errstate(over="ignore"):
            while at < limit and not len(gap):
                x = data[at : min(limit, at + _SEGMENT)]
                gap = np.flatnonzero(SPACE[x])
                x = x[: gap[0]] if len(gap) else x
                piece = int((self.byte[LOWER[x] if lower else x] * self.power[: len(x)]).sum(dtype=_U))
                total = (total + piece * pow(self.BASE, at - begin, 1 << 64)) % (1 << 64)
                at += len(x)
            return mix(np.array([total], _U)), at

    def shingles(self, hashes: np.ndarray, owners: np.ndarray, n: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (63 bits) of k-word shingles with their document index, by
        document; a text of 1 to k-1 words is one shingle. n: documents."""
        with np.errstate(over="ignore"):
            count = np.bincount(owners, minlength=n)
            m = max(0, len(hashes) - k + 1)
            total = np.zeros(m, _U)
            for j in range(k):
                total += hashes[j : j + m] * self.place[j]
            fits = owners[:m] == owners[k - 1 : k - 1 + m]
            out, own = mix(total[fits]) >> _U(1), owners[:m][fits]
            short = np.flatnonzero((count > 0) & (count < k))
            if len(short):
                starts = np.concatenate([[0], np.cumsum(count)])[short]
                more = np.array([int((hashes[s : s + count[d]] * self.place[: count[d]]).sum(dtype=_U)) ^ (int(count[d]) << 56) for s, d in zip(starts, short)], dtype=_U)
                out, own = np.concatenate([out, mix(more) >> _U(1)]), np.concatenate([own, short])
                by = np.argsort(own, kind="stable")
                out, own = out[by], own[by]
        return out, own


def kept(name: str, make):
    """A value made once in each Python worker, however often a task unpickles this module."""
    import builtins

    store = builtins.__dict__.setdefault("_oddsmith_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def hasher() -> Hasher:
    return kept("hasher", Hasher)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(batch: pa.RecordBatch, name: str = "text", most: int = 8 << 20):
    """Row ranges of a batch that hold about `most` bytes of text each (a longer text stands alone)."""
    if not batch.num_rows:
        return
    _, at = text_buffer(batch.column(batch.schema.get_field_index(name)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
