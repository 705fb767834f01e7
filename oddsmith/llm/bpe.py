"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut wherever a rolling hash of the WINDOW bytes before a place hits a
mask, in the middle of words or not, so equal passages give equal chunks wherever they
stand. A chunk is encoded once for as long as a worker's cache holds it (bounded
by bytes); `chunks` counts how much of a corpus repeats. Then each join is
repaired: the text between the nearest certain splits around it is encoded
again, and where the ids disagree with those of the two chunks, they take their place.
White space after another character is a certain split, and so is a full-width mark after an
ideograph: the pre-tokenizer splits there whatever stands around, so ids agree exactly beyond it. Cuts without a certain split between
them and the next are given up, and their chunks merged.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hasher, kept, mix, slices, text_buffer

WINDOW = 16  # bytes that decide on a cut
MASK = 511  # one cut in 512 places
CACHE_BYTES = 48 << 20  # of chunk texts in each worker
_CERTAIN = np.ones(256, bool)  # last bytes of characters that are no white space
_CERTAIN[[*range(9, 14), *range(28, 33)]] = False
# Last byte, and the byte before it, of the white space beyond ASCII
# (U+0085, U+00A0, U+1680, U+180E, U+2000 to 200A, U+2028, U+2029, U+202F, U+205F, U+3000).
# Characters that share both bytes are only checked without need.
_LAST, _PRIOR = np.zeros(256, bool), np.zeros(256, bool)
_LAST[[*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_PRIOR[[0x80, 0x81, 0x9A, 0xA0, 0xC2]] = True
# The ideographic comma and full stop and the full-width ! , : ; ? as UTF-8 bytes.
_MARKS = np.array([0xE38081, 0xE38082, 0xEFBC81, 0xEFBC8C, 0xEFBC9A, 0xEFBC9B, 0xEFBC9F])


class Codec:
    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.size = 0
        self.pieces = self._pieces()
        self.sizes = np.array([len(x) for x in self.pieces], np.int64)
        added = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile(b"|".join([rb"[\xc2\xca-\xff]", *added]))
        self.merger = self._merger()

    def _pieces(self) -> list[bytes]:
        """Bytes of each id. A byte-level vocabulary writes byte b as a printable character."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in plain}
        table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = added[i].encode() if i in added else bytes(table[c] for c in token)
        return out

    def _merger(self):
        """The same vocabulary as ranks, for a faster merger: None unless ids follow the order of merges."""
        import json

        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        step = spec.get("pre_tokenizer") or {}
        plain = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not spec.get("normalizer")
        ids = self.tokenizer.get_vocab()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"].get("merges", [])]
        if not plain or [ids.get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        # Fixed value: the splitting pattern of byte-level vocabularies.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {self.pieces[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def fresh(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts. Those of plain Latin letters without a special token go to the
        faster merger; on others its classes of characters might be of another age."""
        out: list = [None] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if self.merger is None or self.unusual.search(t):
                rest.append(k)
            else:
                out[k] = np.array(self.merger.encode_ordinary(t.decode()), np.uint32)
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k].decode() for k in rest], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.uint32)
        return out

    def encode(self, chunks: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each distinct chunk; those not in the cache are encoded together."""
        out, new = {}, []
        for c in dict.fromkeys(chunks):
            if c in self.cache:
                self.cache.move_to_end(c)
                out[c] = self.cache[c]
            else:
                new.append(c)
        for c, ids in zip(new, self.fresh(new)):
            out[c] = ids
            if len(c) < 1 << 16:
                self.cache[c] = ids
                self.size += len(c)
        while self.size > CACHE_BYTES:
            self.size -= len(self.cache.popitem(last=False)[0])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


def cuts(data: np.ndarray) -> np.ndarray:
    """Places before the first byte of a character, chosen by a rolling hash of the WINDOW bytes before them."""
    out, step = [], len(hasher().power) - 1 - WINDOW
    for begin in range(0, len(data) - WINDOW, step):  # pieces that overlap by a window
        x = data[begin : begin + step + WINDOW]
        total = np.zeros(len(x) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hasher().byte[x] * hasher().power[: len(x)], out=total[1:], dtype=np.uint64)
            h = mix((total[WINDOW:-1] - total[: -WINDOW - 1]) * hasher().inverse[: len(x) - WINDOW])
        out.append(np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK) == 0) & ((x[WINDOW:] & 0xC0) != 0x80)) + begin + WINDOW)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _certain(data: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer splits whatever stands around: white space after another character, a full-width mark after an ideograph."""
    fine = _CERTAIN[data[:-1]] & SPACE[data[1:]]
    fine[1:] &= ~(_LAST[data[1:-1]] & _PRIOR[data[:-2]])
    fine[:1] &= data[:1] < 128
    if len(data) > 6 and (wide := np.flatnonzero((data[3:-2] == 0xE3) | (data[3:-2] == 0xEF))).size:
        # A full-width mark right after an ideograph (U+5000 to U+9FBF) begins a piece of its own: no letter, number or space.
        prior, b, c = data[wide], data[wide + 4].astype(np.int32), data[wide + 5]
        mark = (data[wide + 3].astype(np.int32) << 16 | b << 8 | c)
        ideograph = (prior >= 0xE5) & (prior <= 0xE9) & ~((prior == 0xE9) & (data[wide + 1] == 0xBF)) & (data[wide + 1] & 0xC0 == 0x80) & (data[wide + 2] & 0xC0 == 0x80)
        fine[wide[ideograph & np.isin(mark, _MARKS)] + 2] = True
    return np.flatnonzero(fine) + 1


def joins(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(cut, begin, end) of the cuts of a text that can be repaired: begin and end are the nearest certain splits,
    or the ends of the text. Of cuts whose ranges meet the later ones are given up."""
    splits = np.concatenate([[0], _certain(data), [len(data)]])
    begin = splits[np.searchsorted(splits, at, side="right") - 1]
    end = splits[np.searchsorted(splits, at, side="left")]
    out: list[tuple[int, int, int]] = []
    for c, a, b in zip(at.tolist(), begin.tolist(), end.tolist()):
        if a >= (out[-1][2] if out else 1) and b < len(data) or a == b:
            out.append((c, a, b))
    return out


def _rows(codec: Codec, batch: pa.RecordBatch, more: bool = False):
    """Ids of each text; with `more` also the numbers of its chunks and of joins whose ids changed."""
    data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
    docs, every = [], []
    for s, e in zip(at[:-1], at[1:]):
        x = data[s:e]
        raw, held = x.tobytes(), joins(x, cuts(x)) if e - s > WINDOW else []
        edges = [0, *(c for c, _, _ in held), len(raw)]
        chunks = [raw[i:j] for i, j in zip(edges, edges[1:])] if raw else []
        ranges = [raw[a:b] for _, a, b in held]
        docs.append((held, chunks, ranges))
        every += chunks + ranges
    ids = codec.encode([x for x in every if x])
    for held, chunks, ranges in docs:
        owns = []  # ids of each chunk, and which of them no join covers
        for k, chunk in enumerate(chunks):
            own = ids[chunk]
            skip = held[k - 1][2] - held[k - 1][0] if k else 0
            tail = held[k][0] - held[k][1] if k < len(held) else 0
            if skip or tail:  # both ends are certain splits, so tokens end there
                i, j = np.searchsorted(np.cumsum(codec.sizes[own]), [skip, len(chunk) - tail], side="right").tolist()
            else:
                i, j = 0, len(own)
            owns.append((own, i, j))
        parts, repaired = [], 0
        for k, (own, i, j) in enumerate(owns):
            parts.append(own[i:j])
            if k < len(held) and ranges[k]:
                parts.append(ids[ranges[k]])
                apart = np.concatenate([own[j:], owns[k + 1][0][: owns[k + 1][1]]])
                repaired += not np.array_equal(apart, parts[-1])
        out = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        yield (out, len(chunks), repaired) if more else out


def chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_bytes, n_times): the content-defined chunks of all texts, by two hashes, and how often each occurs.
    sum((n_times - 1) * n_bytes) of them need no encoding of their own where a cache holds them all."""

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                data, at = text_buffer(b.column(0))
                rows = []
                for s, e in zip(at[:-1], at[1:]):
                    x = data[s:e]
                    raw, held = x.tobytes(), joins(x, cuts(x)) if e - s > WINDOW else []
                    edges = [0, *(c for c, _, _ in held), len(raw)]
                    for i, j in zip(edges, edges[1:]):
                        if j > i:
                            d = hashlib.blake2b(raw[i:j], digest_size=16).digest()
                            rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), j - i))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["k1", "k2", "n_bytes"])

    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "k1 long, k2 long, n_bytes long").groupBy("k1", "k2", "n_bytes").agg(F.count("*").alias("n_times"))


def encode(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded, n_chunks, n_repaired), or digests of ids and decoded text with `digest`.

    vocabulary: path of a byte-level tokenizer file that each executor can read.
    n_chunks: chunks of the text; n_repaired: joins of them whose ids changed by the repair.
    Null text counts as empty: no ids, empty decoded text. Repeated rows and
    null ids stay; other columns are ignored. A text is encoded whole, however long.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string") + ", n_chunks long, n_repaired long"

    def run(batches):
        codec = kept(f"codec {vocabulary}", lambda: Codec(vocabulary))
        for whole in batches:
            for b in slices(whole, most=2 << 20):
                rows = list(_rows(codec, b, more=True))
                ids = [x for x, _, _ in rows]
                decoded = [codec.decode(x) for x in ids]
                n = pa.array([len(x) for x in ids], pa.int64())
                if digest:
                    more = [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    more = [pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32)), pa.array([x.decode() for x in decoded], pa.string())]
                names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")), "n_chunks", "n_repaired"]
                counts = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([b.column(0), n, *more, *counts], names)

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, schema)
