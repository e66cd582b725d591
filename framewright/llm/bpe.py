"""Byte-pair encoding and decoding by content-defined chunk reuse.

A rolling (gear) hash cuts each text into chunks whose ends depend on nearby bytes only, so a
passage that many texts share yields the same chunks in each of them. A worker encodes a chunk once
and keeps its ids in a cache of bounded size. Chunks end anywhere, even inside a word, so every join
is repaired: the span around it is re-encoded between two *certain* boundaries (a printable ASCII
character followed by a blank: no pre-token of the vocabulary's pattern crosses one) and widened
until both ends agree exactly with token ends of the chunks on either side.

Sharing is per Python worker. Dealing chunks to one owner each would ship all text to the owners and
all ids back, several times the input in shuffle; a lost executor here costs only its own tasks.

The core that encodes one span is chosen at load time: the rank-based encoder where the vocabulary
is rank-ordered (its ids then are its merge order), else the library the vocabulary file belongs to.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framewright.llm.arrow import append_columns, give_back, text_view

#: Fixed value: the public pattern that splits text before byte-level merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint64, endpoint=False).astype(np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte, sum of gear[b[i-j]] << j over the last 32 bytes (mod 2**32), by doubling."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def chunk_ends(raw: np.ndarray, mean_bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of content-defined chunks, each at a character boundary; the last is len(raw)."""
    n = len(raw)
    if n <= least:
        return [n] if n else []
    hits = np.flatnonzero((gear_hash(raw) >> np.uint32(32 - mean_bits)) == 0) + 1
    starts = (raw & 0xC0) != 0x80
    hits = hits[hits < n]
    hits = hits[starts[hits]]
    ends, begin = [], 0
    for h in [*hits.tolist(), n]:
        while h - begin > most:
            cut = begin + most
            while not starts[cut]:
                cut -= 1
            ends.append(cut)
            begin = cut
        if h - begin >= least or h == n:
            ends.append(h)
            begin = h
    return ends


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for
    themselves, the rest take code points from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkedBpe:
    """Encoder and decoder of one vocabulary file, with a bounded chunk cache."""

    def __init__(self, path: str, cache_bytes: int = 48 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [b""] * size
        for text, i in vocab.items():
            self.tokens[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        for raw, i in self.specials.items():
            self.tokens[i] = raw
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ordered = all(vocab.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        self.core = self.library = None
        if ordered and spec["normalizer"] is None and len(merges) + 256 + len(self.specials) == size:
            import tiktoken

            ranks = {self.tokens[i]: i for i in range(256 + len(merges))}
            self.core = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
        self.cache: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.room = self.limit = cache_bytes
        self.encoded = self.reused = 0

    def encode_span(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8")
        if self.core is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def encode_chunk(self, raw: bytes) -> np.ndarray:
        ids = self.cache.get(raw)
        if ids is not None:
            self.cache.move_to_end(raw)
            self.reused += 1
            return ids
        ids = self.encode_span(raw)
        self.encoded += 1
        self.cache[raw] = ids
        self.room -= len(raw) + ids.nbytes + 200
        while self.room < 0:
            old, gone = self.cache.popitem(last=False)
            self.room += len(old) + gone.nbytes + 200
        return ids

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids of a UTF-8 text; special tokens' strings in it become their ids, as in the library."""
        parts, begin = [], 0
        while self.specials:
            found = [(raw.find(s, begin), -len(s), i) for s, i in self.specials.items()]
            found = [x for x in found if x[0] >= 0]
            if not found:
                break
            at, less, i = min(found)
            parts += [self._segment(raw[begin:at]), np.array([i], np.uint32)]
            begin = at - less
        if begin == 0:
            return self._segment(raw)
        return np.concatenate([*parts, self._segment(raw[begin:])])

    def _segment(self, raw: bytes) -> np.ndarray:
        view = np.frombuffer(raw, np.uint8)
        ends = chunk_ends(view)
        if len(ends) <= 1:
            return self.encode_chunk(raw) if raw else np.zeros(0, np.uint32)
        begins = [0, *ends[:-1]]
        ids = np.concatenate([self.encode_chunk(raw[a:b]) for a, b in zip(begins, ends, strict=True)])
        token_ends = np.cumsum(self.lengths[ids])
        blank = (view == 32) | (view == 10) | (view == 9) | (view == 13)
        solid = (view > 32) & (view < 127)
        certain = np.concatenate(([0], np.flatnonzero(blank[1:] & solid[:-1]) + 1, [len(raw)]))
        joins = np.array(ends[:-1])
        right = np.searchsorted(certain, joins, "left")
        pieces, done_tokens, done_bytes = [], 0, 0
        for x, r in zip(joins.tolist(), right.tolist(), strict=True):
            if x < done_bytes:  # inside the span that repaired the last join
                continue
            lo = r if certain[r] == x else r - 1
            while True:  # widen until a token of the left chunks ends exactly here
                begin = int(certain[lo])
                a = int(np.searchsorted(token_ends, begin, "right"))
                if begin <= done_bytes or a > 0 and token_ends[a - 1] == begin:
                    break
                lo -= 1
            if begin < done_bytes:  # the span reaches into the last one: they are repaired as one
                pieces.pop()
                begin, a = last_begin, last_a
            hi = r
            while True:  # likewise on the right
                end = int(certain[hi])
                b = int(np.searchsorted(token_ends, end, "left"))
                if b < len(token_ends) and token_ends[b] == end:
                    break
                hi += 1
            if begin == end:  # the join is a certain boundary that both sides agree on
                continue
            if a > done_tokens:
                pieces.append(ids[done_tokens:a])
            pieces.append(self.encode_span(raw[begin:end]))
            last_begin, last_a = begin, a
            done_tokens, done_bytes = b + 1, end
        pieces.append(ids[done_tokens:])
        return np.concatenate(pieces)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ChunkedBpe:
    made = ChunkedBpe(path)
    give_back()  # what reading the file took
    return made


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>) and ``decoded``, the text decoded from those ids.

    One row for each input row. A null or empty text has no ids and decodes to ''. Repeated rows are
    encoded alike; other columns pass through (``keep`` prunes them) and one named ``ids`` or
    ``decoded`` is replaced. An empty frame gives an empty frame of the same columns.
    """

    def make():
        bpe = load(path)

        def run(col: pa.Array) -> list:
            raw, off = text_view(col)
            data = raw[off[0] : off[-1]].tobytes()
            off = (off - off[0]).tolist()
            ids, texts = [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                x = bpe.encode(data[a:b])
                ids.append(x)
                texts.append(bpe.decode(x.tolist()))
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), texts]

        return run

    return append_columns(df, text_col, ROUND_TRIP, make, keep)


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``round_trip`` without the decoded text."""
    return round_trip(df, path, text_col, keep).drop("decoded")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of an id array (null ids: null; no ids: ''). A column named ``out_col`` is replaced."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def texts(ids):
        bpe = load(path)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)))

    return df.withColumn(out_col, texts(F.col(ids_col)))
