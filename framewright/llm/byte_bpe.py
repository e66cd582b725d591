"""Byte-level BPE by vectorised pre-tokenisation, with token offsets kept for decoding.

Where a pre-token begins is found without a regular expression. Each character becomes a symbol: its class (letter,
number, white space, other), for white space whether it is the last before something solid, for an apostrophe
how many letters of a contraction follow. A symbol acts on eight states as a transition function; these
functions and all their compositions are a small finite monoid, so a run of characters is one element of it
and composing runs is a table look-up. ``Splitter`` scans blocks of characters side by side, composes the blocks'
elements by doubling, and reads from each character's state whether a token begins there. Being
associative, the scan goes on from window to window, so a text of any length takes bounded memory for it.

The slices then go to a cached pair merge (lowest rank first, leftmost of equals; a heap, so that a slice of a million
letters takes n log n). A class table is built once a process by asking the library whose results are to be met
which characters it takes for letters, numbers and white space: Python's own tables are of another Unicode version.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.arrow import append_columns, give_back, text_view
from framewright.llm.joins import column_of

#: Classes of characters.
OTHER, LETTER, NUMBER, WHITE, SPACE, NOTHING = range(6)
#: Symbols: solid classes, an apostrophe with one or two letters of a contraction after it, white space inside a
#: run, the last space or other white space before something solid. FIRST is added at a text's first character.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_RUN, S_LEAD, S_ALONE = range(8)
FIRST = 8
#: States, after a character: a token begins next whatever comes; inside a run of letters, numbers, others; behind
#: a space that leads a token; inside white space; one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LED, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: The letters that follow the apostrophe of a contraction.
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")
#: Bytes up to which a pre-token is merged by plain search and cached, and pre-tokens that are coded at a time.
LONG_PIECE, SLICES = 128, 1 << 17


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) of each symbol and state."""
    to, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_RUN: IN_WHITE}
    for symbol, state in run.items():
        to[symbol] = state
        begins[symbol, [state] if symbol == S_RUN else [state, LED]] = False
    to[S_LETTER, ONE_LEFT], to[S_LETTER, TWO_LEFT] = FRESH, ONE_LEFT
    begins[S_LETTER, [ONE_LEFT, TWO_LEFT]] = False
    for symbol, state in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
        to[symbol] = state
        to[symbol, [IN_OTHERS, LED]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, LED]] = False
    to[S_LEAD], to[S_ALONE] = LED, FRESH
    to[FIRST:], begins[FIRST:] = to[:FIRST, [FRESH]], True  # whatever the text before left
    return to, begins


def monoid(generators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(actions, compose): all compositions of the generators, which come first, then the identity; and the
    number of "first a, then b" for each pair."""
    known = {}
    todo = [tuple(g) for g in generators.tolist()] + [tuple(range(generators.shape[1]))]
    names = []
    actions: list[tuple] = []
    for g in todo:  # equal generators keep a number each, so that a symbol is its own element
        names.append(len(actions))
        known.setdefault(g, len(actions))
        actions.append(g)
    at = 0
    while at < len(actions):
        for g in generators.tolist():
            made = tuple(g[s] for s in actions[at])
            if made not in known:
                known[made] = len(actions)
                actions.append(made)
        at += 1
    table = np.array([[known[tuple(b[s] for s in a)] for b in actions] for a in actions], np.uint8 if len(actions) < 256 else np.uint16)
    return np.array(actions, np.uint8), table


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, as the library's own pattern engine has it."""
    import tiktoken

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    ranks = {bytes([i]): i for i in range(256)}
    found = np.full(0x110000, OTHER, np.uint8)
    for name, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        one = tiktoken.Encoding(f"class-{name}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        kept = bytes(one.encode_ordinary(everything)).decode()  # what the pattern doesn't match gives no token
        found[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = name
    found[ord(" ")] = SPACE
    return found


class Splitter:
    """Finds the bytes at which pre-tokens begin."""

    def __init__(self, block: int = 256, window: int = 1 << 20):
        self.to, self.begins = transitions()
        self.actions, table = monoid(self.to)
        self.n = len(self.actions)
        self.identity = 16
        self.compose = table.ravel()
        self.classes = character_classes()
        self.block, self.window = block, window

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols of code points; ``first`` marks where texts begin (nothing is seen past a text's end)."""
        n = len(points)
        kind = self.classes[points]
        one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        after = np.full(n, NOTHING, np.uint8)
        same = ~first[1:]
        after[:-1][same] = kind[1:][same]
        one[:-1][same] = points[1:][same]
        two[:-1][same] = one[1:][same]
        white = (kind == WHITE) | (kind == SPACE)
        last = white & (after <= NUMBER)
        out = np.full(n, S_OTHER, np.uint8)
        out[kind == LETTER] = S_LETTER
        out[kind == NUMBER] = S_NUMBER
        out[white] = S_RUN
        out[last] = np.where(kind[last] == SPACE, S_LEAD, S_ALONE)
        mark = np.flatnonzero(points == ord("'"))
        a, b = one[mark], two[mark]
        out[mark[np.isin(a, [ord(c) for c in SHORT_ENDS])]] = S_SHORT
        long = np.zeros(len(mark), bool)
        for x, y in LONG_ENDS:
            long |= (a == ord(x)) & (b == ord(y))
        out[mark[long]] = S_LONG
        out[first] += FIRST
        return out

    def scan(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """(whether a token begins at each symbol, state after the last), from the state before the first."""
        n, width = len(symbols), self.block
        if n == 0:
            return np.zeros(0, bool), state
        blocks = -(-n // width)
        grid = np.full(blocks * width, self.identity, np.intp)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
        total = np.full(blocks, self.identity, np.intp)
        for row in grid:
            total = self.compose[total * self.n + row].astype(np.intp)
        step = 1
        while step < blocks:  # inclusive prefix of the blocks by doubling
            total[step:] = self.compose[total[:-step] * self.n + total[step:]]
            step *= 2
        at = np.empty(blocks, np.intp)
        at[0] = state
        at[1:] = self.actions[total[:-1], state]
        out = np.empty((width, blocks), np.uint8)
        for j, row in enumerate(grid):
            out[j] = at
            at = self.actions[row, at].astype(np.intp)
        before = out.T.ravel()[:n]
        return self.begins[symbols, before], int(self.actions[total[-1], state])

    def starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets in ``raw`` at which tokens of the texts begin that ``offsets`` bound."""
        leads = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
        begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
        first = np.zeros(len(leads), bool)
        first[np.searchsorted(leads, begins)] = True
        found, state, done = [], FRESH, 0
        while done < len(leads):
            end = min(done + self.window, len(leads))
            ahead = min(end + 2, len(leads))  # a contraction looks two characters ahead
            stop = int(leads[ahead]) if ahead < len(leads) else len(raw)
            points = np.frombuffer(raw[leads[done] : stop].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            symbols = self.symbols(points, first[done:ahead])[: end - done]
            begin, state = self.scan(symbols, state)
            found.append(leads[done:end][begin])
            done = end
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a line "base64 rank" for each token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder of one rank file, with a merge cache of bounded size."""

    def __init__(self, path: str, cache_bytes: int = 96 << 20, splitter: Splitter | None = None):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, i in self.ranks.items():
            self.lengths[i] = len(token)
        by_id = dict(sorted((i, t) for t, i in self.ranks.items()))
        self.bytes = np.frombuffer(b"".join(by_id.values()), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths  # where a token's bytes begin in ``bytes``
        self.split = splitter or Splitter()
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        self.limit = self.room = cache_bytes // 2

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: itself where it is a token, else pairs merged, lowest rank first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_short(piece) if len(piece) <= LONG_PIECE else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        """By looking for the least rank among all pairs after each merge."""
        rank, none = self.ranks.get, len(self.lengths)
        ends = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del ends[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(piece[ends[i - 1] : ends[i + 1]], none)
            if i < len(pairs):
                pairs[i] = rank(piece[ends[i] : ends[i + 2]], none)
        return tuple([self.ranks[piece[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """By a heap of pairs."""
        n = len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        alive = [True] * n
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            middle = after[i]
            if middle >= n or after[middle] != end:
                continue
            alive[middle] = False
            after[i], before[end] = end, i
            if end < n and (r := rank(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
            left = before[i]
            if left >= 0 and (r := rank(piece[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def ids_of(self, piece: bytes) -> tuple[int, ...]:
        """``merge`` through the cache, which is of two generations: a full one becomes the older, whose pieces come
        back to the newer one as they are met."""
        got = self.cache.get(piece)
        if got is None:
            got = self.older.get(piece) or self.merge(piece)
            if len(piece) <= LONG_PIECE:  # longer ones hardly come again
                self.room -= len(piece) + 8 * len(got) + 200
                if self.room < 0:
                    self.cache, self.older, self.room = {}, self.cache, self.limit
                self.cache[piece] = got
        return got

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, bounds) of a block of texts: ``ends`` are the tokens' ends as offsets in the block, a
        text's tokens are ``bounds[d]:bounds[d + 1]``."""
        data = raw.tobytes()
        places = [*self.split.starts(raw, offsets).tolist(), len(data)]
        parts = [np.zeros(0, np.uint32)]
        for k in range(0, len(places) - 1, SLICES):
            some = places[k : k + SLICES + 1]
            pieces = [data[a:b] for a, b in zip(some[:-1], some[1:], strict=True)]
            found = list(map(self.cache.get, pieces))
            if None in found:
                found = [self.ids_of(p) if got is None else got for p, got in zip(pieces, found, strict=True)]
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32))
        flat = np.concatenate(parts)
        ends = np.cumsum(self.lengths[flat])
        return flat, ends, np.searchsorted(ends, offsets, "right")

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of ids, each put where its kept end says; ValueError where the two don't fit."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        if ids.max() >= len(self.lengths):
            raise ValueError(f"no token has the id {ids.max()}")
        lengths = self.lengths[ids]
        begins = ends - lengths
        if begins[0] != 0 or not np.array_equal(begins[1:], ends[:-1]):
            raise ValueError("offsets don't fit the ids")
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.at[ids] - begins, lengths)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    made = ByteBpe(path)
    give_back()
    return made


PACKED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())])
ROUND_TRIP = T.StructType([*PACKED.fields, T.StructField("decoded", T.BinaryType())])


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of values as binaries of little-endian unsigned 32-bit integers."""
    width = values.itemsize
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _coder(path: str, decoded: bool):
    def make():
        bpe = load(path)

        def run(col: pa.Array) -> list:
            raw, off = text_view(col)
            raw, off = raw[off[0] : off[-1]], off - off[0]
            ids, ends, bounds = bpe.encode(raw, off)
            own = ends - np.repeat(off[:-1], np.diff(bounds))  # within each text
            out = [_binary(ids.astype("<u4"), bounds), _binary(own.astype("<u4"), bounds)]
            if decoded:
                parts = [bpe.decode(ids[a:b], own[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sizes = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                out.append(_binary(np.concatenate([*parts, np.zeros(0, np.uint8)]), sizes))
            return out

        return run

    return make


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` and ``ends``: a text's token ids and the byte offset at which each token ends, both as
    little-endian unsigned 32-bit integers in a binary (``numpy.frombuffer(x, "<u4")``).

    ``path`` is a rank file. One row for each input row: a null or empty text has no ids (an empty binary), repeated
    rows are coded alike, an empty frame gives an empty one of the same columns. A text of any length is split
    as a whole, in windows that hand on their state. Other columns pass through (``keep`` prunes them);
    one named ``ids`` or ``ends`` is replaced. No special token is made: their strings are ordinary text.
    """
    return append_columns(df, text_col, PACKED, _coder(path, False), keep)


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and beside it ``decoded``, the bytes that ``ids`` and ``ends`` give back, in one pass."""
    return append_columns(df, text_col, ROUND_TRIP, _coder(path, True), keep)


def decode(df: DataFrame, path: str, ids_col: str = "ids", ends_col: str = "ends", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for (null ids or ends: null). An id that no token has, or ends that don't
    fit the ids, raise an error. A column named ``out_col`` is replaced."""

    @F.pandas_udf("binary")
    def texts(ids, ends):
        bpe = load(path)
        made = [None if i is None or e is None else bpe.decode(np.frombuffer(i, "<u4"), np.frombuffer(e, "<u4").astype(np.int64)).tobytes() for i, e in zip(ids, ends, strict=True)]
        return ids.__class__(made, dtype=object)

    return df.withColumn(out_col, texts(column_of(ids_col), column_of(ends_col)))


def count(packed: Column) -> Column:
    """Number of values in a packed column."""
    return (F.octet_length(packed) / 4).cast("long")
