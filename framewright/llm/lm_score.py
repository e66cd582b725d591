"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counting: each task counts words and word pairs of its texts by hash and deals them out in packed
blocks, by ranges of the hash; a range's counts are then merged in one task. Ranges are even whatever
the text, as hashes are.

Filter: a count c is quantised to level 1 + floor(log_BASE c), and the n-gram is entered once for each
level up to its own, so that probing level after level until a miss reads its level back. Words and
pairs enter with any count. Each hash range fills a segment of its own, of ``BITS_PER_ENTRY`` bits for
each entry, so the filter grows with the corpus and its false-positive rate stays the same. It is never
in one place: a block of texts sends its distinct n-grams to their segments and gets levels back.

Score: of each token, log10 of WEIGHT * c(pair) / c(word before) + (1 - WEIGHT) * smoothed share of the
word, counts as the filter gives them. A pair can't have been met more often than either of its words,
so its count is held to theirs: one with a word that was never met counts for nothing, and what is left
of false hits is one of rare words. A level is quantised, so a token is off by log10 of BASE or so where
nothing is wrong; a false hit shows as a pair of count 1.

Base score: it needs exact counts. Each segment has those of its range's words beside it, and the same
shuffle brings them back, so the result is exact for any vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.llm.arrow import give_back, slices, text_view
from framewright.llm.joins import column_of, unused
from framewright.llm.lineage import cut
from framewright.llm.text import U64, Words, combine, mix, words

#: Ratio between the counts of neighbouring levels.
BASE = 1.5
PROBES = 7
BITS_PER_ENTRY = 10
#: Bytes of training text for each hash range, and the least number of ranges.
RANGE_BYTES, LEAST_RANGES = 32 << 20, 8
WEIGHT = 0.4
SMOOTHING = 0.1
#: Tokens that a counting task holds before it hands on their counts.
HELD_TOKENS = 3_000_000
#: A block of texts that is scored as one ends with the slice that takes it to so many words, or before
#: the one that would take it beyond so many bytes of text; a row counts for some bytes besides its text.
MAX_WORDS = 2_000_000
BLOCK_BYTES, ROW_BYTES = 8 << 20, 64

#: The token that ends each text (and stands before its first word).
END = mix(np.array([0x2E], U64))[0]


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's words and then the end."""
    bounds = w.bounds - w.bounds[0] + np.arange(w.n_docs + 1)
    out = np.full(bounds[-1], END, U64)
    at = np.ones(len(out), bool)
    at[bounds[1:] - 1] = False
    out[at] = w.hashes
    return out, bounds


def pairs(toks: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; before a text's first token stands an end."""
    before = np.empty_like(toks)
    before[:1] = END
    before[1:] = toks[:-1]
    return combine(before, toks)


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n even ranges a hash falls into; rises with the hash."""
    return ((hashes >> U64(32)) * U64(n)) >> U64(32)


def short(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes of pairs with about 40 bits left to tell those of one range apart: a range of a million
    takes one for another in a millionth of cases, far below what the filter does."""
    lost = U64(max(0, 24 - n.bit_length()))
    return hashes >> lost << lost


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of bytes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_hashes(sorted_: np.ndarray) -> bytes:
    return pack(np.diff(sorted_, prepend=U64(0)))


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for level 0."""
    low = BASE ** np.maximum(level - 1, 0)
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, low * (1 + BASE) / 2))


BLOCK = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("pairs", T.BooleanType()),
        T.StructField("hashes", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)
#: A range's segment of the filter, and the exact counts of its words.
MERGED = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("segment", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ]
)
#: What a block asks of a range, and the answer: counts and levels of its words and pairs, in the order
#: of their hashes. The block's rows travel along, to one range each.
ASKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("range", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("words", "pairs", "rows")]])
ANSWER = T.StructType([*ASKED.fields[:2], *[T.StructField(c, T.BinaryType()) for c in ("counts", "word_levels", "pair_levels", "rows")]])


def count_blocks(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """Counts of each task's words and pairs, in blocks of one hash range."""
    schema = to_arrow_schema(BLOCK)

    def blocks(hashes: list[np.ndarray], is_pair: bool) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(np.concatenate(hashes), return_counts=True)
        ends = np.searchsorted(ranges(found, n), np.arange(n + 1))
        rows = [k for k in range(n) if ends[k] < ends[k + 1]]
        columns = [
            pa.array(rows, pa.int32()),
            pa.array([is_pair] * len(rows)),
            pa.array([pack_hashes(found[ends[k] : ends[k + 1]]) for k in rows], pa.binary()),
            pa.array([pack(counts[ends[k] : ends[k + 1]].astype(np.uint32)) for k in rows], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_pairs: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                toks, _ = tokens(words(batch.column(0).slice(a, b - a)))
                held.append(toks)
                held_pairs.append(short(pairs(toks), n))
                size += len(toks)
                if size >= HELD_TOKENS:
                    yield from blocks(held, False)
                    yield from blocks(held_pairs, True)
                    held, held_pairs, size = [], [], 0
        if size:
            yield from blocks(held, False)
            yield from blocks(held_pairs, True)

    text = F.coalesce(column_of(text_col).cast("string"), F.lit(""))
    return docs.select(text.alias("text")).mapInArrow(run, BLOCK)


def _summed(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([np.zeros(0, U64), *map(unpack_hashes, hashes)])
    c = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.uint32) for x in counts)]).astype(np.int64)
    if not len(h):
        return h, c
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(c, first)


def segment_of(counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A segment that all n-grams of (hashes, counts) are entered in, as bytes."""
    entries = sum(int(levels(c).sum()) for _, c in counted)
    bits = max(1024, -(-entries * BITS_PER_ENTRY // 8) * 8)
    segment = np.zeros(bits, bool)
    for h, c in counted:
        own = levels(c)
        for k in range(1, int(own.max(initial=0)) + 1):
            for pos in _positions(h[own >= k], k, 1, bits):
                segment[pos.astype(np.int64)] = True
    return np.packbits(segment, bitorder="little")


def merge(table: pa.Table) -> pa.Table:
    is_pair = table.column("pairs").to_pylist()
    hashes, counts = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
    w, wc = _summed([h for h, p in zip(hashes, is_pair, strict=True) if not p], [c for c, p in zip(counts, is_pair, strict=True) if not p])
    p, pc = _summed([h for h, p in zip(hashes, is_pair, strict=True) if p], [c for c, p in zip(counts, is_pair, strict=True) if p])
    row = {
        "range": table.column("range")[0].as_py(),
        "segment": segment_of([(w, wc), (p, pc)]).tobytes(),
        "words": w.tobytes(),
        "counts": wc.astype("<i8").tobytes(),
        "n_tokens": int(wc.sum()),
        "n_words": len(w),
    }
    return pa.Table.from_pylist([row], schema=to_arrow_schema(MERGED))


def _seeds(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of an entry's probes."""
    h = mix(hashes + U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    return h >> U64(32), (h & U64(0xFFFFFFFF)) | U64(1)


def _place(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, n: int, bits: int) -> np.ndarray:
    """Bit number of an entry's k-th probe: its range's segment, and a place in it by double hashing."""
    return ranges(hashes, n) * U64(bits) + ((((a + U64(k) * b) & U64(0xFFFFFFFF)) * U64(bits)) >> U64(32))


def _positions(hashes: np.ndarray, level: int, n: int, bits: int) -> Iterator[np.ndarray]:
    """Bit numbers of entries, PROBES times, one array at a time."""
    a, b = _seeds(hashes, level)
    for k in range(PROBES):
        yield _place(hashes, a, b, k, n, bits)


@dataclass
class Filter:
    """The log-frequency filter: ``n`` segments of ``bits`` bits."""

    data: np.ndarray  # uint8
    n: int
    bits: int

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram: the last one before the first miss; 0 when level 1 misses."""
        out = np.zeros(len(hashes), np.int64)
        live = np.arange(len(hashes))
        k = 1
        while len(live) and k <= 120:
            a, b = _seeds(hashes[live], k)
            for probe in range(PROBES):  # what misses one probe isn't asked for the next
                pos = _place(hashes[live], a, b, probe, self.n, self.bits)
                hit = (self.data[pos >> U64(3)] >> (pos & U64(7)).astype(np.uint8)) & 1 == 1
                live, a, b = live[hit], a[hit], b[hit]
            out[live] = k
            k += 1
        return out


@dataclass
class Model:
    segments: DataFrame  # MERGED, a row for each of ``n`` hash ranges that holds anything
    n: int
    n_tokens: int
    n_words: int

    @property
    def total(self) -> float:
        return max(self.n_tokens + SMOOTHING * (self.n_words + 1), SMOOTHING)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all of ``docs`` (null texts as empty) and builds the filter.

    The number of hash ranges follows the bytes of text alone, so scores are the same whatever the
    session's settings and the layout of the table, and a range's segment stays small at any size. An
    empty frame gives a model of no tokens, by which every n-gram is new.
    """
    size = docs.agg(F.sum(F.octet_length(column_of(text_col).cast("string")))).first()[0] or 0
    n = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    merged = cut(count_blocks(docs, text_col, n).groupBy("range").applyInArrow(merge, MERGED))
    n_tokens, n_words = (x or 0 for x in merged.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    return Model(merged, n, n_tokens, n_words)


def log_probabilities(toks: np.ndarray, where: np.ndarray, count: np.ndarray, pair: np.ndarray, total: float) -> np.ndarray:
    """log10 of each token's probability after the one before it.

    ``where``: each token's place among the distinct ones, whose counts are ``count``; ``pair``: the
    count of each token with the one before. All texts end with END, so the last token is one.
    """
    own = count[where]
    before = np.concatenate((own[-1:], own[:-1]))
    together = np.minimum(1.0, pair / np.maximum(before, 1.0))
    return np.log10(np.minimum(1.0, WEIGHT * together + (1 - WEIGHT) * (own + SMOOTHING) / total))


SCORED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _asked(source: str, n: int):
    """Blocks of rows: what each asks of the ranges, and the rows themselves."""
    schema = to_arrow_schema(ASKED)

    def block(held: list[pa.RecordBatch], held_tokens: list[np.ndarray], number: int) -> pa.RecordBatch:
        rows, toks = pa.Table.from_batches(held), np.concatenate(held_tokens)
        found = [np.unique(toks), np.unique(short(pairs(toks), n))]
        ends = [np.searchsorted(ranges(h, n), np.arange(n + 1)) for h in found]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        used = [k for k in range(n) if any(e[k] < e[k + 1] for e in ends)]
        keys = [[pack_hashes(h[e[k] : e[k + 1]]) for k in used] + [None] for h, e in zip(found, ends, strict=True)]
        home = int(mix(np.array([number], U64))[0] % U64(n))
        columns = [[number] * (len(used) + 1), [*used, home], *keys, [None] * len(used) + [sink.getvalue().to_pybytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, held_tokens, size, n_words = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(source))
            for a, b in slices(text):
                _, off = text_view(text.slice(a, b - a))
                more = int(off[-1] - off[0]) + ROW_BYTES * (b - a)
                if held and (size + more > BLOCK_BYTES or n_words >= MAX_WORDS):
                    yield block(held, held_tokens, number)
                    number, held, held_tokens, size, n_words = number + 1, [], [], 0, 0
                held.append(batch.slice(a, b - a))
                held_tokens.append(tokens(words(text.slice(a, b - a)))[0])
                size, n_words = size + more, n_words + len(held_tokens[-1])
        if held:
            yield block(held, held_tokens, number)
        del held, held_tokens
        give_back()

    return run


def _answer(segments: pa.Table, asked: pa.Table) -> pa.Table:
    """Counts and levels of what blocks ask of one range."""
    known, exact, own = np.zeros(0, U64), np.zeros(0, np.int64), None
    if segments.num_rows:
        data = np.frombuffer(segments.column("segment")[0].as_py(), np.uint8)
        own = Filter(data, 1, len(data) * 8)
        known = np.frombuffer(segments.column("words")[0].as_py(), U64)
        exact = np.frombuffer(segments.column("counts")[0].as_py(), "<i8")

    def level(hashes: np.ndarray) -> bytes:
        return pack((own.level(hashes) if own else np.zeros(len(hashes))).astype(np.uint8))

    counts, word_levels, pair_levels = [], [], []
    for w, p in zip(asked.column("words"), asked.column("pairs"), strict=True):
        if not w.is_valid:
            for out in (counts, word_levels, pair_levels):
                out.append(None)
            continue
        w, p = unpack_hashes(w.as_py()), unpack_hashes(p.as_py())
        at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
        met = known[at] == w if len(known) else np.zeros(len(w), bool)
        count = np.zeros(len(w), U64)
        count[met] = exact[at[met]]
        counts.append(pack(count))
        word_levels.append(level(w))
        pair_levels.append(level(p))
    made = [pa.array(x, pa.binary()) for x in (counts, word_levels, pair_levels)]
    columns = [asked.column("block"), asked.column("range"), *made, asked.column("rows")]
    return pa.Table.from_arrays(columns, schema=to_arrow_schema(ANSWER))


def _scores(kept: list[str], source: str, n: int, total: float):
    """Scores of a block's rows, from the answers of all ranges."""

    def run(table: pa.Table) -> pa.Table:
        carried = table.filter(table.column("rows").is_valid()).column("rows")[0].as_py()
        rows = pa.ipc.open_stream(carried).read_all()
        answers = table.filter(table.column("rows").is_null()).sort_by("range")
        exact, word_level, pair_level = (np.concatenate([unpack(x, t) for x in answers.column(c).to_pylist()]) for c, t in (("counts", U64), ("word_levels", np.uint8), ("pair_levels", np.uint8)))
        w = words(rows.column(source).combine_chunks())
        toks, bounds = tokens(w)
        doc = np.repeat(np.arange(w.n_docs), np.diff(bounds))
        _, where = np.unique(toks, return_inverse=True)
        _, which = np.unique(short(pairs(toks), n), return_inverse=True)
        own = exact[where]
        pair = np.minimum(level_count(pair_level.astype(np.int64))[which], np.minimum(own, np.concatenate((own[-1:], own[:-1]))))
        logs = np.log10((exact + SMOOTHING) / total)
        lm = log_probabilities(toks, where, level_count(word_level.astype(np.int64)), pair, total)
        made = [
            np.diff(bounds),
            np.bincount(doc, weights=(exact > 0)[where], minlength=w.n_docs).astype(np.int64),
            np.bincount(doc, weights=logs[where], minlength=w.n_docs),
            np.bincount(doc, weights=lm, minlength=w.n_docs),
        ]
        return pa.table([rows.column(c) for c in kept] + [pa.array(x) for x in made], names=kept + SCORED.names)

    return run


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each whole text.

    A null or empty text is its end token alone. One row for each input row, repeated or not; columns
    named like an output are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in SCORED.names]
    source = unused(kept, "_framewright_text")
    text = F.coalesce(column_of(text_col).cast("string"), F.lit(""))
    frame = df.select(*[column_of(c) for c in kept], text.alias(source))
    schema = T.StructType([frame.schema[c] for c in kept] + list(SCORED.fields))
    # Rows travel with what they ask, so blocks are made once and the same on both ways.
    asked = frame.mapInArrow(_asked(source, model.n), ASKED).groupBy("range")
    answers = model.segments.groupBy("range").cogroup(asked).applyInArrow(_answer, ANSWER)
    return answers.groupBy("block").applyInArrow(_scores(kept, source, model.n, model.total), schema)
