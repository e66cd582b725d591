"""Token-id output as length-delimited binary records with masked checksums and a separate offset index.

``write`` makes a folder of record files, ``records/``, and beside it an index, ``index/``. A record file is
a run of records, each ``length (u64) | masked crc of the length (u32) | payload | masked crc of the
payload (u32)`` and one line feed after it, all little-endian. A payload is ``doc_id (i64) | id width in
bytes, 128 added for a null doc_id (u8) | ids``, two bytes an id where the vocabulary allows it, else four.
A checksum is CRC-32 (of zlib), masked by rotating it right by 15 bits and adding a constant, so that a
checksum of data that itself holds checksums stays meaningful.

Files are cut by bytes, ``FILE_BYTES`` each, whatever the texts' lengths; they lie in folders by their number in
a task. The index is a Parquet table with a row for every record: its file, offset and length, its doc_id and
number of ids; ``parts/`` has the number of ids before each file. ``read_at`` and ``shuffled`` seek by the
index and read no other bytes; ``read`` takes whole files in order.

Spark's own committed writers carry all three (its text writer the records: a record is a value, the line
feed is its separator), so a lost executor's attempt leaves nothing behind, on any store that Spark
reaches. Seeks open the store from Python and so need one that Arrow's file systems know.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.llm.arrow import slices, text_view
from framewright.llm.bpe import byte_alphabet
from framewright.llm.joins import column_of

#: Fixed value: the constant that the record format adds to a rotated checksum.
MASK_DELTA = 0xA282EAD8

#: Sorts null ids first; the record says whether its id is null.
NO_ID = -(1 << 63)
NULL_FLAG = 128

#: Bytes of text for one task that writes, and the most such tasks; bytes of text for one record file.
TASK_BYTES, MOST_TASKS, FILE_BYTES = 32 << 20, 50_000, 16 << 20


def masked_crc(raw: bytes) -> int:
    crc = zlib.crc32(raw)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame_record(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def record_length(raw: bytes | memoryview, offset: int = 0) -> int:
    """Bytes of the payload of a record; ValueError when its length is wrong or cut off."""
    head = bytes(raw[offset : offset + 8])
    if len(head) < 8 or len(raw) < offset + 12:
        raise ValueError(f"record at {offset}: cut off in its head")
    (length,), (crc,) = struct.unpack("<Q", head), struct.unpack("<I", raw[offset + 8 : offset + 12])
    if masked_crc(head) != crc:
        raise ValueError(f"record at {offset}: wrong checksum of the length")
    return length


def read_record(raw: bytes | memoryview, offset: int = 0) -> tuple[bytes, int]:
    """(payload, offset past the record); ValueError when a length or checksum is wrong."""
    end = offset + 12 + record_length(raw, offset)
    payload = bytes(raw[offset + 12 : end])
    if len(raw) < end + 4:
        raise ValueError(f"record at {offset}: cut off")
    if masked_crc(payload) != struct.unpack("<I", raw[end : end + 4])[0]:
        raise ValueError(f"record at {offset}: wrong checksum of the payload")
    return payload, end + 4


#: Fixed value: the pattern by which such a vocabulary splits lower-cased text, for Latin letters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_SIMPLE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_WORD_END = b"\xff"


class WordPieces(dict):
    """Encodes whole texts with a vocabulary that drops white space, a blank-free piece at a time.

    No merge, normalisation or special token of such a vocabulary spans a blank or line feed, so a
    text's ids are those of its pieces in order. The mapping is the cache of pieces met (emptied when
    it holds ``cached``). A new piece of plain Latin characters goes to a rank-based core, where the
    vocabulary is rank-ordered: a byte that no text holds stands for the end of a word, and pairs with
    it merge first. Any other piece goes to the library.
    """

    def __init__(self, path: str, cached: int = 250_000):
        super().__init__({b"": b""})
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.cached = cached
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.core = self._core(spec)

    @staticmethod
    def _core(spec: dict):
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        specials = {t["content"] for t in spec["added_tokens"]}
        if not suffix or any(vocab.get("".join(m)) != 512 + i for i, m in enumerate(merges)):
            return None
        from tiktoken._tiktoken import CoreBPE

        alphabet = byte_alphabet()
        ranks = {}
        for text, i in vocab.items():
            if text not in specials:
                stem = text.removesuffix(suffix)
                ranks[bytes(alphabet[c] for c in stem) + _WORD_END * (stem != text)] = i
        # The core wants every byte; the end byte alone never stays, as its pairs rank before all merges.
        ranks[_WORD_END] = len(vocab) + len(specials)
        return CoreBPE(ranks, {}, r"\S+")

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if self.core is not None and "<|" not in text and _SIMPLE.fullmatch(text):
            one = self.core.encode_single_piece
            ids = [i for part in _SPLIT.findall(text.lower()) for i in one(part.encode() + _WORD_END)]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        made = self[piece] = array(self.kind, ids).tobytes()
        return made

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, ``width`` bytes each, in the machine's (little-endian) order."""
        if len(self) > self.cached:
            self.clear()
            self[b""] = b""
        return b"".join(map(self.__getitem__, text.replace(b"\n", b" ").split(b" ")))


@lru_cache(maxsize=4)
def load(path: str) -> WordPieces:
    return WordPieces(path)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("record", T.BinaryType())])


@dataclass
class Records:
    """Framed records to write: (doc_id, block, record), and how many blocks."""

    rows: DataFrame
    n_blocks: int


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> Records:
    """The framed record of each whole text's ids, ``end_id`` last.

    A null or empty text has the end id alone. Null ids come first and are read back as null; repeated rows
    are repeated records. Other columns are left out. ``block`` is the range of doc_id that a row falls
    into; ranges come from quantiles of the ids alone, so no text is encoded twice for them, and their
    number from the bytes of text. An id that fills several ranges is dealt among them. A text of any
    length is one record. An empty frame gives no records.
    """
    doc_id = column_of(id_col).cast("long")
    rows = df.select(doc_id.alias("doc_id"), column_of(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    n = min(MOST_TASKS, max(1, -(-(size or 0) // TASK_BYTES)))
    quantiles = rows.select(F.percentile_approx(F.coalesce("doc_id", F.lit(NO_ID)), [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"] if n > 1 else []
    ends = np.array(quantiles or [], np.int64)
    schema = to_arrow_schema(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        end, met = end_id.to_bytes(coder.width, "little"), 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw, off = text_view(batch.column(1).slice(a, b - a))
                data = raw[off[0] : off[-1]].tobytes()
                off = (off - off[0]).tolist()
                own = batch.column(0).slice(a, b - a)
                ids = own.fill_null(NO_ID)
                widths = [coder.width | NULL_FLAG * (not known) for known in own.is_valid().to_pylist()]
                records = [
                    frame_record(struct.pack("<qB", i, w) + coder.encode(data[x:y]) + end)
                    for i, w, x, y in zip(ids.to_pylist(), widths, off[:-1], off[1:], strict=True)
                ]
                low, high = (np.searchsorted(ends, ids.to_numpy(), side) for side in ("left", "right"))
                block = low + (met + np.arange(b - a)) % np.maximum(1, high - low)
                met += b - a
                yield pa.RecordBatch.from_arrays([ids, pa.array(block.astype(np.int32)), pa.array(records, pa.binary())], schema=schema)

    return Records(rows.mapInArrow(run, ENCODED), n)


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("record", T.BinaryType())])


def _pieces(limit: int):
    """Sorted records with the number of the file that takes each in its block: a new one begins with the
    record that would take the last one beyond ``limit`` bytes, so only a longer record makes a longer file."""
    schema = to_arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = 0, 0
        for batch in batches:
            pieces = []
            for n in (pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) + 1).tolist():
                if held and held + n > limit:
                    piece, held = piece + 1, 0
                held += n
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), batch.column(0), batch.column(1)], schema=schema)

    return run


INDEX = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("file_number", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_ids", T.LongType()),
    ]
)
#: Fixed value: how Spark names a task's file of one piece, below the folder of records.
_FILE = re.compile(r"piece=(\d+)/part-(\d+)-[^/]*$")


def _entry(raw: memoryview, at: int) -> tuple[int | None, int]:
    """(doc_id, number of ids) of a payload that begins at ``at``."""
    doc_id, width = struct.unpack_from("<qB", raw, at)
    return (None if width & NULL_FLAG else doc_id), width & ~NULL_FLAG


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of record files, found by going from head to head."""
    schema = to_arrow_schema(INDEX)
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            found = _FILE.search(path.as_py())
            number, part = (int(x) for x in found.groups())
            file = found[0]
            raw, at, rows = memoryview(content.as_buffer()), 0, []
            while at < len(raw):
                length = record_length(raw, at)
                doc_id, width = _entry(raw, at + 12)
                rows.append((part, number, file, at, length + 16, doc_id, (length - 9) // width))
                at += length + 17
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(INDEX), schema, strict=True)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")


def write(encoded: Records, path: str) -> None:
    """Writes records in ascending doc_id order, null ids first, and then their index. Records of one id
    come in any order; an empty frame writes no record."""
    spark = encoded.rows.sparkSession
    ordered = encoded.rows.repartitionById(encoded.n_blocks, "block").sortWithinPartitions("doc_id").select("doc_id", "record")
    cut = ordered.mapInArrow(_pieces(FILE_BYTES), PIECES).sortWithinPartitions("piece", "doc_id")  # in that order already; the writer asks for it
    text = cut.select(F.col("record").cast("string").alias("value"), "piece")
    text.write.mode("overwrite").partitionBy("piece").option("lineSep", "\n").option("compression", "none").text(f"{path}/records")
    _files(spark, path).mapInArrow(_index, INDEX).write.mode("overwrite").parquet(f"{path}/index")
    sums = spark.read.parquet(f"{path}/index").groupBy("part", "file_number", "file").agg(F.sum("n_ids").alias("n_ids"))
    # A row for each file: some tens of bytes for each FILE_BYTES of text.
    before = Window.orderBy("part", "file_number").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("file", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).write.mode("overwrite").parquet(f"{path}/parts")


DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
#: Rows that one output batch holds at most.
_ROWS = 2000


def _decoded(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = _entry(memoryview(payload), 0)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), to_arrow_schema(DOCUMENT), strict=True)], names=DOCUMENT.names)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, content in zip(batch.column(0), batch.column(1), strict=True):
            raw, at, start, rows = memoryview(content.as_buffer()), 0, start.as_py(), []
            while at < len(raw):
                payload, at = read_record(raw, at)
                at += 1  # the line feed
                doc_id, ids = _decoded(payload)
                rows.append((doc_id, start, len(ids), ids.tobytes()))
                start += len(ids)
                if len(rows) == _ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, checked against its checksums.

    ``ids`` are little-endian u32; ``start`` counts the ids of all records before it.
    """
    starts = spark.read.parquet(f"{path}/parts").select("file", "start")
    files = _files(spark, path).withColumn("file", F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)))
    return files.join(starts, "file").select("start", "content").mapInArrow(_documents, DOCUMENT)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_at(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the records that ``entries``, rows of the index, point to, in their
    order within each partition. Only those records' bytes are read; ``start`` is null."""
    records = f"{path}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa_fs.FileSystem.from_uri(records)
        name, file = None, None
        for batch in batches:
            rows = []
            for own, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != name:
                    name, file = own, store.open_input_file(f"{base}/{own}")
                doc_id, ids = _decoded(read_record(file.read_at(length, offset))[0])
                rows.append((doc_id, None, len(ids), ids.tobytes()))
            if rows:
                yield _batch(rows)

    return entries.select("file", "offset", "length").mapInArrow(run, DOCUMENT)


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in an order drawn from ``seed``: index rows alone are sorted, records are sought."""
    order = F.xxhash64("file", "offset", F.lit(seed))
    return read_at(spark, path, index(spark, path).orderBy(order))
