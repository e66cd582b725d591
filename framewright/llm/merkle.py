"""A Merkle manifest of a dataset: one root that vouches for every row, and for each row a proof.

Rows are leaves; those of a group (a source) are one tree, ordered by id, and the groups' roots are the leaves of a
top tree. A node has up to ``ARITY`` children: as long as a tree has more than one node in a level, every run of
that many neighbours becomes the hash of their hex digests.

A *forest* is a set of nodes whose parents can't be hashed yet, keyed by (tree, level, index). Two forests
merge by union; a run of siblings that is complete (a tree's size tells how many it has) becomes its
parent, and so on upwards; a finished group's root becomes a leaf of the top tree. That is associative and
commutative, so partitions of sorted leaves each make a forest and ``treeReduce`` merges them to the root. What stays
of a partition is at most 30 nodes for each level, whatever its size; the runs that complete in merging
(those that cross partitions) are kept as the *spine*, from which, with its own leaves, each partition
then writes the proofs of its rows. The spine has some 5 KB for each partition at most, and there are at most
``MOST_PARTITIONS``: the driver and each worker hold up to some 80 MB whatever the number of rows or groups.

Leaves are hashed before the shuffle, so no text travels. The sorted leaves are cut to the shared folder, which fixes
their partitions: a lost executor's task reads the same rows again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.llm.joins import column_of, packed
from framewright.llm.lineage import cut

ARITY = 16
#: Bytes of a digest in hex.
HEX = 64
#: The tree of the groups' roots; groups are numbered from 0.
TOP = -1
#: Rows of one partition of sorted leaves, and the most partitions (beyond, partitions grow).
PARTITION_ROWS, MOST_PARTITIONS = 1 << 16, 1 << 14


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def level_size(total: int, level: int) -> int:
    """Nodes of a level of a tree with ``total`` leaves."""
    for _ in range(level):
        total = -(-total // ARITY)
    return total


@dataclass
class Forest:
    """Nodes without a parent yet, by (tree, level, index); sizes of the trees they are in; and the complete runs
    that were joined here, by (tree, level, run), as their hex digests in a row."""

    n_groups: int = 0
    nodes: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    spine: dict[tuple[int, int, int], bytes] = field(default_factory=dict)

    def merge(self, other: Forest) -> Forest:
        self.n_groups = max(self.n_groups, other.n_groups)
        self.sizes |= other.sizes
        self.spine |= other.spine
        fresh = list(other.nodes)
        self.nodes |= other.nodes
        while fresh:
            runs = {(t, level, i // ARITY) for t, level, i in fresh}
            fresh = []
            for tree, level, run in runs:
                made = self._join(tree, level, run)
                if made:
                    fresh.append(made)
        return self

    def _join(self, tree: int, level: int, run: int) -> tuple[int, int, int] | None:
        """Replaces a run by its parent where all of it is here; the parent's key."""
        size = level_size(self.n_groups if tree == TOP else self.sizes[tree], level)
        if size == 1:  # a root
            if tree == TOP:
                return None
            root = self.nodes.pop((tree, level, 0))
            self.nodes[TOP, 0, tree] = root
            return TOP, 0, tree
        keys = [(tree, level, i) for i in range(run * ARITY, min(size, (run + 1) * ARITY))]
        if not all(k in self.nodes for k in keys):
            return None
        joined = b"".join(self.nodes.pop(k) for k in keys)
        self.spine[tree, level, run] = joined
        self.nodes[tree, level + 1, run] = digest(joined)
        return tree, level + 1, run

    def root(self) -> str | None:
        left = list(self.nodes.items())
        if not left:
            return None
        if len(left) > 1 or left[0][0][0] != TOP:
            raise ValueError("leaves are missing: the forest is no single tree")
        return left[0][1].decode()


class Span:
    """Neighbouring leaves of one tree and all nodes above them that these leaves alone determine."""

    def __init__(self, total: int, start: int, leaves: bytes):
        self.total = total
        self.levels: list[tuple[int, bytes]] = [(start, leaves)]  # first index and digests of each level
        size = total
        while size > 1:
            first, data = self.levels[-1]
            end = first + len(data) // HEX
            low = -(-first // ARITY)
            high = -(-size // ARITY) if end == size else end // ARITY
            if low >= high:
                break
            at = [(r * ARITY - first) * HEX for r in range(low, high)] + [(min(high * ARITY, end) - first) * HEX]
            self.levels.append((low, b"".join(digest(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))))
            size = -(-size // ARITY)

    def run(self, level: int, run: int) -> bytes | None:
        """The digests of a whole run of siblings, if it is here."""
        if level >= len(self.levels):
            return None
        first, data = self.levels[level]
        a, b = run * ARITY, min(level_size(self.total, level), (run + 1) * ARITY)
        if a < first or b > first + len(data) // HEX:
            return None
        return data[(a - first) * HEX : (b - first) * HEX]

    def open(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, index, digest) of the nodes whose parents are not here."""
        for level, (first, data) in enumerate(self.levels):
            low, up = self.levels[level + 1] if level + 1 < len(self.levels) else (0, b"")
            for k in range(len(data) // HEX):
                i = first + k
                if not low <= i // ARITY < low + len(up) // HEX:
                    yield level, i, data[k * HEX : (k + 1) * HEX]

    def root(self) -> bytes | None:
        data = self.levels[-1][1]
        return data if level_size(self.total, len(self.levels) - 1) == 1 and data else None


@dataclass(frozen=True)
class Place:
    """Where a partition of sorted leaves begins: the number of its first group, the leaves of that group in
    partitions before it, and the whole sizes of its first and last groups."""

    group: int
    before: int
    first_total: int
    last_total: int


def spans(place: Place, n_groups: int, sizes: Sequence[int], leaves: bytes) -> tuple[list[Span], Span | None]:
    """Spans of a partition's groups, whose rows ``sizes`` counts in order, and the span of those groups' roots that
    are known here."""
    made, at = [], 0
    for k, n in enumerate(sizes):
        start = place.before if k == 0 else 0
        total = place.first_total if k == 0 else place.last_total if k == len(sizes) - 1 else n
        made.append(Span(total, start, leaves[at : at + n * HEX]))
        at += n * HEX
    roots = [(place.group + k, s.root()) for k, s in enumerate(made)]
    known = [(g, r) for g, r in roots if r is not None]  # neighbours: only the first and last groups go on elsewhere
    top = Span(n_groups, known[0][0], b"".join(r for _, r in known)) if known else None
    return made, top


def _forest(place: Place, n_groups: int, made: list[Span], top: Span | None) -> Forest:
    out = Forest(n_groups)
    for k, span in enumerate(made):
        if span.root() is None:
            tree = place.group + k
            out.sizes[tree] = span.total
            out.nodes |= {(tree, level, i): d for level, i, d in span.open()}
    if top:
        out.nodes |= {(TOP, level, i): d for level, i, d in top.open()}
    return out


class _Paths:
    """Runs on the way from nodes to the root, from a partition's spans and the spine."""

    def __init__(self, n_groups: int, made: Mapping[int, Span], top: Span | None, spine: Mapping):
        self.n_groups, self.made, self.top, self.spine = n_groups, made, top, spine
        self.last: dict[tuple[bool, int], tuple[int, int, list]] = {}

    def above(self, tree: int, level: int, index: int) -> list[tuple[bytes, int]]:
        """(digests of the run, own position in it) of each level from a node to the root. Leaves come in order,
        so the last path of each level is all that is worth keeping."""
        kept = self.last.get((tree == TOP, level))
        if kept and kept[:2] == (tree, index):
            return kept[2]
        span = self.top if tree == TOP else self.made[tree]
        size = level_size(self.n_groups if tree == TOP else span.total, level)
        if size == 1:
            path = [] if tree == TOP else self.above(TOP, 0, tree)
        else:
            run = index // ARITY
            own = (span.run(level, run) if span else None) or self.spine[tree, level, run]
            path = [(own, index % ARITY * HEX), *self.above(tree, level + 1, run)]
        self.last[tree == TOP, level] = (tree, index, path)
        return path


def fold(leaf: bytes, path: Sequence[tuple[bytes, int]]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for run, at in path:
        leaf = digest(b"".join((run[:at], leaf, run[at + HEX :])))
    return leaf


def siblings(path: Sequence[tuple[bytes, int]]) -> bytes:
    return b"".join(part for run, at in path for part in (run[:at], run[at + HEX :]))


@dataclass(frozen=True)
class Manifest:
    """``root`` is the digest of the whole dataset (None where it is empty), ``leaves`` the sorted leaves."""

    root: str | None
    n_rows: int
    n_groups: int
    leaves: DataFrame
    places: list[Place]
    spine: dict[tuple[int, int, int], bytes]

    def proofs(self) -> DataFrame:
        """A row for each leaf: the kept columns, ``leaf``, ``subroot`` (its group's root), ``root``, ``proof`` (hex
        digests of all siblings in a row, level by level up to the root, left to right in each) and
        ``folded_root``: the root that the row's candidate digest (its own leaf where it has none) gives
        with those siblings. A kept column of such a name is replaced."""
        kept = [f for f in self.leaves.schema["_row"].dataType.fields if f.name.lower() not in OUTPUTS]
        outputs = [T.StructField(n, T.StringType()) for n in OUTPUTS]
        schema = T.StructType([*kept, *outputs])
        arrow = to_arrow_schema(T.StructType(outputs))
        given = self.leaves.sparkSession.sparkContext.broadcast((self.places, self.n_groups, self.root, self.spine))
        names = [f.name for f in kept]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if b.num_rows]
            if not rows:
                return
            places, n_groups, root, spine = given.value
            place = places[TaskContext.get().partitionId()]
            sizes, leaves = _read(rows)
            made, top = spans(place, n_groups, sizes, leaves)
            paths = _Paths(n_groups, {place.group + k: s for k, s in enumerate(made)}, top, spine)
            subroots: dict[int, str] = {}
            walk = ((place.group + k, i) for k, (n, s) in enumerate(zip(sizes, made, strict=True)) for i in range(s.levels[0][0], s.levels[0][0] + n))
            for whole in rows:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    own, changed = _column(b, "_leaf").to_pylist(), _column(b, "_candidate").to_pylist()
                    made_rows = []
                    for leaf, other in zip(own, changed, strict=True):
                        tree, index = next(walk)
                        path = paths.above(tree, 0, index)
                        if tree not in subroots:
                            own_levels = len(path) - len(paths.above(TOP, 0, tree))
                            subroots = {tree: fold(leaf.encode(), path[:own_levels]).decode()}
                        made_rows.append((leaf, subroots[tree], root, siblings(path).decode(), fold((other or leaf).encode(), path).decode()))
                    arrays = [pa.array(c, t.type) for c, t in zip(zip(*made_rows, strict=True), arrow, strict=True)]
                    old = _column(b, "_row")
                    yield pa.RecordBatch.from_arrays([old.field(old.type.get_field_index(n)) for n in names] + arrays, names=[*names, *OUTPUTS])

        return self.leaves.mapInArrow(run, schema)


OUTPUTS = ("leaf", "subroot", "root", "proof", "folded_root")


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _read(rows: list[pa.RecordBatch]) -> tuple[list[int], bytes]:
    """Rows of each group in a partition, in order, and all leaves in a row."""
    leaves, sizes, last = [], [], object()
    for b in rows:
        leaves.append("".join(_column(b, "_leaf").to_pylist()).encode())
        names = _column(b, "_group").dictionary_encode()
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]))
        for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            name = names.dictionary[int(codes[a])].as_py() if codes[a] >= 0 else None
            if sizes and name == last:
                sizes[-1] += e - a
            else:
                sizes.append(e - a)
            last = name
    return sizes, b"".join(leaves)


def framed(column: Column) -> Column:
    """A value's text behind its length in bytes, so that no two rows read alike; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def places_of(sorted_leaves: DataFrame) -> tuple[list[Place], int, int]:
    """(a place for each partition, groups, rows). What is gathered is one row for each partition."""
    key = F.struct(F.col("_group").isNotNull().alias("some"), F.col("_group").alias("name"))
    runs = sorted_leaves.groupBy(F.spark_partition_id().alias("p"), key.alias("key")).agg(F.count("*").alias("n"))
    ends = runs.groupBy("p").agg(F.min(F.struct("key", "n")).alias("first"), F.max(F.struct("key", "n")).alias("last"), F.count("*").alias("groups"), F.sum("n").alias("n"))
    found = {r["p"]: r for r in ends.collect()}
    totals: dict[tuple, int] = {}  # of the groups that begin or end a partition
    for r in found.values():
        for end in {"first", "last"} if r["groups"] > 1 else {"first"}:
            k = tuple(r[end]["key"])
            totals[k] = totals.get(k, 0) + r[end]["n"]
    n_parts = max(found, default=-1) + 1
    places, index, last, seen = [], -1, None, 0
    for p in range(n_parts):
        r = found.get(p)
        if r is None:
            places.append(Place(0, 0, 0, 0))
            continue
        first, end = tuple(r["first"]["key"]), tuple(r["last"]["key"])
        before = seen if first == last else 0
        index += first != last
        places.append(Place(index, before, totals[first], totals[end]))
        index += r["groups"] - 1
        seen = r["last"]["n"] + (before if r["groups"] == 1 else 0)
        last = end
    return places, index + 1, sum(r["n"] for r in found.values())


def build(
    df: DataFrame,
    columns: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    candidate: Mapping[str, Column] | None = None,
    candidate_where: Column | None = None,
    keep: list[str] | None = None,
) -> Manifest:
    """The manifest of ``df``, whose rows are vouched for in ``columns``, in that order.

    Groups are ordered bytewise with null first, rows of a group by id with null first; rows of one id by
    their digest (equal rows are equal leaves, so their order doesn't matter). Nulls in any column are part
    of the digest. ``candidate`` replaces columns' values for a second digest, taken where ``candidate_where``
    holds, which ``proofs`` folds in place of the leaf. ``keep`` (default: all columns) are carried to the proofs.
    An empty frame has no root and no proofs. A lone row's digest is its group's root, a lone group's root the root.
    """
    source = {c: column_of(c) for c in columns}
    leaf = leaf_digest(list(source.values()))
    other = F.lit(None).cast("string")
    if candidate:
        other = F.when(candidate_where if candidate_where is not None else F.lit(True), leaf_digest(list((source | dict(candidate)).values())))
    kept = df if keep is None else df.select(*[column_of(c) for c in keep])
    rows = df.select(column_of(group_col).cast("string").alias("_group"), column_of(id_col).alias("_id"), leaf.alias("_leaf"), other.alias("_candidate"), packed(kept).alias("_row"), F.monotonically_increasing_id().alias("_tie"))
    order = ["_group", "_id", "_leaf", "_tie"]  # equal rows are dealt to several ranges by the last
    sc = df.sparkSession.sparkContext
    n = min(MOST_PARTITIONS, max(sc.defaultParallelism, -(-df.count() // PARTITION_ROWS)))
    leaves = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_id", "_tie"))
    places, n_groups, n_rows = places_of(leaves)
    if not n_rows:
        return Manifest(None, 0, 0, leaves, places, {})
    given = sc.broadcast((places, n_groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            at, groups = given.value
            place = at[TaskContext.get().partitionId()]
            made = _forest(place, groups, *spans(place, groups, *_read(got)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["forest"])

    parts = leaves.select("_group", "_leaf").mapInArrow(run, "forest binary")
    whole = parts.rdd.map(lambda r: pickle.loads(r[0])).treeReduce(Forest.merge, depth=3)
    whole = Forest(n_groups).merge(whole)  # a single forest may have a group's root still to hand on
    return Manifest(whole.root(), n_rows, n_groups, leaves, places, whole.spine)
