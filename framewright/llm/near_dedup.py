"""Near-dedup by bottom-k sketches from one hash function.

A text's set is its distinct word shingles, as 64-bit hashes; its sketch is the ``K`` smallest. Texts
with equal sets are one class from the start. Between classes:

1. Inverted lists of the first ``LISTED`` retained values generate overlaps. Lists of up to ``COLD``
   classes give their pairs; a pair goes on when it shares as many values as a similarity at the
   threshold would with near certainty (five standard errors and more below its mean).
2. Union sketches estimate the similarity of a pair; far lower ones go (again five standard errors).
3. The rest are verified exactly on full sets.

Classes with few values outside longer lists (big groups of near copies, texts of very common words)
get lists by *tuples* of retained values, ``BANDS`` of them, which part texts of common words (tuples of
a value that no other of these classes retains are not made: they meet nothing); classes that such
lists connect are a cluster. A cluster is compared exactly on full sets, in blocks that
multiply incidence matrices and give links only: small clusters whole; large ones first against a few
central members, and then every member that is not in the largest component so far against all others.
So each group is linked whole without forming its pairs.

A link of step 1 and 2 is missed only if random values disagree beyond those bounds (below one in a
million). Tuples are drawn from the values below a limit of hash space that two sets of similar sizes
have in common, so a text inside a longer one meets it as surely as two of one size do: of 16,000 random
pairs of that kind at the threshold or little above it, each shared a tuple.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm import bloom
from framewright.llm.arrow import append_columns
from framewright.llm.components import connected_components
from framewright.llm.joins import column_of, hot_join, shuffled
from framewright.llm.lineage import cut
from framewright.llm.text import U64, mix, shingles, words

K = 64
LISTED = 32
#: Values among which a class's own are told, and how many of them must lie outside long lists.
TOLD, ENOUGH = 24, 12
COLD = 32
#: Tuple lists, how many values a tuple has, and how many values the larger of two sets is to have below
#: their common limit (less than ``K`` by four standard errors).
BANDS, TUPLE, BELOW = 56, 4, 40
#: Bands that join most of a large group, before the others' keys are made.
OPENING = 8
#: Classes whose keys one task makes.
DEALT = 1024
#: Members of a large cluster that all others are compared with first.
CENTRAL = 8
#: Classes, and elements of their sets, that one side of a block holds.
BLOCK, BLOCK_ELEMENTS = 512, 400_000

SKETCH = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("key_a", T.LongType()),
        T.StructField("key_b", T.LongType()),
        T.StructField("sketch", T.ArrayType(T.LongType(), False)),
    ]
)


def _sets(col: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's set, sorted, as 63-bit hashes (so that signed and unsigned order agree)."""
    h, bounds = shingles(words(col), size)
    h = (h >> U64(1)).view(np.int64)
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _keys(sets: list[np.ndarray]) -> list[list[int]]:
    """[key_a, key_b, n] of each set."""
    key_a = [int(mix(s.view(U64)).sum(dtype=U64).view(np.int64)) for s in sets]
    key_b = [int(np.bitwise_xor.reduce(mix(s.view(U64) + U64(0x51ED))).view(np.int64)) if len(s) else 0 for s in sets]
    return [key_a, key_b, [len(s) for s in sets]]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def sketches(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, sketch) of each text; the keys identify its set."""

    def make():
        def run(col: pa.Array) -> list:
            sets = _sets(col, size)
            key_a, key_b, n = _keys(sets)
            return [n, key_a, key_b, _lists([s[:K] for s in sets])]

        return run

    rows = df.select(column_of(id_col).alias("doc_id"), column_of(text_col).alias("_text"))
    return append_columns(rows, "_text", SKETCH, make, ["doc_id"])


def least_shared(told: int, threshold: float) -> int:
    """Shared values among ``told`` that a pair at the threshold falls short of by chance less than once in a million."""
    return max(1, math.floor(threshold * told - 5 * math.sqrt(told * threshold * (1 - threshold))) - 1)


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of classes that may be linked, classes with few values outside long lists)."""
    listed = classes.select("cls", "n", F.posexplode(F.slice("sketch", 1, LISTED)).alias("pos", "value"))
    often = listed.groupBy("value").agg(F.count("*").alias("f")).filter("f > 1")
    met = cut(listed.join(shuffled(often), "value"))
    cold, hot = met.filter(F.col("f") <= COLD), met.filter(F.col("f") > COLD)
    x = cold.select("value", F.col("cls").alias("a"), F.col("n").alias("n_a"))
    y = cold.select("value", F.col("cls").alias("b"), F.col("n").alias("n_b"))
    shared = x.join(shuffled(y), "value").filter((F.col("a") < F.col("b")) & _near_sizes(F.col("n_a"), F.col("n_b"), percent))
    shared = shared.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("n_a", "n_b")).alias("n"))
    in_hot = cut(hot.filter(F.col("pos") < TOLD).groupBy("cls").agg(F.count("*").alias("in_hot")))
    table = F.create_map(*[F.lit(v) for m in range(TOLD + 1) for v in (m, least_shared(m, percent / 100))])
    for end in ("a", "b"):
        hot_of = in_hot.select(F.col("cls").alias(end), F.col("in_hot").alias(f"hot_{end}"))
        shared = shared.join(shuffled(hot_of), end, "left").fillna(0, [f"hot_{end}"])
    told = F.least(F.lit(TOLD), F.col("n")) - F.greatest("hot_a", "hot_b")
    told = F.greatest(F.lit(0), told).cast("int")
    pairs = shared.filter(F.col("shared") >= F.element_at(table, told)).select("a", "b")

    # Sets of fewer than four shingles are linked to equal sets only, which are one class already.
    few = in_hot.join(shuffled(classes), "cls").filter((F.col("n") > 3) & (F.least(F.lit(TOLD), F.col("n")) - F.col("in_hot") < ENOUGH))
    return pairs, few.select("cls", "n", "in_hot", "sketch")


KEYS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("key", T.LongType())])
VALUES = T.StructType([T.StructField("value", T.LongType()), T.StructField("f", T.LongType())])


def limits(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two (tag, limit) of each set size: any two sizes that a link may have share one of them.

    Sizes fall into classes a little wider than the threshold allows, so linked sets are in one class or
    in neighbouring ones; a limit belongs to a class and the next and leaves about ``BELOW`` values of the
    largest set in them. Where that is all of a set, the tag is -1 and the limit the end of hash space.
    """
    base = 100 / percent * (1 + 1e-6)
    own = np.floor(np.log(np.maximum(n, 1)) / np.log(base)).astype(np.int64)
    out = []
    for tag in (own, own - 1):
        share = BELOW / base ** (tag + 2)
        out.append((np.where(share < 1, tag, -1), np.where(share < 1, np.minimum(share, 1) * 2.0**63, 2.0**63)))
    return out


def shared_values(few: DataFrame) -> tuple[Broadcast, int]:
    """(Bloom filter, its bits) of the (mixed) values that at least two of the sketches hold.

    Each task counts its own values first, so one that all sketches hold costs a row a batch. The filter has a bound;
    past its capacity it holds more values than it should, never fewer.
    """

    def run(batches):
        for batch in batches:
            values, f = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mix(values.view(U64)).view(np.int64)), pa.array(f)], names=VALUES.names)

    counted = few.select("sketch").mapInArrow(run, VALUES).groupBy("value").agg(F.sum("f").alias("f"))
    often = cut(counted.filter("f > 1").select("value"))
    bits = bloom.bits_for(often.count())
    return few.sparkSession.sparkContext.broadcast(bloom.collected(bloom.members(often, "value", bits), bits)), bits


def tuple_keys(
    sketches: list[np.ndarray], n: np.ndarray, percent: int, bands: range = range(BANDS), shared: tuple[np.ndarray, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(place of the sketch, key): a key for each of the bands and each limit of a sketch, of the ``TUPLE`` values below
    the limit that come first in that band's order. Given the filter of ``shared_values``, keys of a value that it
    doesn't hold are left out: no other sketch has them."""
    size = np.array([len(x) for x in sketches])
    values = np.zeros((len(sketches), K), U64)
    inside = np.arange(K)[None, :] < size[:, None]
    values[inside] = np.concatenate([*sketches, np.zeros(0, np.int64)]).view(U64)
    alone = inside & ~bloom.holds(*shared, mix(values)) if shared else None
    (tag, limit), (tag_2, limit_2) = limits(n, percent)
    where, keys = [], []
    for own, end, live in ((tag, limit, np.ones(len(n), bool)), (tag_2, limit_2, tag_2 != tag)):
        below = inside & (values < np.minimum(end, 2.0**63).astype(U64)[:, None])
        for band in bands:
            salt = mix(np.array([band + 0xB0], U64))[0]
            order = np.where(below, mix(values ^ salt), U64(0xFFFFFFFFFFFFFFFF))
            first = np.sort(np.partition(order, TUPLE - 1, axis=1)[:, :TUPLE], axis=1)
            key = mix((mix(first) * np.arange(1, 2 * TUPLE, 2, dtype=U64)).sum(axis=1, dtype=U64) + salt + own.astype(U64))
            made = live if alone is None else live & ~(alone & below & (order <= first[:, -1:])).any(axis=1)
            where.append(np.flatnonzero(made))
            keys.append(key[made])
    return np.concatenate(where), np.concatenate(keys)


def keys_of(rows: DataFrame, percent: int, bands: range, shared: tuple[Broadcast, int] | None = None) -> DataFrame:
    """(cls, key) of (cls, n, sketch) rows, for some of the bands; each once in a batch, where rows bear one class.
    With the filter of ``shared_values``, without keys that only one row has for sure."""

    def run(batches):
        held = shared and (shared[0].value, shared[1])
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for at in range(0, batch.num_rows, 512):
                cls, n, sketch = (batch.column(i).slice(at, 512) for i in range(3))
                where, made = tuple_keys([x.values.to_numpy() for x in sketch], n.to_numpy(), percent, bands, held)
                found.append(np.stack((cls.to_numpy()[where], made.view(np.int64))))
            found = np.concatenate(found, axis=1)
            found = found[:, np.lexsort(found)]
            first = np.ones(found.shape[1], bool)
            first[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in found], names=KEYS.names)

    return rows.mapInArrow(run, KEYS)


def key_links(named: DataFrame) -> DataFrame:
    """Links (a, b) of (cls, key) rows: from each to the smallest of its key, for keys that several have."""
    named = cut(named)  # read twice, made once
    lists = named.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first <> last")
    met = named.join(shuffled(cut(lists.select("key", "first"))), "key").filter("cls <> first")
    return met.select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()


def later_keys(few: DataFrame, opening: DataFrame, percent: int, shared: tuple[Broadcast, int] | None = None, tasks: int | None = None) -> DataFrame:
    """Distinct (cls, key) of the bands after the first ``OPENING``, where a class goes by the smallest that the links of
    those first bands join it to. Most of a group goes by few then, which bear a key once."""
    held = opening.groupBy("a").agg(F.min("b").alias("b"))
    rows = few.join(shuffled(held), F.col("cls") == F.col("a"), "left").select(F.coalesce("b", "cls").alias("cls"), "n", "sketch")
    return keys_of(rows.coalesce(tasks) if tasks else rows, percent, range(OPENING, BANDS), shared).distinct()


def clusters(few: DataFrame, percent: int) -> DataFrame:
    """(cls, n, in_hot, cluster, size, elements) of classes that tuple lists connect to others."""
    tasks = math.ceil(max(1, few.count()) / DEALT)
    slim = few.select("cls", "n", "sketch")
    shared = shared_values(slim.coalesce(tasks))
    opening = cut(key_links(keys_of(slim.coalesce(tasks), percent, range(OPENING), shared)))
    connected = connected_components(opening.unionByName(key_links(later_keys(slim, opening, percent, shared, tasks))))
    found = cut(connected.toDF("cls", "cluster").join(shuffled(few.select("cls", "n", "in_hot")), "cls"))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("elements"), F.count("*").alias("_rows"))
    return cut(hot_join(found, cut(sizes), ["cluster"], "_rows", found.count()))


LINKS = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "comp_a", "comp_b")])


def _block_links(percent: int):
    """Links of a block's asking rows to its other rows, one for each (asking row, component)."""

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        cls = table.column("cls").to_numpy()
        comp = table.column("comp").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("set")]
        own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(own) and len(others):
            size = np.array([len(x) for x in sets])
            number, code = np.unique(np.concatenate([sets[i] for i in (*own, *others)]), return_inverse=True)
            row = np.repeat(np.arange(len(own) + len(others)), size[np.concatenate((own, others))])
            split = np.searchsorted(row, len(own))
            here = np.bincount(code[:split], minlength=len(number)).astype(bool) & np.bincount(code[split:], minlength=len(number)).astype(bool)
            place = np.cumsum(here) - 1
            width, common = 8192, np.zeros((len(own), len(others)), np.float32)
            for at in range(0, int(here.sum()), width):
                sides = []
                for part, rows, base in ((slice(0, split), len(own), 0), (slice(split, None), len(others), len(own))):
                    c, r = code[part], row[part] - base
                    keep = here[c] & (place[c] >= at) & (place[c] < at + width)
                    m = np.zeros((rows, width), np.float32)
                    m[r[keep], place[c[keep]] - at] = 1
                    sides.append(m)
                common += sides[0] @ sides[1].T
            union = size[own][:, None] + size[others][None, :] - common
            linked = (common * 100 >= union * percent) & (comp[own][:, None] != comp[others][None, :])
            for i in np.flatnonzero(linked.any(axis=1)):
                js = np.flatnonzero(linked[i])
                _, first = np.unique(comp[others][js], return_index=True)
                out += [[int(x) for x in (cls[own[i]], cls[others[j]], comp[own[i]], comp[others[j]])] for j in js[first]]
        return pa.table({name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(LINKS.names)})

    return run


def blocks_for(rows: Column, elements: Column) -> Column:
    """How many blocks so many rows, with so many elements in their sets, are dealt into."""
    return F.ceil(F.greatest(F.lit(1), rows / BLOCK, elements / BLOCK_ELEMENTS)).cast("int")


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between asking members of each cluster and all its members, by exact comparison.

    ``members``: (cluster, cls, comp, asks, k_own, k_other), written; ``sets``: (cls, set). The asking are
    dealt into ``k_own`` blocks and all into ``k_other``, by a hash of the class; each pair of blocks is one
    small group. Rows are copied once for each block they meet.
    """
    rows, h = members.join(shuffled(sets), "cls"), F.xxhash64("cls")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = rows.filter("asks").select("cluster", F.pmod(h, F.col("k_own")).cast("int").alias("i"), each("k_other").alias("j"), "cls", "comp", "set", F.lit(True).alias("asks"))
    others = rows.select("cluster", each("k_own").alias("i"), F.pmod(h, F.col("k_other")).cast("int").alias("j"), "cls", "comp", "set", F.lit(False).alias("asks"))
    return own.unionByName(others).groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), LINKS)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose similarity, estimated from the ``K`` smallest values of both sketches' union, isn't
    far below the threshold."""
    t = percent / 100
    least = t - 5 * math.sqrt(t * (1 - t) / K)
    x = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("s_a"))
    y = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("s_b"))
    both = pairs.join(shuffled(x), "a").join(shuffled(y), "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    common = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    return both.filter(common >= least * F.size(union)).select("a", "b")


def sets_of(ends: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(cls, set) of the classes in ``ends``, made anew from a text of each.

    A Bloom filter of bounded size finds the rows that bear the ids of those classes, so only (about)
    their sets shuffle; a row's keys tell which class it is of, should ids repeat.
    """
    named = cut(classes.select("cls", "key_a", "key_b", "n", "first_id").join(shuffled(ends), "cls", "left_semi"))
    bits = bloom.bits_for(named.count())
    pages = bloom.members(named.select(F.xxhash64("first_id").alias("_key")), "_key", bits)
    some = bloom.probe(docs.select("doc_id", "text").withColumn("_key", F.xxhash64("doc_id")), "_key", pages, bits, "_in").filter("_in")
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in KEY], T.StructField("set", T.ArrayType(T.LongType(), False))])

    def make():
        def run(col: pa.Array) -> list:
            sets = _sets(col, size)
            return [*_keys(sets), _lists(sets)]

        return run

    sets = append_columns(some, "text", schema, make, []).dropDuplicates(KEY)
    return sets.join(shuffled(named), KEY).select("cls", "set")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` of their full sets."""
    both = pairs.join(shuffled(sets.select(F.col("cls").alias("a"), F.col("set").alias("s_a"))), "a")
    both = both.join(shuffled(sets.select(F.col("cls").alias("b"), F.col("set").alias("s_b"))), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(common * 100 >= (F.size("s_a") + F.size("s_b") - common) * percent).select("a", "b")


#: Tells a set from all others.
KEY = ["key_a", "key_b", "n"]


def classes_of(sketched: DataFrame) -> DataFrame:
    """(key_a, key_b, n, first_id, sketch, members, cls) of each set that isn't empty: the smallest id that
    bears it, its sketch, how many rows do, and a number of its own."""
    some = sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    grouped = some.groupBy("key_a", "key_b", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"), F.count("*").alias("members")
    )
    return grouped.withColumn("cls", F.monotonically_increasing_id())


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row.

    A text's set holds its distinct shingles of ``size`` words (runs of anything but blanks and
    0x09-0x0D, A-Z lower-cased); a text with fewer words has one, the whole sequence; one without
    words, or null, has none and is linked with nothing. Texts are linked when
    100 * intersection >= percent * union; ``component_id`` is the smallest doc_id that links reach
    (the text's own included) and ``kept`` whether that is its own. Rows with a null doc_id are linked
    with nothing, get a null component_id and are kept. A row that shares its id with another has its own
    text's answer, and a text that several ids bear goes by the smallest of them. A set is held as 63-bit
    hashes of its shingles. A text of any length is read whole, by one task. Other columns are left out.
    An empty frame gives an empty frame.
    """
    docs = df.select(column_of(id_col).alias("doc_id"), column_of(text_col).alias("text"))
    sketched = cut(sketches(docs, size))
    classes = cut(classes_of(sketched))
    total = sketched.count()
    pairs, few = candidates(classes, percent)
    pairs = cut(estimated(pairs, classes, percent))
    grouped = clusters(cut(few), percent)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(grouped.select("cls")).distinct()
    sets = cut(sets_of(cut(ends), classes, docs, size))
    links = verified(pairs, sets, percent)
    whole = F.col("size") <= BLOCK
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("in_hot"), F.xxhash64("cls")))
    central = grouped.filter(~whole).select("cluster", "cls", "in_hot", rank.alias("rank")).filter(F.col("rank") <= CENTRAL)
    asks = grouped.join(shuffled(central.select("cls", "rank")), "cls", "left").withColumn("asks", whole | F.col("rank").isNotNull())
    k = blocks_for(F.col("size"), F.col("elements"))
    asks = cut(asks.select("cluster", "cls", F.col("cls").alias("comp"), "asks", F.when(whole, k).otherwise(1).alias("k_own"), k.alias("k_other")))
    links = cut(links.unionByName(block_links(asks, sets, percent).select("a", "b")))
    components = connected_components(links)
    large = grouped.filter(~whole)
    if not large.isEmpty():
        large = cut(large.join(shuffled(components), F.col("cls") == F.col("node"), "left").select("cluster", "cls", "n", "size", "elements", F.coalesce("component", "cls").alias("comp")))
        parts = large.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("e"))
        tops = parts.groupBy("cluster").agg(F.max(F.struct("m", "comp", "e")).alias("top"), F.sum("m").alias("_rows"), F.sum("e").alias("e"))
        left = blocks_for(F.col("_rows") - F.col("top.m"), F.col("e") - F.col("top.e"))
        tops = cut(tops.select("cluster", F.col("top.comp").alias("top"), left.alias("k_own"), "_rows"))
        rest = hot_join(large, tops, ["cluster"], "_rows", large.count())
        rest = cut(rest.select("cluster", "cls", "comp", (F.col("comp") != F.col("top")).alias("asks"), "k_own", k.alias("k_other")))
        more = cut(block_links(rest, sets, percent))
        if not more.isEmpty():  # components are joined as nodes of their own
            joined = connected_components(more, "comp_a", "comp_b").select(F.col("node").alias("old"), F.col("component").alias("new"))
            alone = large.filter("cls = comp").select(F.col("cls").alias("node"), F.col("comp").alias("component"))
            known = components.unionByName(alone).distinct()
            components = cut(known.join(shuffled(joined), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")))
    # A component goes by the smallest id in it; a class without links by its own.
    linked = cut(classes.select(*KEY, "cls", "first_id", "members").join(shuffled(components.select(F.col("node").alias("cls"), "component")), "cls"))
    smallest = cut(linked.groupBy("component").agg(F.min("first_id").alias("_component"), F.count("*").alias("_rows")))
    named = hot_join(linked, smallest, ["component"], "_rows", linked.count()).select(*KEY, "members", "_component")
    alone = classes.join(shuffled(components), F.col("cls") == F.col("node"), "left_anti").select(*KEY, "members", F.col("first_id").alias("_component"))
    named = cut(named.unionByName(alone))
    both = hot_join(sketched.drop("sketch").withColumnRenamed("n_shingles", "n"), named, KEY, "members", total).withColumnRenamed("n", "n_shingles")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return both.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they were whatever their names, but for those whose component
    keeps another. Rows with a null id stay; rows that share an id stay or go together."""
    marks = near_duplicates(df, size, percent, id_col, text_col).filter("not kept").select("doc_id")
    return bloom.without(df, id_col, marks)
