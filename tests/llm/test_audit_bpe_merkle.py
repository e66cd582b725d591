"""Filter audit, byte-level BPE and Merkle manifests against brute force; the bounded sample; scores by exact counts."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import byte_bpe, filter_audit, labelled, lm_score, merkle, queries
from framewright.llm.labelled import split_remainder

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# Filter audit


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def counted(t):
    w = WORD.findall(t)
    return (len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t)))


TEXTS = ["", " ", "a", "A a A", "one  two\tone\n", "ÄA# é é|", "x" * 5000, "\x0b\x0c\r", "w " * 300 + "$", "中文 中文 #"]


def test_figures_equal_counting(monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abAB #\n\té中") for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [counted(t) for t in texts]
    assert list(zip(*(f.tolist() for f in filter_audit.figures(*block(texts))), strict=True)) == want
    assert [tuple(int(f[0]) for f in filter_audit.figures(*block([t]))) for t in texts] == want
    # All words share a hash: neighbours that differ are found by their bytes and counted as words.
    monkeypatch.setattr(filter_audit, "word_hashes", lambda raw, s, e: np.zeros(len(s), np.uint64))
    assert list(zip(*(f.tolist() for f in filter_audit.figures(*block(texts))), strict=True)) == want


def test_hashes_don_t_depend_on_windows():
    raw, off = block(["some words and a verylongword " * 40])
    s, e = filter_audit.bounds_of_words(filter_audit.CLASSES[raw], off)
    whole = filter_audit.word_hashes(raw, s, e)
    for window in (1, 7, 64, 1000):
        assert np.array_equal(filter_audit.word_hashes(raw, s, e, window), whole)


def brute_audit(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        words, distinct, capitals, points, symbols = counted(t or "")
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 3 * points, "D": symbols > 0, "E": i is not None and first[t or ""] < i}
        docs.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shares = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                earlier = set(order[:k])
                alive = [d for d in mine if not d[1] & earlier]
                removed = [d for d in alive if c in d[1]]
                shares[part, c] += len(removed)
                out[part, "".join(order), k + 1] = [
                    len(alive) - len(removed), len(removed), sum(c in d[1] for d in mine) - len(removed), sum(d[1] == {c} for d in mine),
                    sum(d[2] for d in removed), sum(d[3] for d in removed),
                ]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_op11_equals_brute_force_with_nulls_ties_and_repeats(spark):
    long = "word other Third " * 90
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (4, long, "en"), (4, long, "en"), (5, long, "de"), (None, long, "en"), (None, "x", None), (6, "A# " * 250, "en"), (7, " ".join(map(str, range(250))), "en")]
    labels = [(4, 1, 0), (4, 0, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"mask": F.lit("x"), "n_words": F.lit("y"), "part": F.lit(0)})
    made = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert audited(made) == brute_audit(rows, labels)
    assert len(audited(made)) == 3 * 120 * 5
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_op11_query(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(queries.op11_filter_audit(spark, DATA)) == brute_audit(rows, labels)


def test_measure_replaces_columns_and_takes_other_letters(spark):
    made = filter_audit.measure(spark.createDataFrame([("a b a", "old")], "text string, n_words string")).first()
    assert (made["n_words"], made["n_distinct"]) == (3, 2)
    two = spark.createDataFrame([("p", 1, False, False, 2), ("p", 3, True, False, 1), ("p", 0, False, False, 4)], "part string, mask int, good boolean, toxic boolean, n bigint")
    got = audited(filter_audit.interactions(two, "XY"))
    assert got["p", "XY", 1] == (4, 3, 0, 2, 1, 0, 5) and got["p", "XY", 2] == (4, 0, 1, 0, 0, 0, 1) and got["p", "YX", 2] == (4, 2, 1, 2, 0, 0, 5)
    with pytest.raises(ValueError):
        filter_audit.interactions(two, "XX")


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def coded(bpe, texts):
    raw, off = block(texts)
    ids, ends, bounds = bpe.encode(raw, off)
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        assert bpe.decode(ids[a:b], ends[a:b] - off[d]).tobytes() == texts[d].encode()
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


SIGNS = st.text(alphabet=st.sampled_from(list(" \n\t'''abstrevmldSTL019,.!-é中 　\u0085😀́٣  \x1c\x00\U00013460")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(SIGNS, st.text(max_size=20)), min_size=1, max_size=6))
def test_byte_bpe_equals_the_library(library, texts):
    want = [library.encode_ordinary(t) for t in texts]
    assert coded(byte_bpe.load(PATH), texts) == want
    for width, window in ((1, 1), (4, 7), (16, 64)):
        bpe = byte_bpe.load(PATH)
        own = byte_bpe.Splitter(width, window)
        assert np.array_equal(own.starts(*block(texts)), bpe.split.starts(*block(texts)))


def test_every_character_is_split_as_the_library_does(library):
    """Each code point between letters, so that its class decides the pre-tokens."""
    bpe = byte_bpe.load(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}a1{chr(c)}" for c in points[k : k + 4000]) for k in range(0, len(points), 4000)]
    for t in texts:
        assert coded(bpe, [t]) == [library.encode_ordinary(t)]


def test_very_long_texts_and_a_small_cache(library):
    texts = ["x" * 300_000 + " " * 50_000 + "é" * 20_000 + "''" * 999 + "'s", "it's 1 'llama' " * 30_000, ""]
    bpe = byte_bpe.ByteBpe(PATH, cache_bytes=2000, splitter=byte_bpe.Splitter(window=1000))
    assert coded(bpe, texts) == [library.encode_ordinary(t) for t in texts]


def test_op12_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_encode_and_decode_frames(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "don't stop", "c"), (3, "don't stop", "c"), (None, "<|endoftext|>", "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ends string")
    made = byte_bpe.encode(df, PATH)
    assert made.columns == ["doc_id", "text", "ids", "ends"]
    back = byte_bpe.decode(made, PATH, out_col="text").collect()
    assert sorted((r["doc_id"] or 0, bytes(r["text"]).decode()) for r in back) == [(0, "<|endoftext|>"), (1, ""), (2, ""), (3, "don't stop"), (3, "don't stop")]
    r = made.filter("doc_id = 3").first()
    assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary("don't stop") and np.frombuffer(r["ends"], "<u4").tolist() == [3, 5, 10]
    assert byte_bpe.encode(df.limit(0), PATH).count() == 0
    wrong = spark.createDataFrame([(bytes(4), bytes(4)), (None, b"")], "ids binary, ends binary")
    assert byte_bpe.decode(wrong.filter("ids is null"), PATH).first()["decoded"] is None
    with pytest.raises(Exception, match="offsets don't fit"):
        byte_bpe.decode(wrong, PATH).collect()
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.load(PATH).decode(np.array([99_999_999], np.uint32), np.array([1]))


def test_composition_is_associative():
    split = byte_bpe.load(PATH).split
    table = split.compose.reshape(split.n, split.n)
    for a, b, c in itertools.product(range(split.n), repeat=3):
        assert table[table[a, b], c] == table[a, table[b, c]]


# Merkle manifests

ROW = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def climb(nodes):
    """(root, proofs: the siblings of each node's way up) of a list of digests."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
    root, above = climb([h("".join(r)) for r in runs])
    return root, [[(r[:k], r[k + 1 :]), *above[j]] for j, r in enumerate(runs) for k in range(len(r))]


def brute_manifest(rows):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(frame, r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in groups[s]]) for s in order]
    root, above = climb([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (subroot, proofs), more in zip(order, trees, above, strict=True):
        for r, p in zip(groups[s], proofs, strict=True):
            folded = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = leaf((*r[:4], None if r[4] is None else re.sub("[A-Z]+", lambda m: m[0].lower(), r[4])))
            for left, right in p + more:
                folded = h("".join(left) + folded + "".join(right))
            proof = h("".join("".join(left + right) for left, right in p + more))
            out.append((r[0], leaf(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(manifest):
    p = manifest.proofs().select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", (F.col("folded_root") == F.col("root")))
    return sorted((tuple(r) for r in p.collect()), key=repr)


SIZES = {"a": 1, "b": 2, "c": 15, "d": 16, "e": 17, "é": 256, "f": 257, None: 300, "": 3, "B": 33}


@pytest.mark.parametrize("tiny", [False, True])
def test_manifests_equal_brute_force(spark, monkeypatch, tiny):
    """Group sizes around the arity; tiny: partitions of 7 rows and up, so that runs cross many of them."""
    if tiny:
        monkeypatch.setattr(merkle, "PARTITION_ROWS", 7)
    rng, rows = random.Random(4), []
    for source, n in SIZES.items():
        for _ in range(n):
            rows.append((rng.randrange(10_000), source, rng.choice(["en", None, ""]), rng.choice([None, 7]), rng.choice([None, "", "Text", "text", "1:a", "ÄB"])))
    rng.shuffle(rows)
    m = queries.tampered_manifest(spark.createDataFrame(rows, ROW))
    want = brute_manifest(rows)
    assert (m.root, m.n_rows, m.n_groups) == (want[0][3], len(rows), len(SIZES)) and manifest_rows(m) == want
    assert {w[6] for w in want} == {True, False}


def test_many_groups_and_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PARTITION_ROWS", 16)
    rows = [(k, f"s{k:04d}", "en", 1, "X") for k in range(300)] + [(5, "hot", "en", 1, "Same")] * 200 + [(None, "hot", None, None, None)] * 2
    m = queries.tampered_manifest(spark.createDataFrame(rows, ROW))
    assert manifest_rows(m) == brute_manifest(rows)
    assert len({r[0] for r in m.leaves.select(F.spark_partition_id()).distinct().collect()}) > 20  # equal rows are split too


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "s", "en", 1, "A")] * 17])
def test_small_manifests(spark, rows):
    m = queries.tampered_manifest(spark.createDataFrame(rows, ROW))
    want = brute_manifest(rows)
    assert manifest_rows(m) == want and m.root == (want[0][3] if want else None)


def test_any_change_changes_the_root_and_names_may_clash(spark):
    rows = [(k, "s", "en", 1, f"t{k}") for k in range(40)]
    df = spark.createDataFrame(rows, ROW).withColumns({"root": F.lit("old"), "_leaf": F.lit(1), "a`b": F.lit(2)})
    build = lambda d: merkle.build(d, ["doc_id", "source", "text"])
    m = build(df)
    assert m.proofs().columns == ["doc_id", "source", "lang", "n_chars", "text", "_leaf", "a`b", *merkle.OUTPUTS]
    assert build(df.repartition(9)).root == m.root and build(df.filter("doc_id <> 39")).root != m.root
    assert build(df.withColumn("text", F.when(F.col("doc_id") == 3, "T3").otherwise(F.col("text")))).root != m.root
    assert build(df.withColumn("lang", F.lit("de"))).root == m.root  # not vouched for


def test_merging_forests_is_associative_and_commutative():
    rng = random.Random(6)
    sizes = [1, 40, 300, 17]
    leaves = [[h(f"{g}.{i}").encode() for i in range(n)] for g, n in enumerate(sizes)]
    pieces = []
    for g, own in enumerate(leaves):
        at = 0
        while at < len(own):
            n = rng.randrange(1, 30)
            span = merkle.Span(len(own), at, b"".join(own[at : at + n]))
            f = merkle.Forest(len(sizes))
            f.sizes[g] = len(own)
            f.nodes |= {(g, level, i): d for level, i, d in span.open()}
            pieces.append(f)
            at += n
    want = climb([climb([x.decode() for x in own])[0] for own in leaves])[0]
    import copy

    for _ in range(5):
        some = [copy.deepcopy(p) for p in pieces]
        rng.shuffle(some)
        while len(some) > 1:
            k = rng.randrange(len(some) - 1)
            some[k : k + 2] = [some[k].merge(some[k + 1])]
        assert merkle.Forest(len(sizes)).merge(some[0]).root() == want
    with pytest.raises(ValueError, match="missing"):
        merkle.Forest(len(sizes)).merge(pieces[3]).merge(pieces[0]).root()


# Labels and scores


def test_a_sample_has_a_row_for_each_id(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("a "), (F.col("id") % 3).cast("string")).alias("text")).unionByName(spark.createDataFrame([(8, "b b"), (9, "c"), (10, None)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (9, 0), (9, 1), (10, 1), (11, 1), (None, 1), (8, None)], "doc_id bigint, quality int")

    def features(w):
        return np.repeat(np.arange(w.n_docs), np.diff(w.bounds)), np.arange(len(w.hashes))

    got = labelled.bounded_sample(docs, labels, "quality", F.lit(True), features, 3000)
    assert got.labels.tolist() == [1, 0, 1] and np.diff(got.bounds).tolist() == [2, 2, 0]  # 7, 8 and 10; 9 is labelled both ways


def test_scores_stay_near_those_of_exact_counts(spark):
    """The filter's model against the same formula with exact counts of words and pairs."""
    docs = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = docs.filter(split_remainder(F.col("doc_id"), 10) != 0)
    low = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    toks = lambda t: [*WORD.findall(low(t)), None]
    words, pairs = collections.Counter(), collections.Counter()
    for r in train.collect():
        t = toks(r["text"])
        words.update(t)
        pairs.update(zip([None, *t[:-1]], t, strict=True))
    total = sum(words.values()) + 0.1 * (len(words) + 1)
    model = lm_score.train(train)
    off, n, worst = 0.0, 0, 0.0
    for r in lm_score.score(docs, model).collect():
        t = toks(r["text"])
        want = sum(math.log10(0.4 * (pairs[a, b] / words[a] if words[a] else 0) + 0.6 * (words[b] + 0.1) / total) for a, b in zip([None, *t[:-1]], t, strict=True))
        off, n = off + abs(r["score"] - want), n + len(t)
        worst = max(worst, abs(r["score"] - want) / len(t))
    assert off / n < 0.08 and worst < 0.25  # a level stands for counts up to half as high again


def test_a_pair_with_an_unknown_word_counts_for_nothing(spark):
    train = spark.createDataFrame([(1, "a b a b a b")], "doc_id bigint, text string")
    model = lm_score.train(train)
    texts = [f"a x{k}" for k in range(400)]
    scores = [r["score"] for r in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()]
    assert len({round(s, 9) for s in scores}) == 1  # no false hit lifts any


def test_arrow_slices_of_a_packed_column():
    made = byte_bpe._binary(np.array([1, 2, 3], "<u4"), np.array([0, 1, 1, 3]))
    assert [np.frombuffer(x, "<u4").tolist() for x in made.to_pylist()] == [[1], [], [2, 3]] and made.type == pa.binary()


def test_record_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """A run of long texts among short ones: no file takes more than the limit but for one longer record."""
    from framewright.llm import token_file

    monkeypatch.setattr(token_file, "FILE_BYTES", 20_000)
    rows = [(k, "short one" if k < 300 or k >= 400 else "many more words " * 300) for k in range(500)] + [(1000, "w " * 40_000), (None, None)]
    path = str(tmp_path / "tokens")
    coded = token_file.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), public_tokenizers.path("word_bpe_49k.json"))
    token_file.write(coded, path)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "tokens" / "records").rglob("part-*"))
    assert len(sizes) > 10 and sizes[-2] <= 20_000 < sizes[-1]
    got = token_file.read(spark, path).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, *range(500), 1000]
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))
    some = token_file.read_at(spark, path, token_file.index(spark, path).filter("doc_id in (350, 1000)"))
    want = {r["doc_id"]: bytes(r["ids"]) for r in got}
    assert {r["doc_id"]: bytes(r["ids"]) for r in some.collect()} == {k: want[k] for k in (350, 1000)}
