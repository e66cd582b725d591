"""Clashing names, nulls, empty tables and brute-force versions of queries and pipeline stages."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import bloom, components, decontam, exact_dedup, html_extract, lm_score, near_dedup, quality, queries, toxicity
from framewright.llm.labelled import Sample
from framewright.llm.text import mix, words

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"
CLASHING = ("_key", "_hit_a", "_hit_b", "_n", "_maybe", "_sha", "_keep", "_gone", "score", "_row", "_id", "_met", "_rows", "text_sha256", "_toxic", "_in", "cls", "hash", "item_id", "page_a")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def library_ids(name, texts):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.no_truncation()
    library.no_padding()
    return library, {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_op1_query(spark, texts):
    library, ids = library_ids("byte_bpe_50k.json", texts)
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, own in ids.items():
        decoded = library.decode(own, skip_special_tokens=False)
        want = (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_op7_query(spark, texts):
    _, ids = library_ids("word_bpe_49k.json", texts)
    at, want = 0, {}
    for i in sorted(ids):
        own = ids[i] + [1]
        want[i] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op7_token_file(spark, DATA).collect()} == want


def shingle_sets(rows, size):
    out = {}
    for i, t in rows.items():
        w = WORD.findall(low(t))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def linked(a, b, percent=80):
    common = len(a & b)
    return a and b and common * 100 >= percent * (len(a) + len(b) - common)


def test_op4_query(spark, texts):
    sets = shingle_sets(texts, 2)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if linked(sets[a], sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in texts}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op4_near_dedup(spark, DATA).collect()} == want


def test_near_dedup_where_ids_repeat(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y".split(), "A1 B1 C1 D1 E1 F1 G1 H1 I1 J1 K1 L1 M1 N1 O1 P1 Q1 R1 S1 T1".split()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (4, " ".join(b)), (4, " ".join(b))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1)]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2).collect()) == [1, 1]


@pytest.mark.parametrize(("small", "large"), [(4, 5), (12, 15), (200, 250), (213, 250), (1600, 2000), (1998, 2000)])
def test_subset_pairs_share_a_tuple(small, large):
    """A text inside a longer one, at the threshold or above it, meets it by a tuple."""
    rng, n = np.random.default_rng(small), 1500
    full = [np.unique(mix(rng.integers(0, 2**63, large + 8).astype(np.uint64)) >> np.uint64(1)).view(np.int64)[:large] for _ in range(n)]
    part = [np.sort(rng.permutation(x)[:small]) for x in full]
    keys = []
    for sets in (full, part):
        where, found = near_dedup.tuple_keys([x[: near_dedup.K] for x in sets], np.array([len(x) for x in sets]), 80)
        own = collections.defaultdict(set)
        for i, k in zip(where.tolist(), found.tolist(), strict=True):
            own[i].add(k)
        keys.append(own)
    assert all(keys[0][i] & keys[1][i] for i in range(n))


def test_exact_dedup_over_several_filters(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 16)
    rnd = random.Random(2)
    rows = [(i, f"text {rnd.randrange(9000)}" if i % 3 else "hot") for i in range(12000)] + [(None, "hot"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    best, size = {}, collections.Counter(t or "" for _, t in rows)
    for i, t in rows:
        best[t or ""] = max(i if i is not None else -1, best.get(t or "", -1))
    got = exact_dedup.mark_copies(df, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    assert all((r["keep_id"], r["group_size"]) == (best[r["text"] or ""], size[r["text"] or ""]) for r in got)
    assert exact_dedup.drop_copies(df).count() == len(best)


def test_decontam_finds_short_items_and_common_shingles(spark):
    rnd = random.Random(9)
    stock = "answer the following question with one word only please".split()
    items = {k: " ".join([*stock, *(f"i{k}x{j}" for j in range(rnd.randrange(12)))]) for k in range(60)}
    items |= {100: "rare pair", 101: "Lone", 102: "a b c d", 103: "", 104: None, 105: "  "}
    docs = {}
    for d in range(80):
        body = [f"d{d}w{j}" for j in range(30)]
        pick = WORD.findall(items[rnd.randrange(60)])
        body[10:10] = pick[: rnd.randrange(len(pick) + 1)]
        docs[d] = " ".join(body)
    docs |= {200: "here is a rare pair indeed", 201: "lone", 202: "x A b C d y", 203: "a b c x d", 204: None, 205: " ".join(stock)}

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, t in items.items():
        w = WORD.findall(low(t))
        k = min(5, len(w))
        for d, x in docs.items():
            if k:
                own = grams(w, k)
                shared = len(own & grams(WORD.findall(low(x)), k))
                if shared * 100 >= 80 * len(own):
                    want.add((d, i, len(own), shared))
    a, b = spark.createDataFrame(list(docs.items()), SCHEMA), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontam.matches(a, b).collect()}
    assert got == want and {(200, 100), (201, 101), (202, 102)} <= {x[:2] for x in got}


def test_lm_scores_do_not_follow_the_session(spark):
    held, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in queries.op8_lm_score(spark, DATA).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got[0] == got[1] and len(got[0]) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    rows = {r["doc_id"]: r for r in lm_score.score(docs, lm_score.train(docs.limit(0))).collect()}
    assert (rows[1]["n_tokens"], rows[1]["n_known"], rows[2]["n_tokens"]) == (3, 0, 1) and all(math.isfinite(r["score"]) for r in rows.values())


def sample_of(module, texts, labels):
    w = words(pa.array(texts, pa.string()))
    d, f = module.features(w)
    return Sample(np.searchsorted(d, np.arange(len(texts) + 1)).astype(np.int64), f, np.array(labels), float(np.mean(labels))), w


def test_dual_coordinate_descent_reaches_the_optimum(monkeypatch):
    """On 50 rows: the dual objective of projected gradient steps, taken until they stand still."""
    monkeypatch.setattr(quality, "EPOCHS", 2000)
    rnd = random.Random(4)
    rows = [" ".join(rnd.choices([f"w{k + 6 * (i % 2)}" for k in range(14)], k=9)) for i in range(50)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(50)])
    s, _ = sample_of(quality, rows, (y > 0).astype(int))
    ratio = quality.log_count_ratio(s, np.arange(50))
    w, b = quality.dual_coordinate_descent(s, np.arange(50), ratio)
    x = np.zeros((50, 1 << quality.BITS), np.float32)
    for i in range(50):
        f = s.features[s.bounds[i] : s.bounds[i + 1]]
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
    gram = (x @ x.T + 1) * np.outer(y, y)
    alpha = np.zeros(50)
    for _ in range(20000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, quality.COST)
    best = alpha.sum() - alpha @ gram @ alpha / 2
    primal = (w @ w + b * b) / 2 + quality.COST * np.maximum(0, 1 - y * (x @ w + b)).sum()
    assert primal == pytest.approx(best, rel=0.01)


def test_scores_use_unit_length():
    rnd = random.Random(1)
    rows = [" ".join(rnd.choices(["good", "fine", "calm", "x", "y"] if i % 2 else ["bad", "poor", "junk", "x", "y"], k=8)) for i in range(200)]
    s, w = sample_of(quality, rows, [i % 2 for i in range(200)])
    model = quality.fit(s)
    once, often = (model.margins(*quality.features(words(pa.array([t], pa.string()))), 1)[0] for t in ("good fine calm", "good fine calm " * 400))
    assert np.sign(once) == np.sign(often) and abs(often) < 5 and (model.score(w).round() == [i % 2 for i in range(200)]).mean() > 0.95


@pytest.mark.parametrize("kind", ["agreement", "conjunction"])
def test_machine_learns_meetings(kind):
    """Labels by the agreement (or the meeting) of two terms; alone, neither tells anything of an agreement."""
    rng = np.random.default_rng(0)

    def made(n):
        rows, y = [], []
        for _ in range(n):
            a, b = rng.integers(0, 2, 2)
            fill = [f"zz{k}q" for k in rng.integers(0, 300, 12)]
            rows.append(" ".join([*fill, *["alphaterm"] * a, *["betaterm"] * b]))
            y.append(int(a & b) if kind == "conjunction" else int(a == b))
        return rows, y

    model = toxicity.fit(sample_of(toxicity, *made(1500))[0])
    rows, y = made(500)
    assert ((model.score(words(pa.array(rows))) >= 0.5) == np.array(y)).mean() > 0.97


def test_held_out_figures(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for name, label, precision, recall, area in (("op2_quality", "quality", 0.98, 0.99, 0.999), ("op3_toxicity", "toxic", 0.95, 0.83, 0.95)):
        rows = queries.QUERIES[name](spark, d).filter("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
        hit = sum(r["predicted"] and r[label] for r in rows)
        assert hit >= precision * sum(r["predicted"] for r in rows) and hit >= recall * sum(r[label] for r in rows)
        ranks = np.array([r["score"] for r in rows]).argsort().argsort()
        one = np.array([r[label] == 1 for r in rows])
        assert (ranks[one].mean() - (one.sum() - 1) / 2) / (~one).sum() >= area
        assert sum(1e-6 < r["score"] < 1 - 1e-6 for r in rows) > 0.9 * len(rows)


def test_predictions_with_null_ids(spark):
    scored = spark.createDataFrame([(None, 0.3), (1, 0.29999), (5, 0.3)], "doc_id bigint, score double")
    got = queries._predictions(scored, queries.split_remainder(F.col("doc_id"), 5) == 0, 0.3).collect()
    assert [r["predicted"] for r in got] == [1, 0, 1] and got[0]["held_out"] is False and all(r["held_out"] is not None for r in got)


@pytest.mark.parametrize("piece", ['<a "', "<div>", "<", "</", "<p><b x='", "<a1><a2 y>z", "</div>", "<li>x", "&amp", "<!-", "<ul><li><p>x</ul>", "<table><td class=a>"])
def test_html_in_linear_time(piece):
    model = html_extract.default_model()
    began = time.process_time()
    html_extract.main_text(piece * (1_000_000 // len(piece)), model)
    assert time.process_time() - began < 15  # some 2 s; a quadratic reader takes hours


def test_html_edges(spark):
    page = "<article><p>Yes, this is it.</p></article>"
    rows = [(1, page), (1, page), (None, page), (2, "<article><p>" + "word " * 200_000), (3, "<article><p title=\"never closed>Some text here.</p><p>More.</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    for name in ("text", "_framewright_text", "place", "score"):
        pages = pages.withColumn(name, F.lit("old"))
    got = html_extract.extract(pages).collect()
    assert [r["text"] for r in got if r["page_id"] in (1, None)] == ["Yes, this is it."] * 3
    assert next(len(r["text"]) for r in got if r["page_id"] == 2) in (0, 999_999) and all(r["place"] == "old" for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, None), (901, None), (902, ""), (903, "x y"), (903, "x y")], SCHEMA), allowMissingColumns=True)
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    want = {name: None for name in docs.columns}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == list(want), name
        for r in kept.collect():
            assert all(r[c] == c + ("?" if r["doc_id"] is None else str(r["doc_id"])) for c in CLASHING), name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    ids = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, DATA).collect()}
    assert {None, 901, 902, 903} <= ids
    coded = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, DATA)
    assert coded.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and coded.count() == docs.count() and coded.filter("not round_trip").count() == 0
    marked = exact_dedup.mark_copies(docs, keep=docs.columns)
    assert marked.filter("_sha <> concat('_sha', coalesce(cast(doc_id as string), '?'))").count() == 0 and marked.count() == docs.count()


def test_every_query_on_empty_tables(spark, tmp_path):
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_large_group_gives_few_keys_after_its_first_bands(spark):
    """And clusters are those of all bands' keys at once."""
    rng, group = np.random.default_rng(3), 300
    base = rng.integers(0, 2**63, 1200)
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 1200, 25)), rng.integers(0, 2**63, 25)])) for _ in range(group)]
    sets += [np.unique(rng.integers(0, 2**63, 1200)) for _ in range(20)]
    rows = [(i, len(s), 24, s[: near_dedup.K].tolist()) for i, s in enumerate(sets)]
    few = spark.createDataFrame(rows, "cls bigint, n bigint, in_hot bigint, sketch array<bigint>").localCheckpoint()
    got = {r["cls"]: r["cluster"] for r in near_dedup.clusters(few, 80).collect()}
    assert got == dict.fromkeys(range(group), 0)
    slim = few.select("cls", "n", "sketch")
    every = near_dedup.keys_of(slim, 80, range(near_dedup.BANDS))
    opening = near_dedup.key_links(near_dedup.keys_of(slim, 80, range(near_dedup.OPENING))).localCheckpoint()
    assert near_dedup.later_keys(slim, opening, 80).count() < every.count() / 4


def test_keys_that_meet_nothing_are_not_made(spark, monkeypatch):
    """Rows made, each time that a plan makes them: few a class where most tuples hold a value of one class's own.
    Twice the group gives no more than twice the rows, and the classes that keys connect are those of all keys."""
    keys_of, made = near_dedup.keys_of, spark.sparkContext.accumulator(0)

    def counted(*given):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return keys_of(*given).mapInArrow(run, near_dedup.KEYS)

    rows_of = {}
    for group in (300, 600):
        rng = np.random.default_rng(11)
        base = rng.integers(0, 2**63, 400)
        sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 400, 80)), rng.integers(0, 2**63, 80)])) for _ in range(group)]
        sets += [np.unique(rng.integers(0, 2**63, size)) for size in (4, 5, 30, 70, 900) for _ in range(10)]
        sets += [np.append(s[:-1], s[-1] - 1) for s in sets[group : group + 20]]
        rows = [(i, len(s), 24, s[: near_dedup.K].tolist()) for i, s in enumerate(sets)]
        few = spark.createDataFrame(rows, "cls bigint, n bigint, in_hot bigint, sketch array<bigint>").localCheckpoint()
        every = keys_of(few.select("cls", "n", "sketch"), 80, range(near_dedup.BANDS))
        want = {r["node"]: r["component"] for r in components.connected_components(near_dedup.key_links(every)).collect()}
        monkeypatch.setattr(near_dedup, "keys_of", counted)
        made.value = 0
        assert {r["cls"]: r["cluster"] for r in near_dedup.clusters(few, 80).collect()} == want
        monkeypatch.setattr(near_dedup, "keys_of", keys_of)
        rows_of[group] = made.value
        assert 0 < made.value < 60 * len(sets)
    assert rows_of[600] < 2.2 * rows_of[300]


def test_links_are_not_broadcast(spark, monkeypatch):
    """Sides that grow with the input stay off the driver, also where they are small enough for Spark's threshold."""
    plans, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: (cut(df), plans.append(df._jdf.queryExecution().toString()))[0])
    links = spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint")
    assert {r["component"] for r in components.connected_components(links).collect()} == {0}
    assert plans
    assert not any("BroadcastHashJoin" in p for p in plans)
