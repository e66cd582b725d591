"""The pipeline operators against brute force, round trips and held-out accuracy, and their edges."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import bpe, chat_format, components, decontam, exact_dedup, html_extract, lm_score, near_dedup, quality, queries, token_file, toxicity
from framewright.llm.labelled import split_remainder

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

EDGES = [
    (1, None), (2, ""), (3, "  \n"), (4, "One two three four five six seven"), (5, "ONE two three four five six seven"), (5, "ONE two three four five six seven"),
    (None, "One two three four five six seven"), (6, "word " * 30000), (7, "É one"), (8, "é one"), (9, "a<|endoftext|>b " * 3), (10, "漢字" * 5000),
]
SCHEMA = "doc_id bigint, text string"


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("ids", "score", "kept", "set", "_id", "page"):  # clashing names
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_chunk_ends_follow_content():
    rng = np.random.default_rng(0)
    shared = rng.integers(32, 127, 20000).astype(np.uint8)
    a = np.concatenate([rng.integers(32, 127, 777).astype(np.uint8), shared])
    one = {bytes(a[x:y]) for x, y in zip([0, *bpe.chunk_ends(a)], bpe.chunk_ends(a))}
    two = {bytes(shared[x:y]) for x, y in zip([0, *bpe.chunk_ends(shared)], bpe.chunk_ends(shared))}
    assert len(one & two) > 0.8 * len(two)


def test_bpe_equals_the_library():
    library, own, rnd = Tokenizer.from_file(BYTE), bpe.ChunkedBpe(BYTE), random.Random(4)
    alphabet = " \n\tabcABC'sé漢😀1²-_\u0085　"
    texts = [t or "" for _, t in EDGES] + ["".join(rnd.choices(alphabet, k=k)) for k in (3, 40, 3000, 20000)] + ["x" * 30000, " " * 9000]
    for t in texts:
        ids = own.encode(t.encode()).tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_rows(spark, edges):
    rows = bpe.round_trip(edges, BYTE).collect()
    assert len(rows) == len(EDGES) and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe.round_trip(edges.limit(0), BYTE).count() == 0
    assert bpe.decode(bpe.encode(edges, BYTE, keep=["doc_id"]), BYTE).filter("doc_id = 7").first()["decoded"] == "É one"
    digests = queries.bpe_digests(edges).filter("doc_id = 2").first()
    assert digests["ids_sha256"] == digests["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def ids_of(row):
    return np.frombuffer(row["ids"], "<u4").tolist()


def test_token_file(spark, edges, tmp_path, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    least = -(1 << 63)
    want = collections.Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in [*EDGES, (least, "least")])
    df = edges.select("doc_id", "text").unionByName(spark.createDataFrame([(least, "least")], SCHEMA))
    for size in (1 << 24, 3000):  # one file, and several tasks and files with an id that fills more than one
        monkeypatch.setattr(token_file, "TASK_BYTES", size)
        monkeypatch.setattr(token_file, "FILE_BYTES", size // 2)
        path = str(tmp_path / str(size))
        token_file.write(token_file.encode(df, WORDS), path)
        rows = token_file.read(spark, path).collect()
        assert collections.Counter((r["doc_id"], tuple(ids_of(r))) for r in rows) == want
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        named = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert named == sorted(named)
        assert collections.Counter((r["doc_id"], tuple(ids_of(r))) for r in token_file.shuffled(spark, path, 3).collect()) == want
    assert token_file.index(spark, path).select("file").distinct().count() > 3
    empty = str(tmp_path / "empty")
    token_file.write(token_file.encode(edges.limit(0), WORDS), empty)
    assert token_file.read(spark, empty).count() == 0


def test_shuffled_reads_touch_only_their_bytes(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    token_file.write(token_file.encode(documents, WORDS), path)
    some = [r["doc_id"] for r in documents.orderBy(F.rand(5)).limit(10).collect()]
    entries = token_file.index(spark, path).filter(F.col("doc_id").isin(some)).collect()
    kept = collections.defaultdict(list)
    for e in entries:
        kept[e["file"]].append((e["offset"], e["length"]))
    for file in (tmp_path / "t" / "records").glob("part-*"):  # everything else goes
        raw = file.read_bytes()
        blank = bytearray(len(raw))
        for at, n in kept[file.name]:
            blank[at : at + n] = raw[at : at + n]
        file.write_bytes(blank)
    got = {r["doc_id"]: ids_of(r) for r in token_file.read_at(spark, path, spark.createDataFrame(entries)).collect()}
    library = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert got == {i: library.encode(texts[i], add_special_tokens=False).ids + [1] for i in some}


def test_records_tell_damage():
    raw = bytearray(token_file.frame_record(b"abc") + token_file.frame_record(b""))
    assert token_file.read_record(raw)[0] == b"abc"
    for at in range(19):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_file.read_record(bad)


def test_exact_dedup_edges(spark, edges):
    rows = exact_dedup.mark_copies(edges, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(EDGES)
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[(1, None)]["keep_id"] == 2 and by[(2, "")]["kept"]
    group = by[(4, EDGES[3][1])]
    assert (group["keep_id"], group["group_size"], group["kept"]) == (5, 4, False)
    assert by[(7, "É one")]["kept"] and by[(8, "é one")]["kept"]
    assert exact_dedup.mark_copies(edges.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 5, 6, 7, 8, 9, 10]


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common * 100 >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(n=160, seed=3):
    """Groups of near copies of a few texts, large enough for long lists, and texts of common words."""
    rnd = random.Random(seed)
    bases = [[f"w{rnd.randrange(4000)}" for _ in range(k)] for k in (60, 30, 120, 8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(rnd.choices("the of and a to".split(), k=rnd.randrange(1, 9)))) for i in range(60)]


@pytest.mark.parametrize(("size", "cold", "block"), [(2, 32, 512), (2, 2, 8), (5, 4, 16)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, size, cold, block):
    monkeypatch.setattr(near_dedup, "COLD", cold)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = mutated()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, size, 80)


def test_near_dedup_edges(spark, edges):
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_shingles"], by[1]["component_id"], by[1]["kept"]) == (0, 1, True)
    assert by[5]["component_id"] == 4 and by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.near_duplicates(edges.limit(0)).count() == 0
    assert near_dedup.drop_near_duplicates(edges).columns == edges.columns


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(5, None)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_decontam_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    made = con.sql(queries.ORACLE_SQL["op9_decontam"])
    at = [made.columns.index(c) for c in ("doc_id", "item_id", "n_item", "n_shared")]
    got = sorted(tuple(r) for r in queries.op9_decontam(spark, DATA).select("doc_id", "item_id", "n_item", "n_shared").collect())
    assert got == sorted(tuple(r[i] for i in at) for r in made.fetchall())


def test_decontam_edges(spark, edges):
    items = spark.createDataFrame([(1, "ONE Two three four five six"), (2, None), (3, ""), (4, "é one"), (None, "word word word word word")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(edges, items).collect()}
    assert found == {(4, 1), (5, 1), (8, 4)}
    assert decontam.matches(edges, items.limit(0)).count() == 0 == decontam.matches(edges.limit(0), items).count()
    marked = {(r["doc_id"], r["contaminated"]) for r in decontam.mark_contaminated(edges, items).collect()}
    assert (4, True) in marked and (6, False) in marked
    assert sorted(str(r["doc_id"]) for r in decontam.drop_contaminated(edges, items).collect()) == sorted(["None", "1", "10", "2", "3", "6", "7", "9"])


@pytest.mark.parametrize("most", [10**6, 50])
def test_lm_base_is_exact(spark, monkeypatch, edges, most):
    monkeypatch.setattr(lm_score, "MAX_WORDS", most)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = lm_score.train(docs.filter(split_remainder(F.col("doc_id"), 10) != 0))
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*WORD.findall(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.n_words) == (n, v)
    scored = {r["doc_id"]: r for r in lm_score.score(docs, model).collect()}
    held = [0.0, 0.0]
    for i, t in rows:
        toks = [*WORD.findall(low(t)), None]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        assert scored[i]["base_score"] == pytest.approx(want) and scored[i]["n_known"] == sum(counts[w] > 0 for w in toks)
        if zlib.crc32(str(i).encode()) % 10 == 0:
            held = [held[0] + scored[i]["score"], held[1] + want]
    assert held[0] > held[1]  # pairs help on texts not learned from
    assert lm_score.score(edges, model).count() == len(EDGES)


def test_lm_pairs_met_once_count_and_the_filter_grows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], [*WORD.findall(low(r["text"])), None]) for r in docs.collect()]
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    one = collections.Counter(w for t in learned for w in t)
    two = collections.Counter(p for t in learned for p in zip([None, *t], t))
    level = lambda c: 1 + math.floor(math.log(c) / math.log(lm_score.BASE) + 1e-9) if c else 0
    stands = lambda c: float(lm_score.level_count(np.array([level(c)]))[0])
    model = lm_score.train(docs.filter(split_remainder(F.col("doc_id"), 10) != 0))
    entries = sum(level(c) for n in (one, two) for c in n.values())
    assert sum(len(r["segment"]) for r in model.segments.collect()) * 8 >= entries * lm_score.BITS_PER_ENTRY
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, model).collect()}
    off = []
    for i, t in rows:
        p = [0.4 * min(1, stands(two[a, b]) / max(1, stands(one[a]))) + 0.6 * (stands(one[b]) + 0.1) / model.total for a, b in zip([None, *t], t)]
        off.append(abs(got[i] - sum(math.log10(min(1, x)) for x in p)) / len(t))
    assert np.mean(off) < 0.03  # false positives only


def test_lm_levels_read_back():
    rng = np.random.default_rng(2)
    h, c = rng.integers(0, 2**63, 2000).astype(np.uint64), rng.integers(1, 1000, 2000)
    n, bits = 4, 1 << 18
    data = np.zeros(n * bits, bool)
    for k in range(1, int(lm_score.levels(c).max()) + 1):
        for pos in lm_score._positions(h[lm_score.levels(c) >= k], k, n, bits):
            data[pos.astype(np.int64)] = True
    read = lm_score.Filter(np.packbits(data, bitorder="little"), n, bits).level(h)
    assert (read >= lm_score.levels(c)).all() and (read == lm_score.levels(c)).mean() > 0.95


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for name, label, least in (("op2_quality", "quality", 0.97), ("op3_toxicity", "toxic", 0.95)):
        rows = queries.QUERIES[name](spark, d).filter("held_out").join(labels, "doc_id").collect()
        assert sum(r["predicted"] == r[label] for r in rows) >= least * len(rows)


def test_classifier_edges(spark, edges):
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(range(4, 11))] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        for some in (labels, labels.filter(f"{label} = 1"), labels.limit(0)):
            rows = op.score(edges, op.train(edges, some, F.lit(True), label)).collect()
            assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)


def test_html():
    model = html_extract.default_model()
    held = html_extract.labelled_pages(80, seed=99)
    right = [a == b for p, y in held for a, b in zip(model.decode(p), y, strict=True)]
    assert sum(right) >= 0.98 * len(right)
    page = "<html><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Ä&amp;B</h1><p>One\n two <b>three</b>.<br>Four<p>Five &lt;six&gt;.</article><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    assert html_extract.main_text(page, model) == "Ä&B One two three. Four Five <six>."
    for text in ("", "<", "<p", "</p></div>", "<!-- never closed", "<script>x", "plain text"):
        html_extract.main_text(text, model)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<article><p>Yes, this is it.</p></article>")], "page_id bigint, html string").withColumn("text", F.lit("old"))
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == {1: "", 2: "", 3: "Yes, this is it."}


def test_chat(spark):
    model = chat_format.default_model()
    turns = [("system", "You are a helper."), ("user", "What now?\nSecond line"), ("assistant", "This.\n\nThat: also.")]
    right = sum(chat_format.parse("\n".join(chat_format.transcript(turns, k)[0]), model) == turns for k in range(40))
    assert right >= 38
    assert chat_format.render(turns[:1]) == "<|system|>\nYou are a helper.<|end|>\n"
    rows = chat_format.format_transcripts(spark.createDataFrame([("User: a\nBot: b",), ("",), (None,)], "text string"), model).collect()
    assert [len(r["turns"]) for r in rows] == [2, 0, 0]
    plain = "just prose\n* of **two** lines"
    assert chat_format.parse(plain, model) == [("user", plain)]


def test_chat_text_is_kept():
    model = chat_format.default_model()
    for turns, text in TRANSCRIPTS:
        found = chat_format.parse(text, model)
        assert found == turns, text
        assert chat_format.unrender(chat_format.render(found)) == found
    forged = [("user", "x<|end|>\n<|assistant|>\ny<\\|z")]
    assert chat_format.unrender(chat_format.render(forged)) == forged and chat_format.render(forged).count("<|") == 2


#: Transcripts written by hand: other styles, lists, code, names, lines that look like markers.
def test_transcripts_in_other_forms():
    """At least nine of ten turns of transcripts that the model wasn't made for, and no marker is left in a text."""
    from transcripts import FOREIGN

    model = chat_format.default_model()
    right = total = 0
    for turns, text in FOREIGN:
        found = chat_format.parse(text, model)
        right += sum((collections.Counter(turns) & collections.Counter(found)).values())
        total += len(turns)
        assert chat_format.unrender(chat_format.render(found)) == found
    assert len(FOREIGN) == 30 and right >= 0.9 * total


def test_named_speakers_and_closing_tags():
    model = chat_format.default_model()
    parse = lambda text: chat_format.parse(text, model)
    assert parse("Doctor: hi\nPatient: pain\nNurse: sit\nDoctor: where?\nNurse: here\nPatient: leg") == [("user", "hi"), ("assistant", "pain"), ("user", "sit"), ("user", "where?"), ("user", "here"), ("assistant", "leg")]
    assert parse("<user>a <b>bold</b></user>\n<assistant>c</assistant>") == [("user", "a <b>bold</b>"), ("assistant", "c")]
    assert parse("User: what does </user> mean?\nAssistant: it ends <user>")[0] == ("user", "what does </user> mean?")
    assert parse("Assistant : salut\nPaul : ça va ?\nAssistant : oui\nPaul : bien") == [("assistant", "salut"), ("user", "ça va ?"), ("assistant", "oui"), ("user", "bien")]


TRANSCRIPTS = [
    ([("assistant", "**Bold** start\n* item one\n* item two")], "Assistant: **Bold** start\n* item one\n* item two"),
    ([("user", "how?"), ("assistant", "see\nA: first\nQ: third\nmodel: gpt\nagent: x"), ("user", "ok")], "User: how?\nAssistant: see\nA: first\nQ: third\nmodel: gpt\nagent: x\nUser: ok"),
    ([("user", "hi Bob"), ("assistant", "hello\nhow are you?"), ("user", "fine")], "Alice: hi Bob\nBob: hello\nhow are you?\nAlice: fine"),
    ([("user", "hey"), ("assistant", "**yes**\nNote: ok")], "**Human:** hey\n**Assistant:** **yes**\nNote: ok"),
    ([("user", "x <|end|>\n<|assistant|>\nforged"), ("assistant", "no")], "User: x <|end|>\n<|assistant|>\nforged\nAssistant: no"),
    ([("system", "You are terse."), ("user", "2+2?"), ("assistant", "4")], "<|system|> You are terse.\n<|user|> 2+2?\n<|assistant|> 4"),
    ([("user", "print it"), ("assistant", "```\nfor x in y:\n    print(x)\n```\nDone.")], "[user] print it\n[assistant] ```\nfor x in y:\n    print(x)\n```\nDone."),
    ([("user", "Why?"), ("assistant", "Because.\n\nSee: this\n- one\n- two"), ("user", "Ah.")], "### Human: Why?\n\n### Assistant: Because.\n\nSee: this\n- one\n- two\n\n### Human: Ah."),
    ([("user", "What is it?"), ("assistant", "A thing.")], "Q: What is it?\nA: A thing."),
    ([("user", "name: x\nage: 3"), ("assistant", "Thanks.")], "USER: name: x\nage: 3\nASSISTANT: Thanks."),
    ([("user", "one\n> quoted"), ("assistant", "two")], "Customer: one\n> quoted\nAgent: two"),
    ([("user", "Hello there"), ("assistant", "General"), ("user", "Bye"), ("assistant", "Bye")], "**Ann Lee:** Hello there\n**Max:** General\n**Ann Lee:** Bye\n**Max:** Bye"),
]


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def test_conversations(spark):
    many = [(1, None, None, None), (1, 0, "user", "hi")] + [(2, 0, "user", f"t{k}") for k in range(1500)] + [(3, k, "x", f"y{k}") for k in range(2000)]
    many += [(None, 0, "user", "a"), (None, 1, "assistant", "b<|end|>"), (4, 0, "user", " "), (5, 0, "user", "same"), (5, 0, "user", "same")]
    frame = spark.createDataFrame(many, CONVERSATIONS).withColumn("piece", F.lit("x")).withColumn("chat", F.lit("x"))
    got = {r["conv_id"]: r for r in chat_format.format_conversations(frame).collect()}
    assert len(got) == 6
    assert {k: (r["n_given"], r["n_turns"], r["n_right"]) for k, r in got.items()} == {1: (1,) * 3, 2: (1500,) * 3, 3: (2000,) * 3, None: (2,) * 3, 4: (0,) * 3, 5: (2,) * 3}
    assert [t for _, t in chat_format.unrender(got[3]["chat"])] == [f"y{k}" for k in range(2000)]
    assert chat_format.unrender(got[None]["chat"]) == [("user", "a"), ("assistant", "b<|end|>")]
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_long_conversations_in_pieces(spark, monkeypatch):
    rnd = random.Random(5)
    lines = ["yes", "A: one", "Note: x", "what?\nmodel: y", "User: quoted", "", "- a\n\n- b", "You are"]
    many = [(c, k, ("user", "assistant")[k % 2], rnd.choice(lines) + f" {k}") for c in (1, 2, None) for k in range(300)] + [(3, 0, "user", "short")]
    many += [(2, 7, "user", "copy")] * 100
    frame = spark.createDataFrame(many, CONVERSATIONS)
    whole = {r["conv_id"]: r for r in chat_format.format_conversations(frame).collect()}
    monkeypatch.setattr(chat_format, "WHOLE_TURNS", 50)
    monkeypatch.setattr(chat_format, "PIECE_BYTES", 1000)
    rows = chat_format.format_conversations(frame).collect()
    pieces = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        pieces[r["conv_id"]].append(r)
    assert min(len(pieces[c]) for c in (1, 2, None)) > 2 and len(pieces[3]) == 1
    for c, own in pieces.items():
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert "".join(r["chat"] for r in own) == whole[c]["chat"]
        assert sum(r["n_given"] for r in own) == whole[c]["n_given"] and sum(r["n_turns"] for r in own) == whole[c]["n_turns"]


def test_conversations_query(spark):
    rows = queries.op6_chat_format(spark, DATA).collect()
    table = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    assert sorted(r["conv_id"] for r in rows) == sorted({r["conv_id"] for r in table})
    assert sum(r["n_given"] for r in rows) == sum(bool((r["text"] or "").strip()) for r in table)
    assert sum(r["n_right"] for r in rows) >= 0.99 * sum(r["n_given"] for r in rows)


def test_pipeline_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    exact = {r["doc_id"] for r in stage["exact_dedup"](spark, docs, DATA).collect()}
    last = {}
    for i, t in rows.items():
        last[low(t)] = max(i, last.get(low(t), i))
    assert exact == set(last.values())
    near = stage["near_dedup"](spark, docs, DATA)
    assert near.columns == docs.columns
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in brute_components(list(rows.items()), 5, 80).items() if i == c}
    held = {r["doc_id"] for r in queries.op9_decontam(spark, DATA).collect()}
    assert {r["doc_id"] for r in stage["decontam"](spark, docs, DATA).collect()} == set(rows) - held
    assert stage["bpe"](spark, docs, DATA).filter("not round_trip").count() == 0
    assert stage["toxicity"](spark, docs, DATA).columns == docs.columns
    assert 0 < corpus_pipeline.run(spark, DATA).count() <= len(exact)
