"""Operators 3 and 10 and the pipeline against the library and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from quarryline.llm import minhash, sentencepiece_codec
from quarryline.llm.sentencepiece_codec import MODEL, Codec, load

SF = "/root/testdata/sf0.001"


# --- SentencePiece ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return Codec(load(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


CASES = [
    None, "", " ", "a  b", "Hello world", "  x\n\ty", "日本語 🙂", "a b", "<s>hello</s>", "<0x41>", "▁▁a", "ﬁ Å", "\x00a", "a" * 3000, " " * 300 + "a", "zzz" * 50, "=" * 77, "1234567890", "\n\n\n", "🙂🙂​", "ééé\r\n",
]


def test_same_as_library(codec, library):
    for t, ids in zip(CASES, codec.encode(CASES), strict=True):
        assert ids.tolist() == library.encode(t or ""), t
        assert codec.decode(ids) == (t or "").replace("▁", " ")


def test_same_on_documents(spark, codec, library):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts)


def test_random_text(codec, library):
    rng = random.Random(5)
    alphabet = ["a", "b", "the", " ", "  ", "ing", "é", "日", "\n", "ab", "▁", "S", "tion", "🙂", "x"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts)
    small = Codec(codec.v, cache_units=10)
    assert all((a == b).all() for x in range(0, 400, 50) for a, b in zip(small.encode(texts[x : x + 50]), codec.encode(texts[x : x + 50]), strict=True))


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(CASES)], "doc_id long, text string, token_ids string")
    enc = sentencepiece_codec.encode_column(df)
    back = {r["doc_id"]: r["again"] for r in sentencepiece_codec.decode_column(enc, text_col="again").collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(CASES)}
    assert sentencepiece_codec.encode_column(df.limit(0)).count() == 0
    out = sentencepiece_codec.op3_sentencepiece(spark, SF)
    assert out.filter("NOT round_trip").count() == 0 and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_other_models_are_an_error():
    """Models that the codec would encode otherwise than the library are refused, not encoded wrongly."""
    from quarryline.llm.sentencepiece_codec import check_model

    with open(MODEL, "rb") as f:
        check_model(f.read())
    bpe, kept = b"\x12\x02\x18\x02", b"\x20\x00"  # trainer: kind BPE; normaliser: spaces stay as they are
    check_model(bpe + b"\x1a\x02" + kept)
    for data, why in ((b"\x12\x02\x18\x01\x1a\x02" + kept, "BPE"), (b"\x1a\x02" + kept, "BPE"), (bpe + b"\x1a\x05\x12\x01x" + kept, "changes characters"), (bpe, "spaces"), (bpe + b"\x1a\x04\x18\x00" + kept, "spaces")):
        with pytest.raises(ValueError, match=why):
            check_model(data)


def test_odd_ids_and_names(spark, codec):
    assert codec.decode([10**9, None, -1]) == "\ufffd\ufffd\ufffd" and codec.decode([1, 2]) == "" and codec.decode([]) == ""
    df = spark.createDataFrame([("x", 1, "Hello  world"), ("y", 2, None)], "`a.b` string, source int, __text string")
    enc = sentencepiece_codec.encode_column(df, "__text", "made")
    assert enc.columns == [*df.columns, "made"]
    back = sentencepiece_codec.decode_column(enc, "made", "source")
    assert back.columns == ["a.b", "__text", "made", "source"] and sorted(r["source"] for r in back.collect()) == ["", "Hello  world"]


def test_memory_is_bounded(codec):
    """What a worker keeps is bounded by characters and units, whatever it has met, and blocks give the same ids."""
    rng = random.Random(8)
    small = Codec(codec.v)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(4000)) for _ in range(40)]
    for i in range(0, 40, 4):
        got = small.encode(texts[i : i + 4])
        assert small.chars <= sentencepiece_codec.CACHE_CHARS + sentencepiece_codec.TEXT_CHARS + 10 * 4000 * 4
    assert all((a == b).all() for a, b in zip(got, codec.encode(texts[36:]), strict=True))


@pytest.fixture(autouse=True)
def few_parts(monkeypatch, request):
    """Small tables need few chunks and buckets; one test keeps those of the operator."""
    if "sql" not in request.node.name:
        monkeypatch.setattr(minhash, "PARTS", 8)


# --- near-duplicates -------------------------------------------------------------------------


def _classes(docs, similarity=0.8):
    """All pairs by definition, then the least id of each component."""
    bags = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = min(5, len(w))
        bags[i] = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else Counter()
    df = Counter(k for b in bags.values() for k in b)
    n = len(docs)
    w = {i: {k: v * np.sqrt(1 + np.log10(n / df[k])) for k, v in b.items()} for i, b in bags.items()}
    up = {i: i for i, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    text = {i: t or "" for i, t in docs}
    for a in ids:
        for b in ids:
            if a < b:
                both = sum(min(w[a][k], w[b][k]) for k in w[a].keys() & w[b].keys())
                total = sum(w[a].values()) + sum(w[b].values()) - both
                if text[a] == text[b] or total > 0 and both / total >= similarity:
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def _mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 200]))] for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "", "one", "one", "two words", "For " * 300]
    texts += [_mutated(rng, rng.choice(base), rng.randrange(6)) for _ in range(70)]
    texts += [passage + " " + _mutated(rng, rng.choice(base), 0) for _ in range(15)]
    texts += [" ".join(base[0]), " ".join(base[0])]
    rng.shuffle(texts)
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, class_id string, bands int")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == _classes(docs)


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (2, "a b c"), (9, "z")], schema)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in rows) == [(2, 2), (5, 2), (5, 2), (9, 9)]


def test_rare_shingles_weigh_by_their_own_frequency(spark):
    """A passage in 6 of 100 documents weighs less than one in 2: below a tenth of the documents too, IDF differs."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = [(0, words("p", 60) + " " + words("x", 11)), (1, words("p", 60) + " " + words("y", 11))]
    docs += [(i, words("p", 60) + " " + words(f"z{i}v", 400)) for i in range(2, 6)]
    docs += [(6, words("q", 60) + " " + words("s", 11)), (7, words("q", 60) + " " + words("t", 11))]
    docs += [(i, words(f"u{i}v", 20)) for i in range(8, 100)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similarity=0.7).collect()}
    assert got == _classes(docs, 0.7)
    # 56 shared shingles beside 11 of either side's own: 0.71 by the frequency of the pair, 0.68 by that of six.
    assert got[1] == 1 and got[7] == 6


def test_near_duplicates_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(c.sql(minhash.SQL_OP10).fetchall())
    assert sorted(map(tuple, minhash.op10_minhash(spark, SF).select("doc_id", "text_id", "class_id").collect())) == want


def test_large_group_is_one_class(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(150)]
    df = spark.createDataFrame([(i, _mutated(rng, words, 1)) for i in range(400)], "doc_id long, text string")
    assert {r["class_id"] for r in minhash.near_duplicates(df, similarity=0.6).collect()} == {0}


def test_loose_group_equals_brute_force(spark, monkeypatch):
    """Copies of one text at about the similarity asked for, so that no centre is near all: rounds and small cells find every link."""
    monkeypatch.setattr(minhash, "CELL", 4)
    rng = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    docs = [(i, _mutated(rng, words, rng.randrange(1, 4))) for i in range(60)]
    docs += [(100 + i, _mutated(rng, [f"w{j}" for j in range(200)], 2)) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _classes(docs)
    assert 1 < len(set(got.values())) < 60


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    schema = "doc_id long, text string, text_md5 int, k string, chunk int, class_id int"
    docs = spark.createDataFrame([(3, a, 1, "x", 0, 0), (5, a, 2, "x", 0, 0), (5, b, 3, "x", 0, 0), (None, b, 4, "x", 0, 0), (7, None, 5, "x", 0, 0), (7, None, 6, "x", 0, 0), (9, "", 7, "x", 0, 0)], schema)
    got = sorted(((r["doc_id"] or -1), r["text_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, 5, 5), (3, 3, 3), (5, 3, 3), (5, 5, 5), (7, 7, 7), (7, 7, 7), (9, 7, 7)]
    kept = minhash.first_of_class(docs)
    assert kept.columns == docs.columns and sorted(r["text_md5"] for r in kept.collect()) == [1, 3, 5, 6]
    nothing = minhash.first_of_class(docs.filter("doc_id IS NULL"))
    assert [r["text_md5"] for r in nothing.collect()] == [4]


def test_cells_meet_every_pair_of_classes_once(spark):
    """Rows of the cells grow with what is outside a group's largest class, not with the square of the group."""
    from quarryline.llm.common import Scratch

    rows = [("g", f"k{i}", "big" if i < 90 else f"own{i}", 10) for i in range(100)]
    df = spark.createDataFrame(rows, "c string, k string, class_k string, size int")
    with Scratch(spark) as scratch:
        dealt = minhash.cells(df, scratch, cell=8).collect()
    cells = {}
    for r in dealt:
        cells.setdefault(r["cell"], ([], []))[r["side"]].append(r["k"])
    met = {frozenset((x, y)) for left, right in cells.values() for x in left for y in right if x != y}
    assert met >= {frozenset((f"k{i}", f"k{j}")) for i in range(90, 100) for j in range(100) if i != j}
    assert len(dealt) == 10 * 13 + 100 * 2


def test_samples_agree_as_often_as_similarity():
    """Equal ICWS samples estimate weighted Jaccard, also for weights that differ."""
    rng = np.random.default_rng(1)
    agree, want = [], []
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
        wa, wb = rng.integers(1, 4, 40) * 3.7, rng.integers(1, 4, 40) * 3.7
        s = minhash.signatures(np.concatenate([h[:35], h[5:]]), np.concatenate([wa[:35], wb[5:]]), np.array([0, 35]))
        agree.append((s[0] == s[1]).mean())
        want.append(minhash.weighted_jaccard(h[:35], wa[:35], h[5:], wb[5:]))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02


def test_pairs_to_compare_follow_similarity():
    """A pair with 36 of 64 equal samples may well be at 0.6; 35 at 0.8 is still rare enough to be compared."""
    a = np.arange(64, dtype=np.uint32)
    for similarity, equal, kept in ((0.6, 36, 1), (0.8, 35, 1), (0.8, 20, 0)):
        b = np.where(a < equal, a, a + 100).astype(np.uint32)
        least = minhash.least_equal(similarity)
        batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "s_a": [a.tobytes()], "s_b": [b.tobytes()]})
        assert sum(x.num_rows for x in minhash._likely(least)([batch])) == kept
        rng = np.random.default_rng(3)
        assert (rng.binomial(64, similarity, 10**6) < least).sum() <= 8
    cell = pa.table({"samples": [a.tobytes(), b.tobytes()], "class_k": [b"x", b"y"], "side": [0, 1]})
    count = lambda least: sum(len(x) for x, _ in minhash._pairs_of_cell(cell, least))
    assert count(20) == 1 and count(21) == 0


def test_components(spark):
    from quarryline.llm.common import Scratch

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(50)] + [(500, 500)] + [(600, 600 + i) for i in range(200)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    with Scratch(spark) as scratch:
        got = {r["id"]: r["class_id"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: top(x) for x in got} and set(got) >= {x for a, b in edges if a != b for x in (a, b)}


def test_spread_join_is_a_join(spark):
    from quarryline.llm.common import spread_join

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "key long, salt long").cache()
    small = spark.createDataFrame([(i, f"v{i}") for i in range(0, 3000, 2)] + [(1, "v1")], "key long, ways string")
    want = sorted(map(tuple, rows.join(small, "key").collect()))
    joined = spread_join(rows, small, "key", by="salt")
    assert joined.columns == ["key", "salt", "ways"] and sorted(map(tuple, joined.collect())) == want
    assert spread_join(rows, small, "key", how="left").count() == 3000


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p
    from quarryline.llm import decontaminate, quality_classifier, secret_scan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(p.STAGES) <= 5 and p.ORACLE_SQL is None
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_classifier.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality_classifier.score_column(docs, model).filter("score >= 0.5").collect()}
    classes = _classes([(i, rows[i]) for i in sorted(good)])
    first = {i for i in good if classes[i] == i}
    a = decontaminate.Finder([(r["item_id"], decontaminate.normalise(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = sorted(i for i in first if not a.find(decontaminate.normalise(rows[i]))[1])
    want = {}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = secret_scan.dictionary(spark.createDataFrame([(rows[i],) for i in clean], "text string"))
    for i in clean:
        t, at, out = rows[i] or "", 0, ""
        for s, e, kind, _ in secret_scan.scan(t, known=known):
            if s >= at:
                out, at = out + t[at:s] + f"[{kind}]", e
            else:
                at = max(at, e)
        want[i] = lib.encode(out + t[at:])
    got = {r["doc_id"]: list(r["token_ids"]) for r in p.run(spark, SF).collect()}
    assert got == want
    stage = docs
    for _, f in p.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns


def test_pipeline_edges(spark):
    """Nulls, empty and repeated rows, an id with two texts, an empty table and clashing columns pass every stage."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, source_in string, text_md5 int, `a.b` string"
    good = "The first of the sentences runs on, and the next one follows it. " * 3
    other = "Nothing of this stands in any other of the texts here, as it should be."
    rows = [(1, good, "en", "s", 0, 1.0, "x", 1, "y"), (1, good, "en", "s", 0, 1.0, "x", 1, "y"), (1, "Another text, of the same id, that says other things.", None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, None), (None, "", "en", "s", 0, 1.0, "x", 1, "y"), (3, "password = abcdefghijkl1234 " + other, "en", "s", 9, 1.0, "x", 1, "y")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        n = out.count()
        assert n == 5 if name == "near-duplicates" else n <= 6
        if name == "secret scans":
            assert {r["text"] for r in out.filter("doc_id = 3").collect()} == {"[assign] " + other} and out.filter("doc_id = 3").first()["n_chars"] == len(other) + 9
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == 6 and last.filter("size(token_ids) = 0").count() == 2 and p.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
