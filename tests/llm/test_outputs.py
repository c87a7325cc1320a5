"""Operators 11 to 13 against plain versions, and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import catalogue, merkle, token_files, turn_repair
from quarryline.session import shared_folder

SF = "/root/testdata/sf0.001"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _same(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(catalogue.SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


# --- Merkle manifest -------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos long, digest string, id string, kid string"


def _leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _plain_tree(leaves, fanout):
    """(root, the siblings of each leaf by level)."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(place):
            lo = p // fanout * fanout
            run = level[lo : lo + fanout]
            paths[i].append(("".join(run[: p - lo]), "".join(run[p - lo + 1 :])))
            place[i] = p // fanout
        level = [_sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def _plain_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r[:5]), r))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: (sorted(groups[n], key=lambda x: x[:3]), *_plain_tree([x[2] for x in sorted(groups[n], key=lambda x: x[:3])], fanout)) for n in names}
    root, tops = _plain_tree([trees[n][1] for n in names], fanout)
    out = []
    for n, top in zip(names, tops, strict=True):
        for (*_, leaf, r), path in zip(trees[n][0], trees[n][2], strict=True):
            out.append((r[0], leaf, trees[n][1], root, [list(s) for s in path + top]))
    return out


def _rows(n, seed=0):
    r = random.Random(seed)
    made = [(r.choice([None, i, i, i]), r.choice([None, "a", "bé"]), r.choice([None, "", "en", "en", "en", "=x", "é"]), r.choice([None, 3]), r.choice([None, "", "x", "né 🙂"]), "g", 1, "d", "i", "k") for i in range(n)]
    return made + made[:5] + [made[0]] * 3


@pytest.mark.parametrize("fanout,n", [(2, 120), (3, 80), (5, 33)])
def test_merkle_is_the_plain_tree(spark, monkeypatch, fanout, n):
    monkeypatch.setattr(merkle, "STRIDE_NODES", 9)  # several tiers
    rows = [*_rows(n, fanout), (7, "s", "en", 1, "y" * 300_000, "g", 1, "d", "i", "k")]
    m = merkle.build(spark.createDataFrame(rows, DOCS), merkle.COLUMNS, fanout=fanout)
    assert len(m.tiers) > 1
    got = [(r["kid"]["id"], r["kid"]["digest"], r["subroot"], r["root"], [[s["before"], s["after"]] for s in r["proof"]]) for r in m.proofs().collect()]
    want = _plain_manifest(rows, fanout)
    assert sorted(got, key=str) == sorted(want, key=str) and m.root() == want[0][3]
    checked = m.proofs().select(merkle.fold(merkle.F.col("kid.digest"), merkle.F.col("proof")).alias("f"), "root").collect()
    assert all(r["f"] == r["root"] for r in checked)


def test_merkle_of_one_and_of_none(spark):
    one = [(1, "s", "en", 1, "t", "g", 1, "d", "i", "k")]
    m = merkle.build(spark.createDataFrame(one, DOCS), merkle.COLUMNS)
    r = m.proofs().collect()
    assert m.root() == _leaf(one[0][:5]) == r[0]["subroot"] and r[0]["proof"] == []
    none = merkle.build(spark.createDataFrame([], DOCS), merkle.COLUMNS)
    assert none.root() is None and none.proofs().count() == 0
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame(one, DOCS), merkle.COLUMNS, fanout=1)


def test_op11(spark, tmp_path):
    _same(spark, "op11_merkle_manifest")
    rows = _rows(60)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = {}
    by_leaf = {_leaf(r[:5]): r for r in rows}
    for doc_id, leaf, subroot, root, proof in _plain_manifest(rows):
        r = by_leaf[leaf]
        bad = doc_id is not None and r[3] is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        node = _leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf
        for before, after in proof:
            node = _sha(before + node + after)
        want.setdefault((doc_id, leaf, subroot, root, _sha("".join(b + a for b, a in proof)), node, node == root), []).append(1)
        assert bad == (node != root)
    have = {}
    for r in got:
        have.setdefault((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]), []).append(1)
    assert have == want and any(not k[-1] for k in want)


# --- conversations ---------------------------------------------------------------------------


def _plain_repair(rows):
    """Faults, least cost, least audit and repaired lines of (turn, role, text) rows, by a recursion over texts of audits."""
    white = " \t\n\x0b\x0c\r"
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        last = x.rstrip(white)[-1:]
        faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else "")
        seen.add((r, x))
    moves = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    @lru_cache(maxsize=None)
    def best(i, state, inserts=3):
        found = []
        role = "a" if state == 2 else "u"
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserts:
            c, a, w = best(i, moves[role, state], inserts - 1)
            found.append((c + 2, "I" + a, ({"a": "assistant:", "u": "user:"}[role], *w)))
        if i < len(rows):
            c, a, w = best(i + 1, state)
            found.append((c + 3, "D" + a, w))
            if faults[i] not in ("blank", "duplicate"):
                t = faults[i] == "truncated"
                letter = rows[i][1][:1]
                if (letter, state) in moves:
                    c, a, w = best(i + 1, moves[letter, state])
                    found.append((c + t, "K" + a, (f"{rows[i][1]}:{rows[i][2]}", *w)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (r, state) in moves:
                        c, a, w = best(i + 1, moves[r, state])
                        found.append((c + 2 + t, "R" + a, (f"{name}:{rows[i][2]}", *w)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, _sha("\n".join(lines)))


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "ua", None]
TEXTS = ["Yes.", "No!", "cut", "", " \t\n", "Yes. ", "né?", None, "a\nb."]
CONV = "conv_id long, turn long, role string, text string, fault string, behind long, gone boolean"


def test_repair_is_the_least_audit(spark):
    r = random.Random(5)
    convs = {i: [(r.choice([None, t, t, t, t + 2]), r.choice(ROLES), r.choice(TEXTS)) for t in range(r.randrange(1, 9))] for i in range(150)}
    convs[None] = [(1, "user", "Yes."), (2, "assistant", "Yes.")]
    convs[200] = [(3, "user", "Yes.")] * 4
    convs[201] = [(t, r.choice(ROLES), r.choice(TEXTS) if t % 3 else f"{t}.") for t in range(60)]
    rows = [(c, *x, "f", 1, True) for c, xs in convs.items() for x in xs]
    r.shuffle(rows)
    got = {x["conv_id"]: tuple(x)[1:] for x in turn_repair.repair(spark.createDataFrame(rows, CONV)).collect()}
    assert got == {c: _plain_repair(xs) for c, xs in convs.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from(["", "", "blank", "duplicate", "truncated"])), max_size=40), st.integers(1, 40))
def test_layers_hold_the_least_costs(rows, block):
    def plain(i):
        """Least costs from each state before row i, by relaxation."""
        if i == len(rows):
            return [0, 4, 2, 0]
        after, (letter, fault) = plain(i + 1), rows[i]
        t, may = fault == "truncated", fault in ("", "truncated")
        out = []
        for s in range(4):
            ways = [3 + after[s]]
            if may and s in turn_repair.NEXT.get(letter, {}):
                ways.append(t + after[turn_repair.NEXT[letter][s]])
            if may:
                ways.append(2 + t + after[3 if s == 2 else 2])
            out.append(min(ways))
        for _ in range(4):
            out = [min(out[s], 2 + out[3 if s == 2 else 2]) for s in range(4)]
        return out

    word, at = turn_repair.END, len(rows)
    while at:
        lo = max(at - block, 0)
        words, word = turn_repair.layers(rows[lo:at], word)
        for i, w in zip(range(lo, at), words, strict=True):
            want = plain(i + 1)
            assert turn_repair.least_costs(w) == [c - min(want) for c in want] and w < 1 << 64
        at = lo
    want = plain(0)
    assert turn_repair.least_costs(word) == [c - min(want) for c in want]


def test_long_conversation_and_batches(spark):
    """Thousands of turns over many Arrow batches, a text of a million characters."""
    r = random.Random(9)
    xs = [(t, r.choice(ROLES), f"{t}{r.choice(['.', '', '!'])}") for t in range(2500)] + [(3000, "user", "x" * 1_000_000)]
    rows = [(1, *x, "f", 1, True) for x in xs]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = turn_repair.repair(spark.createDataFrame(rows, CONV)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want_faults = [x[2].rstrip()[-1] not in ".!?" for x in xs]
    assert len(got) == 1 and got[0]["truncated"] == sum(want_faults) and got[0]["gaps"] == 3000 + 1 - 2501
    # cost by the plain recurrence over four states
    costs = [0, 4, 2, 0]
    for (_, role, _), t in zip(reversed(xs), reversed(want_faults), strict=True):
        letter, out = (" " if role is None else role)[:1], []
        for s in range(4):
            ways = [3 + costs[s], 2 + t + costs[3 if s == 2 else 2]]
            if s in turn_repair.NEXT.get(letter, {}):
                ways.append(t + costs[turn_repair.NEXT[letter][s]])
            out.append(min(ways))
        for _ in range(3):
            out = [min(out[s], 2 + out[3 if s == 2 else 2]) for s in range(4)]
        costs = out
    audit = got[0]["audit"]
    assert got[0]["cost"] == costs[0] and len(audit) - audit.count("I") == len(xs)


def test_op12(spark, tmp_path):
    _same(spark, "op12_turn_repair")
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, *range(9)]), r.choice(ROLES), r.choice(TEXTS), "f", 1, True) for _ in range(90)]
    rows += [(c, 0, "user", "Once.", "f", 1, True) for c in range(100, 160)]  # some are dropped and leave nothing
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {c: [] for c, *_ in rows}
    for c, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            convs[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {x["conv_id"]: tuple(x)[1:] for x in turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()}
    assert got == {c: _plain_repair(xs) for c, xs in convs.items()}
    assert (0, 0, 0, 0, 0, 0, "", _sha("")) in got.values()
    empty = spark.createDataFrame([], CONV)
    assert turn_repair.repair(empty).count() == 0


# --- token files -----------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=1500), st.data())
def test_pages_round_trip(ids, data):
    v = np.array(ids, dtype=np.uint64)
    page = token_files.pack(v)
    assert token_files.unpack(page).tolist() == ids
    lo = data.draw(st.integers(0, len(ids)))
    hi = data.draw(st.integers(lo, len(ids)))
    assert token_files.unpack(page, lo, hi).tolist() == ids[lo:hi]


def test_words_take_the_most_that_fits():
    """The word count is that of the greedy packing by definition; small ids cost little."""
    r = random.Random(1)
    ids = [r.choice([0, 1, r.randrange(300), r.randrange(50_257), 1 << 61]) for _ in range(3000)]
    words = 0
    for lo in range(0, len(ids), token_files.BLOCK):
        part = ids[lo : lo + token_files.BLOCK]
        while part:
            n = max((min(c, len(part)) for c, w in zip(token_files.COUNTS[1:], token_files.WIDTHS[1:], strict=True) if all(x < 1 << w for x in part[:c])), default=1)
            part, words = part[n:], words + 1
    assert token_files.HEADER.unpack_from(token_files.pack(np.array(ids, np.uint64)))[5] == words
    assert len(token_files.pack(np.zeros(6000, np.uint64))) < 1200


def test_bad_pages_are_refused():
    page = token_files.pack(np.arange(1000, dtype=np.uint64))
    for bad in (b"XXXX" + page[4:], page[:-8], page[:4] + b"\x09" + page[5:]):
        with pytest.raises(ValueError):
            token_files.unpack(bad)
    words = bytearray(page)
    words[-1] |= 0xF0
    with pytest.raises(ValueError):
        token_files.unpack(bytes(words))


PIECES = [" ", "  ", "\n", "\t", "a", "the", "don't", "'s", "é", "12", "...", "<|endoftext|>", " ", " ", "\x1c", "᠎", "🙂", "x" * 300]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_units_give_the_librarys_ids(text):
    e = token_files._encoder(token_files.TOKENIZER)
    assert e.by_unit
    assert e.encode([text])[0].tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_see_whole_texts():
    e = token_files.Encoder("/opt/tokenizers/word_bpe_49k.json")
    assert not e.by_unit
    texts = ["One  two.", None, "", "Drei\nvier"]
    assert [x.tolist() for x in e.encode(texts)] == [e.library.encode(t or "", add_special_tokens=False).ids for t in texts]


TOKENS = "doc_id long, text string, page long, ids string, start long, key string"


def _want(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.TOKENIZER)
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in rows]


def test_files_round_trip(spark, monkeypatch):
    texts = [None, "", "a b", "The  end.\n", "word " * 60_000, "é 🙂", "a b"]
    rows = [(i * 3, texts[i % len(texts)], 1, "i", 2, "k") for i in range(40)] + [(None, "null id", 1, "i", 2, "k"), (9, "a b", 1, "i", 2, "k"), (9, "other", 1, "i", 2, "k")]
    path = f"{shared_folder(spark)}/tokens-test-{random.random()}"
    token_files.write_token_files(spark.createDataFrame(rows, TOKENS).repartition(5), path)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    want = _want([(r[0], r[1]) for r in rows])
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(d), x) for d, x in want)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    flat, at = [], 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
        flat += r["ids"]
    for lo, hi in ((0, 5), (1000, 70_000), (len(flat) - 3, len(flat) + 10), (5, 5)):
        parts = token_files.read_token_range(spark, path, lo, hi).orderBy("start").collect()
        assert [i for p in parts for i in p["ids"]] == flat[lo:hi]
        assert not parts or parts[0]["start"] == lo


def test_files_of_no_documents(spark):
    path = f"{shared_folder(spark)}/tokens-test-{random.random()}"
    token_files.write_token_files(spark.createDataFrame([], TOKENS), path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_op13(spark):
    got = sorted(tuple(r) for r in token_files.op13_token_files(spark, SF).collect())
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for d, ids in _want(rows):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
