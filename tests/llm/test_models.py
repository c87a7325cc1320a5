"""Operators 4, 5, 7 and 8: held-out accuracy, folding, page extraction, empty input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import html_extract, language_id, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


def _labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_accuracy(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = language_id.op4_language_id(spark, SF).join(lang, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert out[0] > 0.97 and 0 <= out[1] and out[2] <= 1, out


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    train = spark.createDataFrame([(i, t, g, 0) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("x", None)] * 5)], schema)
    docs = spark.createDataFrame([(1, None, "q", 0), (2, "123 !!", "q", 0), (3, "the dog", "q", 0), (4, "die katze", "q", 0), (4, "die katze", "q", 0), (5, "", "q", 0), (6, "der " * 200_000, "q", 0)], schema)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, train).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[3][0] == "en" and got[4][0] == got[6][0] == "de"
    assert {r["lang_pred"] for r in language_id.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), train).count() == 0


def _plain_buckets(text):
    """Buckets of all n-grams of a text, from the definition with whole numbers."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    low = text.lower()
    for n in language_id.ORDERS:
        for i in range(len(low) - n + 1):
            h = 0
            for j, c in enumerate(low[i : i + n], 1):
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + j) & m
            yield mix(h) >> 49


def test_language_scores_are_naive_bayes(monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 7)
    monkeypatch.setattr(language_id, "GATHERED", 5)
    rng = np.random.default_rng(0)
    logp = np.log(rng.uniform(size=(language_id.BUCKETS, 3))).astype(np.float32)
    m = language_id.Model(["a", "b", "c"], [logp[:, :2], logp[:, 2:]], np.log([0.5, 0.2, 0.3]))
    texts = ["Abc d", "xyz", "Ein längerer Satz, über mehrere Stücke.", "é"]
    want = []
    for t in texts:
        buckets = list(_plain_buckets(t))
        assert language_id.counts(t).sum() == len(buckets) and set(np.flatnonzero(language_id.counts(t))) == set(buckets)
        s = m.prior + logp[buckets].astype(float).sum(0)
        want.append(np.exp(s - s.max()) / np.exp(s - s.max()).sum())
    assert np.allclose(language_id.scores(texts, m), want, atol=1e-5)


def test_many_languages(spark):
    """No bound on the languages: each of 600 is predicted, over several blocks of the matrix."""
    word = lambda i: "".join(chr(0x4E00 + 7 * i + j) for j in range(5))
    train = spark.createDataFrame([(i, f"{word(i // 3)} {word(i // 3)}", f"l{i // 3:03d}", 1) for i in range(1800)], "doc_id long, text string, lang string, n int")
    out = language_id.identify(train, train).join(train.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang = lang_pred").count() == 1800


def test_language_query_is_brute_force(spark):
    """The whole query against naive Bayes by dictionaries, from the table alone."""
    import zlib
    from collections import Counter, defaultdict

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs}
    grams, n = defaultdict(Counter), Counter()
    for i, t, g in docs:
        if not held[i] and t is not None and g is not None:
            grams[g].update(_plain_buckets(t))
            n[g] += 1
    size = {g: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for g, c in grams.items()}
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        assert got[i]["held_out"] == held[i]
        if not t or not any(map(str.isalpha, t)):
            assert got[i]["lang_pred"] == "und"
            continue
        c = Counter(_plain_buckets(t))
        s = {g: np.log(n[g] / sum(n.values())) + sum(k * np.log((grams[g][b] + language_id.SMOOTHING) / size[g]) for b, k in c.items()) for g in n}
        top = max(s.values())
        assert s[got[i]["lang_pred"]] >= top - 1e-2 and abs(got[i]["score"] - 1 / sum(np.exp(x - top) for x in s.values())) < 1e-2


def test_folding():
    assert toxicity.fold("Id10T!! тrаsh, $cum ＩＤＩＯＴ") == b" idiot trash scum idiot "
    assert toxicity.fold(None) == toxicity.fold(" .,") == b" "


def test_exceptions_and_length():
    m = toxicity.Model({"trash": 4.0, "idiot": 5.0}, ["trash can"])
    a = m.automaton()
    assert toxicity.measures(a, toxicity.fold("the trash can"))[0] == 0.0
    assert toxicity.measures(a, toxicity.fold("trash cans, 1d1ots"))[0] == 9.0
    short, long = (toxicity.measures(a, toxicity.fold("trash " + "word " * n))[1] for n in (50, 500))
    assert short > long > 0


def test_short_and_long_words_are_terms(spark):
    """Words of any length can be toxic: a short one as a whole, a long one beyond the others that begin like it."""
    rng = np.random.default_rng(3)
    words = [f"w{i}x" for i in range(50)] + ["zo", "zogg", "unwahrscheinlichkeiten"]
    text = lambda *more: " ".join([*rng.choice(words, 30), *more])
    rows = [(text("zog", "unwahrscheinlichkeitsfluch") if i % 4 == 0 else text(), int(i % 4 == 0)) for i in range(400)]
    m = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert "zog " in m.terms and any(t.startswith("unwahrscheinlichkeits") for t in m.terms)
    a = m.automaton()
    total = lambda t: toxicity.measures(a, toxicity.fold(t))[0]
    assert total("a ZOG here") > 0 and total("z0g") > 0 and total("zogg zo unwahrscheinlichkeiten") == 0 and total("unwahrscheinlichkeitsfluchs") > 0


def test_toxicity_query_is_brute_force(spark):
    """Scores of the query from the fitted model by plain search for each term, word by word."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), _labels(spark)
    m = toxicity.fit(toxicity.training_rows(docs, labels, "pmod(crc32(cast(doc_id AS string)), 4) = 2", toxicity.MAX_TRAIN_ROWS))
    got = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        body = toxicity.fold(r["text"]).decode()
        out = [(p, p + len(e) + 1) for e in m.exceptions for p in range(len(body)) if body.startswith(f" {e} ", p)] if any(f" {e} " in body for e in m.exceptions) else []
        best = {}
        for t, w in m.terms.items():
            p = body.find(" " + t)
            while p >= 0:
                if p not in best or len(t) > best[p][0]:
                    best[p] = (len(t), w)
                p = body.find(" " + t, p + 1)
        total = sum(w for p, (_, w) in best.items() if not any(x <= p < y for x, y in out))
        rate = 100 * total / max(len(body.split()), 20)
        z = m.curve[0] + m.curve[1] * np.log1p(total) + m.curve[2] * np.log1p(rate)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_held_out(spark):
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "trash " * 50_000, 0.5), (3, "trash " * 50_000, 0.5)], "doc_id long, text string, score double")
    m = toxicity.Model({"trash": 4.0}, [], (-3.0, 1.0, 1.0))
    got = [(r["doc_id"], r["score"] > 0.5) for r in toxicity.toxicity(docs, m).orderBy("doc_id").collect()]
    assert got == [(1, False), (2, False), (3, True), (3, True)]
    none = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    assert toxicity.toxicity(docs, none).filter("score BETWEEN 0 AND 1").count() == 4 and toxicity.toxicity(docs.limit(0), m).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = quality_classifier.op7_quality_classifier(spark, sf)
    n = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.min("score"), F.max("score")).first()
    assert n[0] > 0.97 and n[1] >= 0 and n[2] <= 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0, 1), (2, "", 9.0, 1), (3, "a b", 9.0, 1), (3, "a b", 9.0, 1), (4, "w " * 100_000, 9.0, 1)], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (4, None)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs, labels, held_out="false").collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_query_is_brute_force(spark):
    """The query against ridge regression on all training rows at once and isotonic levels by their min-max formula."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), _labels(spark)
    got = {r["doc_id"]: r for r in quality_classifier.op7_quality_classifier(spark, sf).collect()}
    model = quality_classifier.learn(docs, labels)
    pick = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(quality_classifier.CALIBRATE_PART)) == 0
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "text", "quality", F.expr(quality_classifier.HELD_OUT).alias("out"), pick.alias("cal")).collect()
    x = quality_classifier.ratios(quality_classifier.stats_of(pa.array([r["text"] for r in rows], pa.string())))
    y = np.array([-1 if r["quality"] is None else r["quality"] for r in rows], float)
    out, cal = (np.array([r[c] for r in rows], bool) for c in ("out", "cal"))
    use = ~out & (y >= 0)
    mean, scale = x[use].mean(0), np.sqrt(np.maximum(x[use].var(0), 1e-8))
    z = quality_classifier.fourier(x, mean, scale, model.omega, model.phase)
    fit = use & ~cal
    w = np.linalg.solve(z[fit].T @ z[fit] + quality_classifier.RIDGE * fit.sum() * np.eye(z.shape[1]), z[fit].T @ y[fit])
    raw = z @ w
    assert np.allclose(raw, model.raw(x), atol=1e-5)
    order = np.argsort(raw[use & cal], kind="stable")
    s, t = raw[use & cal][order], y[use & cal][order]
    level = np.array([max(min(t[i : j + 1].mean() for j in range(k, len(t))) for i in range(k + 1)) for k in range(len(t))])
    knots = [(s[level == v].mean(), (t[level == v].sum() + 0.5) / ((level == v).sum() + 1) if (level == v).sum() > 1 else v) for v in np.unique(level)]
    want = np.clip(np.interp(raw, [k for k, _ in knots], [v for _, v in knots]), 0, 1)
    assert max(abs(got[r["doc_id"]]["score"] - v) for r, v in zip(rows, want, strict=True)) < 1e-4
    assert all(got[r["doc_id"]]["held_out"] == r["out"] and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5) for r in rows)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, levels = quality_classifier.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and len(knots) < 100


def test_fourier_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 4))
    omega, phase = rng.normal(size=(4, 20_000)), rng.uniform(0, 2 * np.pi, 20_000)
    z = quality_classifier.fourier(x, np.zeros(4), np.ones(4), omega, phase)[:, 1:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)
    assert np.abs(z @ z.T - want).max() < 0.05


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script><style>p{}</style></head><body><header><a href="/">Home</a></header><nav><ul><li><a>menu</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>One   <b>two</b>three.<br>four</p><aside class="sidebar">side</aside><p>caf&eacute; &#8212; end &lt;x&gt;</p>
<form><input><button>Send</button></form><div id="comments"><p>First!</p></div></article><footer>&copy; foot</footer></body></html>"""


def test_page():
    want = "Head & line\nOne twothree. four\ncafé — end <x>"
    learned = html_extract.weights_of(html_extract.labelled_counts(PAGE))
    for w in (learned, html_extract.weights_of({})):
        assert html_extract.extract(PAGE, w) == want
    assert html_extract.extract(PAGE[: PAGE.index("<aside")], learned) == "Head & line\nOne twothree. four"
    for empty in (None, "", "<p></p>", "<script>x", "<nav>menu</nav>", "<" * 1000, '<a b="' * 300):
        assert html_extract.extract(empty, learned) in ("", "<" * 1000) or empty.startswith("<a")


ARTICLE = "".join(f"<p>Paragraph {i} of the text runs on for some words, and on.</p>" for i in range(12))
TEXT = "\n".join(f"Paragraph {i} of the text runs on for some words, and on." for i in range(12))


@pytest.mark.parametrize("name", ["layout no-sidebar", "has-header page", "article-header", "ad-free", "post comments-open", "search-result", "share-price", "sidebar", "header", "x"])
def test_names_of_layouts(name):
    """The article stays whatever its frame is called; menus, adverts, comments and the footer go."""
    page = f'<body><nav>menu one</nav><div class="{name}">{ARTICLE}</div><div class="ad">Buy this now</div><div id="comments-list"><p>First!</p></div><footer>foot</footer></body>'
    for w in (html_extract.DEFAULT, html_extract.weights_of(html_extract.labelled_counts(PAGE))):
        assert html_extract.extract(page, w) == TEXT


def test_names():
    yes = "ad ads top-ad page-header main-header site_header sidebar left-sidebar siteFooter main-nav ad-slot comment-list comments cookie-bar social-links newsletter related"
    no = "no-sidebar has-header article-header entry-header ad-free comments-open search-result share-price layout page content shadow header-image download"
    assert [x for x in yes.split() if not html_extract.names_boilerplate(x)] == [] and [x for x in no.split() if html_extract.names_boilerplate(x)] == []


def _made_page(rng, label):
    """A page and its main text: paragraphs, lists and headings among menus, adverts, notices, comments and forms."""
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "x&amp;y", "caf&eacute;", "a"]) for _ in range(n))
    import html

    blocks, want = [], []
    for _ in range(int(rng.integers(4, 9))):
        t = words(int(rng.integers(15, 60)))
        kind = rng.choice(["p", "li", "h2", "blockquote"])
        blocks.append(f"<{kind}>{t.replace('lorem', '<b>lorem</b>')}</{kind}>")
        want.append(html.unescape(t))
        if rng.random() < 0.3:
            blocks.append(rng.choice(['<div class="ad-slot">Buy it</div>', '<aside>side words</aside>', '<form><input><button>Go</button></form>', "<script>var a='<p>x</p>'</script>"]))
    frame = rng.choice(["article", "main"]) if label else rng.choice(['div class="entry-content"', 'div id="page-body"', "section"])
    around = ['<div class="cookie-notice">We use cookies here, accept all of them please</div>', '<ul class="menu"><li><a>One</a></li><li><a>Two</a></li></ul>', '<div class="promo7">Deals and deals</div>', '<div class="related-posts-box related"><a>More to read</a></div>']
    rng.shuffle(around)
    page = f"<html><head><title>T</title></head><body><header>Site name</header><nav>menu</nav>{around[0]}{around[1]}<{frame}>{''.join(blocks)}</{frame.split()[0]}>{around[2]}{around[3]}<div id='comments'><p>Nice text, dear author of it</p></div><footer>&copy; foot</footer></body></html>"
    return page, "\n".join(want)


def test_made_pages():
    """Weights come from labelled pages; the others, whose markup says nothing of the main text, give all of it and little else."""
    from collections import Counter

    rng = np.random.default_rng(8)
    counts: Counter = Counter()
    for _ in range(100):
        counts.update(html_extract.labelled_counts(_made_page(rng, True)[0]))
    weights = html_extract.weights_of(counts)
    assert weights[".promo"] <= html_extract.OUTSIDE
    right = []
    for i in range(80):
        page, want = _made_page(rng, i % 2 == 0)
        got, gold = (Counter(t.split()) for t in (html_extract.extract(page, weights), want))
        right.append(2 * (got & gold).total() / (got.total() + gold.total()))
        if i % 2 == 0:
            assert html_extract.extract(page, weights) == want
    assert np.mean(right) > 0.98 and min(right) > 0.9


def test_deep_and_broken_pages():
    """Linear in the page: many open elements, stray ends and unclosed quotes."""
    import time

    for page in ("<div>x" * 100_000, "<p><b>x" * 50_000 + "</i>" * 50_000, '<a b="' * 100_000, "<" * 100_000, "</div>" * 100_000, "<script>" * 50_000):
        began = time.process_time()
        html_extract.extract(page, html_extract.DEFAULT)
        assert time.process_time() - began < 5


def test_best_region():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(-4, 5, rng.integers(0, 12)).astype(float)
        a, b = html_extract.best_region(s)
        most = max((s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert (a, b) == (0, 0) if most <= 0 else s[a:b].sum() == most


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "clash"), (2, "u", "", "clash"), (3, "u", PAGE, "clash"), (3, "u", PAGE, "clash")], "page_id long, url string, html string, text string")
    odd = df.withColumnsRenamed({"url": "__html", "page_id": "source.x"})
    assert html_extract.main_text(odd).columns == ["source.x", "__html", "html", "text"] and html_extract.main_text(odd).count() == 4
    got = [r["text"] for r in html_extract.main_text(df).orderBy("page_id").collect()]
    assert got[:2] == ["", ""] and got[2] == got[3] != "" and html_extract.main_text(df.limit(0)).count() == 0
    assert html_extract.main_text(df).columns == ["page_id", "url", "html", "text"]
    out = html_extract.op8_html_extract(spark, SF)
    assert out.filter("n_chars <> length(text)").count() == 0 and out.filter("text LIKE '%©%'").count() == 0


@pytest.mark.parametrize("chars", [10, 200_000])
def test_long_page(chars):
    assert len(html_extract.extract("<article><p>" + "w " * chars + "</p></article>", html_extract.weights_of({}))) == 2 * chars - 1
