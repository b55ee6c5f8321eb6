"""Decontamination, page text, mixing and the pipeline."""

import random

import pytest

from presswork.llm import decontaminate, html_text, mixing


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_myers():
    r = random.Random(1)
    for _ in range(800):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, b))) for a, b in ((1, 12), (0, 25)))
        assert decontaminate.nearest(decontaminate.masks(p), len(p), t) == distance(p, t)


def planted():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)]
    docs = []
    for i in range(150):
        body = [word() for _ in range(60)]
        if i % 3 == 0:
            t = list(r.choice(items)[1].upper() if i % 2 else r.choice(items)[1])
            for _ in range(r.randint(0, 18)):
                t[r.randrange(len(t))] = r.choice("abcdefghij ")
            body.insert(30, "".join(t).replace(" ", "\n", 2))
        docs.append((i, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 400])
def test_contaminated_against_brute_force(spark, block):
    docs, items = planted()
    want = set()
    for i, t in docs:
        for k, x in items:
            p = decontaminate.normalise(x)
            d, _ = distance(p, decontaminate.normalise(t))
            if d <= int(len(p) * decontaminate.ERROR_RATE):
                want.add((i, k, d))
    extra = [(None, items[0][1]), (900, None), (901, ""), (902, "long words " * 20000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in [*docs, *extra]], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, " ")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench, block_bytes=block)
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got.collect()} == want | {(None, 0, 0)}
    text = {i: decontaminate.normalise(t) for i, t in docs}
    for r in got.where("doc_id IS NOT NULL").collect():
        assert distance(decontaminate.normalise(items[r["item_id"]][1]), text[r["doc_id"]][r["start"] : r["end"]])[0] == r["edits"]
    clean = decontaminate.decontaminate(df, bench, block_bytes=block)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in [*docs, *extra]} - {i for i, _, _ in want} - {None}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0 and decontaminate.contaminated(df.where("false"), bench).count() == 0


PAGE = """<html><head><title>T</title></head><body class="post"><header><h1>Site</h1><a href=/>Home</a></header><div id="cookie-notice">We use cookies on this site to make it better for you and for us all.</div>
<nav><ul><li><a>x</a></ul></nav><main><h1>Title here</h1><p>First long paragraph of the story with many words in it to read &amp; enjoy\n today.<p>Short.<ul><li>One item</li><li>Two</li></ul>
<aside>Related: <a>foo</a></aside><blockquote>Quote <b>it.</blockquote><form><label>Mail</label><input></form><div class="ad">Buy this great product now, it is the best that there ever was in the world.</div><p>End<br>line.</main>
<section id="comments"><h2>Comments</h2><p>I really liked this article and I read it twice because it was so good to read.</p></section><footer>Bye</footer><script>if(a<b){"</p>"}</script></body>"""
BARE = """<div><a>Home</a> | <a>News</a></div><div><div><h2>Story</h2><p>First long paragraph of the story with many words in it to read and enjoy today, is it not.</p><p>Short one.</p>
<p>Another long paragraph of the story with many words in it to read and enjoy today.</p></div></div><div class=sidebar><p>Sidebar text is long enough to be mistaken for content but it is not so here today.</div>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, BARE), (3, "u", None), (4, "u", ""), (5, "u", "plain words only"), (None, "u", "<p"), (6, "u", "<article>" + "<p>a few words of text here</p>" * 3000 + "</article>")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[1]["text"] == "Title here\n\nFirst long paragraph of the story with many words in it to read & enjoy today.\n\nShort.\n\nOne item\n\nTwo\n\nQuote it.\n\nEnd line."
    assert got[2]["text"].split("\n\n")[0] == "Story" and "Short one." in got[2]["text"] and "Sidebar" not in got[2]["text"] and "Home" not in got[2]["text"]
    assert (got[3]["text"], got[3]["n_chars"], got[4]["text"]) == ("", 0, "")
    assert got[6]["text"].count("\n\n") == 2999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A long paragraph of the story with many words in it to read and enjoy today, is it not."


@pytest.mark.parametrize("tag", ["button", "svg", "math", "object", "canvas", "map", "select", "audio", "video"])
def test_open_element_keeps_the_article(tag):
    page = f"<body><nav><div><{tag}>Menu</div></nav><main><h1>Story</h1><p>{LONG}</p></main>"
    assert html_text.main_text(page) == f"Story\n\n{LONG}"
    assert LONG in html_text.main_text(page + f"<nav><{tag}>x</{tag}></nav>")
    assert LONG in html_text.main_text(f"<body><{tag} class=x><main><p>{LONG}</p></main>")


def test_article_parts_are_read():
    text = lambda inner: html_text.main_text(f"<main><p>{LONG}</p>{inner}<p>{LONG}</p></main>").split("\n\n")[1:-1]
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> hold.</p>") == ["Let x=1 hold."]
    for tag in ("object", "canvas", "noscript"):
        assert text(f"<p><{tag}>Fallback of the figure.</{tag}></p>") == ["Fallback of the figure."]
    for name in "byline footnotes toc tags legal disclaimer social search form tracking overflow-hidden entry-header".split():
        assert text(f'<p class="{name}">Said of the story.</p>') == ["Said of the story."], name
    nested = f'<article class="post"><div class="content"><div class="entry">{{}}<p>{LONG}</p></div></div></article>'
    for name in ("comments", "ad", "hidden"):
        assert "Gone" not in html_text.main_text("<main>" + nested.format(f'<div class="{name}"><p>Gone: {LONG}</p></div>') + "</main>"), name
    assert text("<script>if(a<b)</script><button>Press</button><svg><text>mark</text></svg>") == []


def test_many_open_elements_are_read_in_time():
    assert html_text.main_text("<main><p>" + "<button>x <svg>y " * 20000 + LONG).endswith(LONG)


def test_cut_is_minimal():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 7)
        a, b = ([r.choice([0, 1, 2, 5]) for _ in range(n)] for _ in range(2))
        edges = [(i, j, r.choice([0.5, 1, 2])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda side: sum(b[i] if side[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        assert abs(cost(html_text.cut(a, b, edges)) - min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))) < 1e-9


def test_mixing_meets_marginals(spark):
    r = random.Random(8)
    rows = [(i, "src0" if r.random() < 0.4 else f"src{r.randint(1, 3)}", r.choice(["en", "en", "de", None]), "word " * r.randint(1, 200)) for i in range(3000)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, source string, lang string, text string, weight double")
    got = mixing.calibrated(df, {"source": 0.5, "lang": 1.0}).select("source", "lang", "n_tokens", "probability", "chosen").toPandas()
    for dim, power in (("source", 0.5), ("lang", 1.0)):
        mass, want = got.groupby(dim).n_tokens.sum(), None
        want = mass**power / (mass**power).sum()
        expected = (got.n_tokens * got.probability).groupby(got[dim]).sum()
        assert ((expected / expected.sum() - want).abs() < 1e-3).all()
    assert got.probability.max() == pytest.approx(1.0)
    share = got[got.chosen].groupby("source").n_tokens.sum()
    assert (share / share.sum() - 0.25).abs().max() < 0.12
    out = mixing.mixed(df, temper={"source": 0.5})
    assert out.columns == df.columns and out.count() == mixing.mixed(df.repartition(3), temper={"source": 0.5}).count()


def test_one_small_cell_does_not_set_the_rate(spark):
    import corpus_pipeline

    r = random.Random(9)
    rows = [(i, f"src{min(r.randint(0, 9), 5)}", r.choice(["en", "en", "de"]), "word " * r.randint(100, 300), 0) for i in range(2000)]
    rows.append((9999, "own", "en", "word " * 61, 0))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long")
    share = lambda rate: mixing.calibrated(df, rate=rate).selectExpr("sum(n_tokens * probability) / sum(n_tokens) AS s", "max(probability) AS p").first()
    assert share(None)["s"] < 0.2
    for rate in (0.4, 1.0):
        got = share(rate)
        assert got["s"] == pytest.approx(rate, rel=1e-9) and got["p"] <= 1
    assert 700 < corpus_pipeline.mix_sources(spark, df, "").count() < 900
    shares = {(m["dimension"], m["value"]): m for m in mixing.marginals(df, rate=0.4).collect()}
    assert not shares["source", "own"]["met"] and shares["lang", "de"]["met"] and shares["source", "src5"]["met"]
    assert shares["source", "own"]["expected"] < shares["source", "own"]["target"]
    assert all(m["met"] for m in mixing.marginals(df.where("source <> 'own'"), rate=0.4).collect())


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "s", "en", ""), (3, "s", "en", "x " * 100000), (4, "t", "en", "y")], "doc_id long, source string, lang string, text string")
    got = mixing.calibrated(df)
    assert got.count() == 5 and all(0 <= r["probability"] <= 1 for r in got.collect())
    assert mixing.calibrated(df.where("false")).count() == 0
    assert mixing.calibrated(df.where("text = ''")).first()["chosen"] is False


def test_pipeline(spark):
    import corpus_pipeline
    from presswork.session import settle, table

    sf, docs = "/root/testdata/sf0.001", None
    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_pipeline_on_awkward_documents(spark, tmp_path):
    """NULLs, empty and very long texts, repeated rows and further columns with clashing names go through every stage."""
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(60000))
    rows = [(1, None, None, None, None), (None, "plain words of a text", "en", "s", 1), (2, "", "en", "s", 0), (3, long, "en", "s", 9), (4, "some words stand here", None, "t", 3), (4, "some words stand here", None, "t", 3), (5, long, "de", None, 9), (7, "Quite another passage about rivers\nand bridges in spring", "en", "s", 2)]
    rows += [(100 + i, f"text number {i} with words {i * 7} {i * 11} of its own", "en", "s", 5) for i in range(60)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, matches string, weight string, component_id string, toxic int, __gone string, `a b` int"
    docs = spark.createDataFrame([(*r, "x", 0.5, "m", "w", "c", 1, "g", 7) for r in rows], extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 1), (100, 0, 0)], "doc_id long, quality int, toxic int").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "another passage about rivers and bridges"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, str(tmp_path))
        assert out.columns == docs.columns, name
        left = out
        counts.append(left.count())
    assert counts[0] == len(rows)  # nothing is labelled
    assert counts[1] == len(rows) - 1  # of the two long texts one stays
    assert counts[2] == counts[1] - 1  # the text of the benchmark
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[3]


def test_stated_shares(spark, monkeypatch):
    """Shares that the caller states are met, in one task and by shuffles alike."""
    r = random.Random(12)
    rows = [(i, r.choice("aaaab"), r.choice(["en", "de"]), "word " * r.randint(1, 60)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    wish = {"source": {"a": 0.4, "b": 0.6, "absent": 1.0}, "lang": {"de": 3, "en": 1}}
    found = {}
    for small in (mixing.SMALL_CELLS, 0):
        monkeypatch.setattr(mixing, "SMALL_CELLS", small)
        got = {(m["dimension"], m["value"]): m for m in mixing.marginals(df, wish, rate=0.2).collect()}
        assert got["source", "b"]["target"] == pytest.approx(0.6) and got["lang", "de"]["target"] == pytest.approx(0.75)
        assert all(m["met"] for m in got.values()) and len(got) == 4
        found[small] = sorted((x["row"]["doc_id"], round(x["probability"], 9)) for x in mixing.calibrated(df, wish, rate=0.2).select("row", "probability").collect())
    a, b = found.values()
    assert a == b and len(a) == 2000
    only = mixing.mixed(df, temper={"source": {"b": 1.0}}).select("source").distinct().collect()
    assert [x["source"] for x in only] == ["b"]


@pytest.mark.parametrize("page", [
    '<article><p>Hello this is the story of many words in a line today ok.<script src=/js/app/>code()</script> More of it.</p></article>',
    '<script src="/a.js"/>code()</script><article><p>Hello this is the story of many words in a line today ok. More of it.</p></article>',
    '<div class="search-results"><article><p>Hello this is the story of many words in a line today ok. More of it.</p></article></div>',
    '<article><p class="form">Hello this is the story of many words in a line today ok. More of it.</p></article>',
])
def test_signs_that_mislead(page):
    assert html_text.main_text(page) == "Hello this is the story of many words in a line today ok. More of it."


@pytest.mark.parametrize("part", ["<div></p>", "<head>", "<svg><div>", "<template><div></div>", "<button>", "<video></div>", '<a ">', "<select><option>"])
def test_hostile_pages_are_read_in_time(part):
    import time

    began = time.process_time()
    html_text.main_text("<section>" + part * (1_000_000 // len(part)) + "</section></template></button></svg></video></select>")
    assert time.process_time() - began < 8  # 1 to 2 seconds on an idle core; a quadratic reader takes minutes
