"""Toxicity, HTML extraction, neighbours, quotations, URL filters and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows_of, rows_of_sql
from veridiff.llm import html_text as H
from veridiff.llm import neighbours as N
from veridiff.llm import queries as Q
from veridiff.llm import toxicity as T
from veridiff.llm.quotations import link_quotations
from veridiff.llm.url_filters import intervals, judge


@pytest.mark.parametrize("name", ["op5_quotation_linking", "quotation_linking_replies", "op9_url_filters"])
def test_against_sql(spark, data, name):
    assert rows_of(Q.QUERIES[name](spark, data)) == rows_of_sql(connect(data), Q.ORACLE_SQL[name])


# -- toxicity --------------------------------------------------------------------------------------------------------------


def split(scores):
    """Maximal segments by definition: the best run, then the same to its left and right."""
    out = []

    def part(a, b):
        best = None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += scores[j]
                if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                    best = (i, j + 1, s)
        if best:
            part(a, best[0])
            out.append(best)
            part(best[1], b)

    part(0, len(scores))
    return out


def test_segments():
    rng = random.Random(2)
    for _ in range(500):
        x = np.array([rng.choice([-2.3, -1.1, 1.7, 3.13, -0.37, 0.91]) for _ in range(rng.randint(0, 14))])
        assert [(a, b, round(s, 6)) for a, b, s in T.segments(x)] == [(a, b, round(s, 6)) for a, b, s in split(x)]


def test_scores_by_definition(spark, data):
    """The query's scores of all documents of up to 120 words, from the model's ratios and the definition of segments."""
    import math

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = T.learn_toxicity(docs, spark.read.parquet(f"{data}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in Q.QUERIES["op10_toxicity"](spark, data).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(got) == set(texts)
    checked = 0
    for i, text in texts.items():
        words = T._words(text.lower())
        if len(words) > 120:
            continue
        found = split([model.ratio(w) - T.DRIFT for w in words])
        evidence = sum(max(0.0, model.lam * s - math.log(max(model.k * len(words), 1e-9))) for _, _, s in found)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.base + model.slope * math.log1p(evidence)))))
        checked += 1
    assert checked > 20


def test_held_out_accuracy(spark):
    """Learns on the training folds of the sf0.1 documents, judged on rows it never saw."""
    folder = "/root/testdata/sf0.1"
    got = Q.QUERIES["op10_toxicity"](spark, folder).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    seen = got[got["held_out"]].merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    hit = ((seen["predicted"] == 1) & (seen["toxic"] == 1)).sum()
    assert hit / (seen["predicted"] == 1).sum() >= 0.9 and hit / (seen["toxic"] == 1).sum() >= 0.8


def test_toxicity_odd_rows(spark):
    words = "the cat sat on a mat with some other animals and a very long story about nothing".split()
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(words, k=30) + (["vile", "scum"] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs + [(None, None), (1000, ""), (1001, "scum " * 50_000), (1001, "scum " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    model = T.learn_toxicity(df, labels)
    got = T.score_toxicity(df, model, passages=True).collect()
    assert len(got) == 404
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["predicted"] == 0 and by[None]["score"] == by[1000]["score"] and by[1001]["predicted"] == 1
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400) >= 396
    first = by[0]["passages"][0]
    assert (first["first"], first["after"]) == (30, 32)
    kept = T.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 1001").count() == 0 and kept.where("doc_id is null").count() == 1
    none = T.learn_toxicity(df, labels.limit(0))
    assert T.score_toxicity(df, none).where("predicted = 1").count() == 0
    assert T.score_toxicity(df.limit(0), model).count() == 0


def test_scores_agree_when_a_bound_binds(spark, monkeypatch):
    """One clean text in ten and nine toxic texts in ten hold the word; one text in ten is toxic, so it decides for about half."""
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        toxic = rng.random() < 0.1
        rows.append((i, " ".join(rng.choices(words, k=20) + ["vile"] * (rng.random() < (0.9 if toxic else 0.1))), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = spark.createDataFrame([(1, " ".join(words[:20]) + " vile"), (2, " ".join(words[:20]))], "doc_id long, text string")

    def scores():
        model = T.learn_toxicity(df, df.select("doc_id", "toxic"))
        return [r["score"] for r in T.score_toxicity(probe, model).orderBy("doc_id").collect()]

    whole = scores()
    monkeypatch.setattr(T, "MAX_CLEAN", 800)
    bound = scores()
    assert 0.35 < whole[0] < 0.65 and abs(whole[0] - bound[0]) < 0.12 and abs(whole[1] - bound[1]) < 0.03
    monkeypatch.setattr(T, "MAX_TOXIC", 200)
    both = scores()
    assert abs(whole[0] - both[0]) < 0.12 and abs(whole[1] - both[1]) < 0.03


# -- html ------------------------------------------------------------------------------------------------------------------

PAGE = """<html lang=en><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><div>Site Name</div><ul><li><a href=/>Home</a></li></ul></header>
<div id="cookie-notice">We use cookies to make the site better for you and to show the ads that are of interest to you.</div>
<div class="wrapper"><div class="post-content"><h1>A title &amp; more</h1><p>The first para of the text that is in the page and it has many of the words we need.</p><p>Short.</p>
<div class="share-buttons">Share this on the web</div><form><p>Subscribe to the list of the news that we send to you</p></form><blockquote>Quote &lt;b&gt; here 2 &lt; 3</blockquote><p>Last&nbsp;one <b>bo</b>ld.</div>
<section id="comments"><h2>Comments</h2><p>I think that the post is one of the best that I have read on the site in a while.</p></section></div>
<aside><p>About the author of the page, who has been with us for a long time.</p></aside><footer>&copy; 2020 the site and all of it</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == "A title & more The first para of the text that is in the page and it has many of the words we need. Short. Quote <b> here 2 < 3 Last one bold."
    bare = "<p>The text of a page that is not in any of the containers we know of, and it is long enough.</p><p>Yes.</p><p><a href=x>More of it</a></p><p>cut <b"
    assert H.main_text(bare) == "The text of a page that is not in any of the containers we know of, and it is long enough. Yes."
    assert H.main_text("<nav><a>x</a><article><p>Open menu before the text of the article that we want to keep here.</p></article>") == "Open menu before the text of the article that we want to keep here."
    assert [H.main_text(x) for x in (None, "", "<!-- only", "<")] == ["", "", "", ""]


TEXT = "The text of the article that is in the page, with many of the words that we need for it to be prose."


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "id='page' class='with-comments'", "class='page-with-comments'", "class='sidebar'", "class='layout sidebar-right'"])
@pytest.mark.parametrize("inner", ["div class='post-content'", "section class='entry'", "div role=main", "div itemprop='articleBody'"])
def test_wrappers_named_like_boilerplate(wrapper, inner):
    close = inner.split()[0]
    page = f"<body><nav>Menu of the site</nav><div {wrapper}><{inner}><p>{TEXT}</p></{close}><div class='widget'>{TEXT} Not.</div></div></body>"
    assert H.main_text(page) == TEXT
    assert H.main_text(f"<form id=aspnet><{inner}><p>{TEXT}</p></{close}></form>") == TEXT


@pytest.mark.parametrize("part", ["<section id='discussion'>{}</section>", "<section id='related-work'>{}</section>", "<h2 id='search'>{}</h2>", "<p class='notice'>{}</p>", "<div id='legal'>{}</div>"])
def test_parts_of_articles_named_like_boilerplate(part):
    assert H.main_text(f"<article><p>{TEXT}</p>{part.format('A part')}<p>{TEXT}</p></article>") == f"{TEXT} A part {TEXT}"


def test_named_boilerplate_still_goes():
    for x in ("div class='share-buttons'", "section id='comments'", "div class='comments-area'", "ul class='related-posts'", "form"):
        assert H.main_text(f"<article><p>{TEXT}</p><{x}>{TEXT}</{x.split()[0]}></article>") == TEXT
    for x in ("div class='sidebar'", "div id='cookie-notice'", "p class='copyright'", "form"):
        assert H.main_text(f"<p>{TEXT}</p><{x}>{TEXT}</{x.split()[0]}>") == TEXT
    assert H.main_text(f"<p>{TEXT}</p><div class='sidebar'><div class='text'>{TEXT}</div></div>") == TEXT


LINKS = "<ul><li><a href=a>First of the links</a></li><li><a href=b>Second of the links</a></li></ul>"


@pytest.mark.parametrize(
    "text",
    [
        "Zamek zbudowano w czternastym wieku nad brzegiem rzeki, gdzie przez lata mieszkali ksi\u0105\u017c\u0119ta z rodu Piast\u00f3w.",
        "\u0417\u0430\u043c\u043e\u043a \u043f\u043e\u0441\u0442\u0440\u043e\u0438\u043b\u0438 \u043d\u0430\u0434 \u0440\u0435\u043a\u043e\u0439, \u0433\u0434\u0435 \u043c\u043d\u043e\u0433\u043e \u043b\u0435\u0442 \u0436\u0438\u043b\u0438 \u043a\u043d\u044f\u0437\u044c\u044f \u0438\u0437 \u0441\u0442\u0430\u0440\u043e\u0433\u043e \u0440\u043e\u0434\u0430.",
        "\u57ce\u306f\u5ddd\u306e\u307b\u3068\u308a\u306b\u5efa\u3066\u3089\u308c\u305f\u3002" * 6,
        "def area(width, height): return width * height; print(area(3, 4), area(5, 6), area(7, 8))",
    ],
)
def test_long_blocks_without_stop_words(text):
    assert len(text) >= H.SHORT
    page = f"<h1>Title</h1><p>{text}</p><p>{text}</p>"
    assert H.main_text(page) == f"Title {text} {text}"
    assert H.main_text(LINKS + page) in (f"Title {text} {text}", f"{text} {text}")
    assert H.main_text(page + LINKS) == f"Title {text} {text}"
    assert H.main_text(f"<p>{TEXT}</p>{LINKS}<pre>{text}</pre><p>{TEXT} {TEXT}</p>") == f"{TEXT} {text} {TEXT} {TEXT}"


LONG = "The house was built in the time of the old king and it is one of the few that can still be seen from the road today."
PLAIN = f"""<body><div><div>Site Name</div><ul><li><a href=1>Start page</a></li><li><a href=2>All the news of the day</a></li></ul></div>
<div><h2>A title</h2><p>{LONG}</p><p>Short.</p><p>{TEXT}</p></div>
<div><ul><li><a href=3>More like it</a></li><li><a href=4>Imprint</a></li></ul><p>Example Press</p>
<p>Berlin Hamburg Munich Cologne Frankfurt Stuttgart Leipzig Dresden Hanover Nuremberg Bremen</p></div></body>"""


def test_passes_decide_without_containers_and_names():
    assert H.main_text(PLAIN) == f"A title {LONG} Short. {TEXT}"


@pytest.mark.parametrize("part,off", [("DENSE", 0.0), ("LINKED", 9.0), ("SHORT", 10**6), ("_inherit", lambda found, inside: None)])
def test_each_rule_decides_something(monkeypatch, part, off):
    """Stop-word density, link density, length and the second pass: the text changes without any of them."""
    monkeypatch.setattr(H, part, off)
    assert H.main_text(PLAIN) != f"A title {LONG} Short. {TEXT}"


def test_blocks_of_an_article_are_decided():
    assert H.main_text(f"<article><p>{LONG}</p><p>Short.</p><p>Read on</p>{LINKS}<p>Yes</p></article>") == f"{LONG} Short."
    teasers = "".join(f"<article><h3>Teaser {i}</h3><a href={i}>Read on</a></article>" for i in range(3))
    assert H.main_text(f"<div><p>{LONG}</p><p>{TEXT}</p></div><hr>{teasers}") .startswith(f"{LONG} {TEXT}")
    assert H.main_text(f"<main><p>{LONG}</p></main><div>{TEXT}</div>") == LONG


def soup(page):
    """The page without its article element, and without names or elements that tell boilerplate."""
    import re

    for tag in ("article", "nav", "footer"):
        page = re.sub(rf"<(/?){tag}>", r"<\1div>", page)
    return page.replace(' class="ad"', "")


def test_pages_without_their_containers(spark, data):
    """Of the words kept by link density, stop words, length and neighbours alone, how many are the article's."""
    import re
    from collections import Counter

    kept = right = wanted = 0
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = Counter(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]).split())
        got = Counter(H.main_text(soup(r["html"])).split())
        kept, right, wanted = kept + got.total(), right + (got & article).total(), wanted + article.total()
    assert right / kept > 0.9 and right / wanted > 0.95


def test_pages_against_their_articles(spark, data):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = Q.QUERIES["op6_html_extraction"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()) and r["n_chars"] == len(r["text"])


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (1, None, ""), (None, "u", PAGE), (2, "v", "<p>" + "The word is in the text. " * 40_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r["page_id"], r["url"]): r["n_chars"] for r in H.extract(df).collect()}
    assert got[(1, "u")] == 0 and got[(1, None)] == 0 and got[(2, "v")] == 999_999 and got[(None, "u")] > 100
    assert H.extract(df.limit(0)).count() == 0


# -- neighbours --------------------------------------------------------------------------------------------------------------


def exact_neighbours(ids, points, q, k):
    d = np.sqrt(((points - points[q]) ** 2).sum(1))
    return [(ids[i], d[i]) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def test_recall_and_scores(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    ids, points = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), float)
    rows = Q.QUERIES["op4_nearest_neighbours"](spark, data).toPandas().sort_values(["query_id", "rank"])
    assert set(rows["query_id"]) == {i for i in ids if i % 100 == 0} and (rows.groupby("query_id")["rank"].max() == 10).all()
    hit = n = 0
    for q, g in rows.groupby("query_id"):
        want = exact_neighbours(ids, points, int(np.flatnonzero(ids == q)[0]), 10)
        hit += len({i for i, _ in want} & set(g["vec_id"]))
        n += 10
        at = {i: s for i, s in zip(g["vec_id"], g["score"])}
        assert all(s == np.sqrt(((points[ids == i][0] - points[ids == q][0]) ** 2).sum()) for i, s in at.items())
        assert list(g["score"]) == sorted(g["score"])
    assert hit / n >= 0.9


def test_small_leaves_reach_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 20)
    monkeypatch.setattr(N, "SLICE", 7)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    rows = N.nearest_neighbours(df, "id % 50 = 0", k=5).toPandas()
    hit = sum(len({i for i, _ in exact_neighbours(np.arange(1500), points.astype(float), q, 5)} & set(g["vec_id"])) for q, g in rows.groupby("query_id"))
    assert hit / (30 * 5) >= 0.9


def test_outliers_get_all_neighbours(spark, monkeypatch):
    """Tight clusters with a few far vectors, whose own leaves hold fewer than k others."""
    monkeypatch.setattr(N, "LEAF", 128)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 10
    points = np.vstack([c + rng.normal(size=(60, 8)) * 0.01 for c in centres] + [rng.normal(size=(4, 8)) * 1000])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = N.nearest_neighbours(df, "id >= 700", k=10, recall=0.3).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == dict.fromkeys(range(700, 724), 10)


def test_calibration_leaves_copies_out(monkeypatch):
    monkeypatch.setattr(N, "LEAF", 64)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(2000, 16)).astype(np.float32).astype(float)
    hot = np.vstack([points, np.repeat(points[:1], 2000, 0)])
    tree = N.Tree.fit(points)
    tree.calibrate(hot, 10)
    d = ((points[:100, None] - points) ** 2).sum(2)
    d[np.arange(100), np.arange(100)] = np.inf
    leaf, hit = tree.leaf_of(points), 0
    for p, row in zip(points, d):
        hit += np.isin(leaf[np.argsort(row)[:10]], tree.visit(p, tree.visits)).sum()
    assert hit / 1000 >= 0.93


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, None]), (9, [1.0]), (200, []), (None, [1.0, 1.0]), (300, [float("inf"), 0.0])]
    rows += [(1000 + i, [1.0, 0.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = N.nearest_neighbours(df, "id % 100 = 0", k=4).collect()
    by = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert by[0] == [(1, 3, 0.0), (2, 100, 0.0), (3, 1001, 0.0), (4, 1002, 0.0)] and by[100][:2] == [(1, 0, 0.0), (2, 3, 0.0)]
    assert {r["query_id"] for r in got} == {0, 100}
    few = N.nearest_neighbours(df.where("vec_id in (0, 4)"), "id = 0").collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(4, 5**0.5)]
    assert N.nearest_neighbours(df.limit(0), "true").count() == 0


def test_neighbours_repeated_rows_and_doubles(spark, monkeypatch):
    """Rows that repeat, an identifier that hides others behind many copies, and distances that floats can't tell apart."""
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.0]), (3, [0.5 + 1e-9, 0.0])]
    rows += [(50, [3.0, 4.0])] * 15 + [(60 + i, [3.0, 4.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = N.nearest_neighbours(df, "id in (0, 50)", k=4).toPandas().sort_values(["query_id", "rank"])
    by = {q: list(zip(g["vec_id"], g["score"])) for q, g in got.groupby("query_id")}
    assert by[0] == [(3, 1.0 - (0.5 + 1e-9)), (2, 0.5), (1, 2**0.5), (50, 20**0.5)]
    assert by[50] == [(60, 0.0), (61, 0.0), (62, 0.0), (63, 0.0)]
    # an identifier with many vectors near the query is one candidate, and others further off are found all the same
    monkeypatch.setattr(N, "LEAF", 8)
    rng = np.random.default_rng(4)
    rows = [(0, [10.0, 10.0])] + [(7, (10 + rng.normal(size=2)).tolist()) for _ in range(60)] + [(100 + i, rng.normal(size=2).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in N.nearest_neighbours(df, "id = 0", k=5).orderBy("rank").collect()]
    far = sorted(((x - 10) ** 2 + (y - 10) ** 2, i) for i, (x, y) in rows[61:])
    assert len(set(got)) == 5 and got[0] == 7 and got[1:] == [i for _, i in far[:4]]


# -- quotations and urls -------------------------------------------------------------------------------------------------------

TALK = [
    (1, 0, "user", "How do I sort?\nIn Python."), (1, 1, "assistant", "Use sorted().\nIt returns a list."), (1, 2, "user", "On Monday you wrote:\n> Use sorted().\nAnd in place?"),
    (1, 3, "assistant", "> And in place?\n> > use  SORTED().\nUse list.sort().\n\n\n\nDone."), (1, 4, "user", "> How do I sort?\nNever mind."), (2, 0, "user", "Use sorted()."), (2, 1, "user", "> Nobody said this\nHm."),
    (3, 0, None, None), (None, 1, "user", "> Use sorted()."), (1, 4, "user", "> How do I sort?\nNever mind."),
]


def talk(spark):
    return spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")


def test_replies_are_linked(spark, data):
    rows = Q.QUERIES["quotation_linking_replies"](spark, data)
    assert rows.where("parent_turn = turn - 1 and turn % 2 = 1").count() > 30 and rows.where("depth > 1").count() > 0


def test_quotations_are_native(spark, data):
    import re

    plan = Q.QUERIES["quotation_linking_replies"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_common_lines_and_long_turns(spark, monkeypatch):
    """A line that every message says and quotes, over several ranges of turns, some of 13 digits, some negative."""
    from veridiff.llm import quotations

    monkeypatch.setattr(quotations, "RANGE", 4)
    turns = [*range(-6, 30), 10**12 + 1, 10**13 + 5, 2**62]
    df = spark.createDataFrame([(1, t, "user", "> hello there\nhello there") for t in turns], "conv_id long, turn long, role string, text string")
    df = df.withColumn("h", F.lit(1)).withColumn("parent", F.lit("x")).withColumn("lines", F.lit(0))
    rows = {r["turn"]: r for r in link_quotations(df).collect()}
    assert [rows[t]["parent_turn"] for t in turns] == [None, *turns[:-1]]
    assert len({r["order_key"] for r in rows.values()}) == len(turns)
    assert [r["turn"] for r in sorted(rows.values(), key=lambda r: r["order_key"])] == turns


def test_quotations(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in link_quotations(talk(spark)).collect()}
    assert (rows[1, 2]["parent_turn"], rows[1, 2]["root_turn"], rows[1, 2]["depth"], rows[1, 2]["text"]) == (1, 1, 1, "And in place?")
    assert (rows[1, 3]["parent_turn"], rows[1, 3]["root_turn"], rows[1, 3]["depth"], rows[1, 3]["text"]) == (2, 1, 2, "Use list.sort().\n\nDone.")
    assert (rows[1, 4]["parent_turn"], rows[1, 4]["root_turn"]) == (0, 0) and rows[2, 1]["parent_turn"] is None and rows[3, 0]["text"] == ""
    order = sorted((r["order_key"], t) for (c, t), r in rows.items() if c == 1)
    assert [t for _, t in order] == [0, 4, 1, 2, 3]
    assert link_quotations(talk(spark)).count() == len(TALK) and link_quotations(talk(spark).limit(0)).count() == 0


def test_quotations_sql_with_quotes(spark):
    """The query's SQL on conversations that do quote."""
    import duckdb

    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", sorted(set(TALK), key=str))
    assert rows_of(link_quotations(talk(spark).distinct())) == rows_of_sql(c, Q.ORACLE_SQL["op5_quotation_linking"])


def test_long_reply_chain(spark):
    rows = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(60)]
    got = {r["turn"]: (r["root_turn"], r["depth"]) for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i) for i in range(60)}


def test_url_filters(spark):
    events = spark.createDataFrame(
        [("bad.example", "spam", "2024-01-05", "add"), ("bad.example", "spam", "2024-02-01", "remove"), ("bad.example", "spam", "2024-03-01", "add"), ("ok.example/ads", "ads", "2024-01-01", "add"), (None, "x", "2024-01-01", "add"), ("y", "x", None, "add"), ("z", "x", "2024-01-01", "other")],
        "key string, category string, day string, action string",
    ).withColumn("day", F.to_date("day"))
    assert sorted((r["key"], str(r["valid_from"]), str(r["valid_to"])) for r in intervals(events).collect()) == [("bad.example", "2024-01-05", "2024-02-01"), ("bad.example", "2024-03-01", "None"), ("ok.example/ads", "2024-01-01", "None")]
    urls = [("https://www.bad.example/x", "2024-01-04", False), ("https://www.bad.example/x", "2024-01-05", True), ("http://BAD.example:80", "2024-01-31", True), ("http://bad.example", "2024-02-01", False), ("http://bad.example", "2024-12-01", True), ("http://notbad.example", "2024-01-10", False)]
    urls += [("https://ok.example/ads/1?q", "2024-05-05", True), ("https://ok.example/adsx", "2024-05-05", False), (None, "2024-01-01", False), ("http://bad.example", None, False), ("no url", "2024-01-10", False), ("http://user@bad.example/", "2024-01-10", True)]
    df = spark.createDataFrame(urls + urls[:1], "url string, fetched string, want boolean").withColumn("fetched", F.to_date("fetched"))
    got = judge(df, events)
    assert got.count() == len(urls) + 1 and got.where("blocked <> want").count() == 0
    assert judge(df.limit(0), events).count() == 0 and judge(df, events.limit(0)).where("blocked").count() == 0


# -- pipeline ------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    """Each stage on its own input: copies and near copies go by brute force, toxic rows by the model, the rest stays."""
    import corpus_pipeline as C
    from tests.llm.test_dedup_join import brute
    from veridiff.llm.common import settle

    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "packing"] and C.ORACLE_SQL is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a = settle(C.toxicity(spark, docs, data), "t")
    score = Q.QUERIES["op10_toxicity"](spark, data)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in score.where("predicted = 0").collect()}
    b = settle(C.exact_dedup(spark, a, data), "d")
    best = {}
    for r in a.collect():
        k = "".join(c for c in r["text"] if c not in " \t\n\x0b\x0c\r")
        best[k] = min(best.get(k, (1, 1 << 62)), (-len(r["text"]), r["doc_id"]))
    assert b.columns == docs.columns and sorted(r["doc_id"] for r in b.collect()) == sorted(i for _, i in best.values())
    c = settle(C.ngram_jaccard_join(spark, b, data), "j")
    want = brute([(r["doc_id"], r["text"]) for r in b.collect()])
    assert c.columns == docs.columns and sorted(r["doc_id"] for r in c.collect()) == sorted({root for _, root in want.values()})
    d = C.packing(spark, c, data)
    assert {r["doc_id"] for r in d.collect()} == {r["doc_id"] for r in c.collect()}
    assert {r["doc_id"] for r in C.run(spark, data).collect()} == {r["doc_id"] for r in c.collect()}


def test_pipeline_odd_rows(spark, data):
    """Null texts and ids, empty texts, repeated rows, ties and clashing columns through every stage; and no rows at all."""
    import corpus_pipeline as C

    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (1, None), (2, ""), (None, "alone here"), (None, "alone here"), (3, text), (3, text), (4, text + " "), (5, text + " more"), (6, "other words entirely in this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "node", "digest", "sequence_id", "_id", "text_sha256", "component_id", "n", "predicted"):
        docs = docs.withColumn(name, F.lit(name))
    a = C.toxicity(spark, docs, data)
    assert a.columns == docs.columns and a.count() == len(rows)
    b = C.exact_dedup(spark, a, data)
    assert b.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in b.collect())) == [(0, "alone here"), (1, ""), (4, text + " "), (5, text + " more"), (6, "other words entirely in this one")]
    c = C.ngram_jaccard_join(spark, b, data)
    assert c.columns == docs.columns and sorted((r["doc_id"] or 0) for r in c.collect()) == [0, 1, 4, 6]
    d = C.packing(spark, c, data).collect()
    assert sorted((r["doc_id"] or 0) for r in d) == [0, 1, 4, 6] and len({r["sequence_id"] for r in d}) == 1
    none = docs.limit(0)
    for _, stage in C.STAGES[:3]:
        none = stage(spark, none, data)
        assert none.columns == docs.columns and none.count() == 0
    assert C.packing(spark, none, data).count() == 0


def test_linked_blocks():
    page = "<main><h1><a href=x>A linked title</a></h1><p>The text of the article is here and it has a few of the usual words in it.</p><p><a href=y>See the source</a></p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></main>"
    assert H.main_text(page) == "A linked title The text of the article is here and it has a few of the usual words in it. See the source"


def test_columns_named_like_results(spark):
    """Captures whose columns clash with results and working names keep the others; nulls and repeats stay."""
    pages = spark.createDataFrame([("http://a.b.c/x", 5, 1, "q", "r", True), (None, 5, 2, "q", "r", True), ("http://a.b.c/x", 5, 1, "q", "r", True)], "url string, fetched int, _url int, _at string, Categories string, n_entries boolean").withColumn("key", F.lit("k"))
    events = spark.createDataFrame([("b.c", "x", 1, "add")], "key string, category string, day int, action string")
    out = judge(pages, events)
    assert out.columns == ["url", "fetched", "_url", "_at", "key", "blocked", "n_entries", "categories"]
    assert sorted(map(str, ((r["_url"], r["_at"], r["blocked"], r["n_entries"], r["categories"]) for r in out.collect()))) == ["(1, 'q', True, 1, ['x'])"] * 2 + ["(2, 'q', False, 0, [])"]
    assert judge(pages.limit(0), events).count() == 0


def test_driver_returns_native_memory(spark):
    """The driver's JVM takes the command (Java 17.0.9 on, glibc); a JVM that does not is left alone."""
    from types import SimpleNamespace

    from veridiff.llm.common import release, trim_jvm

    assert trim_jvm(spark)
    release(spark)

    def none(name):
        raise RuntimeError(name)

    lang = SimpleNamespace(Class=SimpleNamespace(forName=none), Object=None)
    assert not trim_jvm(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)), _gateway=SimpleNamespace(new_array=lambda kind, n: [None] * n))))
