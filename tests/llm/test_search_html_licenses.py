import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from rasterloom.llm import ann, html, licenses
from rasterloom.llm.queries import ORACLES


def brute_nearest(vectors, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in vectors if i != q)
        out[q] = [i for _, i in d[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_factor_one_is_exact_and_the_relaxed_search_has_recall(vectors):
    queries = vectors.where("vec_id % 20 = 0")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert answers(ann.nearest_neighbours(vectors, queries, 10, factor=1.0)) == want
    got = answers(ann.nearest_neighbours(vectors, queries, 10))
    assert np.mean([len(set(got[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_trees_are_exact_at_factor_one_with_ties_and_copies():
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(3, 6)), 300, axis=0), rng.normal(size=(900, 6)), rng.integers(0, 2, (600, 6)).astype(float)])
    ids = rng.permutation(len(x))
    asked = np.arange(0, len(x), 37)
    best = ann.Best(x[asked], ids[asked], 10, np.full(len(asked), np.inf))
    ann.search_shard(x, ids, best, 1.0)
    for row, q in enumerate(asked):
        d = ann.distances(x[q : q + 1], x)[0]
        d[q] = np.inf
        assert best.id[row].tolist() == ids[np.lexsort((ids, d))[:10]].tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [2.0, 1.0, 1.0]), (None, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = answers(ann.nearest_neighbours(table, table.where("vec_id in (0, 2, 4, 9)"), 3))
    assert got == {0: [6, 7, 8], 9: [10]}
    # another row of the query's id is a candidate, and so is a twin of its own row
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (5, [1.0, 0.5])], "vec_id long, embedding array<float>")
    found = ann.nearest_neighbours(twins, twins.where("vec_id = 0 and embedding[0] = 0"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [5, 0, 0]
    both = ann.nearest_neighbours(twins, twins.where("vec_id = 0 and embedding[0] = 1"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in both] == [0, 0, 5, 5, 0, 0] and [r.score for r in both][:2] == [0.0, 0.0]
    empty = table.where("vec_id = 99")
    assert ann.nearest_neighbours(empty, empty).count() == 0 and ann.nearest_neighbours(table, empty).count() == 0


PAGES = {
    "<p>a<span class=ad>x</span>b<p>c": "ab c",
    "<article><header><h1>T</h1></header><p>x <b>y</b>z&amp;&nbsp;w<div class='comments'><p>no</div></article><footer>f": "T x yz& w",
    "no tags &lt; here": "no tags < here",
    "<div><p>a<div>b</p>c</div>": "a b c",
    "<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>": "1 2 a b c",
    "<script>var t='</p>';</script>x<style>p{}</style> y": "x y",
    "<title>t</title><nav><ul><li>n</nav>main<form><p>f</form><aside>s</aside><div id=cookie-banner>k</div>": "main",
    "<body class='has-sidebar'><article class='no-comments'>t</article><div>o": "t",
    "<!-- c --><p hidden>h</p><div role=navigation>n</div>a<br>b<img src=x>c": "a bc",
    "a < b <3 c": "a < b <3 c", "": "", "<": "<", "<p": "", "<script>": "", "</div>x</p>": "x",
}


@pytest.mark.parametrize("markup", PAGES)
def test_single_pages(markup):
    p = html.Page(markup)
    assert " ".join(html.main_blocks(p.parents, p.hashes, p.inside, p.blocks, p.owners, frozenset(), frozenset())) == PAGES[markup]


def shown(markup, outside=(), within=()):
    p = html.read_page(markup)
    return " ".join(html.main_blocks(p.parents, p.hashes, p.inside, p.blocks, p.owners, frozenset(outside), frozenset(within)))


def test_articles_count_only_with_most_of_the_text():
    assert shown("<main></main><div><p>text</p></div>") == "text"
    story = "<div><p>a long story that fills the page</p></div>"
    assert shown(f"{story}<article>card 1</article><article>card 2</article>") == "a long story that fills the page card 1 card 2"
    assert shown(f"<article>{story}</article><div>beside</div>") == "a long story that fills the page"
    p = html.Page("<article><p>template</p></article><div>own</div>")
    assert shown("<article><p>template</p></article><div>own</div>", (), [h for h, i in zip(p.hashes, p.inside) if i]) == "own"


@pytest.mark.parametrize("wrapper", ["div class='layout right-sidebar'", "div id='content-with-sidebar'", "section class='promo-article'", "div class=sidebar"])
def test_class_names_do_not_drop_the_story(wrapper):
    tag = wrapper.split()[0]
    assert shown(f"<{wrapper}><p>a long story of the page</p><div class='sidebar-left'>s</div></{tag}><p>end") == "a long story of the page end"
    assert shown(f"<{wrapper}><article>short</article></{tag}><p>more text beside it") in ("short", "short more text beside it")


READER = "<article><p>a reader with much to say about it, more than the story itself says</p></article>"


@pytest.mark.parametrize(
    "markup, want",
    [
        (f"<div id=comments>{READER}{READER}</div><article>story of the page</article>", "story of the page"),
        ("<div class='sidebar'><article class='teaser'>Other teaser story</article></div><article>Main story of it</article>", "Main story of it"),
        (f"<article><p>story of the page</p><section class='user-comments'>{READER}</section></article>", "story of the page"),
        (f"<article><h1>T</h1><p>story</p></article><div id='comments' class='comments-area'><h2>2 thoughts</h2><ol class='comment-list'><li>{READER}</li></ol><div id='respond'><form>x</form></div></div>", "T story"),
        ("<article><p>story of the page</p><article class='comment'><p>a reader</p></article></article>", "story of the page"),
        ("<main><p>story of the page</p></main><article class='comment even'><p>a reader</p></article>", "story of the page"),
        ("<p class=it's>Hello</p><p>don't stop</p><p>more</p>", "Hello don't stop more"),
        ('<div class="a" title="5" tall">First block</div><p class="b">Second</p>', "First block Second"),
        ("<p title='a > b' data-x=\"<p>\">one</p><p alt=a\"b>two</p><p x = 'y'>three", "one two three"),
        ("<form id=aspnetForm><input name=x><div><p>the text of the page</p><label>l</label><select><option>o</select></div></form>", "the text of the page"),
        ("<p>the text of the page, longer than the form</p><form><p>search</p><button>go</button></form>", "the text of the page, longer than the form"),
        ("<article>short story</article><form><p>a long form with many words that explain it</p></form>", "short story"),
    ],
)
def test_comments_cards_quotes_and_forms(markup, want):
    assert shown(markup) == want


def test_template_counts_equal_brute_force(spark, sf):
    """Subtrees, counted page by page in dictionaries, against the lists that Spark makes."""
    from collections import defaultdict

    base = spark.read.parquet(f"{sf}/pages.parquet")
    extra = [(10_000 + i, f"http://t{i % 3}.example.org/{i}", f"<div>Site {i % 3}</div><ul><li>home<li>news</ul><article><p>By us</p><p>own {i}</p></article>") for i in range(45)]
    rows = [*base.collect(), *spark.createDataFrame(extra, base.schema).collect(), *spark.createDataFrame(extra[:9], base.schema).collect()]
    on, pages = defaultdict(set), defaultdict(set)
    for r in rows:
        host, p = html.host_of(r.url), html.read_page(r.html or "")
        pages[host].add(p.key)
        for h in p.hashes:
            if h:
                on[host, h].add(p.key)
    want = defaultdict(lambda: (set(), set()))
    for (host, h), seen in on.items():
        if len(seen) >= 5 and len(pages[host]) >= 5 and 2 * len(seen) >= len(pages[host]):
            want[host][0].add(h)
            if 10 * len(seen) >= 9 * len(pages[host]) and len(pages[host]) >= 10:
                want[host][1].add(h)
    table = spark.createDataFrame(rows, base.schema)
    got = {r.host: (set(r.outside), set(r.inside_too)) for r in html.site_templates(html.parse_pages(table)).collect()}
    assert got == dict(want) and all(got[f"t{k}.example.org"][1] for k in range(3))
    texts = {r.page_id: r.text for r in html.extract_main_text(table).collect()}
    for i in range(45):
        assert texts[10_000 + i] == f"own {i}"


def test_class_names_in_articles():
    assert shown("<article><header class='entry-header'><h1>T</h1></header><p>text of it</p><div class='social-share'>s</div></article>") == "T text of it"
    assert shown("<p>text of the page</p><div class='comments-area'>c</div><div id='ad-slot-1'>x</div><div class='no-sidebar'>y</div>") == "text of the page y"


def test_deep_and_long_pages():
    p = html.Page("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>x" * 5000)
    assert len(p.blocks) == 5001


def test_site_templates_go_and_copies_stay(spark):
    pages = [(i, f"http://a.example.com/{i}", f"<div><p>Our site since 1999</p></div><div><p>story {i} of many</p></div><div>Mail us</div>") for i in range(12)]
    pages += [(100 + i, "http://b.example.com/x", "<div><p>one and the same page</p></div>") for i in range(30)]
    pages += [(200 + i, f"http://c.example.com/{i}", f"<article><p>shared passage</p><p>own {i}</p></article>") for i in range(6)]
    pages += [(300, None, "<p>no url</p>"), (301, "http://a.example.com/n", None), (302, "not a url", "<p>odd</p>"), (0, pages[0][1], pages[0][2])]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    rows = html.extract_main_text(table).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r.text for r in rows}
    assert all(got[i] == f"story {i} of many" for i in range(12))
    assert all(got[100 + i] == "one and the same page" for i in range(30))
    assert all(got[200 + i] == f"shared passage own {i}" for i in range(6))
    assert (got[300], got[301], got[302]) == ("no url", "", "odd")
    assert html.extract_main_text(table.limit(0)).count() == 0


def test_articles_of_the_table(spark, sf):
    import html as entities
    import re

    for r in html.extract_main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*(>|$)", "", inner)).split())


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def test_licences_equal_sql_on_hard_rows(spark, hard_docs, no_docs, tmp_path):
    extra = spark.createDataFrame(
        [(900, "A.\nAll rights reserved.", "en", "s", 1), (901, "RELEASED under\tthe MIT-license!! More text here. All rights reserved. x", "en", "s", 1), (902, "\n\n".join(t.replace(" ", "\n", 3) for _, t in licenses.TEMPLATES), "en", "s", 1)],
        hard_docs.schema,
    )
    docs = hard_docs.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = connect("/root/testdata/sf0.001")
    duck.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = licenses.scan_licenses(docs.withColumn("unit", F.lit("clash")).withColumn("license", F.lit(0)))
    assert compare(got.toPandas(), duck.execute(ORACLES["op7_licenses"]).df()) == ""
    assert {r.template for r in got.where("doc_id = 902").collect()} == set(range(len(licenses.TEMPLATES)))
    assert licenses.scan_licenses(no_docs).count() == 0


def test_anchors_cover_every_unit_that_can_reach_the_threshold():
    sets = [licenses.plain_bigrams(t) for _, t in licenses.TEMPLATES]
    anchors = set(licenses.anchor_words(sets, 0.8))
    for s in sets:
        free = [g for g in s if anchors.isdisjoint(g.split(" "))]
        # The best that a unit without anchors can do: all free bigrams and nothing else.
        assert not free or dice(set(free), s) < 0.8
