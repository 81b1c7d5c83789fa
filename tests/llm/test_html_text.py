import html as entities
import itertools
import os
import re
import time

import numpy as np
import pytest

from slidegrid.llm import html_text
from slidegrid.llm.common import table
from slidegrid.llm.dom import Page

SMALL = "/root/testdata/sf0.001"


def article(page):
    """Text of the article element by plain pattern matching, for pages of the test tables."""
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = re.split(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", body)
    return "\n".join(t for b in blocks if (t := " ".join(entities.unescape(re.sub(r"<[^>]*>", " " , b)).split())))


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.train(table(spark, SMALL, "pages"))


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the test tables")
def test_extracts_articles(spark, trees):
    pages = table(spark, SMALL, "pages")
    got = {r["page_id"]: r for r in html_text.extract(pages, trees=trees).collect()}
    truth = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    right = sum(got[k]["text"] == t for k, t in truth.items())
    assert right >= 0.98 * len(truth) and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts_and_odd_rows(spark, trees):
    text = "The river rose in spring, and the lower fields stood under water for weeks. "
    page = f"<html><head><title>T</title></head><body><div class='menu'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></div><article><h1>Head &amp; line</h1><p>{text}<b>bold</b>\n word<p>{text * 3}</p><form><input><button>Go</button></form></article><section class='comments'><h2>Comments</h2><div class='comment'><p>{text}</p></div></section><footer>&copy; all</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (None, "x", page), (4, "y", "</p></div><"), (5, "z", "<div>" * 3000 + "deep" + "</div>" * 10), (6, "s", "<script>if (a</b>) '</p>'</script><style>p{}</style>")]
    out = html_text.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"), trees=trees).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r["text"] for r in out}
    assert by[1] == f"Head & line\n{text}bold word\n{(text * 3).strip()}" == by[None]
    assert by[2] == by[3] == by[6] == "" and out[0]["n_chars"] == len(by[1])


def test_decoding_has_no_contradictions():
    page = Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    for seed in range(20):
        keep = page.decode(np.random.default_rng(seed).random(len(page.nodes)))
        assert all(keep[x.parent] or not keep[k] for k, x in enumerate(page.nodes) if k)


def test_tables_hidden_words_and_names_that_mention_boilerplate(spark, trees):
    text = "The river rose in spring, and the lower fields stood under water for weeks. "
    rows = [
        (1, f"<body><nav><a href='/'>Home</a></nav><article><h1>Law</h1><p>{text}</p><section class='comments-on-law'><h2>Notes</h2><p>{text * 2}</p></section></article><footer>Rights</footer>"),
        (2, f"<body><main><h1>Yield</h1><p>{text}<span hidden>secret <span>more</span> words</span>seen <i style='display: none'>gone</i>too</p><table><tr><td>{text}</td><td>{text}</td></tr></table><p>{text}</p></main>"),
        (3, f"<body><article><h1>Open</h1><div/><p>{text}</p><p>{text}</p></article>"),
    ]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string"), trees=trees).collect()}
    t = text.strip()
    assert got[1] == f"Law\n{t}\nNotes\n{t} {t}"
    assert got[2] == f"Yield\n{t} seen too\n{t}\n{t}\n{t}"
    assert got[3] == f"Open\n{t}\n{t}"


def test_deep_and_stray_tags_take_linear_time():
    n = 100_000
    for html in ("<x-y>" * n + "a", "<div>" * (n // 2) + "</p>" * n + "a", "<ul><li>" * (n // 2) + "a", "<p>a" * n, "<b hidden>" * n + "</b>" * n + "a"):
        start = time.perf_counter()
        page = Page(html)
        assert page.segments[-1][1] == "a"
        assert time.perf_counter() - start < 15


def test_implied_ends():
    tags = lambda html: [(x.tag, page.nodes[x.parent].tag) for page in [Page(html)] for x in page.nodes[1:]]
    assert tags("<p>a<p>b<div>c<p>d</div>e") == [("p", "#root"), ("p", "#root"), ("div", "#root"), ("p", "div")]
    assert tags("<ul><li>a<ul><li>b</ul><li>c") == [("ul", "#root"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]
    assert tags("<table><tr><td>a<td>b<tr><td>c") == [("table", "#root"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert tags("<svg><path/><g/></svg><div/><p>") == [("svg", "#root"), ("path", "svg"), ("g", "svg"), ("div", "#root"), ("p", "div")]


def test_decoding_equals_the_best_of_all_labellings():
    rng = np.random.default_rng(6)
    for _ in range(40):
        page = Page("".join(rng.choice(["<div>", "<section>", "</div>", "</section>", "<p>a</p>"], 9)))
        n = len(page.nodes)
        p = rng.uniform(0.05, 0.95, n)
        cost = lambda keep: sum(np.log(p[k] if on else 1 - p[k]) for k, on in enumerate(keep))  # noqa: B023, E731
        allowed = [keep for keep in itertools.product([False, True], repeat=n) if all(keep[x.parent] or not keep[k] for k, x in enumerate(page.nodes) if k)]
        assert abs(cost(page.decode(p)) - max(map(cost, allowed))) < 1e-9


def test_empty(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
