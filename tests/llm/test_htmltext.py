"""Main text of pages: hand-made pages and the articles of the test pages."""

from __future__ import annotations

import html as entities
import math
import re
import statistics
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import htmltext

LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. Ut enim ad minim veniam, quis nostrud exercitation ullamco. "


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"), ("<p>a  b\n c</p>", "a b c"),
    ("<body><nav><a href=/>menu</a></nav><article><h1>Title</h1><p>One&amp;two &eacute;&#x41;&nbsp;x.</p><p>Three<br>four</p></article><footer>foot</footer></body>", "Title One&two éA x. Three four"),
    ("<article><p>kept</p><aside>no</aside><div class='ad'>no</div><div class='reader-comments'>no</div><script>var x='<p>no</p>'</script><style>p{}</style><form><p>no</p></form></article>", "kept"),
    ("<article><p>a <b>bold</b><i>er</i> <!-- no --> word</p><p hidden>no</p><p style='display: none'>no</p></article>", "a bolder word"),
    ("<article><p>open<p>again<ul><li>x<li>y</ul></article>", "open again x y"),
    ("<article><p>cut off <b>in the", "cut off in the"), ("<main><p>a < b and c > d</p></main>", "a < b and c > d"),
    ("<div class='sidebar'><p>" + LOREM + "</p></div><main><p>short.</p></main>", "short."),
    ("<article><p>x</p></article><article><p>y</p></article>", "x y"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article><table><tr><td>a<td>b</table></article>", "a b"),
])
def test_pages(page, want):
    assert htmltext.main_text(page) == want


def test_paths_without_an_article_are_told_apart_by_their_ratios():
    body = "".join(f"<p>{LOREM * 3}{i}.</p>" for i in range(6))
    links = "".join(f"<li><a href='/{i}'>topic {i}</a></li>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><span>Imprint</span></div></body>"
    got = htmltext.main_text(page)
    assert got == " ".join(f"{LOREM * 3}{i}." for i in range(6))


PROSE = "".join(f"<p>{LOREM * 3}{i}.</p>" for i in range(6))
TEXT = " ".join(f"{LOREM * 3}{i}." for i in range(6))
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>topic {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(("page", "want"), [
    (f"<div><h1>Title</h1>{PROSE}</div>", f"Title {TEXT}"),
    (f"<div><h1>Title</h1><div>{PROSE}<p>Short.</p><ul><li>one</li><li>two</li></ul></div></div>", f"Title {TEXT} Short. one two"),
    (f"<h2>Title</h2>{PROSE}<div>Imprint, 2024.</div>", f"Title {TEXT}"),
    (f"<div><div>Buy it now.</div><div><div>{PROSE}</div></div><div>All rights kept.</div></div>", TEXT),
    (f"<article>{PROSE}{MENU}</article>", TEXT), (f"<div>{MENU}{PROSE}{MENU}</div>", TEXT),
    (f"<article>{PROSE}<p><a href=/>a paragraph that is all link</a></p></article>", f"{TEXT} a paragraph that is all link"),
    (f"<article><p>Teaser.</p></article><div><section>{PROSE * 4}</section></div>", " ".join([TEXT] * 4)),
    (f"<article><section>{PROSE}</section><section><p>End.</p></section></article>", f"{TEXT} End."),
])
def test_ratios_decide(page, want):
    assert htmltext.main_text(f"<html><body>{page}</body></html>") == want


def test_scores_are_those_of_the_definition():
    page = htmltext.Page(f"<body><div class='x'>{PROSE}<p>A <a href=/>link, here</a>.</p></div>{MENU}<main><p>One. Two!</p></main><div>end</div></body>")
    paths = [tuple(path_of(page, p)) for p, _, _ in page.blocks]
    assert ("body", "div.x", "p") in {tuple(x for x in path) for path in paths} and ("body", "ul", "li") in paths
    scores, raw, limit = htmltext.ratios(page)
    blocks = page.blocks

    def mean(path, of):
        own = [of(t, k) for (p, t, k) in blocks if p == path]
        return sum(own) / len(own) * (3.0 if "main" in path_of(page, path) else 1.0)

    length = [mean(p, lambda t, k: len(t) - k) for p, _, _ in blocks]
    marks = [mean(p, lambda t, k: len(re.findall("[.,;:!?]", t))) for p, _, _ in blocks]

    def smoothed(values, i):
        near = [(math.exp(-((j - i) ** 2) / 2), v) for j, v in enumerate(values) if abs(j - i) <= 2]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    fused = [smoothed(length, i) * (0.1 + smoothed(marks, i)) for i in range(len(blocks))]
    for path in {p for p, _, _ in blocks}:
        own = [f for f, (p, _, _) in zip(fused, blocks, strict=True) if p == path]
        i = next(i for i, b in enumerate(blocks) if b[0] == path)
        assert abs(scores[path] - sum(own) / len(own)) < 1e-6 and abs(raw[path] - length[i] * (0.1 + marks[i])) < 1e-6
    assert abs(limit - statistics.pstdev(fused) * htmltext.THRESHOLD) < 1e-6


def path_of(page, path):
    names = {v: k[1] for k, v in page._paths.items()}
    out = []
    while path:
        out.append(names[path])
        path = page.around[path]
    return out[::-1]


def test_deep_and_long_pages_end():
    assert htmltext.main_text("<div>" * 5000 + "deep." + "</div>" * 5000) == "deep."
    assert htmltext.main_text("<article>" + "<p>word.</p>" * 20_000 + "</article>") == " ".join(["word."] * 20_000)
    assert htmltext.main_text("<" * 20_000) is not None and htmltext.main_text('<a "' * 5000) is not None
    assert htmltext.main_text("<article><p>a</p><!-- never closed <p>b</p></article>") == "a"


@pytest.mark.parametrize("broken", [
    '<a b="', "<a ", '<a "> ', '<a ">" ', "<div>", "<script ", "<script></script x", "<!--", "<", "<!x", "<li>", "</a", "<p class= ", "<table><tr>", "<b><i>", "<p>", '<p title="x>',
])
def test_broken_pages_take_time_in_proportion(broken):
    start = time.process_time()
    for page in (broken * (1_000_000 // len(broken)), "<b><article>" + broken * 50_000 + "</p></b></i>" * 50_000 + ">"):
        htmltext.main_text(page)
    assert time.process_time() - start < 12  # a second or two; quadratic time would be minutes


def test_broken_tags_lose_no_text():
    assert htmltext.main_text('<p title="x>one.</p><p>two.</p>') == "one. two." and htmltext.main_text("<p>1 < 2. <3") == "1 < 2. <3"
    assert htmltext.main_text("<p>one.</p><p") == "one." and htmltext.main_text("<p>one <b and no more tags") == "one <b and no more tags"


def test_query_gives_the_articles(spark, large):
    rows = {r.page_id: r for r in htmltext.op9_htmltext(spark, large).collect()}
    pages = spark.read.parquet(f"{large}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p|br|div)[^>]*>", re.sub(r"</?[bi]>", "", article))
        want = " ".join(x for x in (" ".join(entities.unescape(part).split()) for part in parts) if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want) and rows[p.page_id].url == p.url


@pytest.mark.parametrize(("names", "least"), [(True, 1.0), (False, 0.8)])
def test_articles_without_telling_tags(large, monkeypatch, names, least):
    """Without ``article`` all pages come out the same; without telling class names as well the ratios find most."""
    pages = pd.read_parquet(f"{large}/pages.parquet")
    want = [htmltext.main_text(p) for p in pages["html"]]
    if not names:
        monkeypatch.setattr(htmltext, "_NAMED", re.compile("(?!)"))
    got = [htmltext.main_text(re.sub("<(/?)article>", r"<\1div>", p)) for p in pages["html"]]
    assert sum(map(str.__eq__, got, want)) >= least * len(want)


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>é😀</p>"), (1, "u", "<p>é😀</p>")], "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(0)})
    assert sorted(map(tuple, htmltext.extract(df).collect()), key=str) == sorted([(None, None, "", 0), (1, "u", "é😀", 2), (1, "u", "é😀", 2)], key=str)
    assert htmltext.extract(df.limit(0)).isEmpty()
