"""Leaf blocks of odd markup, the field on pages and layouts held out, and the query on the supplied pages."""

import itertools

import numpy as np
import pytest

from cardamom.llm import blocks, extract, queries
from cardamom.llm.labelled import ARTICLES, labelled_pages


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("", []),
        ("plain &amp; simple\n text", ["plain & simple text"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<p><b>bold<br><p>next</p>", ["bold", "next"]),
        ("<ul><li>1<li>2<ul><li>2a</ul><li>3</ul>", ["1", "2", "2a", "3"]),
        ("<table><tr><td>x<td>y<tr><td>z</table>", ["x", "y", "z"]),
        ("<div>a<span>b</span>c<i>d</div>e", ["abcd", "e"]),
        ('<script>var t="</p>";</script>a<style>b</style><!-- <p>c</p> -->d', ["ad"]),
        ("a<!-->b<!-- open <p>c", ["ab"]),
        ("<title>t</title><textarea><p>x</textarea>y", ["y"]),
        ("1 < 2 <3 &lt;b&gt; &#233;&nbsp;&copy &am", ["1 < 2 <3 <b> é ©&am".replace("©&am", "© &am")]),
        ('<a title="x > y" href=/q>link</a> <img alt=">">t', ["link t"]),
        ("<p title=\"open>text</p><p>more", ["text", "more"]),
        ("text<a href='cut", ["text"]),
        ("</div></p></b>x</html>y", ["x", "y"]),
        ("<b><p>one</b> two</p>three", ["one two", "three"]),
        ("<svg><text>no</text></svg><P>Yes</P>", ["Yes"]),
    ],
)
def test_blocks(source, texts):
    assert [b.text for b in blocks.page(source).blocks] == texts


def test_long_and_deep_pages_take_one_pass():
    assert len(blocks.page("<div>a" * 50_000 + "</span>" * 50_000).blocks) == 50_000
    assert blocks.page("<a" * 200_000 + "<!--" * 100_000).blocks == []
    assert len(blocks.page("<p>x" * 100_000).blocks) == 100_000
    assert len(blocks.page("<i>" * 30_000 + "x" + "</b>" * 30_000).blocks) == 1


def test_links_and_sections_are_measured():
    page = blocks.page('<nav><a href="/">four</a> x</nav><article><p>sixteen letters.</article>')
    nav, text = page.blocks
    assert (nav.linked, text.linked) == (4, 0) and page.sizes[text.section] == 16 and "in:article" in text.path.has


def test_viterbi_finds_the_best_of_all_labellings():
    rng = np.random.Generator(np.random.PCG64(4))
    for source, _ in labelled_pages(40, 3):
        page = blocks.page(source)
        page.blocks = page.blocks[:9]
        names = {f for b, t in zip(page.blocks, extract.text_features(page), strict=True) for f in (*extract.path_features(b.path), *t)}
        weights = {f: float(rng.normal()) for f in sorted(names)}
        step = tuple(tuple(float(x) for x in rng.normal(size=2)) for _ in "ab")
        score = [sum(weights[f] for f in (*extract.path_features(b.path), *t)) for b, t in zip(page.blocks, extract.text_features(page), strict=True)]
        value = lambda y: sum(s for s, k in zip(score, y, strict=True) if k) + sum(step[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(score)), key=value)
        assert value(extract.Field(weights, step).decode(page)) == pytest.approx(value(best))


def f1(model, pages):
    hits = wrong = missed = 0
    for source, main in pages:
        page = blocks.page(source)
        for want, got in zip(extract.labels_of(page, main), model.decode(page), strict=True):
            hits, wrong, missed = hits + (want and got), wrong + (got and not want), missed + (want and not got)
    return 2 * hits / (2 * hits + wrong + missed)


def test_pages_held_out():
    assert f1(extract.trained(), labelled_pages(300, 99)) > 0.985


@pytest.mark.parametrize("out", [("div", "table"), ("entry", "section"), ("article", "main")])
def test_layouts_held_out(out):
    rest = tuple(a[-1] for a in ARTICLES if a[-1] not in out)
    assert f1(extract.train(labelled_pages(400, 5, rest)), labelled_pages(200, 98, out)) > 0.96


def test_training_is_repeatable():
    pages = labelled_pages(60, 1)
    assert extract.train(pages, steps=20) == extract.train(pages, steps=20)


def test_query_on_odd_rows(spark, tmp_path):
    article = "<html><body><nav><ul><li><a href=/x>Home</a></ul></nav><article><h1>Kopf</h1><p>Erster &amp; letzter\n\nAbsatz, der etwas länger ist.<p>Wort.</article><footer>&copy; 2020 x</footer>"
    rows = [(1, "u", article, "m", "t"), (1, "u", article, "m", "t"), (None, None, article, None, None), (2, "v", None, None, None), (3, "", "", "", ""), (4, "w", "<p></p><script>x</script>", "", "")]
    rows.append((5, "long", "<article>" + "<p>Ein Satz, der hier oft steht.</p>" * 20_000 + "</article>", "", ""))
    spark.createDataFrame(rows, "page_id long, url string, html string, _html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in queries.op13_html(spark, str(tmp_path)).collect()}
    text = "Kopf\n\nErster & letzter Absatz, der etwas länger ist.\n\nWort."
    assert got[1, "u"] == got[None, None] == (text, len(text))
    assert got[2, "v"] == got[3, ""] == got[4, "w"] == ("", 0)
    assert got[5, "long"][0].count("\n\n") == 19_999
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op13_html(spark, f"{tmp_path}/none").collect() == []
