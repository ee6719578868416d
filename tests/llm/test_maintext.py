"""Page text: blocks, the minimum cut, and whole pages."""

import itertools
import random

from hostlens.llm import maintext as mt

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><a href=x>Home</a></header>
<div class="cookie-notice">We use cookies. Accept them all please.</div><div id="main-content"><h2>Real &eacute;title</h2>
<p>This is a long   paragraph of text, with several sentences.<br>It goes on and on, and ends here.</p><p>Short.
<p>Another <b>long</b> paragraph of text, with commas, and more. The end.</p><ul><li>Item one of the list, which is long enough.</ul>
<script>var p = "<p>no</p>";</script><div class="comments"><p>First! I liked this article very much, thanks for it.</p></div></div>
<div class="sidebar"><a href=q>Link one</a></div><form>Name <input> Send</form><footer>Copyright &copy; 2020 X.</footer></body></html>"""


def test_whole_page():
    assert mt.main_text(PAGE, mt.START).split("\n") == [
        "Real étitle", "This is a long paragraph of text, with several sentences. It goes on and on, and ends here.", "Short.",
        "Another long paragraph of text, with commas, and more. The end.", "Item one of the list, which is long enough.",
    ]


def test_article_without_its_side_matter():
    page = ('<nav><a href="/a">a</a></nav><article><h1>Head</h1><p>One &amp; two</p><div class="ad">Buy now, it is cheap.</div>'
            '<aside>Aside</aside><p>Tail</p><section id="comments"><p>I think that is right.</p></section></article><footer>f</footer>')
    assert mt.main_text(page, mt.START) == "Head\nOne & two\nTail"


def test_malformed_and_edge_pages():
    assert mt.main_text("", mt.START) == ""
    for page in ("<", "<<<>>>", "<p", "<!-- open", "</p></div>", "<script>x", "<p title='a>b\">t", "<a" * 2000, "<b>" * 5000 + "x", "&#xZZ; &bogus; &"):
        mt.main_text(page, mt.START)
    assert [b.text for b in mt.blocks('<p>a &lt; b <b>x</b>y</p>tail <p>q <a href="x>y">l</a>')] == ["a < b xy", "tail", "q l"]
    long = "<article>" + "<p>some words, and more of them.</p>" * 3000 + "</article>"
    assert mt.main_text(long, mt.START).count("\n") == 2999


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 7)
        odds = [r.uniform(-3, 3) for _ in range(n)]
        pairs = {p: r.uniform(0, 2) for p in itertools.combinations(range(n), 2) if r.random() < 0.6}
        net = mt.FlowNetwork(n + 2)
        for i, z in enumerate(odds):
            net.add(n, i, max(z, 0.0), 0.0)
            net.add(i, n + 1, max(-z, 0.0), 0.0)
        for (a, b), w in pairs.items():
            net.add(a, b, w, w)

        def cost(keep):
            return sum(max(z, 0) if not k else max(-z, 0) for z, k in zip(odds, keep)) + sum(
                w for (a, b), w in pairs.items() if keep[a] != keep[b]
            )

        got = net.source_side(n, n + 1)[:n]
        assert abs(cost(got) - min(map(cost, itertools.product((False, True), repeat=n)))) < 1e-6


def test_smoothness_keeps_a_short_block():
    page = "<div><p>" + "</p><p>".join(["A long paragraph, with commas, of many words in a row. It ends."] * 3 + ["Ok"] + ["One more long paragraph, with commas. It ends too."] * 3) + "</p></div>"
    assert "Ok" in mt.main_text(page, mt.START).split("\n")


def test_spark_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (4, "w", "<article><p>Text of it.</p></article><nav>Menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    weights = mt.fit(pages)
    assert len(weights) == len(mt.START)
    got = sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in mt.extract(pages, weights).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[0] == got[1] and got[2][1] == 0 and all(a == b for _, a, b in got)
    assert mt.extract(pages.limit(0), mt.fit(pages.limit(0))).count() == 0
