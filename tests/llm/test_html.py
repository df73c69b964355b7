import random
from itertools import product

from tidemark.llm.html import main_blocks, main_text
from tidemark.llm.mincut import labels

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><!-- <p>not this</p> -->
<div class="ad">Buy this now, it is very cheap and good.</div><div id=cookieNotice>We use cookies here.</div>
<article><header><h1>The  title</h1></header><p><b>First &amp; foremost,<br>a line.<p>Second&nbsp;paragraph &lt;here&gt;, with <a href=x>a link</a> in it.</p>
<aside>Read more of this kind elsewhere on this site.</aside><blockquote>A quote.</blockquote><p title="a > b">Last words of it.</article>
<section id="comments"><p>What a fine article this is, I have to say.</p></section><form>Search the site <input></form><footer>&copy; nobody</footer>"""


def test_article_and_nothing_else():
    assert main_blocks(PAGE) == ["The title", "First & foremost, a line.", "Second paragraph <here>, with a link in it.", "A quote.", "Last words of it."]


def test_pages_without_article_tags():
    soup = '<div class="page-header">Big site</div><div class="post-body"><h2>Title</h2><div>A story with enough words to be the text of the page.</div></div><div class=sidebar>Other things to read today.</div>'
    assert main_blocks(soup) == ["Title", "A story with enough words to be the text of the page."]


def test_linked_blocks_inside_the_article_stay():
    nav = "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>"
    long = "A paragraph of plain words that is long enough to be told as the text of the page by itself. " * 3
    title, linked, items = "A title of some thirty letters", "Twenty letters linked", ["First reference of it", "Second one", "A third"]
    refs = "".join(f"<li><a href=r>{x}</a></li>" for x in items)
    for tag in ("article", "main"):
        page = f"{nav}<{tag}><h1><a href=/p>{title}</a></h1><p>{long}</p><p><a href=q>{linked}</a></p><p>{long}</p><ol>{refs}</ol></{tag}><footer><a href=z>Imprint</a></footer>"
        assert main_blocks(page) == [title, long.strip(), linked, long.strip(), *items]
    assert main_blocks(f"{nav}<article><nav><a href=n>Next one</a></nav><h1><a href=/p>{title}</a></h1><p>{long}</p></article>") == [title, long.strip()]


def test_formulas_are_text():
    page = "<article><p>Energy is <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='application/x-tex'>E=m</annotation></semantics></math> here.</p><math><mtr><mtd>1</mtd><mtd>2</mtd></mtr></math></article>"
    assert main_blocks(page) == ["Energy is E=m here.", "1 2"]


def test_broken_pages_do_not_fail():
    for page in (None, "", "<", "<!--", "<script>", "</p></div>", '<a title="x', "<p" * 500, "<div>" * 3000 + "deep", "&#xZZ; &bogus; &#0;", "<table><tr><td>a<td>b</table>"):
        assert isinstance(main_blocks(page), list)


def test_rows_stay_as_they_are(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "", "x")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows] and [bool(r.text) for r in got] == [True, True, False, False]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        gain = [round(rng.uniform(-3, 3), 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), round(rng.uniform(0, 2.5), 3)) for _ in range(rng.randrange(14))]

        def cost(label):
            return sum(abs(g) for g, x in zip(gain, label) if x != (g > 0)) + sum(w for a, b, w in edges if label[a] != label[b])

        assert abs(cost(labels(gain, edges)) - min(map(cost, product([False, True], repeat=n)))) < 1e-9


LONG = "A sentence of the article that is long enough to be told from a menu, with commas and a full stop at its end."


def page(inside, attributes=""):
    return f"<html><body><nav><a href=/>Home</a><a href=/x>More</a></nav><article{attributes}><p>{LONG}</p>{inside}<p>{LONG}</p></article><footer>All rights reserved</footer></body></html>"


def test_names_on_the_article_do_not_outweigh_it():
    for attributes in (' class="post category-privacy tag-search"', ' class="post-content privacy"', ' id="content" class="tag-cookies"'):
        assert main_blocks(page("", attributes)) == [LONG, LONG]
    # comments are articles of their own, and stay out
    assert main_blocks(page('<article class="comment"><p>I do not agree with a word of this, and say so here.</p></article>')) == [LONG, LONG]
    assert main_blocks(page("<address>Written by A. Author, 12 Some Street, who can be reached there on most days.</address>"))[1].startswith("Written by")


def test_elements_that_are_not_closed_end_with_their_block():
    for inside in ('<p>One <svg class="x" viewBox="0 0 1 1"/> two.</p>', "<p>One <button>press</p><p>two.</p>", "<div><select><option>a</div><p>One two.</p>"):
        found = main_blocks(page(inside))
        assert found[0] == LONG and found[-1] == LONG and "two." in " ".join(found), inside
        assert "press" not in " ".join(found)
    twice = "<p>One <button>first</p><p>between the two.</p><p><button>second</button> after.</p>"
    assert "after." in " ".join(main_blocks(page(twice))) and "second" not in " ".join(main_blocks(page(twice)))
    assert main_blocks(page("<svg><svg><text>no</text></svg><text>no</text></svg>")) == [LONG, LONG]
