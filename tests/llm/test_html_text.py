import html
import re

import pyarrow.parquet as pq
import pytest

from gleaner.llm import html_text
from gleaner.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p><b>One   two<br>three<p>Four&nbsp;<i>fi</i>ve &lt;six&gt; &#233;</p><!-- <p>gone</p> -->
<aside>Side</aside><form><p>Search</p></form><div class='ad big'>Buy</div><ul><li>a point</ul>
<section id="comments"><p>First!</p></section></article>
<div class="sidebar"><p>More</p></div><footer>&copy; me</footer>"""


def test_a_page():
    assert main_text(PAGE) == "Head & line\nOne two three\nFour five <six> é\na point"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("<article>x", "x"), ("<nav><article><p>y</nav>z", "y"), ("<article>a < b &am &amp c</article>", "a < b &am & c"), ('<article><a href="x>text</a> more</article>', "text more"), ("<script>never closed <article>x", ""), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_odd_pages(page, text):
    assert main_text(page) == text


GOOD = "the man of the house is in the garden and it was for the best that he was on the way to the sea " * 3


def test_without_article_blocks_are_judged():
    page = f"<div><a href=x>one</a> <a href=y>two</a></div><h2>Title</h2><p>{GOOD}</p><p>short one</p><p>{GOOD}</p><p><a href=z>all of it a link</a></p><p>© 2020</p>"
    assert main_text(page) == "\n".join(["Title", GOOD.strip(), "short one", GOOD.strip()])


def test_neighbours_decide():
    assert html_text.second_pass([None, True, None, None, None, False, None]) == [True, True, True, True, False, False, False]
    assert html_text.second_pass([None, None]) == [False, False]
    assert html_text.second_pass([]) == []


def test_given_pages():
    """The articles of the given pages, cut out by their known frame."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert main_text(page) == "\n".join(x for x in lines if x)


def test_rows(frame):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "<article>" + "word " * 100000, "t")]
    made = html_text.extract(frame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in made) == sorted([("1", len(main_text(PAGE)))] * 2 + [("None", 0), ("2", 499999)])
    assert all(len(r.text) == r.n_chars for r in made)
    assert html_text.extract(frame(rows, "page_id long, url string, html string, text string").limit(0)).collect() == []


def test_a_body_outside_of_a_teaser_article():
    page = f"<div><h2>Title</h2><p>{GOOD}</p><p>short one</p><p>{GOOD}</p></div><div class=x><article><p>teaser</p></article></div><div><a href=x>one</a></div>"
    assert main_text(page) == "\n".join(["Title", GOOD.strip(), "short one", GOOD.strip(), "teaser"])


def test_links_between_good_blocks_stay():
    refs = "<ul><li><a href=a>first reference</a></li><li><a href=b>second reference</a></li></ul>"
    kept = ["first reference", "second reference"]
    assert main_text(f"<article><p>{GOOD}</p>{refs}<p>end</p></article>") == "\n".join([GOOD.strip(), *kept, "end"])
    assert main_text(f"<article><p>{GOOD}</p>{refs}</article><p>x</p>") == "\n".join([GOOD.strip(), *kept])
    assert main_text(f"<p>{GOOD}</p>{refs}<p>{GOOD}</p>") == "\n".join([GOOD.strip(), *kept, GOOD.strip()])
    assert main_text(f"{refs}<p>{GOOD}</p>{refs}") == GOOD.strip()


NAMES = "Zofia Kowalska, Jan Nowak, Piotr Wisniewski, Anna Lewandowska, Tomasz Kaminski, Ewa Zielinska, Marek Szymanski"


def test_long_blocks_of_few_stop_words_stay():
    assert main_text(f"<p>{GOOD}</p><p>{NAMES}</p><p>{GOOD}</p>") == "\n".join([GOOD.strip(), NAMES, GOOD.strip()])
    assert main_text(f"<div><a href=x>menu</a></div><p>{NAMES} {NAMES}</p><p>{NAMES}</p>") == f"{NAMES} {NAMES}\n{NAMES}"
    assert main_text(f"<p>{NAMES}</p>") == NAMES
    assert main_text(f"<p>{GOOD} © 2020 somebody</p>") == f"{GOOD}© 2020 somebody".replace("  ", " ")


@pytest.mark.parametrize("page", ['<body class="has-sidebar"><p>%s</p>', '<html class="sidebar"><body id=comments><p>%s</p>', '<article class="post with-comments">%s</article>', '<main class="no-header">%s</main>', '<div class="layout-sidebar"><p>%s</p></div>'])
def test_classes_of_a_layout_hide_nothing(page):
    assert main_text(page % GOOD) == GOOD.strip()
    assert main_text(f'<article hidden>{GOOD}</article><div class="left-sidebar"><p>{GOOD}</p></div>') == ""
