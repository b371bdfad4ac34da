import html
import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rosterloom.llm import html_extract, queries
from rosterloom.llm.html_extract import main_text, minimum_cut

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var a="<p>no</p>";</script></head><body class="home">
<header class="site-header"><a href="/">Home</a><a href="/x">Other</a></header><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav>
<div id="cookieNotice">We use cookies. <button>OK</button></div>
<div class="content"><h1>Big &amp; small &#233;</h1><p>First paragraph of the story with   some words,
and more.<p>Second <b>bold</b> text<br>line two.<div class="ad-slot">Buy now!</div><ul><li>one point</li><li>two points</li></ul>
<aside>Related stories that are long enough to be taken for the text of a page by their length.</aside>
<blockquote>quoted words of someone.</blockquote><p>Enough.</p></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think this is a very good article, thanks for it, and so on and on.</p></div></section>
<form><label>Mail</label><input value="x"><textarea>type</textarea></form><footer>&copy; 2020 someone</footer></body></html>"""
TEXT = (
    "Big & small é\nFirst paragraph of the story with some words, and more.\nSecond bold text line two.\none point\ntwo points\n"
    "quoted words of someone.\nEnough."
)


def test_main_text_of_a_page():
    assert main_text(PAGE) == TEXT


STORY = "<h1>A title of the page</h1>" + "".join(f"<p>Paragraph {i} of the story goes on for some words, and then it ends.</p>" for i in range(6))
STORY_TEXT = "A title of the page\n" + "\n".join(f"Paragraph {i} of the story goes on for some words, and then it ends." for i in range(6))
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul>'
REPLIES = '<div id="comments"><h2>Comments</h2>' + "".join(f'<div class="comment"><p>Reader {i} thinks so too, and has more to say.</p></div>' for i in range(3)) + "</div>"


def test_what_wraps_the_page_is_no_boilerplate():
    """Forms around the whole page, layout names, entries with a header, pages without an article."""
    foot = "<footer><p>Made by someone in some year.</p></footer>"
    for page in (
        f"<body><form id='aspnetForm'>{MENU}<article>{STORY}</article>{foot}</form></body>",
        f"<body><form>{MENU}<div>{STORY}</div>{foot}</form></body>",
        f"<body>{MENU}<div class='content-sidebar-wrap'><div class='entry'>{STORY}</div><div class='sidebar'><p>Some other words.</p></div></div>{foot}</body>",
        f"<body class='has-sidebar'>{MENU}<div class='page has-sidebar'><div>{STORY}</div></div>{REPLIES}{foot}</body>",
        f"<body>{MENU}<div class='entry-header'><h1>A title of the page</h1></div><div class='entry-content'>{STORY[len('<h1>A title of the page</h1>'):]}</div>{REPLIES}</body>",
        f"<body>{MENU}<main>{STORY}</main><div class='nav-container'><p>Where to go from here now.</p></div>{REPLIES}{foot}</body>",
        f"<body>{MENU}<div id='widget-area'><div>{STORY}</div></div></body>",
    ):
        assert main_text(page) == STORY_TEXT, page[:60]


def test_readers_words_are_no_content_however_many():
    page = f"<body><div>{STORY}</div>" + REPLIES * 12 + "</body>"
    assert main_text(page) == STORY_TEXT


def test_broken_markup():
    assert main_text("<article><p><b>one.<br><p>two &lt;tag&gt; &amp;amp;<p>three <a hre") == "one.\ntwo <tag> &amp;\nthree"
    assert main_text("</div></p></b>") == ""
    assert main_text("<article>" + "<div>" * 3000 + "<p>Deep words are found here.") == "Deep words are found here."
    long = "word " * 40000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_query_against_the_article_element(spark, sf_dir):
    """Pages of the test table hold their text in one article element of headings and paragraphs."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op7_html_extract(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        article = re.sub("<[^>]*$", "", article).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_defined_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, None, ""), (None, "v", PAGE), (None, "v", PAGE)], SCHEMA).selectExpr("*", "1 as text")
    rows = html_extract.extract(pages).collect()
    assert sorted(r["text"] for r in rows) == ["", "", TEXT, TEXT]
    assert html_extract.extract(pages.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_minimum_cut_costs_no_more_than_any_labelling(data):
    n = data.draw(st.integers(0, 7))
    scores = data.draw(st.lists(st.integers(-8, 8).map(lambda x: x / 2), min_size=n, max_size=n))
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    edges = [(a, b, data.draw(st.integers(1, 6)) / 2) for a, b in pairs if data.draw(st.booleans())]

    def cost(labels):
        own = sum(abs(s) for s, content in zip(scores, labels) if (s > 0) != content and s)
        return own + sum(w for a, b, w in edges if labels[a] != labels[b])

    best = min(cost(labels) for labels in itertools.product([False, True], repeat=n))
    assert abs(cost(minimum_cut(scores, edges)) - best) < 1e-9
