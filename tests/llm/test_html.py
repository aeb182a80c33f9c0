import html
import re

import pytest
from pyspark.sql import functions as F

from embertrail.llm.common import table
from embertrail.llm import html_text
from embertrail.llm.html_text import extract, main_text

ART = "<p>Some long paragraph, with text. And more &amp; more text in it, so that it counts.</p><p>Short.</p><p>Another paragraph with <a href=y>a link</a> in it, and more.</p>"
SAID = "Some long paragraph, with text. And more & more text in it, so that it counts.\nShort.\nAnother paragraph with a link in it, and more."


@pytest.mark.parametrize("page", [
    f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><main>{ART}</main><footer>&copy; us</footer></body></html>",
    f"<body><div class=top-menu><a>A</a><a>B</a></div><div id=content>{ART}</div><div class='sidebar'><p>Read this too, it is good.</p></div></body>",
    f"<body class='has-sidebar'><article><div class='ad'>Buy!</div>{ART}<form>Your mail <input></form><script>if (a < b) {{}}</script><style>p{{}}</style><aside>By us</aside></article></body>",
    f"<div class=cookie-notice>We use cookies, as all do, and you agree by reading on, do you not?</div><div class=post>{ART}</div><section id=comments><p>First! This is a comment that is long, and longer.</p></section>",
    f"<!-- x --><body><header><h1>Site</h1></header><table><tr><td>{ART}</td></tr></table></body>",
])
def test_templates(page):
    assert extract(page) == SAID


@pytest.mark.parametrize("before,after", [
    ("<div>", "</div><div><h2>More</h2><p>A second part, with a sentence. It ends here.</p></div>"),
    ("<div class=lead><p>A short lead, before the story.</p></div><div>", "</div>"),
    ("<div id=page><div class=a>", "</div><div class=b><p>A part without a heading, but with text.</p></div></div>"),
    ("<h1>A title</h1><div>", "</div>"),
])
def test_parts_beside_the_largest_stay(before, after):
    parts = [" ".join(re.sub(r"<[^>]*>", " ", x).split()) for x in re.split(r"</(?:p|h1|h2)>", before + ART * 3 + after)]
    assert [html.unescape(x).replace(" , ", ", ") for x in parts if x] == extract(f"<body>{before}{ART * 3}{after}</body>").split("\n")


@pytest.mark.parametrize("wrapper", ["div class='content-with-sidebar'", "div id='page' class='no-sidebar'", "div class='header-fixed'", "form id='aspnetForm'", "div role='form'"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_names_of_wrappers_lose_nothing(wrapper, inner):
    side = "<div class=sidebar><p>Read this too.</p></div>"
    assert extract(f"<body><{wrapper}>{inner.format(ART)}{side}</{wrapper.split()[0]}><div class=footer>By us.</div></body>") == SAID


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>one<p>two<br>three", "one\ntwo three"), ("<script>x</script>", ""), ("<p>a\n  b\t<b>c</b>d</p>", "a b cd"), ("<<<>>", "<<<>>")])
def test_odd_pages(page, text):
    assert extract(page) == text


def test_deep_and_broken_pages_end():
    assert extract("<div>" * 50_000 + "text") == "text"
    assert isinstance(extract("<a href='" * 20_000), str)


def test_all_pages_against_a_plain_parse_of_the_article(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in main_text(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(x for x in want if x)


@pytest.mark.parametrize("inner", [
    "<header><h2>A heading</h2></header>", "<p class='notice-board'>On the board</p>", "<p class='share-price'>Ten a share</p>", "<p class='meta'>More about it</p>", "<p>So <math>x + y</math> it is</p>",
    "<p>Press <button>Go</button> to go</p>", "<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul>",
])
def test_parts_of_an_article_stay(inner):
    got = extract(f"<body><article>{ART}{inner}{ART}</article></body>")
    texts = [x for x in (" ".join(re.sub(r"<[^>]*>", "" if "math" in inner or "button" in inner else "|", inner).replace("|", " ").split("  ")).split("  ")) if x.strip()]
    assert all(x.strip() in got for x in texts) and got.startswith(SAID) and got.endswith(SAID)


#: No <article>, and no telling tags or names: the paths' values alone say what the article is.
BARE = f"<body><div class=x1><span><a href=/>Home</a></span><span><a href=/n>News</a></span><span>Log in</span></div><div class=x2><h1>A title</h1>{ART * 3}</div><div class=x3><span>Terms</span><span>2020</span></div></body>"


def test_pages_without_telling_names():
    assert extract(BARE) == "\n".join(["A title", *[SAID] * 3])


def test_the_threshold_selects(monkeypatch):
    """With every path taken as content the menu and the foot come along."""
    monkeypatch.setattr(html_text, "SPREAD", 0.0)
    assert extract(BARE) != "\n".join(["A title", *[SAID] * 3]) and "News" in extract(BARE) and "Terms" in extract(BARE)


def test_smoothing_and_both_ratios_count():
    """A long run of words without marks is a menu, a shorter text with sentences is not."""
    words = "<div class=a>" + "".join(f"<span>word{i}</span>" for i in range(60)) + "</div>"
    assert extract(f"<body>{words}<div class=b>{ART * 2}</div></body>") == "\n".join([SAID] * 2)


def test_tables_of_odd_rows(spark):
    rows = [(1, "u", f"<article>{ART}</article>"), (1, "u", f"<article>{ART}</article>"), (None, None, f"<div>{ART}</div>"), (2, "v", None), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    out = [(r["page_id"], r["text"]) for r in main_text(pages).collect()]
    assert sorted(out, key=str) == sorted([(1, SAID), (1, SAID), (None, SAID), (2, ""), (3, "")], key=str)
    assert main_text(pages.where("false")).count() == 0
