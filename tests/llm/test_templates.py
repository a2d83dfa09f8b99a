"""Main text of pages: the given pages against their source, templates of hosts, odd markup and odd rows."""

import html
import re

import pytest

from ledgerspark.llm import queries, templates
from ledgerspark.llm.templates import Page

PAGES = "page_id long, url string, html string"


def article_of(page: str) -> str:
    """What the given pages have in their article: text between block tags, references decoded."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))
    return " ".join(w for x in parts for w in html.unescape(x).split())


def test_query(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op11_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == article_of(p["html"])
        assert got[p["page_id"]]["n_chars"] == len(article_of(p["html"])) and got[p["page_id"]]["url"] == p["url"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<b>b</b>c <i>d</i><br>e<p>f</p>", "abc d e f"),
        ("<div class='main-content'>one &amp; two &lt;b&gt; &#233;&#x41; &nbsp; x &amp;amp;</div>", "one & two <b> éA x &amp;"),
        ("<nav>no</nav><header>no</header><p>yes</p><footer>no</footer><aside>no</aside><form>no<p>no</p></form>", "yes"),
        ("<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {}</style><p>yes</p><noscript><p>no</p></noscript>", "yes"),
        ("<!-- <p>no</p> --><p>yes</p><!-- never closed <p>no", "yes"),
        ("<article><header><h1>Title</h1><span>by someone</span></header><p>yes</p><div class=comments><p>no</p></div></article><p>no</p>", "Title yes"),
        ("<main><div id='cookieNotice'>no</div><p title='a > b'>yes</p><div class='ad'>no</div><div class='with-sidebar'>yes</div></main>", "yes yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<div><a href=x>all</a> <a href=y>links</a></div><p>text with one <a href=z>link</a> inside</p>", "text with one link inside"),
        ("</div></p><p>a</section>b</p><p>un<b>closed", "a b unclosed"),
        ("1 < 2 and <3 hearts <a", "1 < 2 and <3 hearts"),
        ("<title>no</title><TEXTAREA>no</TEXTAREA><P>yes</P><script>never closed", "yes"),
        ("<p class=\"x>a</p><p>b\"</p>", "a b\""),
        ("<div id=content class='sidebar-right'>yes<div class=post-comments>no</div><div class='main-content ad'>no</div></div><div class=sidebar-right>no</div>", "yes"),
        ("<article class='post-7 tag-ads category-menu'>yes<article class=comment>no</article></article>", "yes"),
        ("<main class='page share'>yes</main><article id=replies>no</article><section class=story-body>no</section>", "yes"),
        ("", ""),
        ("just text", "just text"),
    ],
)
def test_markup(page, text):
    assert Page(page, tokens=False).text(()) == text
    assert Page(page).text(()) == text


def test_templates_of_hosts(spark):
    """A note that comes with its tags on a host's pages is a template; passages that repeat among articles are not."""
    note = "<div class=x1><p>Read our other stories.</p></div>"
    rows = []
    for i in range(40):
        menu = "".join(f"<li><a href=/{k}>topic {k}</a></li>" for k in range(i % 3 + 2))
        shared = "<p>A passage that many articles share.</p>" if i % 2 else ""
        copied = "<p>The same long copy.</p>" if i < 30 else f"<p>Own text {i}.</p>"
        rows.append((i, "https://a.example/" + str(i), f"<body><div class=top><ul>{menu}</ul></div><div class=c><h1>Title {i}</h1><p>First {i}.</p>{shared}{copied}{note if i % 4 else ''}</div><div class=z>All rights kept</div></body>"))
    rows += [(100 + i, f"http://b{i}.example/", f"<div>{note}<p>Small host {i}</p></div>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in templates.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(40):
        want = [f"Title {i} First {i}."] + ["A passage that many articles share."] * (i % 2) + ["The same long copy." if i < 30 else f"Own text {i}."]
        assert got[i] == " ".join(want)
    assert got[101] == "Read our other stories. Small host 1"
    classes = templates.templates(spark.createDataFrame(rows, PAGES)).collect()
    assert {c["host"] for c in classes} == {"a.example"}
    by = {c["class"]: c for c in classes}
    # The note's class (30 of 40 pages) nests in the class of all pages.
    notes = [c for c in classes if c["pages"] == 30]
    assert len(notes) == 1 and notes[0]["texts"] == 1 and by[notes[0]["parent"]]["pages"] == 40


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "x", "<p>a</p>"), (1, "http://h/", "<p>" + "long text " * 300_000 + "</p>"), (2, "http://h/", ""), (2, "http://h/", "")] + [(3, "HTTP://H/", "<p>same</p>")] * 9
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "url AS host", "html AS template", "page_id AS n")
    got = [tuple(r) for r in templates.extract(df).collect()]
    assert sorted((r[0] or 0, r[1] or "", r[3]) for r in got) == sorted((r[0] or 0, r[1] or "", len(Page(r[2] or "").text(()))) for r in rows)
    assert templates.extract(df.limit(0)).count() == 0 and templates.extract(df).columns == ["page_id", "url", "text", "n_chars"]
