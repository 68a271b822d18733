"""Main text of pages: markup of all kinds, votes of hosts, and whole tables against a plain reading."""

import html
import re

import pytest
from pyspark.sql import functions as F

from motionlake.llm import mainblocks, queries

BODY = "The first sentence of this article is long enough to count as running text. "
SCHEMA = "page_id long, url string, html string"


def text(page, winners=None):
    return mainblocks.Page(page).text(winners)


def test_parts_that_go():
    page = f"""<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{{}}</style></head>
    <body class="page has-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div id="cookie-notice"><p>We use cookies on this site, please agree to all of them now.</p></div>
    <div class="wrapper with-sidebar"><article class="post category-notice has-comments">
      <header><h1>Head&shy;line &amp; more</h1><p>By A. Writer</header>
      <p>{BODY}<a href="x">a link</a>.<div class="advert">Buy this <b>now</b>, it is cheap and good and it lasts.</div>
      <ul><li>one<li>two <em>three</em></ul><blockquote>said</blockquote>
      <table><tr><td>a<td>b<tr><td>c</table><pre>x
   y</pre><form><p>Your name here, please.</p></form><p>{BODY}<br>after<script>var a="</p><p>no";</script>
      <div class="post-comments"><article class="comment"><p>{BODY * 9}</article></div>
      <div class=share-buttons>Share</div><footer>Filed under news</footer>
    </article><aside><p>{BODY}</aside><div class="sidebarLeft"><p>{BODY}</div></div>
    <noscript>Enable scripts.</noscript><div hidden>{BODY}</div><div style="display: none">{BODY}</div><footer>&copy; me</footer></body></html>"""
    b = BODY.strip()
    assert text(page) == "\n".join(["Head\xadline & more", "By A. Writer", b + " a link.", "one", "two three", "said", "a", "b", "c", "x y", b + " after"])


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"),
    ("<html><head><title>t</title><p>Hello", "Hello"),
    ("<p>a<p>b</p>c", "a\nb\nc"),
    ("<p>&#65;&#x42;&nbsp;&amp;lt; &unknown; &eacute;", "AB &lt; &unknown; é"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<p>a<!-- no -- <p>no</p> -->b<![CDATA[no]]><?php no ?>c", "abc"),
    ("<p title='a > b' class=x>t</p><p title=it's>u</p><p>don't", "t\nu\ndon't"),
    ("<p>open<script>no", "open"), ("<p>a <button>Share</button><span class=ad-slot>x</span> b<svg><text>s</text></svg>c", "a bc"), ("<p>a</b></i></div>b", "a\nb"), ("<P>A</P><DIV>B</DIV>", "A\nB"),
    ("<nav>menu</nav><div class=ad>advert</div><footer>f</footer>", ""),
    ("<p>" + "<b>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
])
def test_markup(page, want):
    assert text(page) == want


def test_no_article_element():
    page = f"<body><div class=top>Menu <a href=1>one</a> <a href=2>two</a></div><div class=x1><h1>Title</h1><p>{BODY}</p><section><p>{BODY}</section><section><p>{BODY * 3}</section></div><div class=x2><a href=1>{BODY}</a></div></body>"
    assert text(page).split("\n") == ["Title", BODY.strip(), BODY.strip(), (BODY * 3).strip()]
    headed = f"<main><h1>Title</h1><p class=date>Monday</p><article><p>{BODY}</article></main>"
    assert text(headed).split("\n") == ["Title", BODY.strip()]


def pages(n, tail, start=0, site="a.example"):
    return [(start + i, f"https://User@{site.upper()}:80/{i}?q#f", f"<body><div class='x1 item-100{i}'><p>{BODY}{i}.</p></div><div class=x9>{tail(i)}</div></body>") for i in range(n)]


def test_hosts_agree(spark):
    """On one page readers wrote more than the author, in a part that nothing marks."""
    rows = pages(12, lambda i: f"<p>{BODY * 5}</p>" if i == 3 else "")
    df = spark.createDataFrame(rows + [(99, "no host", rows[3][2])], SCHEMA)
    got = {r["page_id"]: r for r in mainblocks.main_text(df.repartition(3)).collect()}
    assert len(got) == 13 and all(got[i]["text"] == f"{BODY}{i}." for i in range(12))
    assert got[99]["text"].startswith(f"{BODY}3.\n") and got[99]["path_share"] is None
    assert got[3]["path_share"] == pytest.approx(11 / 12) and got[3]["n_chars"] == len(got[3]["text"])


def test_two_templates_and_rare_paths(spark):
    rows = pages(30, lambda i: "") + [(100 + i, "http://a.example/", f"<body><section class=other><p>{BODY}{i}.</p></section></body>") for i in range(9)]
    rows += [(200, "http://a.example/rare", f"<body><main><p>{BODY}</p></main></body>")]
    got = {r["page_id"]: r["text"] for r in mainblocks.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == f"{BODY}0." and got[105] == f"{BODY}5." and got[200] == BODY.strip()
    won = mainblocks.winners(mainblocks.votes(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["host"], {p["path"] for p in r["paths"]}) for r in won] == [("a.example", {"body>div.item-#.x1", "body>section.other"})]


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "", ""), (2, "http://x/", "<p>" + "word " * 200_000), (3, "::", "<p>t")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("host", "text", "paths", "path", "n_chars", "won_host", "share")})
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in mainblocks.main_text(df).collect()), key=repr)
    assert got == sorted([(1, None, 0), (1, None, 0), (None, "", 0), (2, "http://x/", 5 * 200_000 - 1), (3, "::", 1)], key=repr)
    assert mainblocks.main_text(df.where("false")).collect() == []


def test_query_equals_plain_reading(spark, sf_dir):
    """All pages of the fixture have one article element of headings and paragraphs."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    want = {}
    for r in spark.read.parquet(f"{larger}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = (r["url"], "\n".join(p for p in parts if p))
    got = queries.QUERIES["op13_main_text"](spark, larger).collect()
    assert len(got) == len(want) and all(want[r["page_id"]] == (r["url"], r["text"]) and r["n_chars"] == len(r["text"]) for r in got)
