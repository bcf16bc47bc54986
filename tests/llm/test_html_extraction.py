"""Texts of hand-made pages, site templates against a plain count, the tables' pages, odd rows."""

import html
import re

from nightledger.llm import html_extraction as H

from . import samples

SCHEMA = "page_id long, url string, html string, text string, node long, host string"


def text_of(page):
    return "\n".join(H.content(H.pruned(H.parsed(page))))


def texts(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    return {r["page_id"]: r["text"] for r in H.extract(frame, **kw).collect()}


def test_markup_references_and_white_space():
    assert text_of("<p>a&nbsp;b &lt;i&gt; &eacute;&#233;&#xe9; &bogus; &amp</p>") == "a b <i> ééé &bogus; &"
    assert text_of("<article><h1>T\n t</h1><p>one<b>two</b> three<br>four<p>five</article>") == "T t\nonetwo three four\nfive"
    assert text_of("x<!-- <p>no</p> -->y<script>if (a<b) '</p>'</script><style>p{}</style>z") == "xyz"
    assert text_of('<div title="a>b">1 < 2</div><ul><li>one<li>two</ul>tail') == "1 < 2\none\ntwo\ntail"
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text_of("<head><title>no</title><p>yes") == "yes"
    assert text_of("kept <a href='x") == "kept" and text_of("<p>kept</p><scr") == "kept"
    assert text_of('<p title="broken>kept</p> <p>more') == "kept\nmore"
    assert text_of("<p>&#0;&#xD800;|&#x110000;</p>") == "��|�"


def test_furniture_goes():
    page = """<header>top</header><nav>menu</nav><div class="cookie-notice">ok?</div><main><article>
      <header><h1>Title</h1><p>by someone</p></header><p>Text.</p><aside>side</aside><div class="ad">buy</div>
      <form>mail <input></form><section id="readerComments"><p>first!</p></section><footer>end</footer></article>
      <article class="teaser">other</article></main><div role="complementary">side</div><footer>foot</footer>"""
    assert text_of(page) == "Title\nText."
    assert text_of("<div class='with-sidebar'><p>a</p></div><div class='sidebar'>b</div>") == "a"
    assert text_of("<div class='sidebar-layout'><article>a</article></div>") == "a"
    assert text_of("<form><article>a</article></form><form>b</form>") == "a"
    assert text_of("<article class='post legal'>a</article><article>b</article>") == "a\nb"


def site(n, host="h.example", extra=""):
    """Pages with unlabelled templates around and inside different articles."""
    return [
        (i, f"http://{host}/{i}", f"<body><div>Welcome<ul><li>Home</li></ul></div><article><p>{samples.prose(30, i)}</p>"
         f"<p>A line that all quote.</p><div><p>Read our letter</p></div>{extra}</article><div>Made by us</div></body>")
        for i in range(n)
    ]


def test_templates_of_a_host_go_and_quotes_stay(spark):
    rows = site(12) + [(100 + i, f"http://other/{i}", site(3)[i][2]) for i in range(3)]
    got = texts(spark, rows)
    for i in range(12):
        assert got[i] == f"{samples.prose(30, i)}\nA line that all quote."
    for i in range(3):  # three pages are no site
        assert got[100 + i] == f"{samples.prose(30, i)}\nA line that all quote.\nRead our letter"


def test_pages_without_articles(spark):
    rows = [(i, f"http://h/{i}", f"<div><p>Welcome to us</p></div><p>Imprint</p><div><p>{samples.prose(20, i)}</p></div>" + "<p>quoted</p>" * (i % 3 == 0)) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == samples.prose(20, i) + "\nquoted" * (i % 3 == 0) for i in range(12))


def test_copies_do_not_make_a_template(spark):
    page = f"<div><section><p>{samples.prose(30, 1)}</p></section><section><ul><li>a</li></ul></section></div>"
    got = texts(spark, [(i, f"http://h/{i}", page) for i in range(30)] + [(99, "http://h/z", "<p>z</p>")])
    assert got[3] == f"{samples.prose(30, 1)}\na"


def plain_templates(rows, many=H.MANY, share=H.SHARE):
    """Hashes by counting in Python."""
    pages = {}
    for _, url, page in rows:
        host = H._hosts([url])[0]
        root = H.pruned(H.parsed(page or ""))
        found = H.candidates(root, host)
        pages.setdefault(host, {})["\n".join(H.content(root))] = found
    out = set()
    for contents in pages.values():
        prose = {x: p for found in contents.values() for x, p in found.items()}
        for x, p in prose.items():
            n = sum(x in found for found in contents.values())
            if n >= many and 100 * n >= (H.PROSE_SHARE if p else share) * len(contents):
                out.add(H._signed(x))
    return out


def test_templates_against_a_plain_count_and_both_ways(spark):
    rows = site(30, extra="<div>x</div>") + [(200 + i, "http://big/", f"<div>t{i % 9}</div><div>t{i % 40}</div><p>{i}</p>") for i in range(200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = plain_templates(rows)
    assert {r["node"] for r in H.templates(frame).collect()} == want and len(want) > 10
    # too many for one array: the same texts by joins
    assert texts(spark, rows) == texts(spark, rows, bound=0)


def plain_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks)
    return "\n".join(b for b in blocks if b)


def test_query_on_the_tables(spark):
    from nightledger.llm.registry import queries

    frame = queries()["op13_main_text"](spark, "/root/testdata/sf0.01")
    got = {r["page_id"]: r for r in frame.collect()}
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(table)
    for r in table:
        assert got[r["page_id"]]["text"] == plain_article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(plain_article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(None, None, None), (1, None, ""), (2, "no host", "plain"), (3, "http://h", "<b>" * 20_000 + "deep"), (4, "http://h", long)]
    rows += [(5, "http://h", "<p>same</p>")] * 3 + [(6, "http://h", "<div>" * 20_000 + "deeper"), (7, "http://h", "</p></div><p")]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(2)
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract(frame).collect())
    words = "\n".join(["word"] * 50_000)
    assert got == [(0, "", 0), (1, "", 0), (2, "plain", 5), (3, "deep", 4), (4, words, len(words)), *[(5, "same", 4)] * 3, (6, "deeper", 6), (7, "", 0)]
    assert H.extract(frame.limit(0)).collect() == []
