from pyspark.sql import functions as F

from spanlake.llm.pages import Page, main_texts
from spanlake.llm.q_corpus import op8


def text(html):
    return Page().read(html).main_text()


def test_article_without_its_surroundings():
    html = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
    <div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>One<br>two   <b>bold</b> a&lt;b &eacute;&#233;&nbsp;x.
    <p>Second<i> part</i><ul><li>first<li>second</ul><table><tr><td>c1<td>c2</table>
    <div class="share">Share</div><form><p>Name</p></form><!-- hidden <p>no</p> --><aside>More</aside>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section></article></main>
    <aside>side</aside><footer>&copy; site</footer></body></html>"""
    assert text(html) == "Title & more\n\nOne two bold a<b éé x.\n\nSecond part\n\nfirst\n\nsecond\n\nc1\n\nc2"


def test_pages_without_marks_and_broken_markup():
    assert text("plain < text > 3") == "plain < text > 3"
    assert text("<p>a<p>b</i></div>c") == "a\n\nbc"
    assert text("<div>a<div>b</div>c</div><p>d") == "a\n\nb\n\nc\n\nd"
    assert text("<nav>menu<article><p>kept</article>") == "kept"
    assert text("<article><p>kept</p></article><footer>gone") == "kept"
    assert text('<p title="a > b">x</p><p hidden>no</p><p style="display: none">no</p>') == "x"
    assert text("<p>x<!-- never closed <p>y") == "x"
    assert text("<script>alert(1)") == text("<p>") == text("") == ""
    assert text("<p>cut off<a href=") == "cut off"
    assert text("<p>" + "x " * 100000 + "</p>").count("x") == 100000
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text('<a "' * 20000).strip() == ""


def test_names_that_are_no_article():
    for name in ("top-nav", "mainMenu", "site_footer", "left-sidebar", "ad-slot", "google_ads", "cookieBanner", "notice",
                 "share-buttons", "related-posts", "userComments", "comment-12", "disqus_thread", "skip-link", "search-box"):
        for attr in ("class", "id"):
            assert text(f'<article><p>a</p><div {attr}="x {name}"><p>no</p></div><p>b</p></article>') == "a\n\nb", name
    for name in ("content", "lead", "shadow", "header-image", "menuet", "navy", "adventure", "commentary", "noticeable"):
        assert text(f'<article><p>a</p><div class="{name}"><p>yes</p></div></article>') == "a\n\nyes", name


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, text int").repartition(3)


def test_recurring_subtrees_of_a_host_go(spark):
    box = '<div><p>Subscribe   to our <b>letter</b></p></div>'
    rows = []
    for i in range(12):
        own = f"<p>own words {i}</p><p>said everywhere</p>"
        rows.append((i, f"https://User@A.example.com:80/{i}", f"<article>{own}{box}</article>"))
        rows.append((100 + i, f"http://b.example.com/{i}", f"<body><p>welcome</p><div><p>own {i}</p></div>{box if i < 3 else ''}</body>"))
        rows.append((200 + i, "http://copies.example.com/", f"<body><div><p>the same page</p></div></body>"))
        rows.append((300 + i, None, f"<body><div><p>no host</p></div><p>{i}</p></body>"))
    rows += [(900, "http://b.example.com/x", None), (901, "not a url", ""), (None, "http://a.example.com/", "<article><p>x</p>" + box), (901, "not a url", "")]
    got = {}
    for r in main_texts(pages_of(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["own words 3\n\nsaid everywhere"]
    assert got[101] == ["own 1\n\nSubscribe to our letter"] and got[105] == ["own 5"]
    assert got[203] == ["the same page"] and got[304] == ["no host\n\n4"]
    assert got[900] == [""] and got[901] == ["", ""] and got[None] == ["x"]
    assert main_texts(pages_of(spark, rows).where(F.lit(False))).count() == 0


def test_query_against_the_articles_of_the_table(spark, sf_small):
    import html
    import re
    want = {}
    for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h\d)>", body))
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    out = op8(spark, sf_small).collect()
    assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)


def test_templates_of_a_large_host_and_bare_paragraphs_in_articles(spark):
    box = '<section><p>Members read <b>more</b></p></section>'
    rows = []
    for i in range(300):
        notice = "<p>Seen by all</p>" if i % 4 else ""
        cell = "<p>Seldom said</p>" if i < 60 else ""
        rows.append((i, f"http://large.example.com/{i}", f"<article><p>own {i}</p>{cell}{notice}{box if i < 30 else ''}</article>"))
    for i in range(18):  # too few for paragraphs of an article
        rows.append((1000 + i, f"http://small.example.com/{i}", f"<article><p>own {i}</p><p>Seen by all</p>{box if i < 6 else ''}</article>"))
    want = {i: f"own {i}" + ("\n\nSeldom said" if i < 60 else "") for i in range(300)}
    want |= {1000 + i: f"own {i}\n\nSeen by all" for i in range(18)}
    pages = pages_of(spark, rows)
    assert {r.page_id: r.text for r in main_texts(pages).collect()} == want
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.page_id: r.text for r in main_texts(pages, max_broadcast_bytes=0).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_anchors_and_inline_elements_of_an_article_stay():
    assert text('<article><h1>T</h1><h2 id="related-work">Related work</h2><p>We compare.</p><h2 id="search">Search</h2>'
                '<h3 class="share">Shares</h3><p>x</p></article>') == "T\n\nRelated work\n\nWe compare.\n\nSearch\n\nShares\n\nx"
    assert text('<article><section id="social-effects"><h2>Effects</h2><p>Some.</p></section></article>') == "Effects\n\nSome."
    assert text('<article><p>One <span class="search-term">two</span> three <b class="share">four</b> five.</p></article>') \
        == "One two three four five."
    assert text('<body><div class="post-header"><h1>Title</h1></div><div class="page-header"><p>Site</p></div><p>x</p></body>') \
        == "Title\n\nx"
    assert text('<article><section class="related-posts"><p>no</p></section><p>x</p><section id="comments"><p>no</p></section></article>') == "x"


def test_depth_and_stray_end_tags_take_linear_time():
    import time

    def seconds(html):
        t0 = time.process_time()
        Page().read(html)
        return time.process_time() - t0
    for make in (lambda n: "<div>" * n + "deep" + "</div>" * n, lambda n: "<div>" * n + "</li>" * n,
                 lambda n: "<div><p>a</p>" * n + "</div>" * n, lambda n: "<b>" * n + "<div>x</div>" * n):
        assert seconds(make(16000)) < 8 * seconds(make(4000)) + 0.2
