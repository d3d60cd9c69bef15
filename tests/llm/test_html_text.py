import html
import re

from dossier_spark.llm import html_text as H

TREE = H.tree()
text = lambda page: H.main_text(page, TREE)


def test_tree_fits_its_table():
    wrong = [r for r in H.LABELLED if (H.decide(TREE, r[:-1]) >= 0.5) != bool(r[-1])]
    assert not wrong


def test_page():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header class="site"><a href=/>Home</a> Site name</header><nav><ul><li><a href="a">One</a><li><a href="b">Two</a></ul></nav>
    <div id="cookie-notice">We use cookies to serve this page to you and your family.</div><!-- <p>no</p> -->
    <main><article class="post"><header><h1>Caf&eacute; &amp; co</h1></header><p>First <b>para</b>graph\n\n with <a href="x>y">a link</a> and more words.<br>Next line &#8212; end.
    <p>Ti.</p><ul><li>An item of the list<li>Second item here</ul><form><label>Name</label><input></form>
    <aside>Side words that say nothing of the story</aside><div class="ad">Buy now, buy a lot of it, buy.</div>
    <p hidden>secret</p><blockquote>Quoted text &lt;b&gt; here.</blockquote></article>
    <section id="comments"><p>I liked this story a lot, it was great to read, thanks.</p></section></main>
    <div class="sidebar"><p>Other stories of the week</p></div><footer>&copy; someone</footer></body></html>"""
    assert text(page).split("\n\n") == ["Café & co", "First paragraph with a link and more words. Next line — end.", "Ti.", "An item of the list", "Second item here", "Quoted text <b> here."]


def test_without_article():
    page = "<body><ul><li><a>One</a></li><li><a>Two words</a></li></ul><h1>The title of it</h1><p>" + "word " * 40 + "</p><p>Short one.</p><p>" + "more " * 30 + "</p><div class='footer'>All rights kept</div></body>"
    assert text(page).split("\n\n") == ["The title of it", ("word " * 40).strip(), "Short one.", ("more " * 30).strip()]


def test_named_blocks():
    t = "<article class='post has-sidebar'><div class='entry-header'><h1>Title words</h1></div><p>Some text of it.</p><div class='post-comments'><article class='comment'><p>So good, I read it twice.</p></article></div><div class='download'>Kept words here.</div></article>"
    assert text(t).split("\n\n") == ["Title words", "Some text of it.", "Kept words here."]


def test_hinting_names():
    """A class that only has a listed word in it leaves the decision to lengths and links."""
    long, short = " ".join(["word"] * 30), "<ul><li><a>One</a></li><li><a>Two words</a></li><li><a>Three</a></li></ul>"
    for name in ("side-effects", "legal-history", "share-price", "search-engine", "tags_explained"):
        assert text(f"<body>{short}<div class='{name}'><h2>A title here</h2><p>{long}</p><p>{long}</p></div></body>") == f"A title here\n\n{long}\n\n{long}", name
        assert text(f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div><p>{long}</p></article>").count("word") == 90
    for name in ("side", "related", "comment-list", "cookie_banner", "ad-slot", "site-footer"):
        assert text(f"<body><p>{long}</p><p>{long}</p><div class='{name}'><p>Other {long}</p></div></body>").count("word") == 60, name
    assert text(f"<body><p>{long}</p><p>{long}</p><div class='related-posts'>{short}</div></body>").count("word") == 60


def test_page_within_a_form():
    long = " ".join(["word"] * 30)
    assert text(f"<body><form><ul><li><a>One</a></li><li><a>Two</a></li></ul><h1>A title of it</h1><p>{long}</p><p>{long}</p></form></body>") == f"A title of it\n\n{long}\n\n{long}"


def test_many_unclosed():
    """Work stays in proportion to the page."""
    import time

    began = time.process_time()
    for page in ("<i>" * 40_000 + "x</b>" * 40_000, "<p>" + "<i>" * 40_000 + "<hr>" * 40_000, "<div>" * 20_000 + "</span>" * 20_000, "<b>" + "<div>" * 20_000 + "</p>" * 20_000):
        text(page)
    assert time.process_time() - began < 10


def test_odd():
    assert text(None) == text("") == text("<p></p>") == text("<script>x") == text("<!-- x") == ""
    assert text("plain words only") == "plain words only"
    assert text("<article><p>a < b and c > d & e</p></article>") == "a < b and c > d & e"
    assert text("<article><p>x <scr</p></article>").startswith("x")
    assert text("<article><p>" + "w" * 200_000 + "</p></article>") == "w" * 200_000
    assert len(text("<div>" * 3000 + "<article><p>deep words here</p>")) == 15
    assert text("<article><p title=\"it's\" data-x='\"'>quoted 'marks'</p><p>\"</p></article>") == "quoted 'marks'\n\n\""


def expected(page):
    inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
    parts = re.split(r"(?i)</?(?:p|h1)>", inner)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x)))).strip() for x in parts]
    return "\n\n".join(x for x in parts if x)


def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op1_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>one two three</p>", None)], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in H.extract(df).collect()) == [(0, "one two three"), (1, ""), (1, "")]
    assert H.extract(df.limit(0)).count() == 0


def test_edges_of_tags_and_names():
    t = H.tree()
    para = "word " * 30
    page = f"<html><body><ul><li><a href=/a/>Home</a></li><li><a href=/b/>News</a></li></ul><article><h1>Title here</h1><p class='ad-hoc'>{para}one</p><p class='no-comments-yet'>{para}two</p><div class='ad-slot'>{para}buy</div></article></body></html>"
    got = H.main_text(page, t)
    assert "Home" not in got and "News" not in got and "buy" not in got
    assert "one" in got and "two" in got


def test_both_neighbours_are_asked():
    def used(node):
        return {node[0]} | used(node[2]) | used(node[3]) if len(node) > 1 else set()

    names = {H.FEATURES[i] for i in used(H.tree())}
    assert names & {"words_before", "density_before"} and names & {"words_after", "density_after"}
