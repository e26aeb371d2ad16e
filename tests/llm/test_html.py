from loreweave.llm import html_wrapper as H

SCHEMA = "page_id long, url string, html string, host string, digest string, pivot string"


def page(i, body, host="site.example"):
    html = f"""<!DOCTYPE html><html><head><title>Page {i}</title><script>var x = "<p>no</p>";</script><style>p {{}}</style></head><body>
    <header class="top"><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav>
    <div id="wrap"><div class="promo">Buy now {i}</div><div class="text"><p>Read in the office.</p>{body}</div></div>
    <div class="comments"><p>First! {i}</p></div><form><input value="q"><p>Send</p></form><footer>Footer {i}</footer></body></html>"""
    return (i, f"https://{host}/p/{i}", html, "x", "y", "z")


def got(spark, rows):
    return {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_constants_go_and_slots_stay(spark):
    rows = [page(i, f"<h1>Title {i}</h1>\n<p>Caf&eacute; &amp; <b>bold</b>&nbsp;text&#33; number\n\t {i}, long enough to be the article of its page.</p><!-- gone --><p>Second {i}</p>") for i in range(6)]
    out = got(spark, rows)
    for i in range(6):
        assert out[i] == f"Title {i} Café & bold text! number {i}, long enough to be the article of its page. Second {i}"


def test_article_and_edges(spark):
    rows = [(1, "http://a.example/x", "<article><h1>T</h1><p>Body one</p><aside>no</aside></article><p>out</p>", "", "", "")]
    rows += [(2, "http://a.example/y", None, "", "", ""), (3, None, "", "", "", ""), (None, None, "<main><p>kept</p></main>", "", "", ""), (4, "nonsense", "just text &lt;b&gt;", "", "", "")]
    rows += [(5, "http://b.example", "<main><p>" + "word " * 20000 + "</p></main>", "", "", ""), (5, "http://b.example", "<main><p>" + "word " * 20000 + "</p></main>", "", "", "")]
    rows += [(6, "http://c.example", "<main>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</main>", "", "", ""), (7, "http://c.example/", "<main><p>open <i>never closed", "", "", "")]
    frame = H.main_text(spark.createDataFrame(rows, SCHEMA))
    assert frame.columns[:4] == ["page_id", "url", "text", "n_chars"]
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in frame.collect()]
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    texts = {i: t for i, t, _ in found}
    assert (texts[1], texts[2], texts[3], texts[None], texts[4]) == ("T Body one", "", "", "kept", "just text <b>")
    assert texts[5] == " ".join(["word"] * 20000) and texts[6] == "deep" and texts[7] == "open never closed"


def body_text(body):
    return H.content(H.parse(f"<html><body>{body}</body></html>"), set(), None)


def test_names_are_weak_signs():
    text = "The body of the article, long enough to be most of what its page has to say. "
    article = f"<article><h1>T</h1><p>{text}</p></article>"
    for around in ("elementor-widget-container", "layout has-sidebar", "no-sidebar content", "widget", "sidebar", "withSidebar"):
        assert body_text(f"<div class='{around}'>{article}</div>") == f"T {text}".strip(), around
        assert body_text(f"<div class='{around}'><h1>T</h1><p>{text}</p></div><p>End</p>").startswith(f"T {text}".strip()), around
    inner = "<div class='article-header'><h1>T</h1></div><h2 class='section-header'>H</h2><section id='related-work'><p>W</p></section><div class='header'>D</div>"
    inner += "<pre>x = 1 <span class='comment'># why</span></pre>"
    assert body_text(f"<article>{inner}<p>{text}</p></article>") == f"T H W D x = 1 # why {text}".strip()
    assert body_text("<div class='widget'><p>one half</p></div><div class='notice'><p>other half</p></div>") != ""


def test_named_parts_still_go():
    text = "The body of the article, long enough to be most of what its page has to say. "
    parts = "<div class='ad'>A</div><div class='share-buttons'><a href='/'>S</a></div><div class='comment-list'><p>C</p></div><div class='sidebar-left'>B</div><ul class='menu'><li>M</ul><div class='related-posts'><a href='/'>R</a></div>"
    assert body_text(f"<article>{parts}<p>{text}</p></article>") == text.strip()
    assert body_text(f"<div class='site-header'>H</div><div><p>{text}</p></div>{parts}") == text.strip()
    assert body_text(f"<div><p>Short own text.</p></div><div class='comments'><p>{text * 5}</p></div>") == "Short own text."


def test_all_article_text_is_kept():
    items = "".join(f"<li>Item number {i} of the list in the article" for i in range(30))
    listed = " ".join(f"Item number {i} of the list in the article" for i in range(30))
    menu = "<div><a href='/a'>Menu one</a> <a href='/b'>Menu two</a></div>"
    assert body_text(f"{menu}<div><h1>Title</h1><p>intro</p><ul>{items}</ul><p>end</p></div>") == f"Title intro {listed} end"
    assert body_text(f"{menu}<div><div><h1>Title</h1></div><div><blockquote>{listed}</blockquote></div><div><p>after</p></div></div>") == f"Title {listed} after"
    assert body_text("<article><p>part one, the longer of the two</p></article><p>out</p><article><p>part two</p></article>") == "part one, the longer of the two part two"
    assert body_text("<main><p>before</p><article><p>the article itself</p></article><p>after</p></main>") == "before the article itself after"
    teasers = "<article><h3><a href='/x'>Next story</a></h3><p>It begins</p></article><article><a href='/y'>Only a link</a></article><article class='comment'>C</article>"
    assert body_text(f"<article><h1>Title</h1><p>{listed}</p></article>{teasers}") == f"Title {listed}"


def test_empty_table(spark):
    assert H.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_matching_aligns_in_order():
    a, b = H.parse("<div><p>x</p><ul><li>1<li>2</ul></div>"), H.parse("<div><h2>t</h2><p>y</p><ul><li>3</ul></div>")
    where = H.places(a, b)
    div = a.items[0]
    p, ul = (n for n in div.items if isinstance(n, H.Node))
    assert where[id(p)].endswith("/1p") and where[id(ul)].endswith("/2ul")


def test_queries_rows_on_test_data(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = H.main_text(pages)
    assert out.count() == pages.count() and out.where("text like '%<%>%' or text is null").count() == 0


def test_what_stays_in_an_article():
    """Formulas, fallback texts, and blocks deeper than the tree goes, which keep their breaks."""
    page = lambda body: H.content(H.parse(f"<html><body><nav><a href=x>menu</a></nav><article>{body}</article></body></html>"), set(), None)
    assert page("<p>Sum is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> end.</p>") == "Sum is x+1 end."
    assert page("<p>See <object data=a>a chart</object> and <noscript>an image</noscript>.</p>") == "See a chart and an image."
    deep = "<div>" * 160 + "<p>one</p><p>two</p>three" + "</div>" * 160
    assert page(deep) == "one two three"
