import pytest

from telewatch.llm import op3_html as O

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy this now</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>para</b>graph&nbsp;here.<p>Second one<br>goes on.
<div class="advert">Skip me</div><ul><li>Point one<li>Point two</ul><form><input>Search form</form>
<p>Les.</p></article><section class="comments"><p>Reader says a long thing about the matter</p></section>
<aside>Related pages</aside><footer>&copy; site</footer></body></html>"""


def test_article_without_its_surroundings():
    assert O.main_text(PAGE) == ("Head & line First paragraph here. Second one goes on. "
                                 "Point one Point two Les.")


def test_page_without_article_element():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8))
    body = "".join(f"<p>Sentence number {i} of the text, which goes on for quite a while here.</p>" for i in range(6))
    html = f"<body><div><ul>{menu}</ul></div><div class=story>{body}<p>Short.</p></div><div class=footer>f</div></body>"
    text = O.main_text(html)
    assert text.startswith("Sentence number 0") and text.endswith("Short.") and "Item" not in text


def test_cut_pages_and_odd_input():
    assert O.main_text(None) == O.main_text("") == O.main_text("   ") == ""
    assert O.main_text("<article><p>Some text here</p><p cla") == "Some text here"
    assert O.main_text("<article><p>a &lt; b</article>") == "a < b"
    assert O.main_text("<p>" * 3000 + "deep") == "deep"
    assert O.main_text("<nav>menu only</nav>") == ""


def test_smoothing_and_threshold():
    assert O.smooth([5.0] * 7) == pytest.approx([5.0] * 7)
    cut = O.threshold([1, 2, 1, 50, 60, 55])
    assert 2 < cut < 50


def test_table_with_nulls(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, None), (2, "v", "", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted([(r.page_id, r.url, r.text, r.n_chars) for r in O.extract_main_text(df).collect()], key=repr)
    want = O.main_text(PAGE)
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert O.extract_main_text(df.limit(0)).count() == 0


def test_whole_driver_table(spark):
    from .conftest import SF001
    from telewatch.llm.catalog import QUERIES
    got = QUERIES["op3_html"](spark, SF001).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    assert len(got) == len(pages)
    assert all(r.text == O.main_text(pages[r.page_id]) and r.n_chars == len(r.text) > 0 for r in got)


def test_heading_anchors_and_slugs_do_not_name_a_part():
    text = "A sentence of the article that goes on for quite a while, as sentences of articles do."
    for slug in ("search", "search-algorithms", "related-work", "social-impact", "share", "side-effects"):
        article = (f'<article><h1 id="{slug}">On it</h1><p>{text}</p><h2 id="{slug}">Short head</h2><p id="{slug}">Les.</p>'
                   f'<section id="{slug}"><h3>More</h3><p>{text}</p></section></article>')
        want = f"On it {text} Short head Les. More {text}"
        assert O.main_text(f"<body><nav>menu</nav>{article}<footer>f</footer></body>") == want
        assert O.main_text(f"<body><main>{article[9:-10]}</main></body>") == want
    for name in ("related-work", "alert-fatigue", "ad-hoc", "menu-design"):
        assert O.main_text(f'<article><p>{text}</p><div class="{name}">Les.</div></article>') == f"{text} Les."


def test_a_name_that_may_be_of_the_article_needs_its_text_to_agree():
    text = "A sentence of the article that goes on for quite a while, as sentences of articles do."
    for name in ("notice", "alert", "related", "social"):
        assert O.main_text(f'<article><p>{text}</p><div class="{name}"><p>{text}</p></div></article>') == f"{text} {text}"
        links = "".join(f"<li><a href=/{i}>{text}</a></li>" for i in range(3))
        assert O.main_text(f'<article><p>{text}</p><ul class="{name}">{links}</ul></article>') == text
        assert O.main_text(f'<article><p>{text}</p><div class="{name}">Go</div><p>{text}</p></article>') == f"{text} {text}"
        assert O.main_text(f'<article><p>{text} <b class="{name}">Go</b></p></article>') == f"{text} Go"
    for name in ("ad", "x comments", "cookie-notice"):
        assert O.main_text(f'<article><p>{text}</p><div class="{name}"><p>{text}</p></div></article>') == text
    assert O.main_text(f'<main><article><p>{text}</p></article><div id="comments"><p>{text * 9}</p></div></main>') == text


#: attributes of parts that are not the article, whatever their text
PARTS = ['id="comments"', 'class="comments-area"', 'class="comment-list"', 'class="reader-comments"',
         'id="disqus_thread"', 'class="site-footer"', 'class="related-posts"', 'class="sidebar-left"', 'id="sidebar"',
         'class="ad-container"', 'class="advert-box"', 'class="newsletter-box"', 'class="cookie-notice-bar"',
         'class="comments"', 'class="share-bar"', 'id="newsletter"', 'class="widget-area"']


@pytest.mark.parametrize("attr", PARTS)
def test_named_parts_go_inside_and_beside_the_article(attr):
    text = "A sentence of the article that goes on for quite a while, as sentences of articles do."
    other = "A text of the page that is as long as those of the article and could be taken for one of them."
    part = f"<div {attr}><p>{other}</p><p>{other}</p></div>"
    body = f"<h1>On it</h1><p>{text}</p><h2>Les</h2><p>{text}</p>"
    want = f"On it {text} Les {text}"
    assert O.main_text(f"<body><article>{body}{part}</article></body>") == want
    assert O.main_text(f"<body><main>{body}{part}</main></body>") == want
    assert O.main_text(f"<body><main><article>{body}</article>{part}</main></body>") == want
    assert O.main_text(f"<body><div class='story'>{body}</div>{part}</body>") == want
    section = part.replace("<div", "<section").replace("</div", "</section")
    assert O.main_text(f"<body><article>{body}{section}</article></body>") == want


def test_page_headers_go_and_article_headers_stay():
    text = "A sentence of the article that goes on for quite a while, as sentences of articles do."
    page = f'<body><main><header class="site-header"><a href=/>Home</a> Site</header><header><h1>On it</h1></header><p>{text}</p></main>'
    assert O.main_text(page) == f"On it {text}"
    for name in ("post-content", "item-list", "left-column", "content", "reader", "comment-worthy", "widget-design"):
        assert O.main_text(f'<article><h1>On it</h1><div class="{name}"><p>{text}</p></div></article>') == f"On it {text}"
