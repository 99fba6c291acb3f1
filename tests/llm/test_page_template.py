import html
import re

import pytest

from dwelltail.llm import page_template, queries


def article_text(page):
    """Plain reading of the supplied pages, which keep their text in one article element."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())


def test_supplied_pages(spark, medium):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{medium}/pages.parquet").collect()}
    rows = queries.op1_page_template(spark, medium).collect()
    assert len(rows) == len(pages) == len({r["page_id"] for r in rows})
    for row in rows:
        assert row["text"] == article_text(pages[row["page_id"]]) and row["n_chars"] == len(row["text"])


SIDES = """<header><a href=/>Home</a></header><div class="side-bar sidebar">Latest</div><div id="cookieNotice">We use cookies</div>
<form><p>Your name</p><select><option>a</select></form><aside>See also</aside><script>var a = "<p>no</p>";</script><style>p{}</style>"""


def test_elements_that_are_no_content():
    page = (
        f"<html><head><title>T</title></head><body class='nav-open'>{SIDES}<main><h1>Head &amp; line</h1><div class=share>Share</div>"
        "<p>One <b>tw</b>o<br>three&nbsp;&#8364;<p>Four\n  five<ul><li>six<li>seven</ul><table><tr><td>8<td>9</table>"
        "<div class='ad'>Buy</div><section id=comments><p>First!</p></section><div role=navigation>Next</div></main><footer>End</footer>"
    )
    assert page_template.main_text(page, None)[0] == "Head & line One two three € Four five six seven 8 9"


def test_broken_markup():
    cases = {
        None: "", "": "", "plain &lt;text&gt;": "plain <text>", "<p>a<p": "a", "<p>a</i></div></p>b": "a b", "<!-- x --><p>a<!-- y": "a",
        "<article><p>a<script>b": "a", "<div><p>x > y < z</p></div>": "x > y < z", "<p>a</p><![CDATA[x]]><p title='>'>b</p>": "a b", "&am &amp": "&am &",
        "<a b='": "",
    }
    for page, text in cases.items():
        assert page_template.main_text(page, None)[0] == text, page
    assert page_template.main_text("<div>" * 20_000 + "deep", None)[0] == "deep"


def test_raw_elements_without_an_end():
    article = "<article><p>The text.</p></article>"
    for start in ("<html><head><title>x</title><body>", "<head><meta a=b><script>var a = '<p>';</script>", "<head><title>x</title></head><body>",
                  "<body><svg viewBox='0 0 1 1'/>", "<body><svg><path d=1></svg>", "<body><iframe src=x>", "<body><object><video>", "<head>"):
        assert page_template.main_text(start + article, None)[0] == "The text.", start
    assert page_template.main_text("<article><p>a<iframe>" * 20_000, None)[0].split() == ["a"] * 20_000


def test_names_that_only_contain_a_side_word():
    text = "<h1>Head</h1><p>The text.</p>"
    for start in ("<main><div class='elementor-widget-container'>", "<div class='content-sidebar-wrap'><article>", "<article class='post no-sidebar'>",
                  "<article class='comment-status-open'>", "<main><section id='related-work'>", "<div class=widget><main>", "<div class=search>", "<div id=banner><div role=main>"):
        assert page_template.main_text(start + text, None)[0] == "Head The text.", start
    assert page_template.main_text("<main><h2 id='search-methods'>Search</h2><p>a", None)[0] == "Search a"
    assert page_template.main_text("<main><p>a</p><div class='comment-list'>b<article>c</article></div><div class='site-footer'>d", None)[0] == "a"


def pages(n, host="h.example"):
    """Pages without a main element: the menu is mostly links, one line is on every page, the rest differs."""
    made = []
    for i in range(n):
        menu = "".join(f"<li><a href=/{i}{j}>topic {i} {j}</a></li>" for j in range(4))
        made.append((i, f"http://{host}/{i}", f"<body><div><ul>{menu}</ul></div><div class=c><p>Always the same line.</p><p>Text {i} of its own.</p></div></body>"))
    return made


def test_template_and_menus_without_main_element(spark):
    rows = page_template.extract(spark.createDataFrame(pages(9), "page_id long, url string, html string").repartition(4)).collect()
    assert sorted((r["page_id"], r["text"]) for r in rows) == [(i, f"Text {i} of its own.") for i in range(9)]
    assert all(r["n_template"] > 5 for r in rows)


def test_template_inside_the_main_element(spark):
    made = [(i, "http://h.example/", f"<article><h1>Title</h1><div class=box><p>Read our other news.</p></div><p>Always so.</p><div class=body><p>Text {i}.</p></div></article>")
            for i in range(9)]
    rows = page_template.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in rows) == [(i, f"Title Always so. Text {i}.") for i in range(9)]


def test_paths_of_single_pages_stay_out_of_the_template(spark):
    """Class words that are unique to a page: its links are still dropped, but the host's other pages do not get them."""
    made = []
    for i in range(12):
        slug = "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
        made.append((i, "http://h.example/", f"<body><div class=x{slug}><p><a href=/>link {i} of many</a></div><div class=y{slug}><p>Text {i}.</div></body>"))
    frame = spark.createDataFrame(made, "page_id long, url string, html string")
    rows = page_template.extract(frame).collect()
    assert sorted((r["page_id"], r["text"]) for r in rows) == [(i, f"Text {i}.") for i in range(12)]
    (row,) = page_template.templates(frame.select(page_template.F.lit("h").alias("_host"), frame.html.alias("_html"))).collect()
    assert all(e["kind"] == 1 for e in row["_template"]) and len(row["_template"]) < 8


def test_few_pages_have_no_template(spark):
    (row,) = page_template.extract(spark.createDataFrame(pages(1), "page_id long, url string, html string")).collect()
    assert row["text"] == "Always the same line. Text 0 of its own."


def test_classes_out_of_order_are_left_out():
    classes = {1: [(0.0, 10), (1.0, 11), (2.0, 12)], 2: [(0.5, 20), (1.5, 21)], 3: [(0.0, 30)]}
    assert page_template.usable(classes, [10, 20, 21, 11, 12, 30]) == {10, 11, 12, 20, 21}
    assert page_template.usable(classes, [10, 21, 20, 11, 12]) == {10, 11, 12}
    assert page_template.usable(classes, [10, 12, 11]) == set()


def test_edge_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, note string"
    rows = [(1, None, None, "x", "x", "n"), (1, None, None, "x", "x", "n"), (None, "no url", "", "x", "x", "n"), (2, "HTTP://u@Host:80/a", "<p>" + "w " * 200_000, "x", "x", "n")]
    out = page_template.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "note", "text", "n_chars", "n_template", "n_slots"]
    assert sorted(r["n_chars"] for r in out.collect()) == [0, 0, 0, 399_999]
    assert page_template.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<body><form id='aspnet'><nav>Home</nav><main><h1>Title</h1><p>The text.</p></main></form></body>", "Title The text."),
    ("<div role=dialog><article><p>The text.</p></article></div>", "The text."),
    ("<fieldset><main><p>The text.</p><form><p>Your mail</p></form></main></fieldset>", "The text."),
    ("<header>Site</header><article><header><h1>Title</h1><p>Lead.</p></header><p>The text.</p></article>", "Title Lead. The text."),
    ("<article><header>Filed under news</header><h1>Title</h1><p>The text.</p></article>", "Title The text."),
    ("<article><p>The text.</p></article><article class='comment'><p>I agree.</p></article>", "The text."),
    ("<article><p>The text.</p><article class='comment'><p>I agree.</p></article></article>", "The text."),
    ("<form><p>Mail</p></form><h1>Title</h1><p>The text is longer than the form.</p>", "Title The text is longer than the form."),
])
def test_wrappers_headers_and_comments(page, want):
    assert page_template.main_text(page, [])[0] == want
