"""Main text: templates by recurrence alone, structure, long and hostile pages."""

import time

from pyspark.sql import functions as F

from webloom.llm import html_text
from webloom.llm.common import table

MENU = "<div><ul><li><a href=/a>Home</a><li><a href=/b>Shop</a></ul><div>Call us any day</div></div>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_recurrence_alone(spark):
    rows = [(i, f"http://a.org/{i}", f"<body>{MENU}<div><p>story {i}<p>common line</div>{MENU}</body>") for i in range(9)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body>{MENU}<div><p>tale {i}</div></body>") for i in range(4)]  # too few pages
    rows += [(30 + i, f"http://c.org/{i}", f"<body>{MENU}<div><p>the same tale</div></body>") for i in range(9)]  # copies of one page
    got = {r["page_id"]: r["text"] for r in html_text.texts(frame(spark, rows)).collect()}
    assert [got[i] for i in range(9)] == [f"story {i}\ncommon line" for i in range(9)]
    assert got[21] == "Home\nShop\nCall us any day\ntale 1" and got[31] == "Home\nShop\nCall us any day\nthe same tale"


def test_many_pages_suffice(spark):
    box = "<section>Read all our other stories every day of the week</section>"
    rows = [(i, f"http://a.org/{i}", f"<p>story {i} of the many that we have here{box if i % 60 == 0 else ''}") for i in range(480)]
    df = frame(spark, rows)
    assert [r["n"] for r in html_text.templates(html_text.parsed(df), many=8).collect()] == [8] and html_text.templates(html_text.parsed(df)).count() == 0


def test_tables_have_templates(spark):
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    found = html_text.parsed(pages)
    gone = html_text.templates(found).collect()
    assert gone and all(r["n"] >= html_text.MIN_PAGES for r in gone)
    n, by_template, by_structure = html_text.deletions(pages).agg(F.sum("n_blocks"), F.sum("by_template"), F.sum("by_structure")).first()
    assert by_template > 1000 and by_template + by_structure < n


def test_templates_go_before_the_main_part_is_chosen(spark):
    """A recurring article element with a teaser doesn't hide the main element, and a recurring menu without marks goes from within an article."""
    teaser = "<div><article>Subscribe to us today</article></div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{teaser}<main><p>{'the tale of number ' * 8}{i}</main></body>") for i in range(9)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><article><p>story {i} {'goes on ' * 9}</p>{MENU}</article></body>") for i in range(9)]
    with_it = {r["page_id"]: r["text"] for r in html_text.texts(frame(spark, rows)).collect()}
    without = {r["page_id"]: r["text"] for r in html_text.texts(frame(spark, rows), min_pages=100).collect()}
    assert [with_it[i] for i in range(9)] == ["the tale of number " * 8 + str(i) for i in range(9)]
    assert [with_it[20 + i] for i in range(9)] == [f"story {i} {'goes on ' * 9}".strip() for i in range(9)]
    assert without[3] == "Subscribe to us today" and without[23].endswith("Call us any day")


def test_lists_of_templates_beyond_the_broadcast(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    sets = [html_text.judged(pages, min_pages=2, broadcast_bytes=n).orderBy("page_id").collect() for n in (0, 1 << 20)]
    assert sets[0] == sets[1] and any(x < 0 for r in sets[0] for x in r["levels"])


def text_of(html):
    page = html_text.Page(html)
    levels = page.levels()
    return "\n".join(b for b, x in zip(page.blocks, levels, strict=True) if x == max(levels) > 0)


def test_nothing_else_is_dropped():
    inside = "let <math><mi>x</mi></math> be <svg><text>drawn</text></svg> <select><option>one</select> <output>4</output> <canvas>c</canvas> <object>o</object> <audio>a</audio>"
    assert text_of(f"<article><p>{inside}</p></article>") == "let x be drawn one 4 c o a"
    kept = "<p class='related-work'>r</p><div class='social-science'>s</div><p class='promoted'>p</p><div class='no-sidebar'>n</div><h2 id='share-price'>h</h2>"
    assert text_of(f"<article>{kept}</article>") == "r\ns\np\nn\nh"
    gone = "<div class='related-posts'>r</div><div class='cookieNotice'>c</div><ul id=share_buttons><li>s</ul><p class=ad-1>a</p><div class='comments'>x</div>"
    assert text_of(f"<article>t{gone}</article>") == "t"
    assert text_of("a <!-- b") == "a" and text_of("x<3 &amp; y < z") == "x<3 & y < z" and text_of("<p>a<p>b</i>c") == "a\nbc"


def test_hostile_pages_are_linear():
    n = 1 << 20
    pages = [
        "<a " * (n // 3), "<div>" * (n // 10) + "</b>" * (n // 8), "<div>" * (n // 5), "<" * n, "<a '" * (n // 4) + ">", "<!-- " * (n // 5), "</p " * (n // 4) + "\"",
        "<ul><li><ul>" + "<div>" * (n // 10) + "<li></li>" * (n // 18), "<p>" * (n // 3), "<div>x" * (n // 6) + "</div>" * 9, "<table>" + "<td>" * (n // 4), "<title>" * (n // 7), "&" * n,
    ]
    for html in pages:
        began = time.thread_time()
        page = html_text.Page(html)
        page.parts(page.main(page.levels()))
        assert time.thread_time() - began < 8, html[:20]
