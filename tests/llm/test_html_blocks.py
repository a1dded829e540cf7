"""Main-text extraction on hand-made pages and on the test pages."""

import html
import re
import time

import pytest

from pyspark.sql import types as T

from tutorlens.llm import html_blocks as hb

LONG = ("The report that was given to the council is about the state of the river and of the land that lies by it, "
        "and it says that the work which was done in the last year has not been in vain for the people of the town.")
LONG2 = ("It was not the first time that the water had come up to the houses, and they had to go to the upper rooms "
         "with all that they could carry, as it was in the days of their fathers, which no one had forgotten.")


def text(page):
    return "\n".join(b.text for b in hb.main_blocks(page))


def test_marked_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T of the page</title><style>p{{}}</style></head><body>
    <header><h1>Site of the town</h1><p>{LONG}</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
    <div class="cookie-notice">{LONG}</div><main><article><header><h1>Water &amp; land</h1></header>
    <p>{LONG}<script>var a = "</p>";</script><p>Short.<br>Line two<div class="ad-box">{LONG2}</div><p class=x>{LONG2}
    <form><label>Mail</label><input><button>Send the form</button></form>
    <section id="comments"><p>{LONG2} I agree with it.</p></section></article></main>
    <aside>{LONG}</aside><div class="sidebar"><p>{LONG}</p></div><footer>&copy; all of it {LONG}</footer></body></html>"""
    assert text(page) == f"Water & land\n{LONG}\nShort. Line two\n{LONG2}"


def test_densities_decide_where_nothing_is_marked():
    links = " ".join(f'<a href="{i}">the item of the list {i}</a>' for i in range(12))
    junk = "lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore " * 3
    page = f"<body><div>Menu</div><div>{links}</div><h2>Heading</h2><div>{LONG}</div><div>Yes.</div><div>{LONG2}</div>" \
           f"<div>{links}</div><div>Contact</div><div>{junk}</div><div>All rights © 2020 of the town and of the land</div></body>"
    assert text(page) == f"Heading\n{LONG}\nYes.\n{LONG2}"


def test_first_and_second_pass_labels():
    block = lambda t, linked=0, zone=0, bad=False: hb.Block(t, linked, False, zone, bad)
    assert hb.first_pass(block(LONG + LONG)) == hb.GOOD
    assert hb.first_pass(block("Short one")) == hb.SHORT
    assert hb.first_pass(block(LONG, linked=150)) == hb.BAD
    assert hb.first_pass(block(LONG, bad=True)) == hb.BAD
    blocks = [block("a"), block("b"), block("c"), block("d")]
    assert hb.second_pass(blocks, [hb.BAD, hb.SHORT, hb.SHORT, hb.GOOD], hb.BAD) == [hb.BAD] * 3 + [hb.GOOD]
    assert hb.second_pass(blocks, [hb.GOOD, hb.SHORT, hb.NEAR, hb.GOOD], hb.BAD) == [hb.GOOD] * 4
    assert hb.second_pass(blocks, [hb.BAD, hb.NEAR, hb.SHORT, hb.BAD], hb.BAD) == [hb.BAD] * 4


def test_broken_markup_never_fails():
    for page in ["", "<", "<p", "<!--", "<!-- x", "<script>", "</p></div>", "<a href='x>", "a<b>c", "&#xZZ;&amp", "<p>" * 3000,
                 "<div><div>" + LONG, "\x00<p>퟿", "<svg><p>x", "<p title='>'>" + LONG + "</p>"]:
        hb.main_blocks(page)
    assert text("<div><div>" + LONG) == LONG


def test_pages_of_the_test_tables():
    import duckdb
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    same = 0
    for (page,) in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer)", page, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        same += text(page) == "\n".join(x for x in want if x)
    assert same == len(rows)


SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("url", T.StringType()), (
    "html", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType()))])


def test_extract_table(spark):
    rows = [(1, "u", f"<p>{LONG}</p>"), (2, None, None), (None, "v", ""), (3, "w", f"<article>{LONG * 400}</article>"),
            (1, "u", f"<p>{LONG}</p>"), (4, "x", "<nav>a</nav>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = {(r["page_id"], r["url"]): r for r in hb.extract(pages).collect()}
    assert hb.extract(pages).count() == len(rows)
    assert got[1, "u"]["text"] == LONG and got[1, "u"]["n_chars"] == len(LONG)
    assert got[2, None]["text"] == got[None, "v"]["text"] == got[4, "x"]["text"] == ""
    assert got[3, "w"]["text"] == LONG * 400
    assert hb.extract(pages.where("page_id > 9")).count() == 0


def test_names_on_wrappers_do_not_damn_the_article():
    for wrapper in ("layout has-sidebar", "no-comments", "withSidebar", "post-share", "page-with-nav sidebar-right"):
        for body in (f"<p>{LONG}</p><p>{LONG2}</p>", f"<article><p>{LONG}</p><p>{LONG2}</p></article>"):
            page = f"<body><div>Menu</div><div class='{wrapper}'>{body}<div class='sidebar'><p>{LONG}</p></div></div></body>"
            assert text(page) == f"{LONG}\n{LONG2}", (wrapper, body)


def test_names_of_parts_still_damn_them():
    for part in ("sidebar", "related-posts", "comments", "cookie-notice"):
        assert text(f"<body><div><p>{LONG}</p><p>{LONG2}</p></div><div class='{part}'><p>{LONG}</p></div></body>") == f"{LONG}\n{LONG2}"
        assert text(f"<main><p>{LONG}</p></main><div class='{part}'><article><p>{LONG2}</p></article></div>") == LONG
    assert text(f"<div><p>{LONG}</p></div><div id='comments'>{f'<p>{LONG2}</p>' * 30}</div>") == LONG
    assert text(f"<div class='has-nav' style='display:none'><article><p>{LONG}</p></article></div>") == ""


OTHER_LANGUAGES = [
    "Вчера в городе прошло собрание, на котором жители обсуждали состояние реки и дороги. Глава района сообщил, что работы "
    "начнутся весной, когда сойдёт снег, и продлятся до конца лета, если хватит средств и рабочих рук.",
    "昨天市议会召开会议，讨论河流和周边土地的状况。市长表示，去年所做的工作没有白费，镇上的居民对此感到满意。今年春天将开始修复堤坝，预计夏末完成。专家们认为这项工程十分重要。",
    "Wczoraj w mieście odbyło się zebranie, na którym mieszkańcy rozmawiali o stanie rzeki i drogi. Burmistrz powiedział, że prace "
    "zaczną się na wiosnę, kiedy stopnieje śnieg, i potrwają do końca lata, jeżeli wystarczy na to środków oraz rąk do pracy.",
    "Dün belediye binasında yapılan toplantıda nehir ve çevresindeki arazi için hazırlanan rapor görüşüldü. Başkan, geçen yıl yapılan "
    "çalışmaların boşa gitmediğini ve bu yıl daha çok iş yapılacağını söyledi, ama bütçe için bir karar çıkmadı.",
    "Hôm qua hội đồng thành phố đã họp để bàn về tình trạng con sông cùng vùng đất xung quanh. Thị trưởng cho biết công việc năm "
    "ngoái không hề vô ích, người dân thị trấn rất hài lòng với kết quả đạt được sau nhiều tháng lao động vất vả.",
]


def test_articles_in_other_languages():
    links = " ".join(f'<a href="{i}">Ссылка Link {i} Ссылка</a>' for i in range(12))
    for own in OTHER_LANGUAGES:
        page = f"<body><div>{links}</div><div>{own}</div><p>{own}</p><div>{links}</div><div>© {own}</div>" \
               f"<div class='sidebar'>{own}</div></body>"
        assert text(page) == f"{own}\n{own}", own
    mixed = f"<body><div>{OTHER_LANGUAGES[0]}</div><div>{OTHER_LANGUAGES[0]}</div><div>{LONG}</div></body>"
    assert text(mixed) == f"{OTHER_LANGUAGES[0]}\n{OTHER_LANGUAGES[0]}\n{LONG}"


@pytest.mark.parametrize("unit", ["<a ", "<a '", "<a \"'", "<a '>'", "<script ", "</ ", "<!-- ", "</p ", "<i></b>", "<b><div><i></b>", "<p class=ad>",
                                  "<div class=widget>", "<div class='ad x'><div class=widget>", "<a title='>", "<li><ul>", "<![", "&amp", "<td><b>"])
def test_broken_pages_take_time_in_proportion(unit):
    hb.main_blocks("<p>" + unit * 1000)
    took = time.perf_counter()
    hb.main_blocks("<p>" + unit * 100_000 + f"<p>{LONG}</p>")
    assert time.perf_counter() - took < 5


def test_a_truncated_page_keeps_what_comes_before():
    assert text(f"<div>{LONG}</div><div>{LONG2}</div><a href='x") == f"{LONG}\n{LONG2}"
    assert text(f"<div>{LONG}</div><a title='>'><p>{LONG2}</p><a title='x") == f"{LONG}\n{LONG2}"


def test_paragraphs_in_widgets_of_their_own():
    body = "".join(f"<div class='row'><div class='widget w-{i}'><p>{LONG}</p></div></div>" for i in range(100))
    assert text(f"<body>{body}</body>") == "\n".join([LONG] * 100)
    page = f"<body><div><p>{LONG}</p><p>{LONG2}</p></div>" + f"<div class='widget'><p>{LONG}</p></div>" * 2 + "</body>"
    assert text(page) == f"{LONG}\n{LONG2}"
    ads = f"<div class='widget ad'><p>{LONG2}</p></div>"
    assert text(f"<body>{body}{ads}</body>") == "\n".join([LONG] * 100)
    nested = "<div class=widget>" * 500 + f"<p>{LONG}</p><p>{LONG2}</p>" + "</div>" * 500
    assert text(nested) == f"{LONG}\n{LONG2}"


def plain_labels(labels, edge):
    """The second pass, written out: a short block follows its nearest decided neighbours, then one that is only near does."""
    def nearest(own, i, step):
        j = i + step
        while 0 <= j < len(own) and own[j] == hb.SHORT:
            j += step
        return own[j] if 0 <= j < len(own) else edge

    out = []
    for i, x in enumerate(labels):
        if x == hb.SHORT:
            a, b = nearest(labels, i, -1), nearest(labels, i, 1)
            a, b = a or b or hb.GOOD, b or a or hb.GOOD
            x = hb.BAD if hb.BAD in (a, b) and (hb.GOOD not in (a, b) or edge == hb.BAD) else hb.GOOD
        out.append(x)
    sure = [hb.SHORT if x == hb.NEAR else x for x in out]
    final = []
    for i, x in enumerate(out):
        if x == hb.NEAR:
            a, b = nearest(sure, i, -1), nearest(sure, i, 1)
            a, b = a or b or hb.GOOD, b or a or hb.GOOD
            x = hb.BAD if a == b == hb.BAD and edge == hb.BAD else hb.GOOD
        final.append(x)
    return final


def test_second_pass_against_a_plain_one():
    import itertools
    for size in range(1, 6):
        for labels in itertools.product((hb.GOOD, hb.BAD, hb.NEAR, hb.SHORT), repeat=size):
            blocks = [hb.Block("x", 0, False, 0, False) for _ in labels]
            for edge in ("", hb.BAD):
                assert hb.second_pass(blocks, list(labels), edge) == plain_labels(list(labels), edge), (labels, edge)
