"""Literal cases of the function library: expected values are written by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import css as C
from quire.functions import markup as M
from quire.functions import paths as P
from quire.functions import text as X
from quire.functions import values as V
from quire.operators import contents
from quire.sources import ion


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tags_skip_comments_and_hold_quoted_brackets():
    h = """<p title='a>b' class="x">t<!-- <div> --><br/></p><![CDATA[<i>]]>a < b"""
    assert [(k, n) for _, k, n, _, _ in M.tags(h)] == [("open", "p"), ("other", ""), ("void", "br"), ("close", "p"), ("other", "")]
    assert h[: M.tags(h)[0][4]] == """<p title='a>b' class="x">"""


def test_entities_and_plain_text():
    assert M.unescape_entities("一&emsp;起&mdash;&#20013;&amp;emsp;&foo;&") == "一 起—中&emsp;&foo;&"
    assert M.plain_text("<h2>一&emsp;起</h2>") == "一 起"
    assert not M.has_visible("<p>&emsp;&nbsp;&#12288;</p>") and M.has_visible("<p>&hellip;</p>") and M.has_visible("<p><img src='x'/></p>")
    assert M.plain_text("<title>no</title><style>p{}</style>a<b>b</b> &nbsp; c<script>x<y</script>") == "ab c"
    assert M.xml_unescape("&apos;&#x41;&nbsp;") == "'A&nbsp;" and M.xml_escape('<a "&">') == "&lt;a &quot;&amp;&quot;&gt;"


def test_attributes():
    tag = "<a data-id='1' ID=\"two\" checked class=\"x y\"/>"
    assert M.attr_value(tag, "id") == "two" and M.attr_value(tag, "name") is None and M.attrs(tag)[2] == ("checked", "")
    assert M.set_attr("<p>", "id", "a") == '<p id="a">' and M.set_attr("<br/>", "id", "a") == '<br id="a"/>'
    assert M.set_attr('<p id="b" x="1">', "id", "a") == '<p id="a" x="1">' and M.remove_attr('<p id="b" x="1">', "id") == '<p x="1">'
    assert M.add_class('<p class="a">', "b") == '<p class="a b">' and M.add_class('<p class="a b">', "b") == '<p class="a b">' and M.has_class(tag, "y")
    h = """<p style="font-family:&quot;宋体&quot;;color:red">a</p><p style='color:red'>b</p>"""
    assert M.edit_style_attrs(h, lambda _, v: v.replace("red", "blue")) == """<p style="font-family:&quot;宋体&quot;;color:blue">a</p><p style="color:blue">b</p>"""


def test_style_blocks_are_raw_text():
    h = """<!-- <style>x{}</style> --><style title="a>b"><!-- p{} <b> --></style ><STYLE/><style>q{}</STYLE><style>r{}"""
    assert [b[1] for b in M.style_blocks(h)] == ["<!-- p{} <b> -->", "q{}"]


def test_spans_and_ids():
    h = '<div id="a"><p>x<br>y</p><p>z</div><a name="n">q</a>'
    assert [(s[0], s[1], h[s[3] : s[4]]) for s in M.spans(h)] == [("div", 0, '<p>x<br>y</p><p>z'), ("p", 1, "x<br>y"), ("br", 2, ""), ("p", 1, "z"), ("a", 0, "q")]
    assert [a for a, _ in M.anchors(h)] == ["a", "n"]
    assert M.matching_close("<b><b></b></b>", 0) == (10, 14) and M.matching_close("<b><b></b>", 0) is None
    assert M.collapse_duplicate_ids('<p id="a" class="c" id="b">') == '<p id="a" class="c">' and M.duplicate_id_tags('<p id="a" id="b"><p id="c">') == 1
    assert M.rename_ids('<p id="a"><a href="#a" name="b">', {"a": "a-x2"}) == '<p id="a-x2"><a href="#a-x2" name="b">'
    assert M.trim_tail("<body><p>a</p><p> </p><br/></body>") == "<body><p>a</p></body>"
    assert M.ensure_lang('<html lang="zh"><body>', "en") == '<html lang="zh" xml:lang="en"><body>'


@pytest.mark.parametrize("link", ["http://a/b", "mailto:x@y", "data:image/png;base64,AA", "//cdn/x.png", "urn:isbn:1"])
def test_external(spark, link):
    assert M.is_external(link) and one(spark, P.is_external(F.lit(link)))


@pytest.mark.parametrize("link", ["../Images/**::**.jpg", "a.xhtml#n:1", "Text/x:y.xhtml", "#frag", "", "1a:b", "*:x"])
def test_internal(spark, link):
    assert not M.is_external(link) and not one(spark, P.is_external(F.lit(link)))


def test_paths(spark):
    for path, want in {"a/./b//../c": "a/c", "../../a": "a", "/a/": "a", "": "", "a/..": ""}.items():
        assert one(spark, P.posix_norm(F.lit(path))) == want
    for base, path, want in [("a/b", "a/c/d.x", "../c/d.x"), ("", "a/b", "a/b"), ("a", "a/b", "b"), ("a/b", "c", "../../c"), ("a/b/c", "a/b/d", "../d")]:
        assert one(spark, P.relative_to(F.lit(base), F.lit(path))) == want
    assert one(spark, P.resolve(F.lit("a/b"), F.lit("../c"))) == "a/c" and one(spark, P.dir_of(F.lit("a/b/c"))) == "a/b" and one(spark, P.dir_of(F.lit("c"))) == ""
    assert tuple(one(spark, P.split_href(F.lit("a#b#c")))) == ("a", "b#c") and tuple(one(spark, P.split_href(F.lit("a")))) == ("a", None)
    assert P.percent_decode("a%20b%zz+%E4%B8%AD%ff") == "a b%zz+中�" and P.encode_href("a b/中~.x") == "a%20b/%E4%B8%AD~.x"
    assert P.resolve_link("t", "../a%20b.x?q&amp;r#n%201") == ("a b.x?q&r", "n 1") and P.resolve_link("t", "#x") == ("t", "x")
    names = ["p10.png", "p2.png", "P1.png", "p02b.png"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(P.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["P1.png", "p2.png", "p02b.png", "p10.png"]
    assert one(spark, P.is_html_entry(F.lit("x"), F.lit(" <?xml version='1.0'?>"))) and not one(spark, P.is_html_entry(F.lit("x.css"), F.lit("<html>")))


def test_sentences():
    assert X.sentences("他说：“好。”然后走了！真的?!  3.14 is pi. e.g. this") == ["他说：“好。”", "然后走了！", "真的?!  ", "3.14 is pi. ", "e.g. ", "this"]
    assert X.sentences("  a. \n") == ["a."] and X.sentences("no end") == ["no end"] and X.sentences("wait..ok. b") == ["wait..ok. ", "b"] and X.sentences(" \n") == []


def test_names_and_titles():
    assert X.norm("雪人 (小說)") == "雪人" and X.norm("１３級階梯") == "13級階梯" and X.norm("羅傑．艾克洛命案") == "羅傑艾克洛命案"
    assert X.similarity(X.norm("13級階梯"), X.norm("13級台階")) >= 0.75 > X.similarity("瘟疫", "鼠疫")
    c = X.parse_credits(["[美] 玛格丽特·米切尔 著，梅静 译"])
    assert c == {"authors": [{"name": "玛格丽特·米切尔", "nationality": "美"}], "translators": ["梅静"]}
    assert len(X.parse_credits(["（日）东野圭吾", "刘姿君"])["authors"]) == 2
    c = X.parse_credits(["甲、乙 著；丙 譯"])
    assert len(c["authors"]) == 2 and c["translators"] == ["丙"]
    assert X.author_for_query(["[美] 吉莉安•弗琳 著，胡绯 译"]) == "吉莉安•弗琳" and X.author_keys(["[美] 吉莉安•弗琳 著，胡绯 译"]) == [X.norm("吉莉安·弗琳")]


@pytest.mark.parametrize(
    "title,base",
    [
        ("飘（上册）", "飘"), ("金庸作品全集（修订版）", "金庸作品全集"), ("哆啦A夢 第01卷", "哆啦A夢"), ("死亡筆記 Vol.3", "死亡筆記"), ("飘 - 下册", "飘"),
        ("哆啦A夢全彩版 - 卷01", "哆啦A夢"), ("三体", None), ("三十六计", None), ("福尔摩斯探案全集", None), ("1984", None), ("波洛系列04：罗杰疑案", "罗杰疑案"),
    ],
)
def test_base_title(title, base):
    assert X.base_title(title) == base


def test_hits():
    assert X.form_marker("杀死一只知更鸟（漫）") == "（漫）" and X.form_marker("飘（上册）") is None
    assert X.hit_matches("金庸作品集", "金庸", "金庸作品全集", ["金庸"]) and not X.hit_matches("金庸作品集", "", "金庸作品全集", [])
    assert X.hit_matches("飘 下册", "[美] 米切尔 / 某某", "飘", ["米切尔"]) and not X.hit_matches("飘", "别人", "飘", ["米切尔"])
    assert X.pick_by_title("abcd", ["x", "abcde", "abc"]) is None and X.pick_by_title("abcd", ["abce", "abcd"]) == 1 and X.pick_by_title("abcd", ["abce", "x"]) == 0
    assert X.series_key("哆啦A夢 第01卷", ["乙、甲 著"]) == "哆啦a夢|" + "/".join(sorted(["乙", "甲"]))
    assert X.tags_without_authors(["1999", "金庸", "武侠"], ["金庸 著"]) == ["武侠"]


def test_numerals_dates_files():
    assert [X.section_number(t) for t in ("12", "１２", "十", "二十一", "九", "一一", "四十章", "")] == [12, 12, 10, 21, 9, None, None, None]
    assert [X.partial_date(t) for t in ("2019年3月1日", "2019-13-1", "0999", "x", "2019.2.31x")] == ["2019-03-01", "2019", None, None, "2019-02-31"]
    assert X.issue_date("2019年3月") == "2019-03-01" and X.issue_date("?") is None
    assert X.sanitize_filename(".a/b:c\x00") == "_a_b_c_" and len(X.sanitize_filename("中" * 90).encode()) == 198
    assert X.fnv64("") & 0xFFFFFFFFFFFFFFFF == 0xCBF29CE484222325 and X.fnv64("a") & 0xFFFFFFFFFFFFFFFF == 0xAF63DC4C8601EC8C
    assert X.latin1_encode("a中é") == b"a?\xe9"


def test_script(spark):
    counts = lambda t: X.script_counts(F.lit(t))
    lang = lambda t, least=4: one(spark, X.script_of(counts(t), least))
    assert lang("中文汉字") == "zh" and lang("これはかな漢字") == "ja" and lang("한국어 글") == "ko" and lang("some words") == "en" and lang("ab") is None and lang("中文abcdefghij") is None
    fits = lambda a, b: one(spark, X.language_fits(F.lit(a), F.lit(b)))
    assert fits("zh", "ja") and fits("fr", "en") and not fits("fr", "zh") and not fits("und", "en") and not fits("zh", "en")


@pytest.mark.parametrize(
    "text,color",
    [
        ("#01a0ea", 0xFF01A0EA), ("#fff", 0xFFFFFFFF), ("#f008", 0x88FF0000), ("#01a0ea80", 0x8001A0EA), ("#12345", None), ("#+12", None), ("rgb(255, 0, 0)", 0xFFFF0000),
        ("rgba(128, 0, 0, 0.7)", 0xB2800000), ("rgba(245, 245, 220, 0.5)", 0x7FF5F5DC), ("rgb(100%, 0%, 50%)", 0xFFFF0080), ("rgba(0, 0, 0, 50%)", 0x7F000000), ("rgba(1, 2, 3, )", None), ("rgb(inf, 0, 0)", None),
    ],
)
def test_colors(spark, text, color):
    assert one(spark, V.parse_color(F.lit(text))) == color


def test_numbers(spark):
    length = lambda t: one(spark, V.parse_len(F.lit(t)))
    assert tuple(length("1.5em")) == (1.5, "em") and tuple(length("30%")) == (30.0, "percent") and tuple(length("4px")) == (3.0, "pt") and length("5") is None and tuple(length("0")) == (0.0, "em")
    assert one(spark, V.contrast(F.lit(0xFF000000), F.lit(0xFFFFFFFF))) == pytest.approx(21.0)
    assert one(spark, V.over_white(F.lit(0x80000000))) == one(spark, V.over(F.lit(0x80000000), F.lit(0xFFFFFFFF)))
    assert one(spark, V.column_percents(F.expr("array(10.0D, 30.0D, null, 5.0D)"))) == [22.2222, 66.6667]
    assert [one(spark, V.collapse(F.lit(a), F.lit(b))) for a, b in ((3, 5), (-3, -5), (4, -1))] == [5, -5, 3]
    assert tuple(one(spark, V.fit_page(F.lit(100), F.lit(50), 1000, 1000, F.lit(True)))) == (300, 150)
    assert tuple(one(spark, V.fit_page(F.lit(2000), F.lit(999), 1000, 1000, F.lit(False)))) == (1000, 500)
    assert one(spark, V.megabytes(F.lit(1_540_000))) == "1.5 MB" and one(spark, V.container_id(F.lit(33))) == "0" * 26 + "11"
    assert one(spark, V.shortfall(F.lit(10), F.lit(30), F.lit(5), F.lit(0), F.lit(0))) == 5 + (50 << 20)
    table = one(spark, V.autocontrast_table(F.lit(20), F.lit(220)))
    assert (table[0], table[20], table[120], table[255]) == (0, 0, 128, 255) and one(spark, V.autocontrast_table(F.lit(20), F.lit(100))) is None
    assert one(spark, X.utc_w3c(F.lit(86399 + 86400 * 365))) == "1971-01-01T23:59:59Z"


def test_sheets():
    css = '@charset "utf-8"; /* { */ p { content: \'}\'; color: red }\n@media screen { .a { x: 1 } @supports (y) { .b { z: 2 } } }\n@font-face { font-family: f }\n}{orphan} .c { q: 1'
    got = [(C.selector_of(p), b.strip(), parents, closed) for p, b, parents, closed in C.rule_spans(css)]
    assert got[:4] == [("p", "content: '}'; color: red", [], True), (".a", "x: 1", ["@media screen"], True), (".b", "z: 2", ["@media screen", "@supports (y)"], True), ("@font-face", "font-family: f", [], True)]
    assert got[-1] == (".c", "q: 1", [], False)
    assert C.strip_comments("a/* x */b 'c/*d*/' /* open") == "a b 'c/*d*/'  "
    assert C.tokens('1px/**/solid  "A B"\trgb(0, 0, 0)') == ["1px", "solid", '"A B"', "rgb(0, 0, 0)"]
    assert C.four_values("1px 2px 3px 4px 5px") is None and C.four_values("calc(1em + 2px) 0") == ["calc(1em + 2px)", "0", "calc(1em + 2px)", "0"]
    assert C.declarations("color: red ! important; margin: 0;;x") == [("color", "red", True), ("margin", "0", False)]
    u = C.urls("""a{background:URL( "x y.png" )} b{src:url('f.ttf') format("truetype"),url(g.otf)}""")
    assert [x[:2] for x in u] == [("x y.png", '"'), ("f.ttf", "'"), ("g.otf", None)]
    lone = "p { font-family: \"Georgia;\n color: gray }\nh1 { color: red }"
    assert [C.selector_of(r[0]) for r in C.rule_spans(lone)] == ["p", "h1"]
    r = C.rules("@media print { p { color: blue } } @supports (x) { p { a: b } } [title=\"a;b\"], p.x { margin: 1em 2em }")
    assert [(x["selector"], x["bucket"]) for x in r] == [('[title="a;b"]', "*"), ("p.x", ".x")] and [d["prop"] for d in r[1]["decls"]] == ["margin-top", "margin-right", "margin-bottom", "margin-left"]
    assert C.drop_dead_faces("@font-face{src:url(a.ttf)} p{} @font-face{src:url(b.ttf)} @font-face{src:local(x),url(c.ttf)}", ["b.ttf"]) == " p{} @font-face{src:url(b.ttf)} @font-face{src:local(x),url(c.ttf)}"


@pytest.mark.parametrize(
    "selector,want",
    [
        ("p", (0, 0, 1)), ("p.a", (0, 1, 1)), ("#x .a span", (1, 1, 1)), ("div > p:first-child", (0, 1, 2)), ("*", (0, 0, 0)), ("li:nth-child(2n+1)", (0, 1, 1)), ("p:not(.a)", (0, 1, 1)),
        ("p:not(#x, span)", (1, 0, 1)), ("p:where(.a #b)", (0, 0, 1)), ("p:is(div p, .a)", (0, 1, 1)), ("p::first-line", (0, 0, 2)), ("p:before", (0, 0, 2)), ("a[href='x y']:lang(zh-Hant)", (0, 2, 1)), (r"p.a\.b", (0, 1, 1)), ('a[title=")"]:not(.x)', (0, 2, 1)),
    ],
)
def test_specificity(selector, want):
    assert C.specificity(selector) == want


def test_media():
    env = {"width": 1104.0, "height": 1546.0, "device_width": 1272.0, "device_height": 1696.0, "color": False}
    yes = ["", "all", "screen", "amzn-kf8", "only screen", "not amzn-mobi", "not print", "print, screen", "SCREEN", "screen and (min-width: 600px)", "(max-width: 1104px)", "(min-height: 1500px) and (orientation: portrait)"]
    yes += ["(min-device-width: 1272px)", "(max-aspect-ratio: 3/4)", "(monochrome)", "not (color)", "(min-width: 10in)", "(color: 0)", "not screen and (max-width: 480px)"]
    no = ["print", "amzn-mobi", "not screen", "screen and", "screen (min-width: 1px)", "and (color)", "screen and (max-width: 480px)", "(min-width: 1105px)", "(orientation: landscape)", "(color)"]
    no += ["(min-width: 30em)", "not screen and (min-width: 30em)", "(min-resolution: 2dppx)", "(width >= 600px)", "(min-monochrome: 4)", "(min-width: 600px) or (color)"]
    assert [q for q in yes if not C.media_ok(q, env)] == [] and [q for q in no if C.media_ok(q, env)] == []
    assert C.media_ok("screen") and not C.media_ok("screen and (min-width: 1px)")


def test_contents(spark):
    assert contents.collection_depths(["上册", "甲书", "前言", "第一章 a", "第二章 b", "下册", "乙书", "第一部", "第一章", "后记"]) == [1, 2, 3, 3, 3, 1, 2, 3, 4, 2]
    assert contents.collection_depths(["第一章", "第二章"]) is None
    assert contents.nest_parts([(1, "书"), (2, "序"), (2, "第一部 x"), (2, "第一章"), (3, "节"), (2, "第二部"), (2, "第一章"), (1, "书二")]) == [1, 2, 2, 3, 4, 2, 3, 1]
    rows = [{"depth": 1, "label": "a", "target": "a.x"}, {"depth": 3, "label": "b&", "target": "b.x"}, {"depth": 1, "label": "c", "target": "c.x"}]
    assert contents.write_nav(rows) == '<ol><li><a href="a.x">a</a><ol><li><a href="b.x">b&amp;</a></li></ol></li><li><a href="c.x">c</a></li></ol>'
    from quire.sources import books

    assert books.nav_points(contents.write_ncx(rows)) == [(1, "a", "a.x"), (2, "b&", "b.x"), (1, "c", "c.x")]
    assert books.nav_items(f'<nav epub:type="toc">{contents.write_nav(rows)}</nav>') == [(1, "a", "a.x"), (2, "b&", "b.x"), (1, "c", "c.x")]
    assert one(spark, contents.dense_levels(F.expr("array(2, 4, 2, 6)"))) == [1, 2, 1, 3]
    assert [r["page"] for r in one(spark, contents.page_chunks(F.sequence(F.lit(1), F.lit(45))))] == [1, 21, 41]


def test_ion():
    values = [None, True, 0, -5, 1 << 70, 0.0, 1.5, 0.1, Decimal("-1.50"), Decimal(0), ion.Symbol(300), "é" * 20, b"\x00\x01", [1, [2, ion.SExp([3])]], {4: "x", 200: {5: None}}, ion.Annotated((9, 10), {1: 2})]
    assert ion.decode(ion.encode(values)) == values
    assert ion.encode_value(1) == b"\x21\x01" and ion.encode_value("abc") == b"\x83abc" and ion.encode_value(-1) == b"\x31\x01"
    assert ion.decode(ion.MARK + b"\x03\xff\xff\xff" + b"\x20") == [0]
    for bad in (b"", b"\xe0\x01\x00\xea\xf0", b"\xe0\x01\x00\xea\x85ab", b"\xe0\x01\x00\xea\x31\x00", ion.MARK + b"\xb1" * 200 + b"\x20"):
        with pytest.raises(ion.IonError):
            ion.decode(bad)
    assert ion.compress_ids([5, 1, 2, 3, 9, 9]) == [[1, 3], [5], [9]]
