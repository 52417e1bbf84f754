"""Column functions on literal rows."""

import html as stdlib_html
import random
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import chat, grading, html, lexicon, urls, verdicts


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def one(spark, texts, build):
    return values(spark, [(t,) for t in texts], "t string", build(F.col("t")))


# -- links ----------------------------------------------------------------------


def url_model(text):
    """The intended meaning of link extraction, written out in plain Python."""
    found = []
    for match in re.finditer(rubric.URL_COMPAT, text, re.IGNORECASE):
        if len(match.group(0)) > 3:
            found.append(match.group(0))
    ordered = sorted(set(found), key=lambda u: (-len(u), u))
    kept = [u for u in ordered if not any(u != o and u in o for o in ordered)]
    return [u if u.startswith(("http://", "https://")) else "https://" + u for u in kept]


TEXTS = [
    "nothing here",
    "see www.example.com and example.com, also www.example.com.",
    "HTTP://Example.COM/path?x=1 then http://a.bc",
    "看www.a-b.com吧 a.cn。",
    "one.two.three.four.five",
    "aa.bb cc.dd aa.bb",
    "233.233.171 me@mail.example.org",
    "",
]


def test_urls_match_the_model(spark):
    assert one(spark, TEXTS, urls.extract_urls) == [url_model(t) for t in TEXTS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("ab.-/: 看éHTtps:", max_size=40), min_size=1, max_size=30))
def test_urls_match_the_model_on_random_text(spark, texts):
    assert one(spark, texts, urls.extract_urls) == [url_model(t) for t in texts]


def test_full_pattern_keeps_paths(spark):
    text = "go to https://a.b.c.example.com:8080/x/y?z=1#top, or shop.example.net/buy!"
    got = one(spark, [text], lambda t: urls.extract_urls(t, rubric.URL_FULL))[0]
    assert got == ["https://a.b.c.example.com:8080/x/y?z=1#top", "https://shop.example.net/buy"]


def test_clean_tail(spark):
    cases = {
        "a.com!!": "a.com",
        "a.com看": "a.com",
        "a.com!看": "a.com",
        "a.com看!": "a.com",
        "！？。，": "",
        "@@@@@": "@@@@@",
        "abc)看": "abc)",
        "a.c": "",
        "a.com/": "a.com/",
    }
    assert one(spark, list(cases), urls.clean_tail) == list(cases.values())


def test_no_kept_link_is_part_of_another(spark):
    kept = one(spark, TEXTS, lambda t: urls.maximal(urls.longest_first(urls.find_urls(t))))
    for links in kept:
        assert not any(a != b and a in b for a in links for b in links)


def test_url_key(spark):
    got = one(
        spark,
        ["https://A.com/X/", "http://a.com/X#top", "a.com/X", "HTTPS://a.com?q=B"],
        urls.url_key,
    )
    assert got == ["a.com/X", "a.com/X", "a.com/X", "a.com?q=B"]


# -- pages ----------------------------------------------------------------------


def squeeze_model(text):
    """Trimmed phrases, ended by a line end or two spaces, joined by a space."""
    phrases = []
    for line in text.splitlines():
        for phrase in line.strip().split("  "):
            if phrase.strip():
                phrases.append(phrase.strip())
    return " ".join(phrases)


class TextOfPage(HTMLParser):
    """Text nodes of a page as the parser of the standard library finds them."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=False)
        self.parts, self.hidden = [], 0
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(html.entity_table().get(name, f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(stdlib_html.unescape(f"&#{name};"))


def test_page_text_equals_a_parser_on_whole_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = pages.select("html", html.page_text(F.col("html"), None).alias("t")).collect()
    assert len(got) > 10
    for row in got:
        assert row["t"] == squeeze_model("".join(TextOfPage(row["html"]).parts))


MARKUP = ["<p>", "</p>", "<br/>", "<a href='x>y'>", "</a>", "<!-- c -->", "<script>1<2</script>",
          "<style>a</style>", "&amp;", "&lt;", "&copy;", "&eacute;", "&#233;", "&#x4e2d;", "word",
          "é", " ", "  ", "\n", "\t", "1 < 2", "a & b"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pages=st.lists(st.lists(st.sampled_from(MARKUP), max_size=15), min_size=1, max_size=30))
def test_page_text_equals_a_parser_on_random_markup(spark, pages):
    texts = ["".join(parts) for parts in pages]
    expected = [squeeze_model("".join(TextOfPage(t).parts)) for t in texts]
    assert one(spark, texts, html.page_text) == expected


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(
        st.text("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　", max_size=30),
        min_size=1,
        max_size=40,
    )
)
def test_squeeze_matches_the_model(spark, texts):
    assert one(spark, texts, html.squeeze) == [squeeze_model(t) for t in texts]


def test_page_text(spark):
    pages = {
        "<p>a</p><p>b</p>": "ab",
        "<p>a\n</p><p> b  c </p>": "a b c",
        '<script>var t="</p>";</script>x<style>p{}</style>y': "xy",
        "a<!-- <b>no</b> -->b": "ab",
        "<!DOCTYPE html><title> T &amp; U </title>body": "T & U body",
        '<a title="x > y">link</a>': "link",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "<script>never closed": "",
        "&lt;b&gt; &#65;&#x42; &unknown; &copy 1 &#0; &#x80; &amp;lt;": (
            "<b> AB &unknown © 1 � € &lt;"
        ),
        "<p>caf&eacute;</p>": "café",
        "": "",
    }
    got = one(spark, list(pages), html.page_text)
    assert got == list(pages.values())


def test_page_text_is_cut_only_when_longer(spark):
    got = one(spark, ["x" * 2000, "x" * 2001], html.page_text)
    assert got == ["x" * 2000, "x" * 2000 + "..."]
    whole = one(spark, ["x" * 2001], lambda t: html.page_text(t, None))
    assert whole == ["x" * 2001]


def test_page_title(spark):
    pages = ["<p>x</p>", "<title></title>", "<TITLE lang='x'>\n A &amp; B </TITLE>",
             "<!-- <title>no</title> --><title>yes</title>"]
    assert one(spark, pages, html.page_title) == [rubric.NO_TITLE, "", "A & B", "yes"]


def test_known_entities_agree_with_the_standard_table(spark):
    names = list(html.entity_table())[:300]
    got = one(spark, [f"&{n};" for n in names], html.unescape)
    assert got == [stdlib_html.unescape(f"&{n};") for n in names]


# -- verdicts -------------------------------------------------------------------


def test_verdict_rating(spark):
    replies = {
        '{"rating": 3}': 3.0,
        '```json\n{"rating": 4}\n```': 4.0,
        'I say {"rating": 3.5} so': 3.5,
        "no braces": 0.0,
        "} reversed {": 0.0,
        '{"rating": "3"}': 0.0,
        '{"rating": [3]}': 0.0,
        '{"rating": 0}': 0.0,
        '{"rating": -1}': 0.0,
        '{"rating": 7}': 7.0,
        '{"advice": "x"}': 0.0,
        '{"rating": 3} and {"rating": 4}': 0.0,
        '{"rating": 3}, {"rating": 4}': 0.0,
        '{"rating": NaN}': 0.0,
        "{'rating': 3}": 0.0,
        "": 0.0,
    }
    assert one(spark, list(replies), verdicts.verdict_rating) == list(replies.values())


def test_clean_json_is_left_alone(spark):
    text = ['{"rating": 3, "advice": "a {b} c"}']
    assert one(spark, text, verdicts.json_slice) == text
    assert one(spark, text, verdicts.strip_fence) == text


def test_strip_fence(spark):
    cases = {
        "```json{}```": "{}",
        "```json\n{}": "{}",
        "{}\n```": "{}",
        " ```json {} ``` ": " ```json {} ``` ",
        "{} ": "{} ",
        "{}\n```\n": "{}\n```\n",
    }
    assert one(spark, list(cases), verdicts.strip_fence) == list(cases.values())


def test_reply_content(spark):
    replies = ['{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[]}',
               '{"choices":[{"message":{"content":""}}]}', "no json"]
    assert one(spark, replies, verdicts.reply_content) == ["hi", None, None, None]


def test_page_or_text(spark):
    replies = ['{"url":"u","content":"c","status":"error","error":"e"}', "plain text", "[1]"]
    got = one(spark, replies, lambda t: verdicts.page_or_text(t, F.lit("v")))
    assert [(r.url, r.content, r.status) for r in got] == [
        ("u", "c", "error"), ("v", "plain text", "success"), ("v", "[1]", "success"),
    ]


# -- chat and grading -----------------------------------------------------------

ELEMENT = "array<struct<MsgType:string,MsgContent:struct<Text:string,Desc:string,Data:string>>>"


def test_first_text(spark):
    text = lambda t: ("TIMTextElem", (t, None, None))
    bodies = [[], [("TIMImageElem", None), text("a")], [text(None), text("b")],
              [text("a"), text("b")], None, [("TIMTextElem", None)]]
    got = values(spark, [(b,) for b in bodies], f"b {ELEMENT}", chat.first_text(F.col("b")))
    assert got == [None, "a", None, "a", None, None]


def test_conversation_key(spark):
    pairs = [("b", "a"), ("a", "a"), ("a-b", "c"), (None, "a"), ("Z", "a")]
    got = values(spark, pairs, "x string, y string", chat.conversation_key(F.col("x"), F.col("y")))
    assert got == ["a-b", "a-a", "a-b-c", None, "Z-a"]


def test_tiers_and_advice(spark):
    ratings = [(None,), (0.0,), (2.9,), (3.0,), (4.0,), (5.0,), (7.0,)]
    tiers = values(spark, ratings, "r double", grading.action_tier(F.col("r")))
    assert tiers == ["none", "none", "none", "notice", "alert", "alert", "alert"]
    advice = values(spark, ratings, "r double", grading.advice(F.col("r")))
    low, middle, high = (rubric.ADVICE[k] for k in ("low", "middle", "high"))
    assert advice == [None, None, low, middle, middle, high, high]


def test_notice_shows_numbers_as_written(spark):
    rows = [(4.0, "r", "a"), (3.5, None, "a")]
    got = values(
        spark, rows, "x double, r string, a string",
        chat.notice_text(F.col("r"), F.col("x"), F.col("a")),
    )
    assert got == ["---\n注意：r\n可疑程度：4\n建议：a\n---", "---\n注意：None\n可疑程度：3.5\n建议：a\n---"]


# -- lexicon --------------------------------------------------------------------


def test_keywords_by_group(spark):
    text = "我是公安局专员，请下载ZOOM，把保证金转入安全账户"
    got = one(spark, [text, "", None], lambda t: lexicon.risk_keywords(t))
    assert got[0].asDict() == {
        "transfer": ["安全账户", "保证金"], "software": ["zoom"], "identity": ["公安局", "专员"],
        "threat": [], "lure": [],
    }
    assert got[1].software == [] and got[2].software == []


def test_long_lexicon_equals_short(spark):
    terms = [f"w{i}" for i in range(500)]
    text = "w1 w20 w499 W33"
    long = one(spark, [text], lambda t: lexicon.matched_terms(t, terms))[0]
    assert long == [t for t in terms if t in text.lower()]


def test_scam_type_prefers_more_signs_then_the_lower_number(spark):
    texts = ["退款 和 贷款", "淘宝退款 贷款", "hello", None]
    got = one(spark, texts, lexicon.scam_type)
    assert [r.name for r in got] == [rubric.SCAM_TYPES[3], rubric.SCAM_TYPES[3], None, None]
    assert [r.hits for r in got] == [1, 2, 0, 0]


@pytest.mark.parametrize("state,expected", [("none", 3), ("suspicious", 4), ("clean", 2),
                                            ("unreachable", 2)])
def test_links_adjust_the_level(spark, state, expected):
    got = one(spark, [state], lambda s: lexicon.adjusted_level(F.lit(3), s))
    assert got == [expected]


def test_links_of_any_length(spark):
    texts = ["a1." * 100_000 + "com", "x.yy" + "/-A-Za-z0-9" * 100_000, "a." * 20_000, "see a.b.cc.d and x.yy:80/p"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(
        "i", urls.find_urls(F.col("t")).alias("short"), urls.find_urls(F.col("t"), rubric.URL_FULL).alias("full")
    ).orderBy("i").collect()
    assert got[0]["full"] == [texts[0]] and len(got[0]["short"]) > 1000
    assert got[1]["short"] == [texts[1]] and len(got[1]["full"]) == 1
    assert got[2]["full"] == [] and got[3]["full"] == ["a.b.cc", "x.yy:80/p"]


def test_looping_patterns_equal_the_plain_ones():
    import random
    import re

    dice = random.Random(4)
    plain = re.compile(rubric.URL_FULL, re.I | re.A), re.compile(rubric.URL_COMPAT, re.I | re.A)
    loops = [re.compile(urls._IN_A_LOOP[p], re.I | re.A) for p in (rubric.URL_FULL, rubric.URL_COMPAT)]
    parts = ["a", "bb", ".", ".", "-", "/", ":8", "http://", " ", "_", "é", "/-A-Za-z0-9", "x" * 64, "?", "#q"]
    for _ in range(20_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(1, 14)))
        for one, other in zip(plain, loops):
            assert [m[0] for m in one.finditer(text)] == [m[0] for m in other.finditer(text)], text


def test_maximal_links_of_many(spark):
    rng = random.Random(3)

    def some(n, letters="ab."):
        return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(n)))

    rows = [some(n) for n in (0, 1, 2, 41, 60, 400)]
    rows.append(["x" * 5000, "y" * 300, *("x" * i for i in range(1, 60)), *("y" * i + "é" for i in range(40))])
    rows.append(["x" * 60_000, *("x" * 30_000 + c for c in "abcdefgh"), *some(50)])  # too long for suffixes
    df = spark.createDataFrame([(i, links) for i, links in enumerate(rows)], "i int, links array<string>")
    for i, kept in df.select("i", urls.maximal(F.col("links"))).collect():
        assert kept == [x for x in rows[i] if not any(x != y and x in y for y in rows[i])]
    many = [f"host{i % 700}.example{i % 13}.com/path/{i}/x" for i in range(10_000)]
    one_text = spark.createDataFrame([([*many, "host1.example1.com"],)], "links array<string>")
    start = time.time()
    assert one_text.select(F.size(urls.maximal(F.col("links")))).first()[0] == 10_000
    assert time.time() - start < 20
