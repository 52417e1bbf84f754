"""Main text of pages, and quotations in chats, against brute force."""

import random

from msgrisk.llm import extraction, quotes
from msgrisk.llm.mainlines import common_lines, lines_of


def page(article, frame, extra="", marked=True):
    tag = "article" if marked else "div"
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        f"<body><nav><ul><li><a href='/a'>{frame} one</a></li><li>{frame} two</li></ul></nav><!-- x -->"
        f"<div class='box'>{frame} three</div>{extra}<{tag}>{article}</{tag}><footer>&copy; {frame}</footer>"
    )


def test_lcs_is_longest():
    dice = random.Random(6)
    for _ in range(800):
        a, b = ([dice.randint(0, 4) for _ in range(dice.randint(0, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = common_lines(a, b), iter(b)
        assert len(found) == best[-1][-1]
        assert all(any(a[i] == y for y in rest) for i in found)


def test_lines():
    found = lines_of("<p>a &amp;lt; <b>b</b>c<br>d &nbsp; e</p>tail<textarea>no</textarea><p title='>'>f<p>g")
    assert [x.text for x in found] == ["a &lt; bc d e", "tail", "f", "g"]
    assert lines_of(None) == lines_of("") == lines_of("<script>x") == []
    assert [x.text for x in lines_of("1 < 2 <p title=it's>three")] == ["1 < 2", "three"]
    assert len(lines_of("<p x=\"" * 2000)) <= 1
    assert len(lines_of("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1


def test_zones():
    page = """<body class="has-sidebar"><header><p>0</header><div id="site-header">0</div>
      <main><article class="post comment-open"><header><h1>1</h1></header><p>2<aside>0</aside>
      <div class='ad-box'>0<p>0</div><p>3<form>0<p>0</form><ul><li>4<li>5</ul><p hidden>0</p>
      <div class="entry"><p>6</div><section id=comments><p>0</section></article></main>
      <div role="dialog">0</div><p>7</p>"""
    found = lines_of(page)
    assert [x.text for x in found if x.zone == 0] == list("123456")
    assert [x.text for x in found if x.zone == 1] == ["7"]


def test_pages(spark, tmp_path):
    rows = [(i, f"http://h{i % 2}.org/p/{i}?x", page(f"<h1>T{i}</h1><p>Body {i}.", f"f{i % 4}")) for i in range(40)]
    # The same article twice on a host, and one alone on its host.
    rows += [(50, "http://h0.org/p/50", page("<h1>S</h1><p>Same.", "f0")), (51, "http://h0.org/p/51", rows[0][2]),
             (52, "http://alone.org/", page("<p>Alone.", "q", "<aside>no</aside><form>no</form>"))]
    rows += [(60, None, page("<p>No url.", "f0")), (None, "http://h1.org/p/61", None), (62, "http://h1.org/x", ""),
             (62, "http://h1.org/x", "plain text"), (63, "nothing", "<p>" + "long " * 100_000)]
    # Pages without a marked article: only what differs is text.
    plain = [(100 + i, f"http://plain.org/{i}", page(f"<p>Only here {i}.", "p", marked=False)) for i in range(9)]
    path = str(tmp_path / "pages")
    columns = "page_id long, url string, html string, text int"
    spark.createDataFrame([(*r, 1) for r in rows + plain], columns).repartition(3).write.parquet(path)
    pages = spark.read.parquet(path)
    found = extraction.extracted(pages).collect()
    assert len(found) == len(rows) + len(plain)
    by = {(r["id"], r["url"]): r for r in found}
    for i in range(40):
        row = by[i, rows[i][1]]
        assert row["text"] == f"T{i}\nBody {i}." and row["n_shared"] == 4, row
    assert by[50, "http://h0.org/p/50"]["text"] == "S\nSame."
    assert by[51, "http://h0.org/p/51"]["text"] == "T0\nBody 0."
    assert by[52, "http://alone.org/"]["text"] == "Alone." and by[52, "http://alone.org/"]["n_shared"] == 0
    assert by[60, None]["text"] == "No url." and by[None, "http://h1.org/p/61"]["text"] == ""
    assert sorted(r["text"] for r in found if r["id"] == 62) == ["", "plain text"]
    assert len(by[63, "nothing"]["text"]) == 499_999
    assert all(by[i, u]["text"] == f"Only here {i - 100}." for i, u, _ in plain)
    assert extraction.extracted(pages.limit(0)).count() == 0


def kept(page):
    return extraction.main_text(lines_of(page), None)[0].split("\n")


def test_articles_are_not_dropped():
    article = "<article><p>one</p><p>two</p></article>"
    assert kept(f"<form id=aspnetForm><nav>0</nav>{article}</form>") == ["one", "two"]
    assert kept("<form id=aspnetForm><nav>0</nav><p>one<p>two</form>") == ["one", "two"]
    assert kept(f"<div class='content has-sidebar'>{article}</div>") == ["one", "two"]
    assert kept(f"<div class='widget'><main>{article}</main></div>") == ["one", "two"]
    assert kept("<article><p class='share-price'>one</p><section class=related-work>two</section></article>") == ["one", "two"]
    assert kept(f"{article}<div class='cookie-banner site_footer2'><p>0</div>") == ["one", "two"]
    assert kept("<p>one<p>two<div class='cookie-banner'>0</div><div id=related_posts>0</div>") == ["one", "two"]
    assert kept(f"{article}<div class='related'><article>0</article></div>") == ["one", "two"]
    assert kept("<article><p>one<p>two<article class='comment odd'>0</article></article>") == ["one", "two"]
    assert kept("<article><p>one<p>two</article><article class='comment'>0</article>") == ["one", "two"]


def test_raw_tags_end():
    page = "<article><p>one</p>{}<p>two</p><p>three</p></article>"
    for tag in ("<svg class='i'/>", "<svg/>", "<object data=x>", "<template>", "<select>", "<svg><title>0</title></svg>"):
        assert kept(page.format(tag)) == ["one", "two", "three"], tag
    assert kept(page.format("<svg/>") + "<svg>0</svg>") == ["one", "two", "three"]
    assert len(lines_of("<select>" * 50_000 + "x")) == 1


def texts_of_pages(spark, tmp_path, rows):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(path)
    return {r["url"]: r["text"] for r in extraction.extracted(spark.read.parquet(path)).collect()}


def test_frame_lines_in_main_fall_to_the_pair(spark, tmp_path):
    notice = "<div class='c1'>repeated notice</div>"
    rows = [(f"http://m.org/{i}", f"<main>{notice}<p>lead {i}</p><article><p>Same.<p>Body {i}.</article></main>") for i in range(4)]
    rows += [(f"http://n.org/{i}", f"<div role='main'>{notice}<p>Much more of the text {i}.</div>") for i in range(4)]
    found = texts_of_pages(spark, tmp_path, rows)
    for i in range(4):
        assert found[f"http://m.org/{i}"] == f"lead {i}\nSame.\nBody {i}."
        assert found[f"http://n.org/{i}"] == f"Much more of the text {i}."


def test_large_frames_and_runs_of_copies(spark, tmp_path):
    frame = "".join(f"<div>a long line {i} of the frame of all pages</div>" for i in range(9))
    rows = [(f"http://big.org/{i}", f"<body>{frame}<p>Short {i}.") for i in range(5)]
    for i in range(3):
        rows += [(f"http://run.org/{i}?copy={c}", f"<body>{frame}<p>Told {i}.") for c in range(4)]
    rows += [(f"http://twins.org/{c}", f"<body>{frame}<p>Alone.") for c in range(3)]
    near = "".join(f"<p>Told at length, {i} times.</p>" for i in range(9))
    rows += [(f"http://near.org/a/b{c}", f"<body><div>frame</div>{near}<p>seen {c}") for c in range(2)]
    rows += [(f"http://near.org/{c}", f"<body><div>frame</div><p>Another {c}.") for c in range(2)]
    found = texts_of_pages(spark, tmp_path, rows)
    assert len(found) == len(rows)
    for i in range(5):
        assert found[f"http://big.org/{i}"] == f"Short {i}."
    for i in range(3):
        assert {found[f"http://run.org/{i}?copy={c}"] for c in range(4)} == {f"Told {i}."}
    for c in range(3):  # nothing to compare with
        assert found[f"http://twins.org/{c}"].endswith("all pages\nAlone.")
    assert "Told at length, 3 times." in found["http://near.org/a/b0"]


def passages_of(text):
    """Lines and paragraphs of each level, by joining what no empty line or level parts."""
    found = {(d, quotes.normalised(x)) for d, x in quotes.levels(text)}
    rows = [(d, quotes.normalised(x)) for d, x in quotes.levels(text)]
    for i in range(len(rows)):
        opens = i == 0 or rows[i - 1][0] != rows[i][0] or not rows[i - 1][1]
        if rows[i][1] and opens:
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1]:
                j += 1
            found.add((rows[i][0], " ".join(x for _, x in rows[i:j])))
    return {p for p in found if p[1]}


def brute(messages):
    """Reply, thread and depth of each message, one conversation at a time."""
    out = []
    placed = [m for m in messages if m[0] is not None and m[1] is not None]
    own = {}
    for m in placed:
        own[m[4]] = {x for d, x in passages_of(m[3]) if d == 0}
    parent = {}
    for conv, turn, _, text, row in placed:
        count = {}
        for level, line in {p for p in passages_of(text) if p[0]}:
            earlier = [m for m in placed if m[0] == conv and m[1] < turn and line and line in own[m[4]]]
            if earlier:
                last = max(earlier, key=lambda m: (m[1], m[4]))
                count[level, last] = count.get((level, last), 0) + 1
        if count:
            parent[row] = max(count, key=lambda k: (-k[0], count[k], k[1][1], k[1][4]))[1]
    for conv, turn, role, text, row in messages:
        at, depth = (conv, turn, role, text, row), 0
        while at[4] in parent:
            at, depth = parent[at[4]], depth + 1
        reply = parent[row][1] if row in parent else None
        out.append((conv, turn, role, quotes.own_text(text), reply, at[1], depth))
    return out


def chat_rows():
    dice, rows = random.Random(8), []
    for conv in range(6):
        said = []
        for turn in range(25 if conv else 120):
            lines = [f"line {dice.randint(0, 40)} of {conv}", "", f"Word {turn}", "thanks"][: dice.randint(1, 4)]
            if said and dice.random() < 0.7:
                quoted = dice.choice(said[-6:]).split("\n")
                lines = ["On Monday they wrote:"] * dice.randint(0, 1) + [f"> {x}" for x in quoted[:5]] + lines
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, "user", text))
    rows += [(None, 1, "user", "> Word 1\nx"), (1, None, "user", "> Word 1\ny"), (2, 30, None, None), (2, 31, "", ""),
             (3, 5, "user", "> Word 4\ntwice"), (3, 40, "user", "> twice\n>> Word 4\n> > deep"),
             (4, 50, "user", "> no such line\nz"), (4, 51, "a", "> " * 500 + "x"), (5, 90, "a", ">" * 100_000)]
    return rows


def test_reply_order(spark, tmp_path):
    rows = chat_rows()
    path = str(tmp_path / "chats")
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    frame.coalesce(1).write.parquet(path)
    chats = spark.read.parquet(path)
    found = [tuple(r) for r in quotes.reply_order(chats).collect()]
    want = brute([(*r, i) for i, r in enumerate(rows)])
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(r[4] is not None for r in found) > 100 and max(r[6] for r in found) > 3
    assert quotes.reply_order(chats.limit(0)).count() == 0


def test_rewrapped_and_nested_quotations(spark):
    long = "A long paragraph that one client writes in a single line, of which another makes three lines."
    words = long.split()
    wrapped = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    rows = [
        (1, 1, long + "\n\nA second one."),
        (1, 2, "In between."),
        (1, 3, "On Monday A wrote:\n" + "\n".join(f"> {x}" for x in wrapped) + "\nI agree."),
        (1, 4, "\n".join([*(f">> {x}" for x in wrapped[:2] + wrapped[2:]), "> I agree.", "Me too."])),
        (1, 5, "\n".join(f">> {' '.join(words[i : i + 4])}" for i in range(0, len(words), 4)) + "\nLate."),
        (1, 6, "> A long paragraph that one client\nOnly a part."),
    ]
    chats = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    found = {r["turn"]: r for r in quotes.reply_order(chats).collect()}
    assert {t: r["reply_to"] for t, r in found.items()} == {1: None, 2: None, 3: 1, 4: 3, 5: 1, 6: None}
    assert (found[4]["thread"], found[4]["depth"], found[4]["text"]) == (1, 2, "Me too.")
    assert found[3]["text"] == "I agree." and found[5]["text"] == "Late."


def test_chats_without_quotations_stay_as_they_are(spark, sf_dir):
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = quotes.reply_order(chats).collect()
    before = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chats.collect())
    assert sorted(tuple(r)[:4] for r in found) == before
    assert all(r["reply_to"] is None and r["thread"] == r["turn"] and r["depth"] == 0 for r in found)
