"""Main text of pages: markup rules, alignment and partners."""

import random
import re

import pytest

from docdrift.llm import html_text as H


def lines(page):
    return [t for _, t in H.blocks(page)]


@pytest.mark.parametrize(
    "page,expected",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b <b>c</b>\n d<br>e</p>f", ["a", "b c d e", "f"]),
        ("<nav>x</nav><article><h1>T</h1><p>p &lt;1&gt; &eacute;&#233;&#x1F600;</p></article><footer>f</footer>", ["T", "p <1> éé😀"]),
        ("<script>var t='</p><article>no</article>';</script><style>p{}</style><!-- <p>no --><p>yes", ["yes"]),
        ('<div class="ad">buy</div><div class="content">text</div><div id="comments"><article>me too</article></div>', ["text"]),
        ('<div class="has-sidebar"><p>kept</p><div class="left sidebar">gone</div></div>', ["kept"]),
        ('<body class="nav"><form><input value="x"><label>l</label>q</form><p title="a > b">t</p>', ["t"]),
        ("<nav><ul><li>menu<article><p>a</p></article>", ["a"]),
        ("<main><h1>T</h1><p>a</p><aside>s</aside></main><p>out</p>", ["T", "a"]),
        ('<header>top</header><article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>', ["T", "x"]),
        ('<p hidden>no</p><p style="display: none">no</p><p aria-hidden="true">no</p><p>yes</p>', ["yes"]),
        ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", ["one", "two", "c1", "c2"]),
        ('<p>a < b and <3</p><p>"quoted', ["a < b and <3", '"quoted']),
        ("<title>t</title><p>&nbsp;&nbsp;x&nbsp;y&nbsp;</p>", ["x y"]),
        ('<div role="navigation">n</div><div class="cookie-notice">c</div><section class="commentList">c</section>z', ["z"]),
    ],
)
def test_blocks(page, expected):
    assert lines(page) == expected


@pytest.mark.parametrize(
    "page,expected",
    [
        # Letters that grow in lower case do not move a script's end.
        ("<p>İİİİ İstanbul</p><script>x=1</script><p>After</p>", ["İİİİ İstanbul", "After"]),
        ("<SCRIPT>if (a<b) '</scripts>'</Script ><p>t", ["t"]),
        # A title beside the article, a story beside a teaser.
        ("<main><h1>Title</h1><p>Intro.</p><article><p>a</p></article></main><p>out</p>", ["Title", "Intro.", "a"]),
        ("<div><p>The story.</p></div><article class='card'>teaser</article>", ["The story.", "teaser"]),
        # One word of a name does not make a part of the article something else.
        ('<article><p class="share-price">9</p><section id="related-work">r</section><div class="notice-board">b</div></article>', ["9", "r", "b"]),
        ('<article>x<div class="share-buttons">s</div><div id="relatedPosts">r</div><div class="comment-list">c</div></article>', ["x"]),
        # Names of wrappers, and articles inside of what is left out.
        ('<div class="content-sidebar-wrap"><article>a</article></div>', ["a"]),
        ('<div class="content-sidebar-wrap"><p>a</p></div>', ["a"]),
        ('<div class="with-x menu-page"><main>a</main></div>', ["a"]),
        ('<div class="sidebar"><article>teaser</article></div><p>a</p>', ["a"]),
        ('<div class="post-comments"><main>m</main></div><p>a</p>', ["a"]),
        ('<a href="x>y</a> z">q</a><p title=\'">\'>r', ["q", "r"]),
        ("a <b", ["a <b"]),
    ],
)
def test_blocks_of_odd_pages(page, expected):
    assert lines(page) == expected


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "x" + "</b>" * 50_000,
        '<a "' * 100_000,
        '<a x=">"' * 50_000,
        '<a x="' * 100_000,
        "<!" * 200_000,
        "<form>" * 5_000 + '<div class="ad">' + "<article></p>" * 30_000,
        '<div class="sidebar">' * 30_000 + "<article>" * 30_000,
        "<script>" + "</scrip" * 100_000,
    ],
)
def test_bad_markup_is_read_in_linear_time(page):
    import time

    start = time.process_time()
    H.blocks(page)
    once = time.process_time() - start
    H.blocks(page * 2)
    assert time.process_time() - start < 10 * once + 2


def test_a_near_copy_deletes_nothing():
    story = [(False, f"line {i} of the story") for i in range(20)]
    menu, other = [(False, "Home"), (False, "News")], [(False, f"another line {i}") for i in range(20)]
    assert H.main_lines(menu + story, menu + story) == [t for _, t in menu + story]
    assert H.main_lines(menu + story, menu + story[:-1] + [(False, "changed")]) == [t for _, t in menu + story]
    assert H.main_lines(menu + story, menu + other) == [t for _, t in story]


def test_template_lines_go_against_a_plain_model(llm):
    """Pages put together from known lines; a longest common subsequence is
    taken by its table, the partner by looking at all pages of the host."""
    rnd = random.Random(9)
    rows, own = [], {}
    for i in range(90):
        host = ["big.org", "big.org", f"h{i % 4}.net"][i % 3]
        template = [f"{host} head {k}" for k in range(4)], [f"{host} foot {k}" for k in range(3)]
        story = [f"story {i} line {k} {rnd.random()}" for k in range(rnd.randint(3, 30))]
        top, end = ([t for t in part if rnd.random() < 0.8] for part in template)
        own[i] = top + story + end
        marked = rnd.random() < 0.3
        body = "".join(f"<p>{t}</p>" for t in story)
        page = "".join(f"<div>{t}</div>" for t in top) + (f"<article>{body}</article>" if marked else body) + "".join(f"<div>{t}</div>" for t in end)
        rows.append((i, f"http://{host}/{i:03d}", page))

    def expected(i):
        host, path = rows[i][1][7:].split("/")
        others = [j for j in own if j != i and rows[j][1][7:].split("/")[0] == host]
        before, after = max((j for j in others if j < i), default=None), min((j for j in others if j > i), default=None)
        best, where = -1, None
        for j in (before, after):
            if j is not None:
                same = next((n for n in range(4) if f"/{rows[j][1][-3:]}"[n] != f"/{path}"[n]), 4)
                if same > best:
                    best, where = same, j
        return [t for t in own[i] if t.startswith("story") or where is None or t not in own[where]]

    df = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for ranges in (1, 7):
        got = {r.page_id: r.text for r in H.extract_main_text(df, ranges=ranges).collect()}
        assert got == {i: "\n".join(expected(i)) for i in own}
    long = "<p>" + "wort " * 400_000 + "</p>"
    got = H.extract_main_text(llm.createDataFrame([(1, "http://a.org/", long)], "page_id long, url string, html string")).first()
    assert got.n_chars == 5 * 400_000 - 1


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_is_a_longest_common_subsequence():
    rnd = random.Random(4)
    for _ in range(400):
        letters = "abcdefgh"[: rnd.randint(1, 8)]
        a = [rnd.choice(letters) for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice(letters) for _ in range(rnd.randint(0, 30))]
        places = H.common(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in places)
        assert len(places) == plain_length(a, b)
    assert len(H.common(list(range(3000)) * 2, list(range(3000)))) == 3000


def test_shared_lines_go_but_marked_ones_stay():
    assert H.main_lines([(False, "menu"), (False, "own"), (False, "end")], [(False, "menu"), (False, "other"), (False, "end")]) == ["own"]
    assert H.main_lines([(True, "same")], [(True, "same")]) == ["same"]
    assert H.main_lines([(False, "x")], None) == ["x"]


def plain(rows):
    """Each page's text by whole-host comparison."""
    order = sorted(rows, key=lambda r: (H._key(r[1], r[0]), "\n".join(lines(r[2] or ""))))
    out = []
    for k, (i, url, page) in enumerate(order):
        host, path = H.split_url(url)
        near = [order[n] for n in (k - 1, k + 1) if 0 <= n < len(order) and H.split_url(order[n][1])[0] == host]
        partner = max(near, key=lambda r: H._likeness(H.split_url(r[1])[1], path), default=None)
        text = "\n".join(H.main_lines(H.blocks(page or ""), partner and H.blocks(partner[2] or "")))
        out.append((i, url, text, len(text)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_result_does_not_depend_on_the_ranges(llm, ranges):
    rnd = random.Random(2)
    menu = "<p>Home</p><p>News</p>"
    rows = [
        (i, f"http://{'big' if i % 3 else 'h%d' % (i % 5)}.org/{rnd.choice('ab')}/{rnd.randint(0, 99)}", f"{menu}<p>story {i}</p><p>All rights</p>")
        for i in range(120)
    ]
    rows += [(500, None, menu), (None, "http://big.org/a", menu + "<p>n</p>"), (501, "http://alone.org/", menu), (502, "http://big.org/a/1", None)]
    rows += [(7, "http://twice.org/", menu + "x")] * 2
    df = llm.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as lines").repartition(4)
    got = sorted((tuple(r) for r in H.extract_main_text(df, ranges=ranges).collect()), key=str)
    assert got == plain(rows)
    # Two pages of the big host have no menu to share with a neighbour.
    big = [t == f"story {i}" for i, u, t, _ in got if i is not None and i < 120 and "big" in u]
    assert len(big) - sum(big) <= 4
    assert H.extract_main_text(df.limit(0)).collect() == []


def test_query_gives_the_article_of_every_page(llm):
    import html

    sf = "/root/testdata/sf0.001"
    pages = llm.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.op7_html_text(llm, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        text = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)
        assert got[p.page_id].text == text and got[p.page_id].n_chars == len(text) and got[p.page_id].url == p.url
