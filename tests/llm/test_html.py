from __future__ import annotations

import pytest

from shelfmark.llm import html_main as H

SCHEMA = "page_id long, url string, html string, text string, blocks int, host string"


def text_of(page):
    return "\n".join(t for t, _ in H.blocks_of(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain  text\n only", "plain text only"),
        ("<p>a <b>bo</b>ld<br>line</p><p>second &amp; &eacute;&#x21;&nbsp;x", "a bold line\nsecond & é! x"),
        ("<nav>menu</nav><header>site</header><article><header><h1>T</h1></header><p>Body<aside>ad</aside></article><p>outside</p><footer>f</footer>", "T\nBody"),
        ("<main><p>one</p><section class='comments'><article><p>reader</p></article></section></main>", "one"),
        ("<article><p>A</p><div id=comments><article class=comment><p>reader</p></article></div></article>", "A"),
        ("<div class='header'><h1>Site</h1></div><div><h1>Real</h1><p>x</p></div>", "Real\nx"),
        ("<body class='has-sidebar'><div class='sidebar'>s</div><div class='cookie-banner'>c</div><p>x</p></body>", "x"),
        ("<p>x</p><script>var a='</p><p>no</p>'</script><style>p{}</style><form><p>name<input></p></form><p hidden>h</p><p>y", "x\ny"),
        ("<p>1 < 2 and 3 > 2 <3</p><!-- c <p>no</p> --><p>end <a href='x>y'>link</a> <span>s</sp", "1 < 2 and 3 > 2 <3\nend link s"),
        ("<table><tr><td>a<td>b<tr><th>c</table><ul><li>i<li>j</ul>", "a b\nc\ni\nj"),
        ("<div>" * 4000 + "deep" + "</div>" * 3000, "deep"),
        ("<div style='display: none'>no</div><div aria-hidden=true>no</div>yes", "yes"),
    ],
)
def test_main_text_of_one_page(page, want):
    assert text_of(page) == want


def _site(n, host="a.example"):
    notice = "<div><p>Our shop moved to a new building, find us there.</p></div>"
    return [(i, f"https://{host}/{i}", f"<body>{notice}<div><p>Story number {i} begins.</p><p>{'Quoted by a few.' if i % 3 == 0 else 'Own words ' + str(i)}</p></div></body>", "x", 1, "h") for i in range(n)]


def test_recurring_subtrees_go_and_quoted_passages_stay(spark):
    rows = {r.id: r.text for r in H.main_text(spark.createDataFrame(_site(12), SCHEMA)).collect()}
    assert all("building" not in t and f"Story number {i} begins." in t for i, t in rows.items())
    assert all(("Quoted by a few." in t) == (i % 3 == 0) for i, t in rows.items())


def test_few_pages_and_other_hosts_keep_theirs(spark):
    rows = H.main_text(spark.createDataFrame(_site(4) + [(100 + i, *r[1:]) for i, r in enumerate(_site(4, "b.example"))], SCHEMA)).collect()
    assert all("building" in r.text for r in rows)


def test_copies_of_a_page_are_no_template(spark):
    article = "<article><h1>Title</h1><p>The one story.</p></article>"
    same = [(i, f"https://a.example/{i}", f"<body>{article}</body>", "x", 1, "h") for i in range(6)]
    chrome = [(10 + i, f"https://b.example/{i}", f"<body><nav>menu {i}</nav><article id=n{i}><h1>Title</h1><p>The one story.</p></article></body>", "x", 1, "h") for i in range(6)]
    rows = H.main_text(spark.createDataFrame(same + chrome, SCHEMA)).collect()
    assert len(rows) == 12 and all(r.text == "Title\nThe one story." for r in rows)


def test_a_page_that_is_quoted_whole_keeps_its_text(spark):
    story = "<div><p>The one story.</p></div>"
    quoting = [(i, f"https://a.example/{i}", f"<body>{story}<p>Answer number {i}</p></body>", "x", 1, "h") for i in range(8)]
    rows = {r.id: r.text for r in H.main_text(spark.createDataFrame([*quoting, (9, "https://a.example/9", f"<body>{story}</body>", "x", 1, "h")], SCHEMA)).collect()}
    assert rows[9] == "The one story." and rows[0] == "Answer number 0"


def test_templates_go_also_where_pages_have_copies(spark):
    pages = [(i, f"https://a.example/{i}/{c}", r[2], "x", 1, "h") for i, r in enumerate(_site(12)) for c in range(3)]
    rows = H.main_text(spark.createDataFrame(pages, SCHEMA)).collect()
    assert len(rows) == 36 and all("building" not in r.text and f"Story number {r.id} begins." in r.text for r in rows)


def test_nulls_repeats_long_and_empty_tables(spark):
    long = "<article><p>" + "w " * 200_000 + "</p></article>"
    pages = spark.createDataFrame([(1, None, "<p>no url</p>", "x", 1, "h"), (2, "u", None, "x", 1, "h"), (3, "http://h/", long, "x", 1, "h"), (4, "http://h/", "<p>t</p>", "x", 1, "h"), (4, "http://h/", "<p>t</p>", "x", 1, "h"), (None, "http://h/", "", "x", 1, "h")], SCHEMA)
    got = sorted((r.id or -1, r.text[:10], r.n_chars) for r in H.main_text(pages).collect())
    assert got == [(-1, "", 0), (1, "no url", 6), (2, "", 0), (3, "w w w w w ", 399_999), (4, "t", 1), (4, "t", 1)]
    assert H.main_text(pages.limit(0)).count() == 0


def test_test_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: r.text for r in H.main_text(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert got[p.page_id] == "\n".join(b for b in parts if b)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<script>var s=\"<a href='\";</script><p>It's good</p>", "It's good"),
        ("<style>a:after{content:\"<b title='\"}</style><p>It's \"so\"</p>", "It's \"so\""),
        ("<p>Hello <button>Share</button> world</p><p>a <span class='ad'>Buy now</span><span hidden>secret</span> b <label>Name</label><svg><text>t</text></svg></p>", "Hello world\na b"),
        ("<article class='post-form'><p>Text</p></article>", "Text"),
        ("<div class='recipe-notice'><p>Boil it.</p></div><div class='siteFooter'>f</div><div class='notice'>n</div>", "Boil it."),
        ("<div class='recipe-menu'><a href=x>one</a> <a href=y>two</a></div><p>x</p>", "x"),
        ("<article><p>t</p><article class='comment'>c</article></article>", "t"),
        ("<p title=it's>x</p><p>it's</p>", "x\nit's"), ("<p>x</p><a href=\"http://cut", "x"), ("<p>x<a title='a > b", "x"), ("x<", "x<"), ("a</é>b</3>c<?d?>e<!>f", "abcef"),
    ],
)
def test_scripts_inline_furniture_and_single_words(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("n", [1, 4, 5, 6, 40])
def test_identical_pages_keep_their_text(spark, n):
    page = "<body><div><p>One.</p><p>Two.</p></div><div><p>Three.</p></div></body>"
    rows = H.main_text(spark.createDataFrame([(i, f"https://a.example/{i}", page, "x", 1, "h") for i in range(n)], SCHEMA)).collect()
    assert len(rows) == n and {r.text for r in rows} == {"One.\nTwo.\nThree."}


def test_near_copies_keep_their_text(spark):
    # Each copy differs in one of twenty paragraphs, so every paragraph recurs in nearly all bodies.
    def page(i):
        return "".join(f"<p>Paragraph {k} {'changed ' + str(i) if k == i % 20 else 'stays'} here.</p>" for k in range(20))

    rows = H.main_text(spark.createDataFrame([(i, f"https://a.example/{i}", page(i), "x", 1, "h") for i in range(30)], SCHEMA)).collect()
    assert all(r.text.count("\n") == 19 for r in rows)


def _plain_site(n):
    """Furniture that no markup names and no two pages word alike."""
    return [
        (i, f"https://plain.example/{i}", f"<body><div class=a{i}><ul><li><a href=/{i}>go {i}</a></li><li><a href=/x>to {i + 1}</a></li></ul></div><div class=b><h1>Title {i}</h1><p>{'word ' * (30 + i)}{i}.</p></div><div class=z><p>Bought by {i} others.</p></div></body>", "x", 1, "h")
        for i in range(n)
    ]


def test_recurring_shapes_go_outside_the_content(spark):
    rows = {r.id: r.text for r in H.main_text(spark.createDataFrame(_plain_site(12), SCHEMA)).collect()}
    assert all(t.split("\n")[0] == f"Title {i}" and t.count("\n") == 1 for i, t in rows.items())
    off = {r.id: r.text for r in H.main_text(spark.createDataFrame(_plain_site(12), SCHEMA), templates=False).collect()}
    assert all("Bought by" in t and "go" in t for t in off.values())


def _words(i, k):
    return " ".join(f"w{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + k)}" for j in range(25))


def test_text_of_one_page_alone_stays_whatever_its_shape(spark):
    # Lead and outro recur in shape beside the largest part of the content; no two pages share a word.
    pages = [(i, f"https://a.example/{i}", f"<body><div class=lead><p>{_words(i, 0)}</p></div><div class=text><h1>T{i}</h1><h2>S {_words(i, 5)}</h2><p>{_words(i, 1)} {_words(i, 2)} {_words(i, 3)}</p></div><div class=outro><p>{_words(i, 4)}</p></div></body>", "x", 1, "h") for i in range(10)]
    on = {r.id: r.text for r in H.main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    off = {r.id: r.text for r in H.main_text(spark.createDataFrame(pages, SCHEMA), templates=False).collect()}
    assert on == off and all(t.count("\n") == 4 for t in on.values())


def test_subheadings_that_recur_alone_stay(spark):
    def page(i):
        return f"<body><div class=top><h2>Our shop</h2><p>Find us in the square.</p></div><div><h1>Dish {i}</h1><h2>Ingredients</h2><p>{_words(i, 0)}</p><h2>Method</h2><h3>In short</h3><p>{_words(i, 1)}</p><h2>More from us</h2></div></body>"

    rows = H.main_text(spark.createDataFrame([(i, f"https://a.example/{i}", page(i), "x", 1, "h") for i in range(10)], SCHEMA)).collect()
    assert all(r.text == f"Dish {r.id}\nIngredients\n{_words(r.id, 0)}\nMethod\nIn short\n{_words(r.id, 1)}" for r in rows)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T</h1><p>A</p><div class='reader-comments'><p>c</p></div><div class='user-comments'>d</div></article>", "T\nA"),
        ("<div class='google-ads'>a</div><div id='div-gpt-ad-1'>b</div><div class='cookie-law-info'>c</div><p>x</p>", "x"),
        ("<div class='search'><p>How to search.</p></div>", "How to search."), ("<div class='form'><h1>Form</h1><p>follows function</p></div>", "Form\nfollows function"), ("<div class='search'>find</div><p>x</p>", "x"),
        ("<div class='advert'>buy</div>", ""), ("<main><p>Intro</p><article><h1>T</h1><p>x</p></article><nav>n</nav></main><p>out</p>", "Intro\nT\nx"),
        ("<main><p>Intro</p></main><article><p>x</p></article>", "x"),
    ],
)
def test_comments_adverts_and_sole_holders(page, want):
    assert text_of(page) == want


def test_quoted_paragraphs_of_declared_articles_stay(spark):
    pages = [(i, f"https://a.example/{i}", f"<article><h1>T {i}</h1><p>The same passage in all.</p><p>Own {i}.</p><div class='post-notice'><p>Read our offers.</p></div></article>", "x", 1, "h") for i in range(9)]
    rows = {r.id: r.text for r in H.main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(t == f"T {i}\nThe same passage in all.\nOwn {i}." for i, t in rows.items())


def test_templates_are_those_of_a_plain_count(spark):
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    parts = ["<div><p>Offer of the week.</p></div>", "<p>Loose</p>", "<div><div><p>In two.</p></div></div>", "<section><p>A</p><p>B</p></section>"]
    pages = []
    for i in range(120):
        some = "".join(p for p in parts if rnd.random() < 0.6)
        pages.append((i, f"https://h{i % 7}.example/{i}", f"<body>{some}<div><h1>Own {rnd.randrange(80)}</h1><p>{'tale ' * 20}{rnd.randrange(60)}</p></div></body>", "x", 1, "h"))
    read = {i: (None, H._inner(H.blocks_of(h))) for i, _, h, *_ in pages}
    seen, shaped, bodies = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for i, *_ in pages:
        body = tuple(t for t, _ in read[i][1])
        bodies[i % 7].add(body)
        for _, (within, _) in read[i][1]:
            for mark in within:
                seen[i % 7][mark].add(body)

    def often(marks, site):
        return {m for m, b in marks.items() if len(b) >= 5 and len(b) >= 0.5 * len(bodies[site])}

    text_gone = {site: often(seen[site], site) for site in bodies}
    words, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for i, *_ in pages:
        for t, (within, shapes) in read[i][1]:
            if not text_gone[i % 7] & set(within):
                total[i % 7] += len(t.split())
                for mark in shapes:
                    shaped[i % 7][mark].add(tuple(x for x, _ in read[i][1]))
                    words[i % 7][mark] += len(t.split())
    for r in H.main_text(spark.createDataFrame(pages, SCHEMA)).collect():
        site = r.id % 7
        shape_gone = {m for m in often(shaped[site], site) if words[site][m] <= H.MOST_WORDS * total[site]}
        left = [(t, w) for t, (w, s) in read[r.id][1] if not shape_gone & set(s)]
        kept = [t for t, w in left if not text_gone[site] & set(w)]
        if len(" ".join(kept).split()) < H.LEAST_LEFT * len(" ".join(t for t, _ in left).split()):
            kept = [t for t, _ in left]
        assert r.text == "\n".join(kept)
