import random
from functools import cache

import pytest

from docmill.llm.wrapper import Node, align, article_blocks, extract, matching, parse


def page(i: int, extra: str = "") -> str:
    return (
        f'<html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1><form>search</form></header><nav><ul><li>Home<li>About {i}</ul></nav>'
        f'<main><article><header><h2>Title {i}</h2><p class=byline>by me</p></header><p>Para &lt;{i}&gt; &nbsp; one <a href=x>lin<b>k</b></a>ed.<p>Para two {i}.{extra}<div>Subscribe to our paper today</div>'
        f'<ul><li>a{i}<li>b{i}</ul></article><section id="comments"><article>Comment {i}</article></section><div class="cookie-notice">We use</div></main><aside>rel</aside><footer>c</footer><script>if(a<b){{x="<p>no</p>"}}</script></body></html>'
    )


def test_template_goes_and_slots_stay(spark):
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Para <{i}> one linked. Para two {i}. a{i} b{i}" for i in range(8)}


def test_copies_are_no_template(spark):
    rows = [(i, f"http://h.com/{i}", page(1)) for i in range(20)]
    got = {r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"Title 1 Para <1> one linked. Para two 1. Subscribe to our paper today a1 b1"}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n only", "plain text only"),
        ("<p>a < b &amp; c<p>d<br>e<p class='ad'>no", "a < b & c d e"),
        ("<table><tr><td>x<td>y<tr><td>z</table>", "x y z"),
        ("<div><!-- <p>no</p> -->in <i>line</i>d</div><script>bad", "in lined"),
        ("<p><a href=1>only a link</a></p><p>words</p><div><a href=1>menu</a></div>", "only a link words"),
        ('<p title="unclosed>text', "text"),
        ("<article><p>in</p></article><p>out</p>", "in"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>&#65;&eacute;&unknown;</p>", "Aé&unknown;"),
        ("<article><div class='entry-header'><h1>Title</h1><span>by x</span></div><p>body</p><div class='entry-footer'>filed</div></article>", "Title body"),
        ("<b>" * 3000 + "deep" + "</b>" * 3000, "deep"),
    ],
)
def test_single_pages(spark, html, want):
    df = spark.createDataFrame([(1, "http://a.b/", html), (1, "http://a.b/", html), (None, None, html)], "page_id long, url string, html string")
    rows = extract(spark, df).collect()
    assert [(r.text, r.n_chars) for r in rows] == [(want, len(want))] * 3


def test_tree_matching():
    a, b = parse("<div><p>1</p><ul><li>2</ul><h2>3</h2></div>")[0], parse("<div><ul><li>x</ul><table><tr><td>y</table><h2>z</h2></div>")[0]
    assert matching(a, b) == 5  # root, div, ul, li, h2
    assert matching(a, Node.unpacked(a.packed())) == a.size()
    align(a, b)
    by = {n.label: n.number for n in a.children["div"].children.values()}
    assert by["p"].startswith("~") and by["ul"] == "2" and by["h2"] == "7"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='has-sidebar'><p>text</p><div class='sidebar'>no</div></div>", "text"),
        ("<div class='content-sidebar-wrap'><p>text</p></div><div class='no-sidebar'>more</div>", "text more"),
        ("<div class='page sidebar'><article><h1>T</h1><p>text</p></article><div>no</div></div>", "T text"),
        ("<div class='header'><main><p>text</p><p class='share'>no</p></main></div>", "text"),
        ("<div class='sidebar-left'><p>all there is</p><p class='ad'>no</p></div>", "all there is"),
        ("<article><h2 id='related-work'>Related work</h2><section id='search'>Search</section><p id='comments-on-x'>On x</p><div id='comments'>no</div></article>", "Related work Search On x"),
        ("<main><p>a long text of the page</p></main><div class='related'><article>teaser</article></div>", "a long text of the page"),
        ("<div id='comments'><article>a comment</article></div><p>x</p>", "x"),
    ],
)
def test_marked_wrappers_keep_their_article(spark, html, want):
    (row,) = extract(spark, spark.createDataFrame([(1, "http://a.b/", html)], "page_id long, url string, html string")).collect()
    assert row.text == want


def test_main_stays_around_small_articles():
    def kept(html: str) -> str:
        blocks = parse(html)[1]
        return " ".join(b.text for b, own in zip(blocks, article_blocks(blocks), strict=True) if own)

    assert kept("<main><h1>T</h1><p>a long text of the page</p><article class='card'>teaser</article></main>") == "T a long text of the page teaser"
    assert kept("<main><h1>T</h1><article><p>a long text</p></article><p>more</p><h2>x</h2></main>") == "T a long text"


def random_tree(r: random.Random, depth: int = 4) -> Node:
    node = Node("x")

    def grow(at: Node, left: int) -> None:
        for label in r.sample("abcdefg", r.randrange(7 if left else 1)):
            grow(at.child(label), left - 1)

    grow(node, depth)
    return node


def test_matching_equals_brute_force():
    """Against the plain recursion of simple tree matching, table and all."""

    @cache
    def plain(a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        rows = [[0] * (len(b.children) + 1)]
        for i, x in enumerate(a.children.values()):
            row = [0]
            for j, y in enumerate(b.children.values()):
                row.append(max(row[j], rows[i][j + 1], rows[i][j] + plain(x, y)))
            rows.append(row)
        return 1 + rows[-1][-1]

    r = random.Random(4)
    for _ in range(150):
        a, b = random_tree(r, 3), random_tree(r, 3)
        assert matching(a, b) == matching(b, a) == plain(a, b)
        align(a, b)
        numbers = [int(n.number) for _, n in a.walk() if n.number[0] != "~"]
        assert numbers == sorted(numbers) and len(numbers) in (0, matching(a, b))
        assert Node.unpacked(a.packed()).packed() == a.packed()


def test_planted_templates(spark):
    """Unmarked template text around articles, in hosts of several layouts: the articles come out whole, nothing else does."""
    r, rows, want = random.Random(9), [], {}
    words = lambda n: " ".join(r.choice("stone river light garden paper winter silver market bridge".split()).capitalize() + str(r.randrange(1000)) for _ in range(n))
    for h in range(4):
        tags = [r.choice(["div", "section", "td", "span"]) for _ in range(3)]
        top, bottom = words(30), words(60)
        for i in range(12):
            paragraphs = [words(r.randrange(1, 9)) for _ in range(r.randrange(1, 6))]
            body = "".join(f"<p>{p}</p>" for p in paragraphs)
            k = 100 * h + i
            rows.append((k, f"http://h{h}.com/{i}", f"<body><{tags[0]}><div class=a>{top}</div></{tags[0]}><div class=b><h1>Title {k}</h1>{body}<ul><li>{top} x<li>{bottom} y</ul></div><{tags[1]}><div class=z>{bottom}</div></{tags[1]}></body>"))
            want[k] = " ".join([f"Title {k}", *paragraphs])
    got = {x.page_id: x.text for x in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 10_000 + "deep {0}" + "</div>" * 10_000
    mixed = "".join(f"<div class=c{i}>" for i in range(3_000)) + "mixed {0}"
    wide = "".join(f"<div class=w{i}>" + "wide {0} " + f"{i}</div>" for i in range(3_000))
    rows = [(3 * i + k, f"http://h{k}.com/{i}", x.replace("{0}", str(i))) for i in range(6) for k, x in enumerate((deep, mixed, wide))]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep 0" and got[4] == "mixed 1" and got[8] == " ".join(f"wide 2 {i}" for i in range(3_000))


def kept(html: str) -> str:
    blocks = parse(html)[1]
    return " ".join(b.text for b, own in zip(blocks, article_blocks(blocks), strict=True) if own)


def test_article_text_stays_whatever_its_class():
    html = (
        '<body><article><header><h1>T</h1><p class="standfirst">stands first</p><p class="byline">by x</p><span>today</span></header><p class="lead alert">lead</p><figure class="widget-figure"><figcaption>shown</figcaption></figure>'
        '<div class="related-work social">more</div><div class="ad">buy</div><form><p>name</p></form><div class="comments">well</div><div class="sidebar">aside</div><p hidden>none</p><p>end</p></article></body>'
    )
    assert kept(html) == "T stands first lead shown more end"


def test_choice_of_article_on_planted_pages():
    """Pages put together from parts whose place is known: exactly the article's parts stay, in order."""
    r = random.Random(12)
    inside = [("<p class='{c}'>{t}</p>", True), ("<div class='{c}'><p>{t}</p></div>", True), ("<h2 id='{c}'>{t}</h2>", True), ("<ul class='{c}'><li>{t}</ul>", True), ("<blockquote>{t}</blockquote>", True), ("<div class='ads {c}'>{t}</div>", False), ("<aside>{t}</aside>", False), ("<form>{t}</form>", False), ("<section class='comments'><p>{t}</p></section>", False), ("<nav>{t}</nav>", False), ("<script>{t}</script>", False), ("<p style='display:none'>{t}</p>", False)]
    around = ["<nav><ul><li>{t}</ul></nav>", "<header class='{c}'>{t}</header>", "<footer><p>{t}</p></footer>", "<div class='cookie-notice'>{t}</div>", "<div class='sidebar'><p>{t}</p></div>", "<div id='comments'><article>{t}</article></div>", "<div class='advert'>{t}</div>"]
    classes = ["lead", "alert", "widget-figure", "intro social", "share-price", "related-work", "breadcrumb-trail", "modal-verbs", "x1"]
    for n in range(200):
        part = lambda shape, k: shape.replace("{t}", f"text {n} {k}").replace("{c}", r.choice(classes))  # noqa: B023, E731
        chosen = [r.choice(inside) for _ in range(r.randrange(1, 9))]
        if not any(own for _, own in chosen):
            continue
        body = "".join(part(shape, k) for k, (shape, _) in enumerate(chosen))
        before, after = ("".join(part(r.choice(around), f"{side}{k}") for k in range(r.randrange(4))) for side in "ab")
        assert kept(f"<html><body>{before}<article>{body}</article>{after}</body></html>") == " ".join(f"text {n} {k}" for k, (_, own) in enumerate(chosen) if own)


def test_markup_without_end_takes_linear_time():
    """A megabyte of each: seconds at most, where a scan to the end for every tag would take hours."""
    import time

    began = time.perf_counter()
    for unit in ("<x ", "<!x ", "<x a='", '<x "', "</x>", "<b>", "<b><div></div>", "<li><p>", "<!-", "<![CDATA["):
        parse("<p>start</p>" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 60
    assert kept("<p>a</p><x b c") == "a <x b c" and kept("<p>a</p>b <!-- c") == "a b" and kept("<p>a</p>b < c <!-- d > e") == "a b < c"


def test_few_pages(spark):
    """Of two to four pages, what all have in one slot is template; near copies keep theirs."""
    rows = [(i, f"http://few.com/{i}", f"<div class=t>banner of the site</div><div class=m><p>text of page {i} with some words more</p></div><div class=f>footer of the site</div>") for i in range(4)]
    rows += [(10 + i, f"http://near.com/{i}", f"<div class=m><p>the same long paragraph in both of the pages</p><h2>part {i}</h2></div>") for i in range(2)]
    rows += [(20, "http://one.com/", "<div>banner</div><p>alone</p>"), (21, "http://one.com/b", "<div>banner</div><p>alone</p>")]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text of page {i} with some words more" for i in range(4))
    assert got[10] == "the same long paragraph in both of the pages part 0" and got[20] == got[21] == "banner alone"


def test_recurring_headings_are_template(spark):
    rows = [(i, f"http://r.com/{i}", f"<article><h2>Ingredients</h2><p>flour {i} and more of it</p><h2>Method {i}</h2><p>stir {i} times</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "flour 2 and more of it Method 2 stir 2 times"
