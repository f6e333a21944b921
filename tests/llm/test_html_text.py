"""Whole pages, broken pages, and the density by itself."""

import html
import math
import random
import re

import pytest

from quarry.llm.html_text import extract, main_text

AROUND = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>%s<footer>Imprint and more</footer></body></html>'


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        (None, ""),
        ("plain text", "plain text"),
        ("<p>a<b>b</b> c&nbsp;&amp;<p>d", "ab c & d"),
        (AROUND % "<article><h1>Head</h1><p>One two three four five.</p><p>Six seven.</p></article>", "Head One two three four five. Six seven."),
        (AROUND % "<div><div class='ad'>Buy this now, it is cheap and good</div><article><p>One two three<p>four five</article></div>", "One two three four five"),
        (AROUND % "<article><p>Text of some length here.</p><p>And more of it.</p></article><div id='comments'><p>First! What a long comment this is, truly.</p><p>Second one.</p></div>", "Text of some length here. And more of it."),
        (AROUND % "<article><p>One two three</p><script>var t='</p>';</script><p>four five<br>six</p><form><input><p>Name</p></form></article>", "One two three four five six"),
        ("<!-- never ends <p>text", ""),
        ("<p>one two</p><script>never ends", "one two"),
        ("<p>a < b and c</p>", "a < b and c"),
        ("<p title='a>b'>quoted</p>", "quoted"),
        ("<p>cut <a hre", "cut"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


TEXT = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i} of the text, which goes on for a while.</p>" for i in range(4))
WANT = "Head " + " ".join(f"Paragraph {i} of the text, which goes on for a while." for i in range(4))


@pytest.mark.parametrize(
    "inner",
    [
        "<div class='content has-sidebar'><article>%s</article><div class='sidebar'>Aside words</div></div>",
        "<div id='page' class='no-sidebar'><main>%s</main></div>",
        "<div class='related-work'>%s</div>",
        "<form method=post action='/'><div class='sidebar'>Aside words</div>%s</form>",
        "<form role=form><article>%s</article></form>",
        "<article><div class='body share-enabled'>%s</div><div class='share'>Share this</div></article>",
        "<div class='sidebar'>%s</div>",
        "<nav><a href='/'>Home</a><main>%s</main></nav>",
        "<div class='post social-science'><article>%s</article></div>",
        "<article><div class='tags'>%s</div></article>",
        "<div class='post ad-free'>%s</div><div class='comment-list'><p>A short one.</p></div>",
        "<div class='post'>%s</div><div class='related-posts'><a href='/1'>Another text</a> <a href='/2'>A third</a></div>",
        "<article>%s</article><div id='comments'>" + "<p>A comment that is long and goes on for quite a while.</p>" * 40 + "</div>",
    ],
)
def test_names_do_not_empty_a_page(inner):
    assert main_text(AROUND % (inner % TEXT)) == WANT


def test_a_doubtful_root_does_not_displace_an_article():
    got = main_text(AROUND % ("<div><article><p>One.</p><p>Two.</p></article></div><div class='related-work'>" + TEXT * 3 + "</div>"))
    assert "One. Two." in got and WANT in got
    assert main_text("<body><div class='menu'><a href='/'>Only</a></div></body>") == "Only"


LONG = "<p>" + "Words that go on and on, as texts do. " * 60 + "</p>"


@pytest.mark.parametrize("name", ["related-work", "social-science", "tags", "no-sidebar", "skip", "side"])
@pytest.mark.parametrize("frame", ["<article>%s</article>", "<div>%s</div>"])
def test_names_do_not_cut_a_part_out(frame, name):
    got = main_text(AROUND % (frame % (LONG + f"<section class='{name}'>{TEXT}</section>" + LONG)))
    assert WANT in got and got.count("Words that go on") == 120
    links = f"<div class='{name}'>" + "".join(f"<a href='/{i}'>Another page {i}</a> " for i in range(9)) + "</div>"
    assert "Another page" not in main_text(AROUND % (frame % (LONG + links)))


@pytest.mark.parametrize("name", ["comments", "comment-list", "cookie-notice", "site-footer", "ad-slot"])
def test_whole_names_leave_a_part_out(name):
    assert main_text(AROUND % f"<article>{TEXT}</article><div class='x {name}'><p>Not of the text, but quite long all the same.</p></div>") == WANT


COMMENTS = "<p>Great article, thank you for it.</p><p>I do not agree with any of that.</p><p>Where can I read more about this?</p>"
PARTS = "post-comments user-comments reader-comments comment-body newsletter-form cookie-law social-share author-sidebar google-ad article-footer comments comments-section comment-thread site-notice advert-top"
FIRST = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i} of the text, which goes on for a while.</p>" for i in range(2))


@pytest.mark.parametrize("name", PARTS.split())
@pytest.mark.parametrize("frame", ["<article>%s</article>", "<div>%s</div>"])
def test_parts_inside_and_behind_the_article(frame, name):
    part = f"<div class='{name}'>{COMMENTS}</div>"
    rest = TEXT.removeprefix(FIRST)
    for page in (frame % (TEXT + part), frame % TEXT + part, frame % (part + TEXT), frame % (FIRST + part + rest)):
        assert main_text(AROUND % page) == WANT


def tree_of(rnd, depth):
    """(tag, children), a child being text or a tree."""
    tag = rnd.choice(["div", "div", "section", "p", "ul", "a", "b"]) if depth else "body"
    if depth == 4 or tag in ("p", "a", "b"):
        return tag, [" ".join(rnd.choice(["word", "longer", "a"]) + str(rnd.randrange(1000)) for _ in range(rnd.choice([1, 3, 20])))]
    return tag, [tree_of(rnd, depth + 1) for _ in range(rnd.randint(1, 4))]


def written(tree):
    tag, children = tree
    return f"<{tag}>" + "".join(c if isinstance(c, str) else written(c) for c in children) + f"</{tag}>"


def counts(tree, link=False):
    """Characters, tags (emphasis aside), and those of links, below the node."""
    link = link or tree[0] == "a"
    c = t = lc = lt = 0
    for child in tree[1]:
        if isinstance(child, str):
            c, lc = c + len(child), lc + link * len(child)
        else:
            x = counts(child, link)
            c, lc = c + x[0], lc + x[2]
            if child[0] != "b":
                t, lt = t + x[1] + 1, lt + x[3] + (child[0] == "a")
    return c, t, lc, lt


def plain_text_density(body):
    """The rule of the operator, node by node."""
    whole = counts(body)

    def density(tree, link):
        c, t, lc, lt = counts(tree, link)
        if not c:
            return 0.0
        t = max(1, t)
        balance = math.log(c / max(1, c - lc) * lc + whole[2] / whole[0] * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1) / math.log(balance + 1)

    nodes = []  # (tree, density, sum of the children's densities, path)

    def visit(tree, link, path):
        inside = link or tree[0] == "a"
        below = [c for c in tree[1] if not isinstance(c, str)]
        nodes.append((tree, density(tree, link), sum(density(c, inside) for c in below), path))
        for c in below:
            visit(c, inside, [*path, tree])

    visit(body, False, [])
    root = max(enumerate(nodes), key=lambda x: (x[1][2], -x[0]))[1]
    path = [*root[3], root[0]]
    threshold = min(d for tree, d, _, _ in nodes if any(tree is p for p in path))
    dense = {id(tree): d for tree, d, _, _ in nodes}
    out = []

    def take(tree, state):
        if tree is root[0]:
            state = "in"
        elif state == "path" and not any(tree is p for p in path):
            state = "in" if dense[id(tree)] >= threshold or tree[0] in ("a", "b") else "out"
        for c in tree[1]:
            if isinstance(c, str):
                if state == "in":
                    out.append(c)
            else:
                take(c, state)
            if not isinstance(c, str) and c[0] not in ("a", "b"):
                out.append(" ")

    take(body, "path")
    return out


def test_density_threshold_and_root_like_plain_loops():
    rnd, cut = random.Random(8), 0
    for _ in range(300):
        body = tree_of(rnd, 0)
        want = "".join(plain_text_density(body)).split()
        got = main_text(f"<html>{written(body)}</html>").split()
        assert "".join(got) == "".join(want), written(body)
        cut += len("".join(got)) < counts(body)[0] - 20
    assert cut > 30


def test_formulas_stay():
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></article>") == "Let x=2 be."


def test_density_alone_finds_the_text():
    """Nothing in the names of the elements tells."""
    menu = "<div>" + "".join(f"<div><a href='/{i}'>Item {i}</a></div>" for i in range(12)) + "</div>"
    text = "<div>" + "".join(f"<p>This is paragraph {i} of the text, which goes on for quite a while so that it is dense.</p>" for i in range(6)) + "</div>"
    got = main_text(f"<body>{menu}<div>{text}</div>{menu}</body>")
    assert "paragraph 0" in got and "paragraph 5" in got and "Item" not in got


def test_hostile_pages_end():
    for page in ("<div>" * 20_000 + "hello world", "<a " * 50_000, "<!--" * 50_000, "<p>" * 20_000 + "x", "<b>" * 3000 + "y" + "</i>" * 3000, "&" * 50_000):
        main_text(page)


def test_all_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


def test_repeated_pages_and_long_flat_text(spark):
    page, flat = AROUND % f"<article>{TEXT}</article>", "word " * 400_000
    rows = [(1, page), (1, page), (2, page), (3, flat), (4, f"<body>{flat}</body>"), (5, "<p>" + flat)]
    got = sorted((r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id long, html string")).collect())
    assert got == [(1, WANT), (1, WANT), (2, WANT), *[(i, flat.strip()) for i in (3, 4, 5)]]


def test_columns(spark):
    pages = spark.createDataFrame([(1, None, "old"), (None, "<p>x y", None)], "page_id long, html string, text string")
    assert sorted((tuple(r) for r in extract(pages).collect()), key=repr) == sorted([(1, ""), (None, "x y")], key=repr)
    assert extract(pages.limit(0)).count() == 0
