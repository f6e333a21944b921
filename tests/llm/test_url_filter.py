import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from compare import assert_equal
from pyspark.sql import functions as F

from quarry.llm.queries import SQL, URL_RULES, op2_url_aliases
from quarry.llm.url_filter import judge, named_links, resolved

PAGES = [
    (1, "http://A.com/en/x", '<link rel="canonical" href="http://b.org/q">'),
    (2, "http://b.org/q", None),
    (3, "http://example.com/en/7a", '<link href="/z" rel=canonical>'),
    (4, "http://example.com/z", None),
    (5, None, None),
    (6, "nourl", None),
    (7, "https://www.b.org/q/#f", None),
    (8, "http://example.com/en/z", "<meta http-equiv=refresh content='0; url=http://c.net/1'>"),
    (9, "http://c.net/1", ""),
    (10, "https://example.com/en/7a/?utm_x=1", "<link rel=canonical href='http://c.net/1'>"),
    (11, "http://d.net/1", ""),
    (12, "http://b.org/q", "<link rel=canonical href='http://b.org/q'>"),
]


def test_aliases(spark):
    got = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[1] == ("com/en/", "block")
    assert got[2] == got[7] == got[12] == (None, "block")  # the canonical link of a blocked page, and what redirects to it
    assert got[3] == got[10] == ("example.com/en/7", "allow")
    assert got[4] == got[9] == (None, "allow")  # blocked and allowed aliases: the allow goes first
    assert got[8] == ("com/en/", "block")  # its own rule goes before
    assert got[5] == got[6] == got[11] == (None, "allow")


def test_urls_in_parameters_are_no_urls(spark):
    pages = [
        (1, "http://good.com/r?u=http://spam.org/es/1", None),
        (2, "https://www.good.com/r/?u=http://spam.org/es/1", None),
        (3, "http://bad.com/en/x?u=http://example.com/en/7", "<link rel=canonical href='http://q.info/1'>"),
        (4, "http://q.info/1", None),
        (5, "http://archive.info/http://spam.org/es/1", None),
    ]
    got = {r.page_id: r for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {1: (None, "allow"), 2: (None, "allow"), 3: ("com/en/", "block"), 4: (None, "block"), 5: (None, "allow")}
    assert got[1].alias == got[2].alias == "http://good.com/r?u=http://spam.org/es/1"


@pytest.mark.parametrize(
    "link",
    [
        '<LINK REL="CANONICAL" HREF="http://q.net/1">',
        "<link href='../../z' rel='canonical'>",
        "<link rel=canonical href='z?a=1&amp;b=2'>",
        "<link rel=canonical href='?id=7'>",
        "<base href='http://q.net/x/'><link rel=canonical href=y>",
        "<base href='../up/'><meta HTTP-EQUIV=Refresh content='3;URL=y'>",
        "<link rel='canonical' href='//q.net/1'>",
    ],
)
def test_blocks_reach_what_links_name(spark, link):
    ends = {"../../z": "http://spam.org/z", "z?a": "http://spam.org/es/b/z?a=1&b=2", "?id": "http://spam.org/es/b/c?id=7", "/x/'": "http://q.net/x/y", "up/": "http://spam.org/es/up/y"}
    end = next((v for k, v in ends.items() if k in link), "http://q.net/1")
    pages = [(1, "http://spam.org/es/b/c", "<p>long</p>" * 50_000 + link), (2, end, ""), (3, "http://q.net/other", "")]
    rules = [("block", "spam.org/es/b/c")]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_links_resolve_as_urljoin_has_it(spark):
    rnd = random.Random(5)
    links = ["", "x", "./x", "../x", "../../../x", "/x/../y", "/..", "a/./b/../c/", "..", ".", "?q=1", "x?q=/../z", "#f", "x#y/../z", "//h.org/a/b", "https://h.org/q", "x/.."]
    links += ["".join(rnd.choice(["..", ".", "/", "/", "a", "b", "?", "#"]) for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    bases = ["http://e.com", "http://e.com/", "http://e.com/a/b/c", "http://e.com/a/b/c/?q=/x/y", "http://e.com/a/b#f/g"]
    rows = [(u, b) for u in links for b in bases if "//" not in u or u in ("//h.org/a/b", "https://h.org/q")]  # urljoin drops empty segments
    got = spark.createDataFrame(rows, "u string, b string").select("u", "b", resolved(F.col("u"), F.col("b")).alias("r")).collect()
    for r in got:
        if r.u.split("#")[0] and not re.search(r"\?(#|$)", r.u):  # the page itself; an empty query, which urljoin drops
            same = lambda x: re.sub(r"^http://e\.com(?=$|[?#])", "http://e.com/", x.rstrip("?#"))  # noqa: E731  one url
            assert same(r.r) == same(urljoin(r.b, r.u)), (r.u, r.b)
    odd = spark.createDataFrame([("mailto:a@b.c", "http://e.com/"), ("x", "nourl"), (None, "http://e.com/"), ("x", None)], "u string, b string")
    assert [r.r for r in odd.select(resolved(F.col("u"), F.col("b")).alias("r")).collect()] == [None] * 4


def made_pages(n):
    rnd, hosts = random.Random(n), ["a.com", "www.a.com", "example.com", "spam.org", "b.net:80", "example.net", "q.info"]
    url = lambda: f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'de', 'x'])}/{rnd.choice(['', '7', '8', '1', 'y/2'])}{rnd.choice(['', '/', '?b=1&a=2', '?utm_s=1', '#t'])}"
    link = lambda: rnd.choice([url(), url(), "/es/1", "../x/1", "?a=2&amp;b=1", "7", "//spam.org/es/1", "mailto:x"])
    forms = ['<link rel="canonical" href="%s">', "<LINK HREF='%s' REL=canonical>", '<meta http-equiv="refresh" content="0; url=%s">', "<base href='http://q.info/de/'><link rel=canonical href='%s'>"]
    rows = [(i, url(), rnd.choice(["", "<p>x", *forms]).replace("%s", link())) for i in range(n)]
    return [*rows, (n, None, forms[0] % url()), (n + 1, "nourl", forms[0] % url()), (n + 2, url(), None), rows[3], (None, url(), "")]


@pytest.mark.parametrize("n", [15, 60])
def test_like_sql_with_links(spark, tmp_path, n):
    spark.createDataFrame(made_pages(n), "page_id long, url string, html string").coalesce(1).toPandas().astype({"page_id": "Int64"}).to_parquet(tmp_path / "pages.parquet")
    assert_equal(op2_url_aliases(spark, str(tmp_path)), str(tmp_path), SQL["op2_url_aliases"])


NAMING = [
    '<link rel="alternate canonical" href="http://q.net/1">',
    '<link rel=canonical href="http://q.net/1" data-href="http://z.net/2">',
    '<link title="a>b" rel=canonical href="http://q.net/1">',
    '<link rel=canonical href="http:&#x2F;&#47;q.net&sol;1">',
    '<link rel=canonical href = "  http://q.net/1 ">',
    "<link rel='Canonical' href=http://q.net/1 href=http://z.net/2 />",
]
NOT_NAMING = [
    '<!-- <link rel=canonical href="http://q.net/1"> -->',
    '<link rel="canonical-x" href="http://q.net/1">',
    '<link data-rel="canonical" href="http://q.net/1">',
    '<script>var x = "<link rel=canonical href=http://q.net/1>";</script>',
    '<link title="rel=canonical href=http://q.net/1">',
    '<linked rel=canonical href="http://q.net/1">',
]


def test_links_that_are_there_and_that_are_not(spark, tmp_path):
    """Blocked pages with some html, and what it may name, in Spark and in SQL."""
    rows = []
    for k, html in enumerate(NAMING + NOT_NAMING):
        mine = re.sub(r"\b([qz])\.net", rf"\g<1>{k}.net", html)
        rows += [(3 * k, f"http://spam.org/es/{k}", "<head>" + mine + "<p>x"), (3 * k + 1, f"http://q{k}.net/1", ""), (3 * k + 2, f"http://z{k}.net/2", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert_equal(op2_url_aliases(spark, str(tmp_path)), str(tmp_path), SQL["op2_url_aliases"])
    got = {r.page_id: r.verdict for r in op2_url_aliases(spark, str(tmp_path)).collect()}
    want = [["block", "block" if k < len(NAMING) else "allow", "allow"] for k in range(len(NAMING + NOT_NAMING))]
    assert [got[i] for i in range(len(rows))] == [v for three in want for v in three]


class Links(HTMLParser):
    """Canonical links and refreshes, as the standard library reads tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base, self.found = None, []

    def handle_starttag(self, tag, attrs):
        at = {}
        for name, value in attrs:
            at.setdefault(name, value)
        if tag == "base" and self.base is None and (at.get("href") or "").strip():
            self.base = at["href"].strip()
        link = at.get("href") if tag == "link" and "canonical" in (at.get("rel") or "").lower().split() else None
        if tag == "meta" and (at.get("http-equiv") or "").strip().lower() == "refresh":
            m = re.match(r"""\s*[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", at.get("content") or "", re.I | re.S)
            link = next((g for g in m.groups() if g is not None), None) if m else None
        if link and link.strip():
            self.found.append(link.strip())


def made_html(rnd):
    url = lambda: rnd.choice(["http://q.net/1", "http://q.net/a&amp;b", "/es/1", "x?a=1&#38;b", "https:&#x2f;&#x2F;e.com/%20", "y", "../z", "http://h.org/&#233;"])
    value = lambda v: rnd.choice([f'"{v}"', f"'{v}'", v.replace(" ", "") or '""', f'" {v}\n"'])
    sp = lambda: rnd.choice(["", "", " ", "\n"])

    def tag():
        kind = rnd.choice(["link", "LINK", "link", "meta", "Meta", "base", "links"])
        attrs = [("href", url()), ("rel", rnd.choice(["canonical", "CANONICAL", "alternate canonical", "canonical-x"])), ("http-equiv", rnd.choice(["refresh", "Refresh", "content-type"])),
                 ("content", rnd.choice(["0; url=", "5;URL=", "0, ", "1 url = '", "x; url="]) + url()), ("title", "a>b"), ("data-rel", "canonical"), ("data-href", "http://w.org/"), ("hidden", None), ("HREF", url()), ("title", "it''s rel=canonical")]
        chosen = rnd.sample(attrs, rnd.randint(5, 9))
        body = "".join(rnd.choice([" ", "\n", "\t "]) + name + ("" if v is None else sp() + "=" + sp() + (f'"{v}"' if ">" in v or "'" in v or " " in v else value(v))) for name, v in chosen)
        return f"<{kind}{body}{rnd.choice(['', ' ', ' /'])}>"

    parts = [rnd.choice([tag, tag, tag, lambda: "<!-- " + tag() + " -->", lambda: "<script>x = '" + tag() + "'</script>", lambda: "<p>text &lt;link rel=canonical>", lambda: "<style>" + tag() + "</style>"])() for _ in range(rnd.randint(1, 6))]
    return "<html><head>" + "".join(parts)


def test_links_like_the_standard_parser(spark):
    rnd = random.Random(9)
    pages = [(i, "http://e.com/a/b", made_html(rnd)) for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.links, r.html) for r in df.select("page_id", "html", named_links(F.col("url"), F.col("html")).alias("links")).collect()}
    some = 0
    for i, url, html in pages:
        parser = Links()
        parser.feed(html)
        base = urljoin(url, parser.base or "")
        want = [urljoin(base, u) for u in parser.found]
        assert got[i][0] == want, html
        some += bool(want)
    assert some > 200


def test_very_long_pages(spark):
    pages = ["canonical <link" + " a='1'" * 20_000 + " rel=canonical href=ok>", "<!--" * 30_000 + "canonical", "canonical" + "<link rel=canonical href='" * 3_000, "canonical &" + "&#" * 50_000 + "<link rel=canonical href='" + "&#x;&" * 20_000 + "'>"]
    df = spark.createDataFrame([("http://e.com/", p) for p in pages], "url string, html string")
    assert [len(r.links) for r in df.select(named_links(F.col("url"), F.col("html")).alias("links")).collect()] == [1, 0, 0, 1]


def plain(url):
    """Host, path, rule and verdict without aliases."""
    _, found, rest = (url or "").partition("://")
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_all_given_pages(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op2_url_aliases(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ((verdict,) if verdict else ("allow", "block"))  # and exactly in test_sql


def test_empty(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string, html string, id int, label int"), URL_RULES).count() == 0
