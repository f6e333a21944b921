"""URL filter with redirect equivalence (operator 2), in DataFrame functions only.

Rules name a host (with its subdomains) and a path prefix, and block or allow; the
longest that fits a url decides. Urls that no rule fits take the decision of their
aliases: urls are joined to those that they redirect to (a refresh in the page; what
servers redirect by custom: another scheme, a www host, a last slash, a fragment,
tracking parameters) and to the page's canonical link, and the connected components
of these edges are the aliases. A component with a url that a rule blocks is blocked,
unless it also has one that a rule allows: an explicit allow takes precedence.

Tags are read as HTML has them: comments and the text of scripts and the like are left out, a
quoted value is one whatever it holds, attributes are told by their whole names (the first of
a name counts), rel is a list of words, and character references in values are decoded (those
by number, and the names of characters that urls have). A page is read only if it has the word
canonical or refresh somewhere. Links are resolved against the page's url or its base element.
Links of schemes without "://" are no urls.

Edge cases: null urls and those without "://" have an empty host and path, no rule and
no aliases, and are allowed. Null html has no edges. Pages that repeat a url share its
decision. An empty table gives no rows. Whole pages are searched, however long. Other
columns are ignored, whatever their names; rows of a null id are judged like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: a short
    list of ("block" or "allow", "host/path")."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def settled(url: Column) -> Column:
    """The url that servers redirect to by custom: without scheme, www, fragment,
    tracking parameters and last slash. Null without "://"."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[a-z]+|gclid|fbclid|ref)=") & (p != ""))
    bare = F.concat(F.regexp_replace(host_of(url), r"^www\.|:(80|443)\z", ""), F.regexp_replace(path_of(url), r"/+\z", ""))
    return F.when(F.locate("://", url) > 0, F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(bare))


def _with(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _undotted(path: Column) -> Column:
    """A path without the segments . and .., the latter with the one before them."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), none, step)
    ends = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), ends), r"^/+\z", "/")


def resolved(link: Column, base: Column) -> Column:
    """What a page at base means by a link; null if that is no url."""
    site = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    own = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")
    path = F.regexp_extract(link, r"^[^?#]*", 0)
    after = F.substring(link, F.length(path) + 1, F.length(link))
    full = F.when(path.startswith("/"), path).when(folder == "", F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.lit(":"), link))
        .when(path == "", F.concat(own, after))
        .otherwise(F.concat(site, _undotted(full), after))
    )


# Fixed values of HTML: white space, elements whose content is no markup, an attribute, a tag.
_WS = r"[ \t\n\f\r]"
_HIDDEN = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[ \t\n\f\r/>]).*?(?:</\1(?=[ \t\n\f\r/>])|\z)"
_NAME = r"[^ \t\n\f\r/>=]++"
_ATTRIBUTE = rf"""{_NAME}(?:{_WS}*+=(?:{_WS}*+"[^"]*+"|{_WS}*+'[^']*+'|{_WS}*+[^ \t\n\f\r>"'][^ \t\n\f\r>]*+|{_WS}*+(?=>)))?+"""
_TAG = rf"(?i)<(?:link|meta|base)(?=[ \t\n\f\r/>])(?:[ \t\n\f\r/]++|{_ATTRIBUTE})*+>"
_REFERENCE = "&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z]+;|&|[^&]+"
_NAMED = {"amp": "&", "AMP": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "period": ".", "quest": "?", "num": "#", "equals": "=", "percnt": "%", "lowbar": "_", "commat": "@", "plus": "+", "semi": ";", "comma": ","}


def _character(reference: Column) -> Column:
    """What one reference stands for; other text as it is."""
    digits = F.regexp_replace(F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
    short = F.when(F.length(digits) < 8, digits).otherwise("0")
    code = F.when(reference.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    by_number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    by_name = F.coalesce(F.try_element_at(names, F.regexp_extract(reference, "^&([a-zA-Z]+);$", 1)), reference)
    return F.when(reference.rlike("^&#[xX]?[0-9a-fA-F]"), by_number).when(reference.startswith("&"), by_name).otherwise(reference)


def decoded(value: Column) -> Column:
    """An attribute's value with its character references decoded."""
    return F.when(F.locate("&", value) > 0, F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), 0), _character), "")).otherwise(value)


def attributes(tag: Column) -> Column:
    """An array of (name, value) in the order of the tag; values decoded, null where there is none."""

    def parts(a: Column) -> Column:
        raw = F.when(F.locate("=", a) > 0, F.regexp_replace(a, rf"^[^=]*={_WS}*", ""))
        bare = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct(F.lower(F.regexp_extract(a, f"^{_NAME}", 0)).alias("name"), decoded(bare).alias("value"))

    return F.transform(F.regexp_extract_all(F.regexp_replace(tag, "^<[a-zA-Z]+", ""), F.lit(_ATTRIBUTE), 0), parts)


def _value(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda x: x["name"] == name), F.lit(0))["value"]


def _as_url(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")


def _refresh_to(content: Column) -> Column:
    """The url in the content of a refresh."""
    rest = F.regexp_extract(content, rf"(?is)^{_WS}*[0-9.]+{_WS}*(?:[;,]{_WS}*|(?<={_WS}))(?:url{_WS}*={_WS}*)?(.*)\z", 1)
    inner = F.substring(rest, 2, 1 << 30)
    return F.when(rest.startswith('"'), F.substring_index(inner, '"', 1)).when(rest.startswith("'"), F.substring_index(inner, "'", 1)).otherwise(rest)


def named_links(url: Column, html: Column) -> Column:
    """Urls that the page names as its canonical link or refreshes to."""
    none, low = F.array().cast("array<string>"), F.lower(html)

    def of_tag(tag: Column) -> Column:
        """(kind, link) of a tag: base, or link for a canonical link or a refresh; else nulls."""

        def told(attrs: Column) -> Column:
            name = F.lower(F.regexp_extract(tag, "^<([a-zA-Z]+)", 1))
            canonical = (name == "link") & F.array_contains(F.split(F.lower(_value(attrs, "rel")), f"{_WS}+"), "canonical")
            refresh = (name == "meta") & (F.lower(F.btrim(_value(attrs, "http-equiv"), F.lit(" \t\n\f\r"))) == "refresh")
            link = F.when(refresh, _refresh_to(_value(attrs, "content"))).otherwise(_value(attrs, "href"))
            kind = F.when(name == "base", "base").when(canonical | refresh, "link")
            return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), _as_url(link)).alias("link"))

        return _with(attributes(tag), told)

    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAG), 0)

    def links(found: Column) -> Column:
        of = lambda kind: F.transform(F.filter(found, lambda x: (x["kind"] == kind) & (x["link"] != "")), lambda x: x["link"])
        base = F.coalesce(resolved(F.get(of("base"), F.lit(0)), url), url)
        return _with(base, lambda b: F.filter(F.transform(of("link"), lambda u: resolved(u, b)), lambda u: u.isNotNull()))

    some = (F.locate("canonical", low) > 0) | (F.locate("refresh", low) > 0)
    return F.when(some & (F.locate("://", url) > 0), _with(F.transform(tags, of_tag), links)).otherwise(none)


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, path, rule, verdict, alias) for each page; alias is the least
    url of its component, null where it has no other."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), named_links(F.col(url_col), F.col(html_col)).alias("links"))
    rows = materialize(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "settled": settled(F.col("url"))}), "url-rows")
    named = rows.where(F.size("links") > 0).select("url", F.explode("links").alias("b"))
    # Nodes: "=" and a url, or "~" and a settled url, which may hold "://" in its query.
    real, bare = lambda c: F.concat(F.lit("="), c), lambda c: F.concat(F.lit("~"), c)
    found = rows.select(real(F.col("url")).alias("a"), bare(F.col("settled")).alias("b"))
    found = found.unionByName(named.select(real(F.col("url")).alias("a"), real(F.col("b")).alias("b")))
    found = found.unionByName(named.select(real(F.col("b")).alias("a"), bare(settled(F.col("b"))).alias("b")))
    groups = materialize(components(found, hashed=True), "url-groups")

    # One decision for each component, from the rules that fit its urls, seen or named.
    # A settled url stands for its group and is no url of its own.
    groups = groups.where(F.col("node").startswith("=")).select(F.expr("substring(node, 2)").alias("node"), F.expr("substring(label, 2)").alias("label"))
    groups = groups.where(F.locate("://", "node") > 0)
    by_rule = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    own = groups.select("label", by_rule.alias("v")).groupBy("label").agg(F.max(F.col("v") == "block").alias("blocked"), F.max(F.col("v") == "allow").alias("allowed"))
    own = materialize(own, "url-decisions")
    decided = materialize(groups.join(own, "label"), "url-decided")
    out = rows.join(decided, rows.url == decided.node, "left")
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    blocked = F.coalesce(F.col("blocked"), F.lit(False)) & ~F.coalesce(F.col("allowed"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "host",
        "path",
        fit["rule"].alias("rule"),
        F.coalesce(fit["verdict"], F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.col("label").alias("alias"),
    )
