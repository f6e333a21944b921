"""SQL for the operators that it can express; DuckDB's dialect."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

JACCARD_COMPONENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.least AS component_id
FROM sets JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON sets.doc_id = m.a"""


_SCHEME = "'^[A-Za-z][A-Za-z0-9+.-]*:"


def _host(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"


def _rule(host: str, path: str, rules: list[tuple[str, str]], pick: int) -> str:
    """The verdict (pick 0) or the rule (1) of the longest rule that fits."""
    whens = ""
    for one in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = one[1].partition("/")
        whens += f" WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '{slash}{rest}') THEN '{one[pick]}'"
    return f"CASE{whens} END"


def _resolved(u: str, b: str) -> str:
    path, site = f"regexp_extract({u}, '^[^?#]*')", f"regexp_extract({b}, '^([^/?#]*://[^/?#]*)', 1)"
    folder = f"regexp_replace({_path(b)}, '[^/]*\\z', '')"
    full = f"CASE WHEN starts_with({path}, '/') THEN {path} WHEN {folder} = '' THEN '/' || {path} ELSE {folder} || {path} END"
    kept = f"list_reduce(string_split(substr({full}, 2), '/'), lambda acc, x: CASE WHEN x = '..' THEN acc[:-2] WHEN x = '.' THEN acc ELSE list_append(acc, x) END, CAST([] AS VARCHAR[]))"
    undotted = f"regexp_replace('/' || array_to_string({kept}, '/') || CASE WHEN regexp_matches({full}, '/\\.\\.?\\z') THEN '/' ELSE '' END, '^/+\\z', '/')"
    return f"""CASE WHEN regexp_matches({u}, {_SCHEME}//') THEN {u}
      WHEN regexp_matches({u}, {_SCHEME}') OR {site} = '' THEN NULL
      WHEN starts_with({u}, '//') THEN regexp_extract({b}, '^([^:/?#]*)://', 1) || ':' || {u}
      WHEN {path} = '' THEN regexp_extract({b}, '^[^?#]*') || {u}
      ELSE {site} || {undotted} || substr({u}, length({path}) + 1) END"""


def _settled(u: str) -> str:
    kept = f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)='))"
    bare = f"regexp_replace({_host(u)}, '^www\\.|:(80|443)\\z', '', 'g') || regexp_replace({_path(u)}, '/+\\z', '')"
    return f"CASE WHEN contains({u}, '://') THEN {bare} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string(list_sort({kept}), '&') ELSE '' END END"


_BLANK = r"[ \t\n\f\r]"
_RAW = "|".join(rf"<{name}[ \t\n\f\r/>].*?(?:</{name}[ \t\n\f\r/>]|\z)" for name in "script style textarea title xmp iframe noembed noframes".split())
_ATTR = rf"""[^ \t\n\f\r/>=]+(?:{_BLANK}*={_BLANK}*(?:"[^"]*"|''[^'']*''|[^ \t\n\f\r>"''][^ \t\n\f\r>]*)|{_BLANK}*={_BLANK}*)?"""
_TAGS = rf"regexp_extract_all(html, '(?i)<(?:link|meta|base)[ \t\n\f\r/](?:[ \t\n\f\r/]+|{_ATTR})*>')"
_ENTITIES = """MAP {'amp': '&', 'AMP': '&', 'quot': '"', 'apos': '''', 'lt': '<', 'gt': '>', 'sol': '/', 'colon': ':', 'period': '.', 'quest': '?', 'num': '#', 'equals': '=', 'percnt': '%', 'lowbar': '_', 'commat': '@', 'plus': '+', 'semi': ';', 'comma': ','}"""


def _numbered(code: str) -> str:
    return f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({code} AS INTEGER)) ELSE chr(65533) END"


def _unescaped(v: str) -> str:
    pieces = f"regexp_extract_all({v}, '&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z]+;|&|[^&]+')"
    digits = lambda base: f"coalesce(nullif(ltrim(regexp_extract(p, '^&#[xX]?({base}+)', 1), '0'), ''), '0')"
    short = lambda base: f"CASE WHEN length({digits(base)}) < 8 THEN {digits(base)} ELSE '0' END"
    hexed, decimal = f"CAST('0x' || {short('[0-9a-fA-F]')} AS BIGINT)", f"CAST({short('[0-9]')} AS BIGINT)"
    one = f"CASE WHEN regexp_matches(p, '^&#[xX]') THEN {_numbered(hexed)} WHEN regexp_matches(p, '^&#[0-9]') THEN {_numbered(decimal)} ELSE coalesce({_ENTITIES}[regexp_extract(p, '^&([a-zA-Z]+);$', 1)], p) END"
    return f"CASE WHEN contains({v}, '&') THEN array_to_string(list_transform({pieces}, lambda p: {one}), '') ELSE {v} END"


def url_aliases(rules: list[tuple[str, str]]) -> str:
    """Verdicts over pages: rules, and components of redirects and canonical links."""
    attr = lambda name: f"list_filter(attrs, lambda x: x.name = '{name}')[1].value"
    link = lambda u: rf"regexp_replace(regexp_replace({u}, '^[\x00-\x20]+|[\x00-\x20]+\z', '', 'g'), '[\t\n\r]', '', 'g')"
    return rf"""
WITH RECURSIVE shown AS (
  SELECT DISTINCT url, regexp_replace(html, '(?is)<!--(?:-?>|.*?(?:--!?>|\z))|{_RAW}', ' ', 'g') AS html FROM pages
  WHERE contains(url, '://') AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
tags AS (SELECT url, html, unnest({_TAGS}) AS tag, generate_subscripts({_TAGS}, 1) AS i FROM shown),
split AS (
  SELECT url, html, i, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS name, list_transform(regexp_extract_all(regexp_replace(tag, '^<[a-zA-Z]+', ''), '{_ATTR}'),
    lambda a: {{'name': lower(regexp_extract(a, '^[^ \t\n\f\r/>=]+')), 'raw': CASE WHEN contains(a, '=') THEN regexp_replace(a, '^[^=]*={_BLANK}*', '') END}}) AS parts FROM tags),
read AS (
  SELECT url, html, i, name, list_transform(parts, lambda a: {{'name': a.name, 'value': CASE WHEN regexp_matches(a.raw, '^["'']') THEN a.raw[2:-2] ELSE a.raw END}}) AS parts FROM split),
clear AS (SELECT url, html, i, name, list_transform(parts, lambda a: {{'name': a.name, 'value': {_unescaped("a.value")}}}) AS attrs FROM read),
valued AS (
  SELECT url, html, i, name, {attr("href")} AS href, {attr("rel")} AS rel, {attr("http-equiv")} AS equiv,
    regexp_extract({attr("content")}, '(?is)^{_BLANK}*[0-9.]+(?:{_BLANK}*[;,]{_BLANK}*|{_BLANK}+)(?:url{_BLANK}*={_BLANK}*)?(.*)\z', 1) AS target FROM clear),
raw AS (
  SELECT url, html, i, name, CASE
    WHEN name = 'base' OR name = 'link' AND list_contains(regexp_split_to_array(lower(rel), '{_BLANK}+'), 'canonical') THEN href
    WHEN name = 'meta' AND regexp_matches(equiv, '(?i)^{_BLANK}*refresh{_BLANK}*$') THEN CASE WHEN left(target, 1) IN ('"', '''') THEN string_split(substr(target, 2), left(target, 1))[1] ELSE target END END AS u FROM valued),
bare AS (SELECT url, html, i, name, {link("u")} AS u FROM raw),
bases AS (SELECT url AS of_url, html AS of_html, arg_min(u, i) AS base FROM bare WHERE name = 'base' AND u <> '' GROUP BY ALL),
based AS (SELECT url, u, base FROM bare LEFT JOIN bases ON url = of_url AND html = of_html WHERE u <> '' AND name <> 'base'),
placed AS (SELECT url, u, coalesce({_resolved("base", "url")}, url) AS b FROM based),
named AS (SELECT DISTINCT url, link FROM (SELECT url, {_resolved("u", "b")} AS link FROM placed) WHERE link IS NOT NULL),
found AS (
  SELECT '=' || url AS a, '~' || {_settled("url")} AS b FROM pages
  UNION SELECT '=' || url, '=' || link FROM named
  UNION SELECT '=' || link, '~' || {_settled("link")} FROM named),
edges AS (SELECT a, b FROM found WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM found WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
nodes AS (SELECT a, substr(b, 2) AS u FROM reach WHERE starts_with(a, '=') AND starts_with(b, '=')),
told AS (SELECT a, {_rule(_host("u"), _path("u"), rules, 0)} AS v FROM nodes),
decided AS (SELECT substr(a, 2) AS url, bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false) AS blocked FROM told GROUP BY a),
rows AS (SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path FROM pages)
SELECT page_id, host, path, {_rule("host", "path", rules, 1)} AS rule,
  coalesce({_rule("host", "path", rules, 0)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM rows LEFT JOIN decided ON rows.url = decided.url"""


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: By role initials: E nothing yet, S after a system row, U after a user's, A after an assistant's.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda acc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(acc, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS hit FROM named),
made AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM made),
told AS (
  SELECT conv_id, turn, role, text, i, right(rtrim(text, {_WHITE}), 1) AS ending, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
inserts (came, reached, paid, word, lines) AS (VALUES
  ('E', 'E', 0, '', ''), ('E', 'U', 2, 'I', chr(10) || 'user:'), ('E', 'A', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('S', 'S', 0, '', ''), ('S', 'U', 2, 'I', chr(10) || 'user:'), ('S', 'A', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('U', 'U', 0, '', ''), ('U', 'A', 2, 'I', chr(10) || 'assistant:'), ('A', 'A', 0, '', ''), ('A', 'U', 2, 'I', chr(10) || 'user:')),
shifts (reached, symbol, goes_to) AS (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
acts (letter, takes, price, new_role) AS (VALUES ('K', NULL, 0, NULL), ('R', 'u', 2, 'user'), ('R', 'a', 2, 'assistant')),
way AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS place, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} AS found FROM conversations
  UNION ALL
  SELECT conv_id, i, place, min(option) AS found FROM (
    SELECT w.conv_id, f.i, goes_to AS place,
      {{'cost': w.found.cost + paid + price + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, 'audit': w.found.audit || word || letter,
        'lines': w.found.lines || inserts.lines || chr(10) || coalesce(new_role, role) || ':' || text}} AS option
    FROM way w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 AND fault NOT IN ('blank', 'duplicate')
      JOIN inserts ON came = place JOIN acts ON true JOIN shifts ON shifts.reached = inserts.reached AND symbol = coalesce(takes, initial)
    UNION ALL
    SELECT w.conv_id, f.i, place, {{'cost': w.found.cost + 3, 'audit': w.found.audit || 'D', 'lines': w.found.lines}} AS option
    FROM way w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) x
  GROUP BY conv_id, i, place),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
every AS (
  SELECT conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN (SELECT conv_id AS of_conv, * EXCLUDE conv_id FROM counted) b ON conv_id IS NOT DISTINCT FROM of_conv),
best AS (
  SELECT w.conv_id, min({{'cost': found.cost + paid, 'audit': found.audit || word, 'lines': found.lines || inserts.lines}}) AS r
  FROM way w JOIN every e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = e.n JOIN inserts ON came = place
  WHERE reached = 'A' OR place = 'E' AND reached = 'E' GROUP BY w.conv_id)
SELECT e.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, r.cost AS cost, r.audit AS audit, sha256(substr(r.lines, 2)) AS repaired_sha256
FROM every e JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id"""
