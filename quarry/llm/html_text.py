"""Main text of web pages by composite text density (operator 9).

A page becomes a tree of its elements. Each node has the characters and tags below
it, and those of them in links. Its density is characters per tag, lowered by the
share of link text. The content root is the node whose children's densities have the
greatest sum. The least density on the path from it to the body is the threshold:
outside the root's subtree, a block counts as content too if its own density and
those of its ancestors below the path reach the threshold.

Elements whose tag or role says that they are menus, headers, footers, sidebars,
notices, scripts or styles take no part in the densities and give no text, unless a
menu and the like holds a main element. A header inside an article belongs to it.

Names (class, id) and forms say less, as a page's frame may be `has-sidebar` or one
form. They are one weight of several, see Page.dropped: how surely a name speaks (`ad`,
`user-comments`, `related-work`), how much of the text of its article or of the body
the element has, whether all that text lies on one side of it, whether an article has text
elsewhere, how much of its own text is links, and whether it looks like a section of its
own (a heading and paragraphs as long as others, with text before and behind). What
holds an article or main with text is never left out by name. If nothing is left, names
and forms are disregarded.

Edge cases: null html is the empty page, whose text is empty. Unclosed elements end
where their parent ends, a paragraph where the next block begins. A comment or
script that never ends reaches to the end of the page. A page without body is taken
whole. Very deep pages are walked without recursion. Repeated rows give repeated
results. Columns beside those named are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# What is not content, by tag, by role and by the words of class and id.
DROP_TAGS = frozenset("button select svg object audio video canvas head".split()) | RAW
BESIDE_TAGS = frozenset("nav footer aside dialog menu".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
TEXT_TAGS = frozenset("article main".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing widget pagination pager".split()
)
# Of these, the words that seldom say anything else.
SURE_NAMES = frozenset("ad ads advert adverts advertisement adsense adbox sponsored cookie cookies gdpr newsletter comment comments disqus popup navbar breadcrumb breadcrumbs masthead".split())
# Names that may be those of a topic, words that say nothing beside others, and words that turn a name round.
TOPIC_NAMES = frozenset("side social related recommended tags skip".split())
PLAIN_NAMES = frozenset("area bar block box body bottom buttons col column container content form global group inner item items left links list main outer page panel primary right row secondary section site slot thread top unit wrap wrapper".split())
TURNING_NAMES = frozenset("no non not has have with without free enabled disabled is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# What a tag or role says: beside the content, or none at all.
BESIDE, DROP = 1, 2
# What a name weighs: a form or nothing but words of DROP_NAMES, one that is named by such a word, one with
# such a word, one that may be a topic. An element goes from OUT on.
WHOLE, NAMED, PARTLY, TOPIC, OUT = 3.0, 2.0, 1.0, 0.5, 3.0

#: A paragraph of so many characters is long, however long the others are.
LONG_PARAGRAPH = 80

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """A page's elements as parallel lists; node 0 is the document."""

    def __init__(self, text: str):
        self.tag, self.parent, self.doubt, self.weight, self.link = ["#document"], [-1], [0], [0.0], [False]
        self.runs: list[tuple[int, str]] = []  # (node, text) in page order; "" is a block's border
        self._open = [0]
        self._parse(text)

    def _parse(self, text: str) -> None:
        at, end = 0, len(text)
        last = text.rfind(">")
        while at < end:
            lt = text.find("<", at)
            if lt < 0:
                self._text(text[at:])
                return
            if lt > at:
                self._text(text[at:lt])
            if text.startswith("<!--", lt):
                close = text.find("-->", lt + 4)
                at = end if close < 0 else close + 3
            elif text.startswith(("<!", "<?"), lt):
                close = text.find(">", lt)
                at = end if close < 0 else close + 1
            elif lt > last:
                if re.match(r"</?[a-zA-Z]", text[lt : lt + 3]):
                    return  # a tag that the page's end cuts off
                self._text("<")
                at = lt + 1
            elif m := _TAG.match(text, lt):
                closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
                name = name.lower()
                at = m.end()
                if closing:
                    self._close(name)
                else:
                    self._start(name, rest)
                    if name in RAW and name != "svg":
                        close = re.compile(f"</{name}\\b[^>]*>", re.I).search(text, at)
                        if name == "title" and close is None:
                            close = _TAG.search(text, at)
                            at = close.start() if close else end
                        else:
                            at = close.end() if close else end
                        self._pop()
            else:
                self._text("<")
                at = lt + 1

    def _text(self, text: str) -> None:
        self.runs.append((self._open[-1], html_lib.unescape(text) if "&" in text else text))

    def _pop(self) -> None:
        node = self._open.pop()
        if self.tag[node] not in INLINE:
            self.runs.append((self._open[-1], ""))

    def _close(self, name: str) -> None:
        if name == "br":
            self.runs.append((self._open[-1], ""))
            return
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == name:
                while len(self._open) > depth:
                    self._pop()
                return
            if name in INLINE and self.tag[self._open[depth]] not in INLINE:
                return  # an inline end tag does not end a block

    def _start(self, name: str, rest: str) -> None:
        tag = self.tag
        if name in ENDS_P or name in ENDS_SAME:
            ends, stop = ("p", ()) if name in ENDS_P else (name, ENDS_SAME[name])
            for depth in range(len(self._open) - 1, 0, -1):
                t = tag[self._open[depth]]
                if t == ends or name in ("dt", "dd") and t in ("dt", "dd") or name in ("td", "th") and t in ("td", "th"):
                    while len(self._open) > depth:
                        self._pop()
                    break
                if t in stop or ends == "p" and t not in INLINE:
                    break
        if name == "body":
            while len(self._open) > 1 and tag[self._open[-1]] != "html":
                self._pop()
        up = self._open[-1]
        node = len(tag)
        tag.append(name)
        self.parent.append(up)
        self.link.append(self.link[up] or name == "a")
        doubt, weight = self._not_content(name, rest)
        self.doubt.append(doubt)
        self.weight.append(weight)
        if name not in INLINE:
            self.runs.append((node, ""))
        if name not in VOID and not rest.endswith("/"):
            self._open.append(node)
        elif name == "br":
            self.runs.append((up, ""))

    def _not_content(self, name: str, rest: str) -> tuple[int, float]:
        if name in DROP_TAGS:
            return DROP, 0.0
        if name in BESIDE_TAGS:
            return BESIDE, 0.0
        if name == "header":
            return 0 if any(self.tag[x] in TEXT_TAGS for x in self._open) else BESIDE, 0.0
        weight = WHOLE if name == "form" else 0.0
        if rest and name not in ("html", "body", "article", "main") and ("=" in rest):
            for m in _NAMES.finditer(rest):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "role":
                    if value.lower() in BESIDE_ROLES:
                        return BESIDE, 0.0
                    if value.lower() == "form":
                        weight = WHOLE
                else:
                    weight = max([weight, *map(name_weight, value.split())])
        return 0, weight

    def dropped(self) -> tuple[list[bool], list[bool]]:
        """Which nodes are no content, and which lie in one that is content only since
        it holds most of the text.

        To the weight of a doubtful element's name are added: 1 if it has up to half of the
        text (links aside) of its frame, the article or body around it, else -2; 1 if all
        other text of the frame that is not in doubt lies before it, or all behind it; 2 if
        it is in no article and an article has text; 2 if its own text is links for the
        greater part; and -1.5 if it is a section of its own, within the text."""
        n = len(self.tag)
        tag, parent, doubt, weight = self.tag, self.parent, self.doubt, self.weight
        out, most = [False] * n, [False] * n
        main = [t == "main" for t in tag]
        for i in range(n - 1, 0, -1):
            main[parent[i]] |= main[i] and doubt[i] != DROP
        beside = [False] * n
        for i in range(1, n):
            beside[i] = (beside[parent[i]] or doubt[i] == BESIDE) and tag[i] != "main"
            out[i] = out[parent[i]] or doubt[i] == DROP or beside[i] and not main[i]
        if not any(weight[i] and not out[i] for i in range(1, n)):
            return out, most
        chars, plain = [0] * n, [0] * n  # with links and without
        for node, run in self.runs:
            if run and not out[node]:
                size = len(run.strip())
                chars[node] += size
                if not self.link[node]:
                    plain[node] += size
        holds, frame = [False] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if not out[i]:
                chars[parent[i]] += chars[i]
                plain[parent[i]] += plain[i]
                holds[parent[i]] |= holds[i] or tag[i] in TEXT_TAGS and chars[i] > 0
        body = next((i for i in range(n) if tag[i] == "body" and chars[i]), 0)
        told = False  # whether an article has text
        for i in range(1, n):
            frame[i] = frame[parent[i]]
            if tag[i] in TEXT_TAGS and not out[i]:
                told |= plain[i] > 0
                frame[i] = i
        large = [2 * plain[i] > plain[frame[i] or body] for i in range(n)]
        # The doubtful element that a node lies in, if any, and where the text not in doubt begins and ends.
        within = [0] * n
        for i in range(1, n):
            within[i] = i if weight[i] and not large[i] and not holds[i] else within[parent[i]]
        firsts, lasts, began, ended = {}, {}, [len(self.runs)] * n, [-1] * n
        for at, (node, run) in enumerate(self.runs):
            if run.strip() and not out[node]:
                began[node], ended[node] = min(began[node], at), at
                if not within[node] and not self.link[node]:
                    firsts.setdefault(frame[node], at)
                    lasts[frame[node]] = at
        for i in range(n - 1, 0, -1):
            began[parent[i]], ended[parent[i]] = min(began[parent[i]], began[i]), max(ended[parent[i]], ended[i])
        sections = self._sections(plain, within, frame)
        sure = out
        out = list(sure)
        for i in range(1, n):
            out[i] |= out[parent[i]]
            most[i] = most[parent[i]]
            if weight[i] and not out[i] and not holds[i]:
                amid = firsts.get(frame[i], len(self.runs)) < began[i] and ended[i] < lasts.get(frame[i], -1)
                told_elsewhere = told and not frame[i]
                score = weight[i] + (-2 if large[i] else 1) + (not amid) + 2 * told_elsewhere + 2 * (2 * plain[i] < chars[i]) - 1.5 * (amid and i in sections)
                out[i] = score >= OUT
                most[i] |= large[i] and not out[i]
        if not any(run.strip() and not out[node] for node, run in self.runs):
            return sure, most
        return out, most

    def _sections(self, plain: list[int], within: list[int], frame: list[int]) -> set[int]:
        """Doubtful elements with a heading and two or more paragraphs, on average at least
        half as long as the median paragraph of their frame that is not in doubt."""
        usual: dict[int, list[int]] = {}
        own: dict[int, list[int]] = {}
        headed = set()
        for i, tag in enumerate(self.tag):
            if tag == "p" and plain[i]:
                (own if within[i] else usual).setdefault(within[i] or frame[i], []).append(plain[i])
            elif tag in HEADINGS and within[i]:
                headed.add(within[i])
        typical = {f: sorted(sizes)[len(sizes) // 2] for f, sizes in usual.items()}
        return {i for i in headed if len(own.get(i, ())) > 1 and 2 * sum(own[i]) >= len(own[i]) * min(typical.get(frame[i], 0), LONG_PARAGRAPH)}


def name_weight(name: str) -> float:
    """How much a class or an id says that an element is no content."""
    words = [w.lower() for w in _WORD.findall(name)]
    if TURNING_NAMES.intersection(words):
        return TOPIC
    words = [w for w in words if w not in PLAIN_NAMES]
    if not words:
        return 0.0
    if all(w in DROP_NAMES for w in words):
        return WHOLE
    if words[-1] in DROP_NAMES or SURE_NAMES.intersection(words):
        return NAMED
    return PARTLY if DROP_NAMES.intersection(words) else TOPIC if TOPIC_NAMES.intersection(words) else 0.0


def densities(page: Page, dropped: list[bool], body: int, chars: list[int], link_chars: list[int]) -> list[float]:
    """Characters per tag of each node, lowered by its share of link text. chars and
    link_chars are those of the nodes' own text, and come out as those of their subtrees."""
    n, parent = len(page.tag), page.parent
    tags, link_tags = [0] * n, [0] * n
    for node in range(n - 1, 0, -1):  # children come after their parents
        if not dropped[node]:
            up = parent[node]
            chars[up] += chars[node]
            link_chars[up] += link_chars[node]
            if page.tag[node] in INLINE and page.tag[node] != "a":
                continue  # emphasis is not structure
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (page.tag[node] == "a")
    if not chars[body]:
        body = 0
    whole_c, whole_l = max(1, chars[body]), link_chars[body]

    def density(i: int) -> float:
        c = chars[i]
        if not c:
            return 0.0
        t, lc, lt = max(1, tags[i]), link_chars[i], link_tags[i]
        base = math.log(c / max(1, c - lc) * lc + whole_l / whole_c * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1) / math.log(base + 1)

    return [0.0 if dropped[i] else density(i) for i in range(n)]


def main_text(text: str | None) -> str:
    """The main text of one page."""
    page = Page(text or "")
    n, parent = len(page.tag), page.parent
    chars, link_chars = [0] * n, [0] * n
    dropped, most = page.dropped()
    for node, run in page.runs:
        if run and not dropped[node]:
            size = len(run.strip())
            chars[node] += size
            if page.link[node]:
                link_chars[node] += size
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    dense = densities(page, dropped, body, chars, link_chars)
    if not chars[body]:
        body = 0
    total = [0.0] * n
    for i in range(1, n):
        if not dropped[i]:
            total[parent[i]] += dense[i]
    within = [False] * n
    within[body] = True
    for i in range(body + 1, n):
        within[i] = within[parent[i]]
    root = max((i for i in range(body, n) if within[i] and not dropped[i]), key=lambda i: (total[i], -i))
    path, threshold, i = set(), math.inf, root
    while True:
        path.add(i)
        threshold = min(threshold, dense[i])
        if i == body or i < 0 or parent[i] < 0:
            break
        i = parent[i]
    # 0: not content, 1: on the path to the root, 2: content.
    state = [0] * n
    for i in range(n):
        up = state[parent[i]] if i else 0
        if i == root:
            state[i] = 2
        elif i in path:
            state[i] = 1
        elif dropped[i]:
            state[i] = 0
        elif up == 2:
            state[i] = 2
        elif up == 1 and (dense[i] >= threshold or page.tag[i] in INLINE):
            state[i] = 2
        elif most[root] and page.tag[i] in TEXT_TAGS:
            state[i] = 2  # a doubtful root does not displace an article
    out = []
    for node, run in page.runs:
        if not run:
            out.append(" ")
        elif state[node] == 2 and not dropped[node]:
            out.append(run)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The given columns without html, with the page's main text."""
    keep = [c for c in pages.columns if c not in (html_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(html_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, out_col])

    from pyspark.sql import types as T

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out_col, T.StringType())])
    return pages.select(*keep, html_col).mapInArrow(run, schema)
