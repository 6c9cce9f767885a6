"""Main text of web pages by composite text density.

A page becomes a tree of elements. For each, the characters of its text are set against its tags and adjusted by how
much of both belongs to links (composite text density); the densities of an element's children are summed. The subtree
with the greatest sum is content. The least density on its path from the body is the threshold: where no ``article`` or
``main`` holds the subtree, so is the greatest-sum subtree of every other element whose density reaches it, unless that
stands in an article of its own. Elements that are never article text (menus, footers, forms, scripts, elements marked
as advert, comments and the like) are left out before densities are taken; a form or marked element with most of the
page's text stays.

Pages of any length and shape take time in proportion to their length: no tag is scanned twice, and the open elements
that a start or end tag looks for are kept by kind.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# --- fixed values: element names of HTML, and words that mark what isn't article text ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr li dd dt".split()) | frozenset("li dd dt".split())
#: Elements whose start ends open ones of the second set, up to an element of the third.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
}
SCOPE = frozenset("table td th caption button html template object".split())
NEVER = frozenset("nav footer aside form script style noscript template button select textarea iframe svg canvas dialog menu object embed head title search input math datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus respond replies pagination pager toolbar widget widgets skip login paywall teaser outbrain taboola".split()
)
#: Parts of a class name that say nothing of what the element is about: the part before them does.
SHELLS = frozenset(
    "container containers box boxes wrapper wrap inner outer block blocks section sections area zone list lists item items link links bar buttons button icons panel panels unit slot "
    "body content text title header heading label left right top bottom center desktop mobile first last small large row col column group form module main id message link media thread".split()
)
#: A class name with one of these in front speaks of the page, not of the element.
STATES = frozenset("has no with without is not hide show".split())
HEADERS = frozenset("header topbar site-header page-header".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
# --- end of fixed values ---

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SIGN = re.compile(r"""[>"']""")
VALUE = re.compile(r"=\s*\Z")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
PART = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


#: What a start tag looks for among the open elements: kinds that end, and kinds that it doesn't look beyond.
LOOKS = {"p": (frozenset(["p"]), SCOPE), **SIBLINGS}
KINDS = tuple(LOOKS)
LOOKED = frozenset().union(*(ends | upto for ends, upto in LOOKS.values()))


class Tree:
    """Elements in page order (0: the root), and the page's runs of text between block borders (None)."""

    def __init__(self, page: str):
        self.page, self.loose = page, False
        self.tag, self.parent, self.marks = ["#root"], [-1], [""]
        self.runs: list[tuple[int, str | None]] = []
        self.open = [0]
        #: For each open element the outermost open one, in scope, that a tag of each of KINDS would end (-1: none).
        self.ended = [(-1,) * len(KINDS)]
        #: Open elements by name: of all, and of those since each open element of SCOPE.
        self.held: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]
        at = text = 0
        size = len(page)
        while (at := page.find("<", at)) >= 0:
            sign = page[at + 1 : at + 2]
            if sign in ("!", "?") and sign:
                end = page.find("-->", at + 4) if page.startswith("<!--", at) else page.find(">", at)
                self._text(text, at)
                at = text = size if end < 0 else end + (3 if page.startswith("<!--", at) else 1)
                continue
            ends = sign == "/"
            name = NAME.match(page, at + 1 + ends)
            end = self._tag_end(name.end()) if name else -1
            if end < 0:
                at += 1
                if name:
                    break  # no tag ends behind this place: the rest is text
                continue
            self._text(text, at)
            attributes = page[name.end() : end]
            at = text = end + 1
            tag = name[0].lower()
            if ends:
                self._end(tag)
                continue
            node = self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = text = close.end() if close else size
                self._close(node)
            elif tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                self._close(node)
        self._text(text, size)

    def _tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag stands; one inside a quoted value doesn't count, unless quotes never end."""
        if not self.loose:
            here = at
            while m := SIGN.search(self.page, here):
                if m[0] == ">":
                    return m.start()
                here = m.end()
                if VALUE.search(self.page, max(at, m.start() - 8), m.start()):
                    here = self.page.find(m[0], here) + 1
                    if not here:
                        break
            self.loose = True  # from here on, quotes count no more
        return self.page.find(">", at)

    def _text(self, start: int, end: int) -> None:
        if end > start:
            raw = self.page[start:end]
            self.runs.append((self.open[-1], html.unescape(raw) if "&" in raw else raw))

    def _border(self) -> None:
        self.runs.append((self.open[-1], None))

    def _pop(self) -> None:
        tag = self.tag[self.open.pop()]
        self.ended.pop()
        self.held[tag] -= 1
        self.scopes[-1][tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()

    def _close(self, node: int) -> None:
        while self.open[-1] != node:
            self._pop()
        if self.tag[node] in BLOCK:
            self._border()
        elif self.tag[node] == "br":
            self.runs.append((node, " "))
        self._pop()

    def _start(self, name: str, attributes: str) -> int:
        if name in ("html", "body") and self.held[name]:
            return self.open[-1]
        if name in BLOCK and self.held["head"]:  # a head that never ended
            self._close(next(x for x in self.open if self.tag[x] == "head"))
        for kind in ("p" if name in ENDS_PARAGRAPH else "", name if name in SIBLINGS else ""):
            if kind and (last := self.ended[-1][KINDS.index(kind)]) >= 0:
                self._close(last)
        if name in BLOCK:
            self._border()
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self.open[-1])
        self.marks.append(attributes if attributes and not attributes.isspace() else "")
        self.open.append(node)
        above = self.ended[-1]
        self.ended.append(tuple(-1 if name in upto else node if name in ends and (last < 0 or k == "p") else last for (k, (ends, upto)), last in zip(LOOKS.items(), above, strict=True)) if name in LOOKED else above)
        self.held[name] += 1
        if name in SCOPE:
            self.scopes.append(Counter())
        self.scopes[-1][name] += 1
        return node

    def _end(self, name: str) -> None:
        if name in VOID:
            if name == "br":
                self.runs.append((self.open[-1], " "))
            return
        if (self.held if name in BLOCK else self.scopes[-1])[name] > 0:
            self._close(next(x for x in reversed(self.open) if self.tag[x] == name))


def marked(name: str, marks: frozenset[str]) -> bool:
    """Whether a class or id name (one token) says that its element is of a marked kind.

    That is told by its last part, as in cookie-notice, or, where that is a mere shell, by the one before, as in
    ad-container; notice-board and share-price are no notice and no sharing.
    """
    if name.lower() in marks:
        return True
    parts = PART.findall(CAMEL.sub(" ", name).lower())
    if not parts or parts[0] in STATES:
        return False
    while len(parts) > 1 and (parts[-1] in SHELLS or parts[-1].isdigit()) and parts[-1] not in marks:
        parts.pop()
    return parts[-1] in marks


def left_out(tree: Tree) -> list[bool]:
    """Elements that are no article text, with all that they hold.

    A form, or an element with a mark, that holds most of the page's text outside links is left to its density: over
    half if it holds blocks, over nine tenths if it holds bare text (a short article may be outdone by an advert).
    """
    n = len(tree.tag)
    plain, no_text, blocks = [0] * n, [False] * n, [False] * n
    for i in range(1, n):
        no_text[i] = no_text[tree.parent[i]] or tree.tag[i] == "a" or tree.tag[i] in NEVER and tree.tag[i] != "form"
    for node, text in tree.runs:
        if text and not no_text[node]:
            plain[node] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        plain[tree.parent[i]] += plain[i]
        blocks[tree.parent[i]] = blocks[tree.parent[i]] or blocks[i] or tree.tag[i] in BLOCK
    most = [2 * x > plain[0] if b else 10 * x > 9 * plain[0] for x, b in zip(plain, blocks, strict=True)]
    holds_article = [False] * n
    for i in range(n - 1, 0, -1):
        if tree.tag[i] in ("article", "main") or holds_article[i]:
            holds_article[tree.parent[i]] = True
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        p, tag = tree.parent[i], tree.tag[i]
        inside[i] = inside[p] or tag in ("article", "main")
        if out[p]:
            out[i] = True
        elif tag in NEVER and not (tag == "form" and (holds_article[i] or most[i])):
            out[i] = True
        elif tag == "header" and not inside[i] and not holds_article[i]:
            out[i] = True
        elif tree.marks[i]:
            found: dict[str, str] = {}
            for m in ATTRIBUTE.finditer(tree.marks[i]):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            names = f"{found.get('class', '')} {found.get('id', '')}".split()
            role = found.get("role", "").strip().lower()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")) is not None
            if tag in ("html", "body", "main"):
                out[i] = False
            elif tag == "article" or holds_article[i]:
                out[i] = tag == "article" and any(marked(x, COMMENTS) for x in names) or hidden and not holds_article[i]
            else:
                out[i] = hidden or not most[i] and (role in ROLES or any(marked(x, MARKS) or not inside[i] and x.lower() in HEADERS for x in names))
    return out


def content_roots(tree: Tree, out: list[bool]) -> list[int]:
    """The elements that hold the content, in page order: see above."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    link = [False] * n
    for i in range(1, n):
        link[i] = link[tree.parent[i]] or tree.tag[i] == "a"
    for node, text in tree.runs:
        if text and not out[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if link[node]:
                link_chars[node] += size
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    overall = link_chars[body] / max(1, chars[body])

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        if not c:
            return 0.0
        base = math.log(c / max(1, c - link_chars[i]) * lc + overall * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)))

    dense = [0.0 if out[i] else density(i) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if not out[i]:
            sums[tree.parent[i]] += dense[i]
    fits = [not out[i] and chars[i] > 0 and (i == 0 or tree.tag[i] in BLOCK) for i in range(n)]
    if not any(fits):
        return [body]
    rank = lambda i: (sums[i], dense[i], -i)
    #: The best of each subtree.
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if fits[top[i]] and not out[i] and (not fits[top[p]] or rank(top[i]) > rank(top[p])):
            top[p] = top[i]
    best = top[0]
    path = [best]
    while path[-1] > 0:
        path.append(tree.parent[path[-1]])
    for i in path:
        if tree.tag[i] in ("article", "main"):
            return [i]
    threshold = min(dense[i] for i in path if i >= body or i == best)
    chosen = [best]
    # what else on the page is as dense as that, from the outermost inwards
    taken, closed = [False] * n, [False] * n
    on_path = set(path)
    for i in range(n):
        p = tree.parent[i]
        taken[i] = i == best or i > 0 and taken[p]
        closed[i] = i > 0 and (closed[p] or out[i] or tree.tag[i] == "article")
        if not taken[i] and not closed[i] and i not in on_path and fits[i] and dense[i] >= threshold:
            chosen.append(top[i] if fits[top[i]] else i)
            taken[i] = True
    while best > 0 and tree.tag[best] not in ("div", "section", "body", "td", "html", "center"):
        best = tree.parent[best]
    return sorted({best, *chosen[1:]})


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line; white space inside a block is one space."""
    if not page:
        return ""
    tree = Tree(page)
    out = left_out(tree)
    roots = content_roots(tree, out)
    within = [False] * len(tree.tag)
    for i in roots:
        within[i] = True
    for i in range(roots[0] + 1, len(tree.tag)):
        within[i] = within[i] or within[tree.parent[i]] and not out[i]
    blocks, held = [], []
    for node, text in tree.runs:
        if text is None:
            if held:
                blocks.append(" ".join("".join(held).split()))
                held = []
        elif within[node]:
            held.append(text)
    if held:
        blocks.append(" ".join("".join(held).split()))
    return "\n\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, *, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars (code points).

    Null and empty pages, and pages without article text, give an empty text; repeated rows are read each; other
    columns are ignored.
    """

    bounded_batches(pages)

    @F.pandas_udf("text string, n_chars long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(x) for x in batch]
            yield pd.DataFrame({"text": pd.Series(texts, dtype="object"), "n_chars": pd.Series(map(len, texts), dtype="int64")})

    return pages.select(F.col(key), F.col(url), read(F.col(page)).alias("__read")).select(key, url, "__read.text", "__read.n_chars")
