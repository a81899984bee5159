"""Pages as balanced token streams, and union-free expressions inferred from them by alignment.

``read_page`` turns html into a folded stream: elements in order, text runs as slots, and elements or groups of up to three
elements that follow each other with the same inside written once as a repeated group.  Missing end tags are supplied
first, so that every group is a run of whole elements.  ``align`` compares two streams (or a stream and a wrapper):
tokens that agree stay, what only one of them has becomes optional, neighbours of one kind become a repeated group, and
text becomes a slot.  The result is an expression without alternatives that accepts both.

A node is ``[key, mult, children]``: key is ``#`` for a text slot, ``()`` for a group, else the tag with its class and id;
mult is "" (once), "?" (optional), "+" (repeated) or "*" (both).
"""

from __future__ import annotations

import html
import re

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output picture q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose text is never part of an article.
OUTSIDE_TAGS = set("head nav footer aside button select option datalist noscript template menu dialog canvas audio video object svg math".split()) | RAW
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
#: Words in a class or id that mark what is no part of an article.
OUTSIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager paging topbar toolbar masthead "
    "footer foot copyright colophon sidebar sidebars side aside rail widget widgets related recommended recommendations recirc trending popular "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall "
    "newsletter subscribe subscription signup login signin register form search share sharing social "
    "comment comments commentlist reply replies respond disqus discussion".split())
HEADER_WORDS = {"header", "head", "hdr"}
#: Blocks of running prose share one token, so that a text's headings and paragraphs fold into one group.
PROSE = set("p h2 h3 h4 h5 h6 pre blockquote address figcaption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"},
         "option": {"select"}, "body": {"html"}}
DEPTH = 200  # deeper elements are read as part of the one around them; their text stays
CELLS = 250_000  # beyond, unlike runs of two child lists are not aligned but generalised to optional repeated elements

NAME = re.compile(r"[A-Za-z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _tag_end(page: str, at: int, closed: dict) -> int:
    """Place of the ``>`` that ends the tag, not one in a quoted value; -1 if there is none."""
    while True:
        at = PLAIN.match(page, at).end()
        if at >= len(page):
            return -1
        c = page[at]
        if c == ">":
            return at
        if at >= closed.get(c, len(page)):  # no further closing quote of this kind: the quote is a plain character
            at += 1
            continue
        end = page.find(c, at + 1)
        if end < 0:
            closed[c] = at
            at += 1
        else:
            at = end + 1


def _words(value: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(value)]


class _Element:
    """An open or closed element; ``kids`` are [form, mult, slots, parts], where parts lead to the blocks of a kid."""

    __slots__ = ("tag", "key", "parent", "kids", "always", "marked", "article", "holds_article", "outside", "depth")

    def __init__(self, tag: str, key: str, parent: _Element | None, always: bool = False, marked: bool = False, article: bool = False):
        self.tag, self.key, self.parent, self.always, self.marked, self.article = tag, key, parent, always, marked, article
        self.kids, self.holds_article, self.outside = [], False, None
        self.depth = 0 if parent is None else parent.depth + 1


class _Forms:
    """Numbers for distinct insides: (key, kids as (form, mult))."""

    def __init__(self):
        self.number, self.form = {}, []

    def of(self, key: str, kids: list) -> int:
        f = (key, tuple((k[0], k[1]) for k in kids))
        if f not in self.number:
            self.number[f] = len(self.form)
            self.form.append(f)
        return self.number[f]

    def expand(self, kid: tuple) -> list:
        key, kids = self.form[kid[0]]
        return [key, kid[1], [self.expand(k) for k in kids]]


def _fold(kids: list, forms: _Forms) -> list:
    """Siblings with the same inside, one after the other, as one repeated node; then groups of two and three."""
    for period in (1, 2, 3):
        if len(kids) < 2 * period:
            continue
        out, i = [], 0
        while i < len(kids):
            first = [k[0] for k in kids[i:i + period]]
            n = 1
            while [k[0] for k in kids[i + n * period:i + (n + 1) * period]] == first:
                n += 1
            if n == 1:
                out.append(kids[i])
                i += 1
                continue
            run = kids[i:i + n * period]
            i += n * period
            if period == 1:
                out.append([first[0], "+", run[0][2], [(0, k[3]) for k in run]])
                continue
            group = [[f, "+" if any(k[1] for k in run[j::period]) else "", run[j][2], None] for j, f in enumerate(first)]
            offsets = [sum(k[2] for k in run[:j]) for j in range(period)]
            out.append([forms.of("()", group), "+", sum(k[2] for k in run[:period]), [(offsets[j % period], k[3]) for j, k in enumerate(run)]])
        kids = out
    return kids


def _closed_parts(kids: list) -> tuple[int, list]:
    offset, parts = 0, []
    for k in kids:
        parts.append((offset, k[3]))
        offset += k[2]
    return offset, parts


def _marks(tag: str, attributes: str, parent: _Element) -> _Element:
    """The element of a start tag, with what its names say of it."""
    values = {a.group(1).lower(): (a.group(2) or "").strip("\"'") for a in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    named = [w.lower() for w in WORDS.findall(values.get("class", "") + " " + values.get("id", ""))]
    role = values.get("role", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(values.get("style", "")))
    words = OUTSIDE_WORDS if parent.article else OUTSIDE_WORDS | HEADER_WORDS
    marked = tag not in ("html", "body") and (tag == "form" or tag == "header" and not parent.article or any(w in words for w in named))
    article = (tag in ("article", "main") or role in ("main", "article")) and (tag == "main" or not marked)
    key = "p" if tag in PROSE and not named else ".".join([re.sub(r"[^a-z0-9]", "", tag), *named])
    return _Element(tag, key, parent, tag in OUTSIDE_TAGS or role in OUTSIDE_ROLES or hidden, marked and not article, article or parent.article)


def _is_outside(e: _Element) -> bool:
    """No part of an article: inside an element that never is, or in a marked one in which no article stands."""
    path = []
    while e is not None and e.outside is None:
        path.append(e)
        e = e.parent
    out = False if e is None else e.outside
    for x in reversed(path):
        out = x.outside = out or x.always or x.marked and not x.holds_article
    return out


def read_page(page: str) -> tuple[list, list[tuple[int, str, int, bool]]]:
    """The folded stream (list of nodes) and the blocks in page order: (slot in the stream, text, characters in links, in an article).

    Blocks that are no part of an article are left out; their slots stay in the stream.
    """
    forms, blocks, text, links = _Forms(), [], [], []
    top = _Element("", "", None)
    n, at, closed, in_link = len(page), 0, {}, False

    def end_block():
        whole = " ".join("".join(text).split())
        if whole:
            blocks.append([whole, min(sum(map(len, links)), len(whole)), top, 0])
            top.kids.append([forms.of("#", []), "", 1, blocks[-1]])
        text.clear()
        links.clear()

    def close() -> _Element:
        kids = _fold(top.kids, forms)
        slots, parts = _closed_parts(kids)
        up = top.parent
        up.kids.append([forms.of(top.key, kids), "", slots, parts])
        up.holds_article |= top.holds_article or (top.article and not up.article and not top.always)
        top.kids = []
        return up

    def inner(tags: set, barrier: set) -> bool:
        """Whether one of ``tags`` is open, not counting beyond ``barrier``."""
        e = top
        while e.parent is not None and e.tag not in barrier:
            if e.tag in tags:
                return True
            e = e.parent
        return False

    while at < n:
        lt = page.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at:
            piece = html.unescape(page[at:lt])
            text.append(piece)
            if in_link:
                links.append(piece)
        at = lt + 1
        if at >= n:
            break
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("![CDATA[", at):
            end = page.find("]]>", at)
            text.append(page[at + 8:n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if page[at] in "!?":
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        ending = page[at] == "/"
        m = NAME.match(page, at + ending)
        if not m:
            text.append("<")
            continue
        end = _tag_end(page, m.end(), closed)
        if end < 0:  # the page stops inside a tag
            break
        tag, attributes, at = m.group().lower(), page[m.end():end], end + 1
        if tag == "a":
            in_link = not ending
        if tag in INLINE:
            continue
        end_block()
        if tag in VOID:
            continue
        if tag in RAW:
            found = None if ending else RAW_END[tag].search(page, at)
            if not ending:
                at = n if not found else _tag_end(page, found.end(), closed) + 1 or n
                top.kids.append([forms.of(tag, []), "", 0, []])
            continue
        if ending:
            if inner({tag}, set()):
                while top.tag != tag:
                    top = close()
                top = close()
                in_link = False
            continue
        while top.tag == "p" or (top.tag in PROSE and tag in PROSE and top.tag != "blockquote"):  # end tags left out
            top = close()
        while tag in CLOSED_BY and inner(CLOSED_BY[tag], SCOPE[tag]):
            top = close()
        if top.depth < DEPTH:
            top = _marks(tag, attributes, top)
    end_block()
    while top.parent is not None:
        top = close()
    kids = _fold(top.kids, forms)
    _, parts = _closed_parts(kids)
    walk = [(0, parts)]
    while walk:
        offset, part = walk.pop()
        if part and isinstance(part[0], str):
            part[3] = offset
        else:
            walk.extend((offset + o, p) for o, p in part)
    return [forms.expand((k[0], k[1])) for k in kids], [(b[3], b[0], b[1], b[2].article) for b in blocks if not _is_outside(b[2])]


def slots(nodes: list) -> int:
    return sum(1 if n[0] == "#" else slots(n[2]) for n in nodes)


def _more(*mults: str, optional: bool = False, repeated: bool = False) -> str:
    r = repeated or any(m in "+*" and m for m in mults)
    o = optional or any(m in "?*" and m for m in mults)
    return "*" if r and o else "+" if r else "?" if o else ""


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two key lists."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    mid, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            mid.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return [(k, k) for k in range(lo)] + mid + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def _grouped(nodes: list, other: list) -> list:
    """``nodes`` with the groups of ``other`` recognised where their members stand in a row."""
    for g in other:
        if g[0] != "()":
            continue
        keys, out, i = [c[0] for c in g[2]], [], 0
        while i < len(nodes):
            if [c[0] for c in nodes[i:i + len(keys)]] == keys:
                out.append(["()", "", nodes[i:i + len(keys)]])
                i += len(keys)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _label(n: list) -> str:
    return n[0] if n[0] != "()" else "(" + " ".join(c[0] for c in n[2]) + ")"


def _join(a: list, b: list, optional: bool = False, repeated: bool = False) -> list:
    return [a[0], _more(a[1], b[1], optional=optional, repeated=repeated), align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """The expression that accepts both ``a`` and ``b``.

    Where two lists are so long and unlike that aligning them would take more than CELLS steps, their elements become
    optional repeated ones in the order in which their kinds first appear; nothing is left out.
    """
    if not a and not b:
        return []
    a, b = _grouped(a, b), _grouped(b, a)
    ka, kb = [_label(n) for n in a], [_label(n) for n in b]
    if ka == kb:
        return [_join(x, y) for x, y in zip(a, b)]
    if len(a) * len(b) > CELLS:
        kinds: dict[str, list] = {}
        for n, k in zip(a + b, ka + kb):
            kinds[k] = _join(kinds[k], n, True, True) if k in kinds else [n[0], _more(n[1], optional=True), n[2]]
        return list(kinds.values())
    out, i, j = [], 0, 0
    for x, y in [*_common(ka, kb), (len(a), len(b))]:
        for n in a[i:x] + b[j:y]:
            out.append([n[0], _more(n[1], optional=True), n[2]])
        if x < len(a):
            out.append(_join(a[x], b[y]))
        i, j = x + 1, y + 1
    merged = out[:1]  # neighbours of one kind repeat
    for n in out[1:]:
        if _label(n) == _label(merged[-1]):
            last = merged[-1]
            must = any(m[1] in ("", "+") for m in (last, n))
            joined = align(last[2], n[2])
            merged[-1] = [n[0], "+" if must else "*", joined]
        else:
            merged.append(n)
    return merged


def locate(wrapper: list, stream: list, base: int = 0) -> list[int]:
    """For each slot of ``stream``, the slot of the wrapper that takes it; -1 if none does."""
    stream = _grouped(stream, wrapper)
    kw, ks = [_label(n) for n in wrapper], [_label(n) for n in stream]
    start, at = [], base
    for n in wrapper:
        start.append(at)
        at += 1 if n[0] == "#" else slots(n[2])
    first: dict[str, int] = {}
    for i, k in enumerate(kw):
        first.setdefault(k, i)
    where = {} if len(kw) * len(ks) > CELLS else {y: x for x, y in _common(kw, ks)}
    out, last = [], -1
    for y, n in enumerate(stream):
        x = where.get(y)
        if x is None:  # a repetition of the element before, or any of its kind
            x = last if last >= 0 and kw[last] == ks[y] else first.get(ks[y], -1)
        if x < 0:
            out.extend([-1] * (1 if n[0] == "#" else slots(n[2])))
            continue
        last = x
        out.extend([start[x]] if n[0] == "#" else locate(wrapper[x][2], n[2], start[x]))
    return out


def show(nodes: list) -> str:
    """The expression in one line."""
    return " ".join((n[0] if not n[2] and n[0] != "()" else ("" if n[0] == "()" else n[0]) + "(" + show(n[2]) + ")") + n[1] for n in nodes)
