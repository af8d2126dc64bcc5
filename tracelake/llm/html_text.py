"""Main text of web pages by consensus host paths.

Method. A page is read into a tree of containers; a container's generalised path is its chain of tags and class words, digits left
out, named by a chained 64-bit hash. Each page scores its containers (prose below counts, nearer prose more; link text and
dropped parts don't) and votes for its best. Spark sums by host and path how many pages hold a path and how many vote for it; a
host's winning paths are those that most of their pages, two at least, vote for. The pages are then read again and their text is
what lies under a winning path: the most voted one that has text on the page, and inside it a winner of a narrower layout, if
there is one. A page without a winning path gives the text of its own best container.

Dropped are elements whose kind is boilerplate (navigation, footers, scripts, ...), hidden ones, and those that a whole class or
id token, role or item type marks: every word of the token is a mark or a word of layout, so `post-comments` and `ad-box` are
marks, `commentary`, `social-studies`, `has-sidebar` aren't. Words that also name parts of an article (`discussion`, `widget`) mark
an element of one only if it reads like boilerplate: without a paragraph, with much link text, with a form, or as a thread (several
children of one path). A marked or hidden wrapper, or a form, that holds the page's main
element is kept, and so is one that holds nearly all prose and every paragraph of the main element (of the page, if it has none);
if nothing were left all marks but those of forms are passed over.

Scale. Votes are folded by (host, path) before the shuffle, so a host with a third of all pages is a few rows a task. At most
WINNERS paths a host are joined back (a page with none of them uses its own best container): broadcast only if the table's
measured size allows, else a sort-merge join that splits a hot host. Reading, scoring and extraction are linear in the page,
in time and memory, whatever its tags, quotes and nesting.

A null html is empty and gives an empty text; a null or odd url belongs to the host ''; repeated rows give repeated results (and
vote once each); extra columns are ignored; an empty table gives an empty result. Quotes count only around attribute values;
one that never ends is an ordinary character. Markup that the page's end cuts off (a tag without its >, a comment, a script) is
no text. If quoted values swallow every later >, tags end at the next > from there on.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Paths a host hands to its pages.
WINNERS = 16

#: Element kinds of HTML.
CONTAINERS = frozenset("html body main article section div aside nav header footer form table tbody thead tfoot tr td th ul ol dl li dd dt figure fieldset dialog details menu template noscript iframe object select button search svg hgroup blockquote center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 br hr pre address caption figcaption summary legend option title".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("nav aside footer script style template noscript iframe object select button dialog menu svg search textarea fieldset".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Words of a class or id token that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle adbox adslot banner banners taboola outbrain sponsor sponsors sponsored promo promos promotion promoted notice notices alert alerts popup popups modal overlay "
    "newsletter subscribe subscription signup signin login menu menus submenu nav navbar navigation topnav subnav sidenav mainnav sitenav navmenu topmenu mainmenu breadcrumb breadcrumbs sidebar sidebars side widget widgets related recommended recommendations "
    "share sharing sharebar social footer header masthead topbar toolbar pagination pager toc form search searchbox searchform "
    "werbung anzeige anzeigen reklame publicite annonce annonces publicidad anuncio anuncios".split()
)
#: Words that mark what readers or the site's consent banners say.
OTHERS_SAY = frozenset("comment comments commentlist disqus respond responses reply replies discussion talkback feedback cookie cookies consent gdpr kommentar kommentare commentaire commentaires comentario comentarios".split())
#: Of those words, the ones that also name parts of an article.
EITHER = frozenset("discussion responses respond feedback widget widgets".split())
#: Words of layout, which change nothing about a mark beside them.
LAYOUT = frozenset(
    "area article articles author bar bars blog block blocks body bottom box boxes btn button buttons center col column container content contents count cta custom desktop entry fixed float floating global google holder icon icons inner "
    "item items js label left link links list lists main meta mobile module modules outer page pages panel placeholder post posts primary reader readers right row secondary section sections site slot small sticky story stories strip "
    "text thread title tools top unit units user users view wrap wrapper wrappers zone policy law info message messages email mail top sm md lg xl fb facebook gpt dfp".split()
)
#: Roles and item types that mark what isn't the article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_OWN_HEADER = frozenset("article blog entry post story title content section text".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|([!?/]))")
_UPTO = re.compile(r"[^>=]*+(?:=\s*+)?")
_ATTR = re.compile(r"([^\s\"'>/=]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}

WRAPPER, FORM, OTHERS, FIXED = 1, 2, 3, 4
#: Added to a mark that only words of EITHER make, until the element has been read.
EITHER_WAY = 8
#: How much prose of a container counts, by its kind; each container hands STEP of it to the one around it.
_BONUS = {"article": 2.0, "main": 1.5, "section": 1.0, "div": 1.0, "td": 0.8, "body": 0.7, "blockquote": 0.3, "html": 0.5, "": 0.4}
STEP = 0.75

#: What an opening tag closes if it is open around it (by place in Node.near), and what keeps it from doing so.
_CLOSES = {"li": 0, "tr": 1, "td": 2, "th": 2, "dd": 3, "dt": 3}
_WALLS = {"ul": (0,), "ol": (0,), "menu": (0,), "table": (1, 2), "dl": (3,)}


class Node:
    """An element that can hold text of its own kind: any container, and other elements that are marked."""

    __slots__ = ("tag", "path", "parent", "own", "near", "inside", "dropped", "h1", "paras", "prose", "links", "core", "free", "flow", "others", "fixed", "has")

    def __init__(self, tag: str, path: int, parent: Node | None, own: int = 0):
        """own: WRAPPER or OTHERS by marks or because it is hidden, FORM, FIXED by its kind, or 0."""
        self.tag, self.path, self.parent, self.own = tag, path, parent, own
        self.near = parent.near if parent else (None, None, None, None)
        self.inside = bool(parent and parent.inside) or tag in ("article", "main")
        self.dropped = self.core = self.others = self.fixed = self.has = False
        self.h1, self.paras, self.prose, self.links, self.free, self.flow = False, 0, 0, 0, 0, 0.0


def _token_mark(token: str, inside: bool) -> int:
    """WRAPPER or OTHERS if the token's words are marks and words of layout only, else 0; EITHER_WAY is added inside an article if all
    those marks are words of EITHER."""
    words = _WORD.findall(_CAMEL.sub(" ", token).lower())
    found, either = 0, inside
    for w in words:
        if w in OTHERS_SAY:
            found = OTHERS
        elif w in MARKS:
            if w == "header" and (inside or not _OWN_HEADER.isdisjoint(words)):  # the article's own
                return 0
            found = found or WRAPPER
        elif w not in LAYOUT and len(w) > 1:
            return 0
        else:
            continue
        either = either and w in EITHER
    return found + EITHER_WAY if found and either else found


def _marks(attrs: str, inside: bool) -> tuple[int, bool, str]:
    """How an element is marked (WRAPPER, OTHERS or 0), is it hidden, and its class attribute."""
    found: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(attrs):
        found.setdefault(k.lower(), a or b or c or "")
    mark = 0
    for name in ("class", "id"):
        for token in found.get(name, "").split():
            mark = max(mark, _token_mark(token, inside), key=lambda m: (m != 0, m < EITHER_WAY, m))  # a plain mark outweighs one that may go
    if found.get("role", "").strip().lower() in ROLES:
        mark = mark if 0 < mark < EITHER_WAY else WRAPPER
    if found.get("itemprop", "").lower() == "comment" or found.get("itemtype", "").rstrip("/").lower().endswith(("/comment", "/usercomments")):
        mark = OTHERS
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "style" in found and bool(_HIDDEN.search(found["style"]))
    return mark, hidden, found.get("class", "")


class _Tags:
    """Where tags end. Each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes, self.none = page, True, set()

    def end(self, pos: int) -> int:
        """The place of the > that ends the tag whose attributes begin at pos; -1 if no > is left."""
        page = self.page
        close = page.find(">", pos)
        if close < 0 or not self.quotes:
            return close
        two, one = page.count('"', pos, close), page.count("'", pos, close)
        if not two and not one or not one and not two & 1 or not two and not one & 1:
            return close
        at = pos
        while True:
            m = _UPTO.match(page, at)
            at = m.end()
            if at >= len(page):
                self.quotes = False
                return close
            c = page[at]
            if c == ">":
                return at
            if c in "\"'" and m.group().rstrip().endswith("="):
                stop = -1 if c in self.none else page.find(c, at + 1)
                if stop < 0:
                    self.none.add(c)
                at = max(at, stop) + 1


def parse(page: str) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """The nodes (parents first) and the events in page order: (node, kind, text), kind 0 being text, 1 a block boundary, 2 text
    inside a link."""
    root = Node("", 0, None)
    nodes, events, open_ = [root], [], {}
    tags, at, pos, end, link = _Tags(page), root, 0, len(page), False
    endless: set[str] = set()  # raw elements without an end from here on

    def up_to(node: Node) -> Node:
        nonlocal at
        while at is not node:
            open_[at.tag] -= 1
            at = at.parent
        return at

    def push(node: Node) -> None:
        nonlocal at
        nodes.append(node)
        open_[node.tag] = open_.get(node.tag, 0) + 1
        at = node

    while pos < end:
        m = _OPEN.search(page, pos)
        start = m.start() if m else end
        if start > pos:
            events.append((at, 2 if link else 0, page[pos:start]))
        if not m:
            break
        if m[3]:
            mark, skip = ("-->", 2) if page.startswith("<!--", start) else (">", 0)
            close = page.find(mark, start + skip)
            pos = end if close < 0 else close + len(mark)
            continue
        close = tags.end(m.end())
        if close < 0:
            break
        closing, tag, attrs, pos = m[1], m[2].lower(), page[m.end() : close], close + 1
        if tag == "a":
            link = not closing and "href" in attrs.lower()
        if not closing and tag in RAW:
            stop = None if tag in endless else _RAW_END[tag].search(page, pos)
            if stop:
                pos = stop.end()
            elif tag in ("script", "style"):
                break
            else:  # a title or form text that never ends: only its tag goes
                endless.add(tag)
            continue
        if tag in BLOCKS:
            events.append((at, 1, ""))
            if tag not in VOID:
                link = False
            if not closing and open_.get("p"):  # no block lies in a paragraph
                while at.tag != "p":
                    up_to(at.parent)
                up_to(at.parent)
            if tag == "p" and not closing:
                at.paras += 1
            elif tag == "h1" and not closing:
                at.h1 = True
        if closing:
            if open_.get(tag):
                while at.tag != tag:
                    up_to(at.parent)
                up_to(at.parent)
            continue
        if tag in VOID:
            continue
        if tag not in CONTAINERS:
            if open_.get(tag) or attrs.strip():
                mark, hidden, _ = _marks(attrs, at.inside) if attrs else (0, False, "")
                if mark or hidden or open_.get(tag):
                    push(Node(tag, at.path, at, WRAPPER if hidden and mark > EITHER_WAY else mark or (WRAPPER if hidden else 0)))
            continue
        if attrs.rstrip().endswith("/") and tag not in ("div", "section", "article", "main"):
            continue
        kind = _CLOSES.get(tag)
        if kind is not None and at.near[kind]:
            up_to(at.near[kind].parent)
        mark, hidden, classes = _marks(attrs, at.inside) if attrs else (0, False, "")
        if tag in DROPPED or tag == "header" and not at.inside:
            own = FIXED
        elif tag in ("html", "body", "main"):
            own = 0
        elif tag == "article":
            own = mark if mark % EITHER_WAY == OTHERS else 0
        else:
            own = mark
        own = WRAPPER if hidden and own > EITHER_WAY else own or (WRAPPER if hidden else FORM if tag == "form" else 0)
        name = tag + "".join("." + w for w in sorted(set(_WORD.findall(_CAMEL.sub(" ", classes).lower()))))
        node = Node(tag, xxhash.xxh64_intdigest(name, seed=at.path) >> 1, at, own)
        if tag in _WALLS or kind is not None:
            near = list(node.near)
            for k in _WALLS.get(tag, ()):
                near[k] = None
            if kind is not None:
                near[kind] = node
                if tag == "tr":
                    near[2] = None
            node.near = tuple(near)
        push(node)
    _settle(nodes, events)
    return nodes, events


def _settle(nodes: list[Node], events: list[tuple[Node, int, str]]) -> None:
    """Decide which nodes are dropped, and note each node's prose and link text."""
    for node, kind, text in events:
        if kind != 1 and (n := len(text.strip())):
            if kind == 0:
                node.prose += n
            else:
                node.links += n
    if any(n.own > EITHER_WAY for n in nodes):
        _weigh(nodes)
    if any(n.own for n in nodes):
        root = nodes[0]
        cores, frees, core_paras, free_paras = _held(nodes)
        total, all_ = cores[root], frees[root]

        def kept(n: Node) -> bool:
            if total and not n.core:
                return cores[n] * 3 > total * 2
            held, whole, paras = (cores, total, core_paras) if total else (frees, all_, free_paras)
            return n.own in (WRAPPER, FORM) and held[n] * 10 > whole * 9 and paras[n] == paras[root] and (n.own == WRAPPER or paras[n] > 1)

        for n in nodes[1:]:
            n.dropped = n.parent.dropped or n.own == FIXED or bool(n.own) and not kept(n)
        if all(n.dropped or not n.prose and not n.links for n in nodes):
            for n in nodes[1:]:
                n.dropped = n.parent.dropped or n.own in (FIXED, FORM)
    for n in reversed(nodes):
        n.has |= not n.dropped and (n.prose > 0 or n.links > 0)
        if n.has and n.parent:
            n.parent.has = True


def _weigh(nodes: list[Node]) -> None:
    """Decide the marks that may go either way by what lies below them: prose, link text, paragraphs, forms, children of one path."""
    prose, links, paras = ({n: v(n) for n in nodes} for v in (lambda n: n.prose, lambda n: n.links, lambda n: n.paras))
    forms = {n: n.tag == "form" for n in nodes}
    for n in reversed(nodes):
        if n.parent:
            for below in (prose, links, paras, forms):
                below[n.parent] += below[n]
    children: dict[Node, list[int]] = {}
    for n in nodes[1:]:
        if n.parent.own > EITHER_WAY and n.tag in CONTAINERS and (prose[n] or links[n]):
            children.setdefault(n.parent, []).append(n.path)
    for n in nodes:
        if n.own > EITHER_WAY:
            thread = len(children.get(n, ())) > len(set(children.get(n, ())))
            n.own = n.own - EITHER_WAY if not paras[n] or 3 * links[n] > prose[n] or forms[n] or thread else 0


def _held(nodes: list[Node]) -> tuple[dict, dict, dict, dict]:
    """By node, below it: prose in main and article elements, prose that no fixed element or readers' part holds, and the paragraphs
    of both."""
    for n in nodes:
        up = n.parent
        n.fixed = n.own == FIXED or bool(up and up.fixed)
        n.others = n.own == OTHERS or bool(up and up.others)
        begins = n.own == 0 and (n.tag == "main" or n.tag == "article" and not n.others)
        n.core = not n.fixed and (begins or bool(up and up.core) and n.own != OTHERS)
    cores = {n: n.prose if n.core else 0 for n in nodes}
    frees = {n: 0 if n.fixed or n.others else n.prose for n in nodes}
    core_paras = {n: n.paras if n.core else 0 for n in nodes}
    free_paras = {n: 0 if n.fixed or n.others else n.paras for n in nodes}
    for n in reversed(nodes):
        if n.parent:
            for below in (cores, frees, core_paras, free_paras):
                below[n.parent] += below[n]
    return cores, frees, core_paras, free_paras


def container_scores(nodes: list[Node]) -> dict[int, float]:
    """The page's containers by generalised path: prose below each less its link text, nearer prose more, weighted by the kind of
    element. Paths in page order; only those above 0."""
    total: dict[int, float] = {n.path: 0.0 for n in nodes if n.tag in _BONUS and n.has}
    for n in nodes:
        n.flow = 0.0 if n.dropped else float(n.prose - n.links)
    for n in reversed(nodes):
        passed = n.flow
        if n.tag in _BONUS:
            if n.path in total:
                total[n.path] += passed * _BONUS[n.tag]
            passed *= STEP
        if n.parent:
            n.parent.flow += passed
    return {p: s for p, s in total.items() if s > 0}


def best_path(nodes: list[Node]) -> int | None:
    """The page's own best container, as a path: the highest score, ties to the first in the page. A heading just above it, or a
    parent whose several children it is, belongs to it. Without prose, an article or main element that has text."""
    scores = container_scores(nodes)
    if not scores:
        return next((n.path for n in nodes if n.tag in ("article", "main") and n.has), None)
    best = max(scores, key=scores.get)  # the first of equal ones
    while True:
        here = [n for n in nodes if n.path == best and n.has and n.tag in _BONUS]
        above = {n.parent for n in here}
        up = here[0].parent
        if len(above) > 1 or here[0].tag in ("article", "main") or not up or up.tag not in ("div", "section", "td") or not (up.h1 or len(here) > 1):
            return best
        best = up.path


def extract(page: str, winners: list[int] | None = None) -> str:
    """The text under the outermost containers of the page's winning path; if it has none, of its own best path. winners: paths,
    the most voted first."""
    nodes, events = parse(page)
    path = None
    if winners:
        rank = {p: i for i, p in enumerate(winners)}
        here = [n for n in nodes if n.has and n.tag in _BONUS and n.path in rank]
        path = min((n.path for n in here), key=rank.get, default=None)
        while here:  # a winner inside the chosen one belongs to a narrower layout
            below = _below(nodes, path)
            here = [n for n in here if n.path != path and n.parent in below]
            path = min((n.path for n in here), key=rank.get, default=path)
    if path is None:
        path = best_path(nodes)
    if path is None:
        return ""
    below = _below(nodes, path)
    blocks, open_ = [], []
    for node, kind, text in events:
        if kind == 1:
            if open_:
                blocks.append("".join(open_))
                open_ = []
        elif node in below and not node.dropped:
            open_.append(entities.unescape(text) if "&" in text else text)
    blocks.append("".join(open_))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _below(nodes: list[Node], path: int) -> set[Node]:
    found: set[Node] = set()
    for n in nodes:
        if n.path == path and n.tag in _BONUS or n.parent in found:
            found.add(n)
    return found


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, pages, votes: how many of a host's pages hold text under a container path, and for how many it is the best."""

    def run(batches):
        for batch in batches:
            votes: dict[tuple[str, int], list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes, _ = parse(page or "")
                best = best_path(nodes)
                for path in {n.path for n in nodes if n.has and n.tag in _BONUS}:
                    v = votes.setdefault((host, path), [0, 0])
                    v[0] += 1
                    v[1] += path == best
                if len(votes) > 500_000:
                    yield rows(votes)
                    votes.clear()
            yield rows(votes)

    def rows(votes):
        hosts, paths = [k[0] for k in votes], [k[1] for k in votes]
        counts = [[v[i] for v in votes.values()] for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (paths, *counts))], ["host", "path", "pages", "votes"])

    votes = pages.select("host", "html").mapInArrow(tidy(run), "host string, path long, pages long, votes long")
    return votes.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("votes").alias("votes"))


def winning_paths(paths: DataFrame, most: int = WINNERS) -> DataFrame:
    """host, paths: the paths that more than half of their pages, and two at least, vote for, most votes first, ties by path."""
    first = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    won = paths.filter("votes >= 2 and 2 * votes > pages").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    return won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "path"))).alias("x")).select("host", F.col("x.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    won = written(winning_paths(host_paths(x)), "paths")
    y = x.join(won, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for batch in batches:
            ids, urls, texts, paths = batch.columns
            out = [extract(t or "", p) for t, p in zip(texts.to_pylist(), paths.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return y.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
