"""Main-text extraction from web pages by consensus host paths.

Every page is read once from left to right into blocks of text, each under its chain of containers (body, div, section, article,
main, ...). A container's path is its tags and classes from the body down, without digits. The page scores its containers by the
text that they hold outside links and votes for the path of the best: the main or article element that holds half of it, else the
smallest container with nine tenths of it, widened to its parent while prose of the parent would be left out. Spark counts the votes
of each host; the winning path of the host, if the page has it, else the page's own best, tells the containers whose blocks are the
text, with the headline and the prose that stand before them in their parent.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand: by
element, role and hiding for certain, by class and id on evidence. A class marks as a whole: one of the furniture words itself, or a
compound of furniture words and neutral ones (``comment-list``, ``site-footer``), so ``has-sidebar`` and ``post-header`` mark nothing;
or by its last word, if that tells comments or adverts (``post-comments``, ``google-ad``). The evidence is in ``Page.furniture``: what is
marked is never furniture if it holds half of the page's prose, an article or, being comments, the only prose; a form only if it has a
control to fill in. A headline in a marked header stays if the page's title begins with it, and so does all if nothing else has text.

The votes are small rows and are summed before they shuffle; the winners are broadcast if they are at most ``broadcast_hosts``.
Beyond that, hosts with more than one in 1,024 pages are broadcast and only the pages of the others move, to be joined by host. Pages
do not move otherwise.

Defined results: null, empty or text-less html gives an empty text; a page with null or host-less url has no consensus and uses its
own best container; of equal votes the path with more text wins, then the smaller one; unclosed and misnested elements close as
browsers close them, a ``<`` that opens no element and an unknown character reference stay as they are; repeated rows vote and are
extracted each; the input's other columns are kept by ``extract``, those named html, text, n_chars or path are replaced, and names
that begin with two underscores are safe. An empty table gives no rows. Time and memory grow with the page's length, whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, strings, table

# The element and role names of HTML, and class words that mark page furniture or say nothing.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"head", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "map", "nav", "footer", "aside", "menu", "button", "select", "textarea", "input", "dialog", "title", "xmp", "noembed", "noframes"}
FORMS = {"form", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
FURNITURE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promos", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
NEUTRAL = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "global", "group", "icons", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper"}
HEADERS = {"header", "masthead", "banner"}
TALK = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored"}
STATES = {"has", "hide", "is", "no", "show", "with", "without"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | SKIPPED | FORMS
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "datalist", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "meter", "output", "option", "optgroup", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "slot", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ELEMENTS = BLOCKS | INLINE | VOID
CONTAINERS = {"article", "body", "center", "div", "main", "section", "td"} | FORMS
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "button", "select", "input", "svg", "math", "legend"}
#: Elements that end an open one of the same kinds, and where the search for it stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"""([^\s/><][^\s/><=]*)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'><][^\s><]*))?)?""")
ENDING = {tag: re.compile(f"</{tag}[\\s/>]|</{tag}\\Z", re.I) for tag in RAW}
PROSE_CHARS, PROSE_LINKS = 80, 0.3


def is_prose(text: str, links: int) -> bool:
    return len(text) >= PROSE_CHARS and links < PROSE_LINKS * len(text)


def step_name(tag: str, classes: str, ident: str) -> str:
    """An element's part of a path: tag and classes (or id) without digits."""
    marks = sorted(set(re.sub(r"[\d/]+", "", (classes or ident or "").lower()).split()))
    return ".".join([tag, *marks])


def read_tag(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """A tag's attributes by lower-cased name (the first of a repeated one), where the tag ends, and whether a ``>`` ends it."""
    found: dict[str, str] = {}
    while True:
        at = GAP.match(html, at).end()
        if at >= len(html) or html[at] == "<":
            return found, at, False
        if html[at] == ">":
            return found, at + 1, True
        m = ATTRIBUTE.match(html, at)
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


def attributes_of(source: str) -> dict[str, str]:
    return read_tag(source, 0)[0]


def skipped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Furniture for certain: by element, role or hiding."""
    if tag in SKIPPED or tag == "header" and not in_article:
        return True
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None


def marked(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """What a class or id, or a form, says of an element: "talk" (reader comments), "header", "furniture", "form", or "" for nothing.

    A class counts as a whole, or by its last word if that tells comments or adverts; headers only outside articles."""
    if tag in ("html", "body", "article", "main"):
        return ""
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[-_\d]+", re.sub(r"\d+x\d+", "", token)) if w]
        kinds = FURNITURE.intersection(words)
        if not kinds or in_article and kinds <= HEADERS:
            continue
        if FURNITURE.union(NEUTRAL).issuperset(words) or words[-1] in TALK | ADVERTS and words[0] not in STATES:
            return "talk" if kinds & TALK else "header" if kinds <= HEADERS else "furniture"
    return "form" if tag in FORMS else ""


class Node(NamedTuple):
    """A container or marked element: its parent's number, tag, path step, and what it is marked as ("": nothing). Number 0 is the page."""

    parent: int
    tag: str
    step: str
    marked: str


class Block(NamedTuple):
    """A block's pieces of text as (node, text, in a link), the container that holds it, and whether it is a headline."""

    node: int
    pieces: list[tuple[int, str, bool]]
    headline: bool


def read(html: str | None) -> tuple[list[Node], list[Block], set[int], str]:
    """The page's nodes, parents first, its blocks in page order, the nodes right round a control to fill in, and the title. Every character
    is looked at a bounded number of times."""
    html, nodes, blocks, pieces = html or "", [Node(-1, "", "", "")], [], []
    controls: set[int] = set()
    title = ""
    stack: list[tuple[str, bool, int]] = []  # tag, skipped, node
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    at = 0

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush():
        if pieces:
            blocks.append(Block(stack[-1][2] if stack else 0, pieces.copy(), bool(places.get("h1"))))
            pieces.clear()

    def add(raw: str):
        if raw and not (stack and stack[-1][1]):
            pieces.append((stack[-1][2] if stack else 0, entities.unescape(raw), bool(places.get("a"))))

    def close(index: int):
        while len(stack) > index:
            if stack[-1][0] in BLOCKS:
                flush()
            places[stack.pop()[0]].pop()

    while at < len(html):
        sign = html.find("<", at)
        if sign < 0:
            add(html[at:])
            break
        add(html[at:sign])
        at = sign + 1
        if html.startswith(("!", "?"), at):
            opening, ending = next((p for p in (("!--", "-->"), ("![CDATA[", "]]>")) if html.startswith(p[0], at)), ("", ">"))
            end = html.find(ending, at + len(opening))
            if opening == "![CDATA[":
                add(entities.escape(html[at + 8 : end if end >= 0 else len(html)], quote=False))
            at = end + len(ending) if end >= 0 else len(html)
            continue
        ends = html.startswith("/", at)
        name = NAME.match(html, at + ends)
        if not name:
            add("<")
            continue
        tag = name[0].lower()
        attributes, end, whole = read_tag(html, name.end())
        if not whole and tag not in ELEMENTS:
            add("<")
            continue
        at = end
        if ends:
            if tag == "br":
                add(" ")
            elif places.get(tag):
                close(places[tag][-1])
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag == "body" and places.get("head"):
            close(places["head"][-1])
        if tag in CLOSES_P:
            open_p = nearest(("p", "td", "th", "button"))
            if open_p >= 0 and stack[open_p][0] == "p":
                close(open_p)
        if tag in IMPLIED:
            kinds, stops = IMPLIED[tag]
            same = nearest(kinds | stops)
            if same >= 0 and stack[same][0] in kinds:
                close(same)
        if tag in BLOCKS:
            flush()
        if tag in ("select", "textarea") or tag == "input" and attributes.get("type", "").lower() != "hidden":
            controls.add(stack[-1][2] if stack else 0)
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        _, inside, node = stack[-1] if stack else ("", False, 0)
        in_article = bool(places.get("article") or places.get("main"))
        inside = inside or skipped(tag, attributes, in_article)
        if not inside:
            mark = marked(tag, attributes, in_article)
            if mark or tag in CONTAINERS:
                nodes.append(Node(node, tag, step_name(tag, attributes.get("class", ""), attributes.get("id", "")), mark))
                node = len(nodes) - 1
        if tag in RAW:
            found = ENDING[tag].search(html, at)
            if tag == "title" and not title:
                title = entities.unescape(html[at : found.start() if found else len(html)])
            at = html.find(">", found.start()) + 1 or len(html) if found else len(html)
            continue
        if html[end - 2 : end] != "/>" or tag in BLOCKS or tag in INLINE:
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, inside, node))
    flush()
    return nodes, blocks, controls, " ".join(title.split())


class Page:
    """A page's text by container, without furniture. Containers are numbered in page order, so each holds a range of numbers."""

    def __init__(self, html: str | None):
        self.nodes, read_blocks, controls, title = read(html)
        size = len(self.nodes)
        up = [n.parent for n in self.nodes]
        holds = [n.tag in ("article", "main") for n in self.nodes]
        self.last = list(range(size))
        for i in range(size - 1, 0, -1):
            holds[up[i]] |= holds[i]
            self.last[up[i]] = max(self.last[up[i]], self.last[i])
        drop, spared = self.furniture(read_blocks, holds, controls, title)
        self.blocks = self.without(drop, read_blocks, spared) or self.without([False] * size, read_blocks, set())
        self.keys, self.paths = [0] * size, {}
        for i in range(1, size):
            self.keys[i] = self.paths.setdefault((self.keys[up[i]], self.nodes[i].step), len(self.paths) + 1)
        own, prose, heads = [0.0] * size, [0] * size, [0] * size
        for node, text, links, headline in self.blocks:
            own[node] += len(text) - links + 1e-6 * len(text)
            prose[node] += is_prose(text, links)
            heads[node] += headline and links < len(text)
        sums = [list(accumulate(x, initial=0)) for x in (own, prose, heads)]
        self.weights, self.prose, self.heads = ([x[self.last[i] + 1] - x[i] for i in range(size)] for x in sums)

    def furniture(self, read_blocks: list[Block], holds: list[bool], controls: set[int], title: str) -> tuple[list[bool], set[int]]:
        """Which marked nodes are furniture by evidence, and the headlines that stay although they stand in one.

        Comments are, if the page has prose elsewhere or they have none. A form is, if it has a control to fill in and holds less than half
        of the page's prose outside comments (of its text, where there is no prose); what else is marked, if it holds less than half of that
        prose and no article. The page's only h1, in a marked header and no link, stays if the title begins with it."""
        size = len(self.nodes)
        talk, asks = [n.marked == "talk" for n in self.nodes], [i in controls for i in range(size)]
        for i in range(1, size):
            talk[i] = talk[i] or talk[self.nodes[i].parent]
        chars, prose, said = [0] * size, [0] * size, [0] * size
        heads: list[tuple[int, int, str, int]] = []
        for at, (node, text, links, headline) in enumerate(self.without([False] * size, read_blocks, set(), gaps=True)):
            own = (len(text) - links) * is_prose(text, links)
            if talk[node]:
                said[node] += own
            else:
                prose[node] += own
                chars[node] += len(text) - links
            if headline:
                heads.append((at, node, text, links))
        sums = [list(accumulate(x, initial=0)) for x in (chars, prose, said, asks)]
        all_chars, all_prose, all_said, all_asks = ([x[self.last[i] + 1] - x[i] for i in range(size)] for x in sums)
        drop = []
        for i, n in enumerate(self.nodes):
            little = 2 * all_prose[i] < all_prose[0] or not all_prose[0]
            if n.marked == "talk":
                drop.append(bool(all_prose[0] or not all_said[i]))
            elif n.marked == "form":
                drop.append(not holds[i] and bool(all_asks[i]) and (little if all_prose[0] else 2 * all_chars[i] < all_chars[0]))
            else:
                drop.append(bool(n.marked) and not holds[i] and little)
        spared = set()
        if len(heads) == 1 and title.lower().startswith(heads[0][2].lower()) and not heads[0][3]:
            node, over = heads[0][1], []
            while node >= 0:
                over += [self.nodes[node].marked] * drop[node]
                node = self.nodes[node].parent
            spared = {heads[0][0]} if set(over) <= {"header"} else spared
        return drop, spared

    def without(self, drop: list[bool], read_blocks: list[Block], spared: set[int], gaps: bool = False) -> list[tuple[int, str, int, bool]]:
        """(container, text, characters in links, headline) of the blocks that have text outside the dropped nodes, or are spared."""
        for i in range(1, len(drop)):
            drop[i] = drop[i] or drop[self.nodes[i].parent]
        found = []
        for at, (node, pieces, headline) in enumerate(read_blocks):
            kept = [(t, link) for n, t, link in pieces if at in spared or not drop[n]]
            text = " ".join("".join(t for t, _ in kept).split())
            if text or gaps:
                found.append((node, text, min(len(text), sum(len(t.strip()) for t, link in kept if link)), headline and bool(text)))
        return found

    def inside(self, node: int, root: int) -> bool:
        return root <= node <= self.last[root]

    def best(self) -> int | None:
        """The page's own main container; None without text."""
        if not self.blocks:
            return None
        root = 0
        for tag in ("main", "article"):
            outer: list[int] = []
            for i in range(root, self.last[root] + 1):
                if self.nodes[i].tag == tag and 2 * self.weights[i] >= self.weights[root] and not (outer and self.inside(i, outer[-1])):
                    outer.append(i)
            if len(outer) == 1:
                root = outer[0]
        if root == 0:
            root = min((i for i, w in enumerate(self.weights) if w >= 0.9 * self.weights[0]), key=lambda i: (self.weights[i], -i))
            while root:
                parent = self.nodes[root].parent
                if self.prose[parent] == self.prose[root] and (self.heads[root] or not self.heads[parent]):
                    break
                root = parent
        return root

    def path(self, node: int) -> str:
        steps = []
        while node >= 0:
            steps.append(self.nodes[node].step)
            node = self.nodes[node].parent
        return "/".join(reversed(steps))

    def at_path(self, path: str) -> list[int]:
        """The containers of this path that hold text."""
        key = 0
        for step in path.split("/")[1:]:
            key = self.paths.get((key, step), -1)
        return [i for i, k in enumerate(self.keys) if k == key and self.weights[i]]

    def text(self, path: str | None) -> tuple[str, str | None]:
        """The text of the containers of this path, or of the page's best container; and the path used."""
        if not self.blocks:
            return "", None
        roots = self.at_path(path) if path is not None else []
        if not roots:
            best = self.best()
            roots, path = [best], self.path(best)
        parent, trusted, headed = self.nodes[roots[0]].parent, self.nodes[roots[0]].tag in ("article", "main"), self.heads[roots[0]]
        held, begun = [], False
        for node, text, links, headline in self.blocks:
            at = roots[max(0, bisect_right(roots, node) - 1)]
            if self.inside(node, at):
                begun = True
                held.append(text)
            elif not begun and parent >= 0 and self.inside(node, parent) and (headline and not headed and links < len(text) or not trusted and is_prose(text, links)):
                held.append(text)
        return "\n\n".join(held), path


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def votes(frames):
    import pandas as pd

    for frame in frames:
        rows = []
        for host, html in zip(strings(frame["host"]), strings(frame["html"]), strict=True):
            page = Page(html)
            best = page.best()
            if best is not None:
                rows.append((host, page.path(best), page.weights[best]))
        if rows:
            yield pd.DataFrame(rows, columns=["host", "path", "points"]).groupby(["host", "path"], as_index=False).agg(n=("points", "size"), points=("points", "sum"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, __rows): the path that most of the host's pages vote for, and how many pages voted."""
    ballots = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null").mapInPandas(votes, "host string, path string, n long, points double")
    counted = ballots.groupBy("host", "path").agg(F.sum("n").alias("n"), F.round(F.sum("points"), 3).alias("points"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("points"), "path")).alias("path"), F.sum("n").alias("__rows"))


def with_host_path(pages: DataFrame, broadcast_hosts: int) -> DataFrame:
    """``pages`` with __path, null where the page's host has none."""
    paths = durable(host_paths(pages)).withColumnsRenamed({"host": "__host", "path": "__path"})
    keyed = pages.withColumn("__page_host", host_of(F.col("url")))
    here = F.col("__page_host") == F.col("__host")
    if paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        found = keyed.join(F.broadcast(paths.drop("__rows")), here, "left")
    else:
        total = paths.agg(F.sum("__rows")).first()[0]
        hot = F.col("__rows") * 1024 > total
        few, rest = paths.where(hot).drop("__rows"), paths.where(~hot).drop("__rows")
        stay = keyed.join(F.broadcast(few), here, "left").where("__page_host is null or __host is not null")
        move = keyed.where("__page_host is not null").join(F.broadcast(few.select("__host")), here, "left_anti")
        found = stay.unionByName(move.hint("merge").join(rest.hint("merge"), here, "left"))
    return found.drop("__page_host", "__host")


def extract(pages: DataFrame, broadcast_hosts: int = 200_000) -> DataFrame:
    """Rows of ``pages`` (url, html, ...) without html, with text, n_chars and path (columns of these names are replaced)."""
    fields = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars", "path")]
    found = with_host_path(pages.drop("text", "n_chars", "path"), broadcast_hosts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [Page(h).text(p) for h, p in zip(batch["html"].to_pylist(), batch["__path"].to_pylist(), strict=True)]
            made = [pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([p for _, p in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), *made], [*(f.name for f in fields), "text", "n_chars", "path"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return found.select(*(f"`{f.name}`" for f in fields), "html", "__path").mapInArrow(run, schema + "text string, n_chars long, path string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
