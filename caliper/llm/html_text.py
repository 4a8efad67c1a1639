"""Operator 8, HTML extraction by tree scoring.

A page becomes a tree.  Subtrees that cannot be the article (menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, reader comments: by tag, role, and
words of class and id) are cut.  A name that is made of such words alone, or begins with one that
no text is named by (``ad-slot``, ``disqus_thread``), cuts anywhere; a name with other words too, such as
the slug of a heading, cuts inside the main text only blocks of links.  A form is no menu
if it holds the article, or most of the page's long blocks.  Each paragraph passes points, for its length and its
commas, to its parent and, ever less, to the ancestors above; a container's points are
discounted by the share of its text that stands in links.  The best container, widened
to the article element it lies in, and siblings that score like it are the main text; on
a page without article or main also all uncut blocks of few links, however short, that
stand between and next to them.

The text has one line a block: character references decoded, white space inside a block
(``<br>`` too) made one space, blocks in page order.

Pages are independent, so the plan is one map over slices of bounded size.  Edge cases:
null, empty and text-free html give an empty text; markup that never closes is closed at
its end, a head where the first element of the page begins; time is linear in the page, however deep
it is nested (points rise ``LEVELS`` levels); a page without any paragraph falls back to its article, main or body; repeated
rows and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caliper.llm.common import map_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
#: Elements that are never part of an article.
CUT = frozenset("aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object "
                "script select style svg template textarea title".split())
#: Words in class, id or role that mark such elements.
CUT_WORDS = frozenset("ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments "
                      "complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar "
                      "navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
                      "recommended related replies reply respond search share sharing sidebar signup skyscraper social "
                      "sponsor sponsored subscribe subscription toolbar widget".split())
#: Of these, words that name no part of an article even if other words follow.
FIRST_WORDS = frozenset("ad ads adv advert advertisement adverts advertising breadcrumb breadcrumbs comments cookie cookies "
                        "disqus gdpr masthead navbar newsletter pagination popup promo sidebar skyscraper sponsored".split())
#: Words that say nothing beside a word of CUT_WORDS; a class of such words only is a match.
PLAIN_WORDS = frozenset("area article articles aside bar block body bottom box btn button buttons card container content entry form "
                        "icons in inline inner item items left link links list main media message module outer page panel plugin post "
                        "posts right section site slot stories story tags text title top unit widget widgets wp wrap wrapper".split())
#: First words of names that tell what a container has, such as ``has-sidebar``.
ABOUT = frozenset("has no with without".split())
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
#: A start tag closes an open element of these, if it is nearer than any of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "li", "dd", "dt"} | {"li", "dd", "dt"}
LEAST_CHARS = 25
SIBLING_SHARE = 0.2
#: Blocks with this share of their text in links are not the article's.
LINK_SHARE = 0.25
#: Inside the main text, blocks that only an id or a part of a class marks go from here on.
SOFT_LINK_SHARE = 0.5
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a head holds; anything else begins the page.
HEAD_TAGS = frozenset("base link meta title script style noscript template object".split())
#: A block of text is long from so many characters.
LONG_BLOCK = 80
LEVELS = 64
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "soft", "by_id", "score", "length", "linked", "commas")

    def __init__(self, tag, parent, cut=False, soft=False, by_id=None):
        self.tag, self.parent, self.kids, self.cut, self.soft, self.by_id = tag, parent, [], cut, soft, by_id
        self.score, self.length, self.linked, self.commas = 0.0, 0, 0, 0


def _marked(tag: str, attrs: list) -> tuple[str | None, str | None]:
    """Do tag and attributes say that this is not a part of an article?  ``hard``: yes;
    ``soft``: only a name that has other words too says so.  If nothing but its id says yes, the id."""
    if tag in CUT:
        return "hard", None
    found = by_id = None
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for one in (value or "").split():
                words = [w.lower() for w in _WORD.findall(one)]
                if words and words[0] not in ABOUT and not CUT_WORDS.isdisjoint(words):
                    if name == "role" or words[0] in FIRST_WORDS or CUT_WORDS.union(PLAIN_WORDS).issuperset(words):
                        if name != "id":
                            return "hard", None
                        by_id = one
                    else:
                        found = "soft"
                if one.lower() in ("header", "site-header") and tag not in ("article", "main"):
                    return "hard", None
        elif name == "hidden" or name == "aria-hidden" and value == "true" \
                or name == "style" and re.search(r"display\s*:\s*none", value or ""):
            return "hard", None
    return ("hard", by_id) if by_id else (found, None)


class Tree(HTMLParser):
    """Builds the tree; text nodes are plain strings among ``kids``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open = Counter()               # open elements by tag

    def handle_starttag(self, tag, attrs):
        if self.at.tag == "head" and tag not in HEAD_TAGS:
            self._up(self.at.parent)
        if tag == "html" or tag == "body" and self.open["body"]:
            return
        if tag in CLOSES_P:
            self._close({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        marked, by_id = _marked(tag, attrs) if tag not in ("body", "main") else (None, None)
        if tag == "header" and marked != "hard" and not self.open["article"] and not self.open["main"]:
            marked = "hard"
        node = Node(tag, self.at, marked is not None, marked == "soft", by_id)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._close({tag}, {"td", "th", "table", "article", "main", "body"} - {tag} if tag not in BLOCK else set())

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._up(self.at.parent)
        self.at.kids.append(data)

    def _up(self, node) -> None:
        """Close open elements until ``node`` is the last open one."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags, bounds) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node is not None and node.tag not in tags:
            if node.tag in bounds:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self._up(node.parent)


def _walk(root: Node):
    """All uncut nodes, parents first, and the nodes under them (no recursion)."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.cut]
    return out


def _unhide(root: Node) -> None:
    """A container marked by a class word, but holding the page's article, is not cut."""
    todo, cut_holders = [(root, None)], []
    while todo:
        node, holder = todo.pop()
        if holder is not None and node.tag in ("article", "main") and not node.cut:
            cut_holders.append(node)
            continue
        if node.cut and node.tag not in CUT:
            holder = node
        elif node.cut:
            continue
        todo += [(k, holder) for k in node.kids if isinstance(k, Node)]
    if cut_holders and not any(n.tag in ("article", "main") for n in _walk(root)):
        node = cut_holders[0]
        while node is not None:
            node.cut, node = False, node.parent


def _free_forms(root: Node) -> None:
    """A form that holds an article or main element, or most of the page's long blocks, is the page."""
    forms, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "form":
            node.cut = False
            forms.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and (not k.cut or k.tag == "form")]
    if not forms:
        return
    run, long, holds = {}, {}, set()        # inline text of the open block, long blocks below, has article or main
    for node in reversed(_walk(root)):
        key = id(node)
        run[key] = run.get(key, 0) + sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        up = id(node.parent)
        if node.tag in BLOCK:
            long[key] = long.get(key, 0) + (run[key] if run[key] >= LONG_BLOCK else 0)
        else:
            run[up] = run.get(up, 0) + run[key]
        long[up] = long.get(up, 0) + long.get(key, 0)
        if node.tag in ("article", "main") or key in holds:
            holds.add(up)
    whole = long[id(root)]
    for form in forms:
        form.cut = id(form) not in holds and not 0 < whole <= 2 * long[id(form)]


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order."""
    out, line = [], []

    def end():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    todo: list = [None, *reversed(nodes)]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.cut:
            if x.tag == "br":
                line.append(" ")
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.kids)
    end()
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters of text, of text in links, and commas of every node (children come later in ``nodes``)."""
    for node in reversed(nodes):
        for k in node.kids:
            if isinstance(k, str):
                node.length += len(k.strip())
                node.commas += k.count(",")
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.commas += node.commas


def _own_heading(node: Node) -> str:
    """The text of the first heading at the beginning of a block."""
    while True:
        below = [k for k in node.kids if isinstance(k, Node) or k.strip()]
        if not below or isinstance(below[0], str):
            return ""
        node = below[0]
        if node.tag in HEADING:
            return "".join(k for n in [node, *_walk(node)[1:]] for k in n.kids if isinstance(k, str))


def _free_slugs(root: Node) -> None:
    """The id of a heading is the slug of its text and marks nothing, nor does that of a paragraph; an
    id of several words that is the slug of its block's own heading marks it softly."""
    for node in _walk(root):
        for k in node.kids:
            if not isinstance(k, Node) or not k.cut or not (k.soft or k.by_id):
                continue
            if k.tag in HEADING or k.tag == "p":
                k.cut = False
            elif k.by_id:
                words = [w.lower() for w in _WORD.findall(k.by_id)]
                k.soft = len(words) > 1 and words == [w.lower() for w in _WORD.findall(_own_heading(k))]


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it."""
    _free_forms(root)
    _unhide(root)
    _free_slugs(root)
    nodes = _walk(root)
    _measure(nodes)
    density = lambda n: n.linked / n.length if n.length else 0.0
    scored = {}
    for node in nodes:
        direct = node.tag == "div" and sum(len(k.strip()) for k in node.kids if isinstance(k, str)) >= LEAST_CHARS
        if node.tag not in PARAGRAPH and not direct or node.length < LEAST_CHARS:
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - density(node))
        up, share = (node if direct else node.parent), 1.0
        level = 0
        while up is not None and up.parent is not None and level < LEVELS:
            up.score += points * share
            scored[id(up)] = up
            level += 1
            up, share = up.parent, 1 / 2 if level == 1 else 1 / (3 * level)
    best = max(scored.values(), key=lambda n: n.score * (1 - density(n)), default=None)
    if best is None:
        for tag in ("article", "main", "body"):
            found = [n for n in nodes if n.tag == tag]
            if found:
                return [max(found, key=lambda n: n.length)]
        return [root]
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        best = node
    least = SIBLING_SHARE * best.score * (1 - density(best))
    kin = best.parent.kids if best.parent is not None and best.tag != "body" else [best]
    sure = [isinstance(k, Node) and not k.cut
            and (k is best or k.score and k.score * (1 - density(k)) >= least and density(k) < LINK_SHARE
                 or k.tag == "p" and k.length > 80 and density(k) < LINK_SHARE) for k in kin]
    if node is not None:        # an article element bounds itself
        return [k for k, ok in zip(kin, sure, strict=True) if ok]
    return _with_neighbours(kin, sure)


def _restore(kept: list) -> None:
    """Inside the main text an id, or a part of a class, cuts only blocks of links."""
    todo = [k for k in kept if isinstance(k, Node)]
    while todo:
        node = todo.pop()
        if node.cut and node.soft:
            below = _walk(node)
            for n in below:
                n.length = n.linked = n.commas = 0
            above, node.parent = node.parent, None
            _measure(below)
            node.parent = above
            node.cut = node.tag not in HEADING and node.linked >= SOFT_LINK_SHARE * max(node.length, 1)
        if not node.cut:
            todo += [k for k in node.kids if isinstance(k, Node)]


def _with_neighbours(kin: list, sure: list[bool]) -> list:
    """The sure ones of ``kin`` and, between and next to them, all uncut blocks of low link
    density, however short; text and inline elements in a row are one block.  Outwards
    the first block of links is the end."""
    runs: list[tuple[list, bool]] = []
    joins = False
    for k, ok in zip(kin, sure, strict=True):
        inline = isinstance(k, str) or k.tag not in BLOCK and not k.cut
        if inline and joins and not ok and not runs[-1][1]:
            runs[-1][0].append(k)
        else:
            runs.append(([k], ok))
        joins = inline and not ok

    def linked(run) -> float | None:
        nodes = [k for k in run if isinstance(k, Node) and not k.cut]
        length = sum(k.length for k in nodes) + sum(len(k.strip()) for k in run if isinstance(k, str))
        return sum(k.linked for k in nodes) / length if length else None

    share = [linked(run) for run, _ in runs]
    first = next(i for i, (_, ok) in enumerate(runs) if ok)
    last = next(i for i in reversed(range(len(runs))) if runs[i][1])
    while first and (share[first - 1] is None or share[first - 1] < LINK_SHARE):
        first -= 1
    while last + 1 < len(runs) and (share[last + 1] is None or share[last + 1] < LINK_SHARE):
        last += 1
    out = []
    for i in range(first, last + 1):
        run, ok = runs[i]
        heading = isinstance(run[0], Node) and run[0].tag in HEADING
        if ok or heading or share[i] is not None and share[i] < LINK_SHARE:
            out += run
    return out


def main_text(html: str | None) -> str:
    """The main text of one page, one line a block."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    kept = main_nodes(tree.root)
    _restore(kept)
    return "\n".join(_blocks(kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(part):
        texts = [main_text(x) for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_text(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"),
                    run, "page_id long, url string, text string, n_chars long", "html")
