"""Pages as trees of block elements, and as features of the graphical model in html_extract."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Buckets of hashed features.
N_FEATURES = 1 << 13

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_NAMING = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose inside is no text of the page. Without an end tag, the former end at the next tag and the latter at once.
RAW = frozenset("script style title".split())
HIDDEN = frozenset("template svg iframe".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | HIDDEN}
_NEXT_TAG = re.compile(r"<[a-zA-Z/!?]")
#: Open blocks on top of each other; deeper ones become siblings, as browsers have it.
MAX_DEPTH = 512

#: Elements within a line of text, and those that leave their inside as it is.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr object noscript math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the listed kinds, up to the nearest of the scope's.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass
class Tree:
    """Block elements in page order; runs are the texts between block borders, with the block that holds them."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters of each run within links


class Scanner:
    """Text and tags of a page from left to right: (text, tag, attributes, is an end tag); each character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.quoting = True
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Behind the > that ends a tag; one within a quoted value doesn't. -1 if the page ends within the tag."""
        page, i = self.page, at
        if at > self.last:
            return -1
        while self.quoting:
            stop = _STOP.search(page, i)
            if not stop:
                self.quoting = False  # an open quote somewhere: from here on, quotes don't count
                break
            if stop[0] == ">":
                return stop.end()
            i = stop.end()
            if page[at : i - 1].rstrip()[-1:] == "=" if i - at < 64 else page[i - 64 : i - 1].rstrip()[-1:] == "=":
                close = page.find(stop[0], i)
                i = close + 1 if close >= 0 else i
        return page.find(">", at) + 1

    def __iter__(self) -> Iterator[tuple[str, str, str, bool]]:
        page, at, begin = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            mark = page[at + 1 : at + 2]
            name = _NAME.match(page, at + 2 if mark == "/" else at + 1)
            if not name and mark not in "!?/" or not mark:
                at += 1  # a plain <
                continue
            text = page[begin:at]
            if name:
                end = self.tag_end(name.end())
                tag, attributes = name[0].lower(), page[name.end() : end - 1]
            elif page.startswith("<!--", at):
                short = page.startswith((">", "->"), at + 4)
                end = page.find(">" if short else "-->", at + 4)
                end, tag, attributes = end + (1 if short else 3) if end >= 0 else -1, "", ""
            else:
                end, tag, attributes = page.find(">", at) + 1 or -1, "", ""
            at = begin = end if end >= 0 else len(page)  # a page that is cut within a tag or comment ends there
            if end < 0:
                tag = ""
            if mark != "/" and tag in _RAW_END and not attributes.endswith("/"):
                close = None if tag in self.unclosed else _RAW_END[tag].search(page, at)
                shut = page.find(">", close.end()) if close and close.end() <= self.last else -1
                if shut >= 0:
                    at = begin = shut + 1
                else:
                    self.unclosed.add(tag)
                    if tag in RAW:
                        following = _NEXT_TAG.search(page, at)
                        at = begin = following.start() if following else len(page)
                tag = ""
            yield text, tag, attributes, mark == "/"
        yield page[begin:], "", "", False


def parse(page: str | None) -> Tree:
    """Tolerates unclosed and stray tags; a page without elements is one body. Comments, scripts and styles are left out."""
    tree, stack = Tree(), []
    text: list[str] = []
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
    linked, in_link = 0, False

    def opened(tag: str, attributes: str) -> None:
        if len(stack) >= MAX_DEPTH:
            closed(len(stack) - 1)
        tree.tags.append(tag)
        tree.parents.append(stack[-1] if stack else -1)
        tree.depths.append(len(stack))
        names, label = [], ""
        if attributes:
            for key, a, b, c in _NAMING.findall(attributes):
                if key.lower() == "data-y":
                    label = a or b or c
                else:
                    names += [w.lower() for w in _PART.findall(a or b or c)]
        tree.names.append(names)
        tree.labels.append(label)
        if tag not in VOID:
            where[tag].append(len(stack))
            stack.append(len(tree.tags) - 1)

    def closed(down_to: int) -> None:
        while len(stack) > down_to:
            where[tree.tags[stack.pop()]].pop()

    def flush() -> None:
        nonlocal linked
        if text:
            run = "".join(text)
            text.clear()
            if "&" in run:
                run = html.unescape(run)
            run = " ".join(run.split())
            if run:
                if not stack:
                    opened("body", "")
                tree.runs.append((stack[-1], run))
                tree.links.append(min(linked, len(run)))
        linked = 0

    for before, tag, attributes, ends in Scanner(page or ""):
        if before:
            text.append(before)
            if in_link:
                linked += len(before)
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                text.append(" ")
        elif ends:
            if where[tag]:
                flush()
                in_link = False
                closed(where[tag][-1])
        else:
            flush()
            in_link = False
            if stack and tree.tags[stack[-1]] == "p":
                closed(len(stack) - 1)
            if tag in ENDS:
                kinds, scope = (max((where[t][-1] for t in own if where[t]), default=-1) for own in ENDS[tag])
                if kinds > scope:
                    closed(kinds)
            opened(tag, attributes)
            if attributes.endswith("/") and stack and stack[-1] == len(tree.tags) - 1:
                closed(len(stack) - 1)
    flush()
    return tree


_KNOWN: dict[str, int] = {}


def feature(name: str) -> int:
    found = _KNOWN.get(name)
    if found is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        found = _KNOWN[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % N_FEATURES
    return found


def _size(n: float, most: int) -> int:
    return min(int(n).bit_length(), most)


#: Kinds of edges, by the child's tag.
EDGE_KINDS = {t: k for k, tags in enumerate(("div section main article aside header footer nav form body", "p blockquote pre figure figcaption address", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table thead tbody tr td th caption"), 1) for t in tags.split()}
N_EDGES = 1 + max(EDGE_KINDS.values())


def features(tree: Tree) -> list[list[int]]:
    """Active features of each node: tag, naming words, own text, links, and the share of the page's text beneath."""
    n = len(tree.tags)
    chars, linked, runs, stops = [0] * n, [0] * n, [0] * n, [0] * n
    for (node, run), link in zip(tree.runs, tree.links, strict=True):
        chars[node] += len(run)
        linked[node] += link
        runs[node] += 1
        stops[node] += run[-1] in ".!?…\"”»"
    below, below_linked, kids, paragraphs = chars[:], linked[:], [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        p = tree.parents[i]
        if p >= 0:
            below[p] += below[i]
            below_linked[p] += below_linked[i]
            kids[p] += 1
            paragraphs[p] += tree.tags[i] in ("p", "pre", "blockquote") and chars[i] > 80
    total, out = max(1, sum(chars)), []
    for i in range(n):
        tag, p = tree.tags[i], tree.parents[i]
        own = ["bias", f"tag={tag}", f"len={_size(chars[i], 8)}", f"below={_size(below[i], 9)}", f"share={int(8 * below[i] / total)}", f"links={int(4 * below_linked[i] / max(1, below[i]))}", f"kids={_size(kids[i], 2)}", f"paragraphs={_size(paragraphs[i], 2)}", f"stops={int(2 * stops[i] / max(1, runs[i]))}"]
        own.append(f"in={tree.tags[p] if p >= 0 else ''}")
        own.append(f"len={_size(chars[i], 8)},{tag}")
        for w in set(tree.names[i]):
            own += [f"name={w}", f"name={w[:4]}~"]
        own.append("named" if tree.names[i] else "unnamed")
        out.append([feature(f) for f in own])
    return out
