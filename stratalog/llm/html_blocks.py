"""The leaf blocks of a page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)
    |(?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
#: Elements whose content is no markup, and elements that are passed over if they have an end tag.
RAW = frozenset(("script", "style", "title", "textarea"))
PASSED = frozenset(("noscript", "template", "svg", "iframe", "select", "canvas"))
_END = re.compile(rf"</({'|'.join(sorted(RAW | PASSED))})(?=[\s/>])[^>]*(?:>|\Z)", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMED = frozenset(("class", "id", "role", "itemprop"))
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]{2,}")

#: Tags of HTML that begin and end a block, and those without an end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag on the left ends an open element on the right that lies in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table body div article section aside main nav footer header form".split())


@dataclass(slots=True, eq=False)
class Node:
    """An open element: its parent, tag and depth, and those of its marks (tag and class names) that no ancestor has."""

    parent: Node | None
    tag: str
    depth: int
    marks: list[str]


@dataclass(slots=True)
class Block:
    node: Node | None  # the innermost open element
    text: str
    linked: int  # characters within links


def _attributes(rest: str) -> tuple[list[str], bool]:
    """The class and id names of a tag's attributes, and whether they hide it."""
    found, hidden = set(), False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in _NAMED:
            found.update(_NAME.findall(value.lower()))
        elif name == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif name == "style":
            hidden = hidden or bool(_UNSEEN.search(value))
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
    return sorted(found), hidden


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments and elements marked hidden have none.

    Graphics, frames and choice lists are passed over up to their end tag; self-closed or without one, they are a tag like
    any other, and so are formulas, whose text stays. Elements whose names only begin like one of these are others. Time
    and memory grow with the page, however deep its elements nest: a block knows its innermost element alone.
    """
    out: list[Block] = []
    path: list[Node] = []
    own: list[list[str]] = []  # all marks of each open element
    held: dict[str, int] = {}  # open elements by mark
    open_at: dict[str, list[int]] = {}  # depths of open elements by tag
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    hidden_from = None
    run: list[str] = []
    links = linked = 0

    def end_run() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append(Block(path[-1] if path else None, text, min(len(text), linked)))
            run.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal hidden_from
        end_run()
        for node, marks in zip(path[n:], own[n:], strict=True):
            open_at[node.tag].pop()
            for mark in marks:
                held[mark] -= 1
        del path[n:], own[n:]
        if hidden_from is not None and n <= hidden_from:
            hidden_from = None

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if text := m["text"]:
            if hidden_from is None:
                run.append(text)
                if links:
                    linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        closing = m["close"] or m["close2"]
        rest = m["rest"] or m["rest2"] or ""
        if not closing and (tag in RAW or tag in PASSED and not rest.endswith("/")):
            known = ends.get(tag, [])
            i = bisect_left(known, (at, at))
            if i < len(known):
                at = known[i][1]
                continue
            if tag in RAW:
                break
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCK_TAGS:
            links = 0
            if closing:
                if open_at.get(tag):
                    pop_to(open_at[tag][-1])
                else:
                    end_run()
                continue
            end_run()
            if path and path[-1].tag == "p":
                pop_to(len(path) - 1)
            if (before := ENDS.get(tag)) and (last := nearest(before)) >= 0 and last >= nearest(CONTAINERS - before):
                pop_to(last)
            if tag in VOID_TAGS:
                continue
            names, hides = _attributes(rest) if rest else ([], False)
            marks = [f"in {tag}", *(f"name {n}" for n in names)]
            path.append(Node(path[-1] if path else None, tag, len(path) + 1, [x for x in marks if not held.get(x)]))
            own.append(marks)
            for mark in marks:
                held[mark] = held.get(mark, 0) + 1
            open_at.setdefault(tag, []).append(len(path) - 1)
            if hidden_from is None and hides:
                hidden_from = len(path) - 1
    end_run()
    return out
