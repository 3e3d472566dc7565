"""HTML as a sequence of leaf blocks: their tag paths and texts."""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from dataclasses import dataclass

_NAME = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)")
#: The name of a tag whose first name runs into a quote that never ends.
_PLAIN_NAME = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>\"']*)")
_SPECIAL = re.compile(r"[>\"']")
#: Elements open at once; deeper ones take the place of the deepest, as browsers have it.
DEPTH = 512
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style title template noscript svg iframe".split())
#: Those of them whose content is no markup and ends at the first end tag.
RAW = frozenset("script style title noscript iframe".split())
#: Formulas, and the elements inside.
MATH = frozenset(
    "math maction menclose merror mfenced mfrac mglyph mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover none semantics annotation annotation-xml".split()
)
#: Elements inside a line of text; all others begin and end a block.
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp "
    "s samp small span strike strong sub sup time tt u var wbr br input object param".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the same kind, up to their container.
SIBLINGS = {
    "li": frozenset(["ul", "ol", "menu"]),
    "tr": frozenset(["table"]), "td": frozenset(["tr"]), "th": frozenset(["tr"]),
    "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "option": frozenset(["select"]),
}


@dataclass(frozen=True)
class Block:
    """``path``: element names from the root, each with the words of its class, id and role."""

    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def _label(tag: str, rest: str) -> str:
    names = [x for found in _NAMES.findall(rest) for x in found] if "=" in rest else []
    return " ".join([tag, *_PART.findall(" ".join(names).lower())])


class Tags:
    """Where the tags of a page end, found for all places in one pass from the back.

    Quoted values may hold a ``>``. From a special character outside quotes the way to the end of a tag is
    always the same, so it is worked out once; a tag that never ends costs no scan of the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.places = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        following = {'"': -1, "'": -1}  # number of the next quote of each kind
        for k in range(len(self.places) - 1, -1, -1):
            c = page[self.places[k]]
            if c == ">":
                self.ends[k] = self.places[k]
            else:
                if following[c] >= 0:
                    self.ends[k] = self.ends[following[c] + 1]
                following[c] = k
        self.last = page.rfind(">")

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes start at ``at``; -1 if none does."""
        return self.ends[bisect.bisect_left(self.places, at)]

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        """Slash, name and attributes of the tag at ``at``, and where it is over."""
        for form in (_NAME, _PLAIN_NAME):
            found = form.match(self.page, at)
            if not found:
                return None
            end = self.end(found.end())
            if end >= 0:
                return found["close"], found["tag"], self.page[found.end() : end], end + 1
        return None


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with text, in order. White space inside a block becomes one space.

    Unclosed and crossed elements are closed as browsers do: a new block ends an open paragraph, a list
    item ends the one before, an end tag closes all that is open inside its element. Broken markup never
    fails: what is no tag is text. A skipped element without an end tag ends where its parent does; only
    an open script or style runs to the end of the page. Formulas and the text of objects are text. Time
    and memory grow with the page, whatever is broken in it.
    """
    found: list[Block] = []
    tags: list[str] = []
    labels: list[str] = []
    parts: list[str] = []
    linked = links = 0
    silent: str | None = None  # the element that is skipped
    inside: Counter[str] = Counter()  # elements open in it

    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # blocks of one place share their path

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(labels)
                found.append(Block(paths.setdefault(path, path), text, linked))
            parts.clear()
        linked = 0

    def cut(at: int) -> None:
        nonlocal links
        links -= tags[at:].count("a")
        del tags[at:], labels[at:]

    at, size = 0, len(page)
    known = Tags(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            text, at = page[at:end], end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        elif token := known.tag(at):
            close, tag, rest, at = token
            text = None
        elif page.startswith(("<!", "<?", "</"), at) and known.last > at:
            at = page.find(">", at) + 1
            continue
        else:
            text, at = "<", at + 1
        if text is not None:
            if not silent:
                text = html.unescape(text)
                parts.append(text)
                linked += len(text) * (links > 0)
            continue
        tag = tag.lower()
        empty = rest.endswith("/")
        if silent and close:
            if inside[tag] > 0:
                inside[tag] -= 1
                continue
            if tag != silent and tag not in tags:
                continue
            ended, silent = silent, None
            if tag == ended:
                continue
        if close:
            if tag in tags:
                if tag not in INLINE:
                    end_block()
                cut(len(tags) - 1 - tags[::-1].index(tag))
            elif tag not in INLINE:
                end_block()
            continue
        if empty and (silent or tag == "svg" or tag in MATH):
            continue
        if tag in RAW:
            code = tag in ("script", "style")
            start = "" if code else rf"|<{tag}\b"
            end = None
            if known.last >= at:
                end = re.compile(rf"</{tag}\b[^>]*>{start}", re.IGNORECASE).search(page, at)
            if code or (end and end[0][1] == "/"):
                at = end.end() if end else size
                continue
        if silent:
            inside[tag] += tag not in VOID
            continue
        if tag in SILENT:
            silent = tag
            inside.clear()
            continue
        if tag not in INLINE:
            end_block()
            if "p" in tags:
                cut(len(tags) - 1 - tags[::-1].index("p"))
            if tag in SIBLINGS and tag in tags:
                last = len(tags) - 1 - tags[::-1].index(tag)
                if not SIBLINGS[tag].intersection(tags[last:]):
                    cut(last)
        elif tag in ("br", "mtd"):
            parts.append(" ")
        if tag not in VOID:
            if len(tags) >= DEPTH:
                cut(DEPTH - 1)
            tags.append(tag)
            labels.append(_label(tag, rest))
            links += tag == "a"
    end_block()
    return found
