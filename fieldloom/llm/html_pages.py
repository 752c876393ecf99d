"""A page as a stream of elements and text, read once.

The few repairs that a stream needs are made: void elements, paragraphs, list items and
table parts that end where the next begins, end tags without a start, ends that are missing.
What an element takes from those around it (its path as a hash, what it is left out for, which
open element a repair would end) is kept on it, so time and memory are linear in the page,
however deep it is.

A form is furniture, unless it holds most of the page's letters and no article or main lies
outside the forms: pages of some frameworks lie in a form as a whole.  Labels, buttons and
fieldsets inside it stay furniture.  Headers are furniture inside an article, too.
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

# Elements by what they mean for the text of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe svg math canvas object audio video head title textarea select".split())
FURNITURE = frozenset("nav header footer aside button menu dialog fieldset label input".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
# A class or id is furniture by its first or last word; by the second list only without a word of text.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu menus nav navbar navigation newsletter"
    " pager pagination popup promo promoted promotion related replies reply share sharing sidebar sponsor sponsored subscribe toolbar".split()
)
WEAK_FURNITURE_WORDS = frozenset("banner consent header masthead modal notice social topbar widget".split())
LAYOUT_WORDS = frozenset("has with without no is".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TEXT_WORDS = frozenset("article body content entry main post story text".split())
#: Share of a container's text that one inside must hold to be raised to it; by name of the outer one.
NEARLY = {"article": 0.0, "main": 0.8, "": 0.9}
#: An element that opens closes an open one of these, unless one of the barriers is between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
BREAKS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p"
    " pre section table ul".split()
)
PARAGRAPH_BARRIERS = frozenset("button td th caption table html body div article section main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_PART = re.compile(r"[A-Za-z]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in UNREAD - {"head"}}


#: What a repair ends (elements, barriers), and by name of the element that opens.
_RULES = [({"p"}, PARAGRAPH_BARRIERS), ({"head"}, frozenset()), *({tuple(map(frozenset, rule)): rule for rule in CLOSES.values()}.values())]
_ENDED_BY = {name: 0 for name in BREAKS_PARAGRAPH} | {"body": 1} | {name: _RULES.index(rule) for name, rule in CLOSES.items()}
_IN_RULES = frozenset().union(*(names | barriers for names, barriers in _RULES))
_NONE_OPEN = (-1,) * len(_RULES)

#: Why an element and all in it are left out: by name or role, by class or id, as part of the head.
_BY_NAME, _BY_CLASS, _HEAD = 1, 2, 4


class Element:
    """An element and what it takes from those around it."""

    __slots__ = ("name", "path", "level", "marks", "weight", "form", "linked", "prose", "container", "outer", "reach")

    def __init__(self, above: Element | None, name: str, text: str, position: int):
        attributes = _attributes(text)
        general = _general(attributes.get("class", ""))
        step = name + (f".{general}" if general else "")
        self.name = name
        # Names and generalised classes from the root, as a hash of the path above and this step.
        self.path = hashlib.blake2b(f"{above.path if above else ''}>{step}".encode("utf-8", "replace"), digest_size=16).hexdigest()
        self.level = above.level + 1 if above else 0
        self.marks = (above.marks if above else 0) | _marks(name, attributes)
        words = {w.lower() for key in ("class", "id") for w in _PART.findall(attributes.get(key, ""))}
        self.weight = (1.5 if name in ("article", "main") else 1.0) * (1.25 if words & TEXT_WORDS else 1.0)
        self.form = above.form if above and above.form else self if name == "form" else None
        self.linked = bool(above and above.linked) or name == "a"
        self.prose = bool(above and above.prose) or name in ("article", "main")
        self.outer = above.container if above else None
        self.container = self if name in CONTAINERS else self.outer
        reach = above.reach if above else _NONE_OPEN
        if name in _IN_RULES:
            reach = tuple(position if name in names else -1 if name in barriers else at for at, (names, barriers) in zip(reach, _RULES, strict=True))
        self.reach = reach  # for each repair, the place of the open element that it would end


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


def _general(classes: str) -> str:
    """At most two classes, in order of the alphabet, numbers replaced."""
    return ".".join(sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})[:2])


def _marks(name: str, attributes: dict[str, str]) -> int:
    if name == "head":
        return _HEAD
    if name in FURNITURE or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return _BY_NAME
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return _BY_NAME
    if name in ("html", "body", "main", "article"):
        return 0
    return _BY_CLASS if any(_names_furniture(c) for key in ("class", "id") for c in attributes.get(key, "").split()) else 0


def _names_furniture(name: str) -> bool:
    words = [w.lower() for w in _PART.findall(name)]
    if not words or words[0] in LAYOUT_WORDS:
        return False
    ends = {words[0], words[-1]}
    return bool(ends & FURNITURE_WORDS) or bool(ends & WEAK_FURNITURE_WORDS and not set(words) & TEXT_WORDS)


def _letters(text: str) -> int:
    return sum(map(len, text.split()))


class Page:
    """The elements of a page in the order they open, and its text in pieces.

    A piece is (element that holds it, decoded text); text None ends a block.  Elements that
    are never read are left out.
    """

    def __init__(self, page: str):
        self.elements: list[Element] = []
        self.pieces: list[tuple[Element | None, str | None]] = []
        self._forms: dict[bool, frozenset[Element]] = {}
        stack: list[Element] = []
        n_open: dict[str, int] = {}

        def end_from(position: int) -> None:
            while len(stack) > position:
                n_open[stack.pop().name] -= 1

        def mark(name: str) -> None:
            if name == "br":
                self.pieces.append((stack[-1] if stack else None, " "))
            elif name not in INLINE and self.pieces and self.pieces[-1][1] is not None:
                self.pieces.append((None, None))

        at = 0
        while at < len(page):
            token = _TOKEN.search(page, at)
            end = token.start() if token else len(page)
            if end > at:
                self.pieces.append((stack[-1] if stack else None, html.unescape(page[at:end])))
            if token is None:
                return
            at = token.end()
            name = (token[2] or token[5] or "").lower()
            if not name:
                continue
            attributes = token[3] or token[6] or ""
            if token[1] or token[4]:
                if n_open.get(name):
                    while stack[-1].name != name:
                        end_from(len(stack) - 1)
                    end_from(len(stack) - 1)
                    mark(name)
                continue
            if name in _ENDS and not attributes.rstrip().endswith("/"):
                stop = _ENDS[name].search(page, at)
                at = page.find(">", stop.end()) + 1 if stop else len(page)
                at = at or len(page)
                continue
            for rule in (0 if name in BREAKS_PARAGRAPH else None, _ENDED_BY.get(name)):
                if rule is not None and stack and stack[-1].reach[rule] >= 0:
                    end_from(stack[-1].reach[rule])
            if name not in VOID:
                stack.append(Element(stack[-1] if stack else None, name, attributes, len(stack)))
                n_open[name] = n_open.get(name, 0) + 1
                self.elements.append(stack[-1])
            mark(name)

    def forms(self, by_class: bool) -> frozenset[Element]:
        """The forms that hold the page's text."""
        if by_class not in self._forms:
            marks = _BY_NAME | _HEAD | (_BY_CLASS if by_class else 0)
            total, outside, held = 0, 0, {}
            if any(element.form for element in self.elements):
                for element, text in self.pieces:
                    if text is None or (element and element.marks & marks):
                        continue
                    size = _letters(text)
                    total += size
                    if element and element.form:
                        held[element.form] = held.get(element.form, 0) + size
                    elif element and element.prose:
                        outside += size
            self._forms[by_class] = frozenset(form for form, size in held.items() if 2 * size > total and not outside)
        return self._forms[by_class]

    def is_left_out(self, element: Element | None, by_class: bool = True) -> bool:
        """Whether it is no main text; ``by_class`` tells whether classes and ids, too, mark furniture."""
        if element is None:
            return False
        if element.marks & (_BY_NAME | _HEAD | (_BY_CLASS if by_class else 0)):
            return True
        return element.form is not None and element.form not in self.forms(by_class)


class Container(NamedTuple):
    score: float  # its own text, and less of what containers inside it hold; links count against it
    size: int  # letters in it that are not furniture
    weight: float  # of text in it
    name: str
    level: int
    outer: str | None  # path of the container around it


def containers(page: Page | str) -> dict[str, Container]:
    """The containers of a page by path."""
    page = page if isinstance(page, Page) else Page(page)
    held: dict[Element, list] = {}
    for element, text in page.pieces:
        if text is None or element is None or element.container is None or page.is_left_out(element):
            continue
        size = _letters(text)
        if size:
            sums = held.setdefault(element.container, [0.0, 0])
            sums[0] += -0.5 * size if element.linked else size
            sums[1] += size
    found: dict[str, Container] = {}
    # Elements inside others open later, so each has all its text when its turn comes.
    for element in reversed(page.elements):
        if element in held:
            text, size = held[element]
            score, letters, weight = found[element.path][:3] if element.path in found else (0.0, 0, element.weight)
            outer = element.outer
            found[element.path] = Container(
                score + text * element.weight, letters + size, max(weight, element.weight), element.name, element.level, outer.path if outer else None)
            if outer:
                sums = held.setdefault(outer, [0.0, 0])
                sums[0] += text / 2
                sums[1] += size
    return found


def around(path: str, found: dict[str, Container]) -> list[str]:
    """The containers around the one at a path, inner ones first."""
    above = []
    while (path := found[path].outer) is not None:
        above.append(path)
    return above


def raised(path: str, found: dict[str, Container]) -> str:
    """The highest container around a path that holds nearly the same text; an article around it is one in any case."""
    best = path
    for above in around(path, found):
        if found[path].size >= NEARLY.get(found[above].name, NEARLY[""]) * found[above].size:
            best = above
    return best


def extract(page: Page | str, path: str | tuple[str, ...] | None, by_class: bool = True) -> str:
    """Text of the containers at a path, or at several, a line for each block; of the whole page without one."""
    page = page if isinstance(page, Page) else Page(page)
    paths = (path,) if isinstance(path, str) else path
    inside: set[Element] = set()
    if paths:
        # Elements that open while one at a path is open are deeper; the first that is not is outside it.
        level = None
        for element in page.elements:
            if level is not None and element.level <= level:
                level = None
            if level is None and element.path in paths:
                level = element.level
            if level is not None:
                inside.add(element)
    blocks, words = [], []
    for element, text in page.pieces:
        if text is None:
            blocks.append(words)
            words = []
        elif (paths is None or element in inside) and not page.is_left_out(element, by_class):
            words.append(text)
    blocks.append(words)
    return "\n".join(line for block in blocks if (line := " ".join("".join(block).split())))
