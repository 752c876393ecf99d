"""Main content of a page as Markdown.

Dialect: ATX headings, ``**`` and ``*``, ``[text](href)``, ``![alt](src)``, ``* item``
and ``1. item`` (nested by two spaces), back-ticks, fenced ``pre``, ``> `` quotes,
``---`` rules, pipes for table cells; blocks are separated by one blank line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = {"nav", "footer", "aside", "script", "style"}
_BLOCKS = set(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 "
    "header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY = {  # an opening tag of the set ends an open tag of the key
    "p": _BLOCKS - {"td", "th", "li"} | {"li"},
    "li": {"li"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "tr": {"tr"},
    "option": {"option"},
}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "holds_block")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.kids, self.holds_block = tag, attrs, parent, [], False
        if tag in _BLOCKS:
            while parent is not None and not parent.holds_block:
                parent.holds_block = True
                parent = parent.parent

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSED_BY.get(self.here.tag, ()):
            self.open[self.here.tag] -= 1
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.kids.append(node)
        if tag not in _VOID:
            self.here = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.here.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        while self.open[tag] > 0:
            closed = self.here
            self.here = closed.parent
            self.open[closed.tag] -= 1
            if closed.tag == tag:
                return

    def handle_data(self, data):
        self.here.kids.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if n.tag and test(n)), None)


def main_content(root: Node) -> Node:
    """First of main, article, #content, .content, div.main, body, whole page."""
    tests = (
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: n.attrs.get("id") == "content",
        lambda n: "content" in n.attrs.get("class", "").split(),
        lambda n: n.tag == "div" and "main" in n.attrs.get("class", "").split(),
        lambda n: n.tag == "body",
    )
    for test in tests:
        found = _first(root, test)
        if found is not None:
            return found
    return root


def _run(task: Generator):
    """Value of a task that yields the tasks it needs; the depth of markup costs no stack."""
    stack, value = [task], None
    while stack:
        try:
            task = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(task)
            value = None
    return value


def _joined(kids: list) -> Generator:
    out = []
    for kid in kids:
        out.append(kid if isinstance(kid, str) else (yield _spans(kid)))
    return "".join(out)


def _inline(node: Node) -> Generator:
    return re.sub(r"[ \t\r\n\f]+", " ", (yield _joined(node.kids)))


def _spans(item: Node) -> Generator:
    if item.tag in _DROPPED:
        return ""
    if item.tag == "br":
        return "\x00"
    if item.tag == "img":
        return f"![{item.attrs.get('alt', '')}]({item.attrs.get('src', '')})"
    inner = yield _joined(item.kids)
    core = inner.strip()
    if not core:
        return inner
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if item.tag in ("b", "strong"):
        core = f"**{core}**"
    elif item.tag in ("i", "em"):
        core = f"*{core}*"
    elif item.tag in ("code", "kbd", "samp"):
        core = f"`{core}`"
    elif item.tag == "a" and item.attrs.get("href"):
        core = f"[{core}]({item.attrs['href']})"
    elif item.tag in _BLOCKS:
        return " " + core + " "
    return lead + core + tail


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t\r\n\f]+", " ", text)
    return "\n".join(part.strip() for part in text.split("\x00")).strip()


def _list(node: Node, indent: int) -> Generator:
    """Lines of a list; what stands in it without being an item keeps its place, without a bullet."""
    lines, number = [], 1
    waiting = list(reversed(node.kids))
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            if text := _tidy(item):
                lines.append("  " * indent + text.replace("\n", " "))
        elif item.tag in ("ul", "ol"):
            lines += yield _list(item, indent + 1)
        elif item.tag == "li":
            bullet = f"{number}." if node.tag == "ol" else "*"
            inner = [k for k in item.kids if not (isinstance(k, Node) and k.tag in ("ul", "ol"))]
            lines.append("  " * indent + f"{bullet} " + _tidy((yield _joined(inner))).replace("\n", " "))
            for kid in item.kids:
                if isinstance(kid, Node) and kid.tag in ("ul", "ol"):
                    lines += yield _list(kid, indent + 1)
            number += 1
        elif item.holds_block and item.tag not in _DROPPED:
            waiting.extend(reversed(item.kids))
        elif text := _tidy((yield _spans(item))):
            lines.append("  " * indent + text.replace("\n", " "))
    return lines


def _blocks(node: Node) -> Generator:
    out, run = [], []

    def flush():
        text = _tidy("".join(run))
        run.clear()
        if text:
            out.append(text)

    for kid in node.kids:
        if isinstance(kid, str):
            run.append(kid)
        elif kid.tag in _DROPPED or kid.tag in ("head", "title"):
            continue
        elif kid.tag not in _BLOCKS and not kid.holds_block:
            run.append((yield _spans(kid)))
        else:
            flush()
            out += yield _block(kid)
    flush()
    return out


def _block(node: Node) -> Generator:
    tag = node.tag
    if re.fullmatch(r"h[1-6]", tag):
        text = _tidy((yield _inline(node))).replace("\n", " ")
        return ["#" * int(tag[1]) + " " + text] if text else []
    if tag in ("ul", "ol"):
        lines = yield _list(node, 0)
        return ["\n".join(lines)] if lines else []
    if tag == "hr":
        return ["---"]
    if tag == "pre":
        body = "".join(k if isinstance(k, str) else "".join(t for n in k.walk() for t in n.kids if isinstance(t, str)) for k in node.kids)
        return ["```\n" + body.strip("\n") + "\n```"]
    if tag == "blockquote":
        inner = yield _blocks(node)
        return ["\n".join("> " + line for line in "\n\n".join(inner).split("\n"))] if inner else []
    if tag == "tr":
        cells = []
        for cell in node.kids:
            if isinstance(cell, Node) and cell.tag in ("td", "th"):
                cells.append(_tidy((yield _inline(cell))).replace("\n", " "))
        return ["| " + " | ".join(cells) + " |"] if cells else []
    return (yield _blocks(node))


def markdown_of(root: Node) -> str:
    return "\n\n".join(_run(_blocks(main_content(root))))


def to_markdown(html: str) -> str:
    return markdown_of(parse(html))


def title_text(root: Node) -> str:
    node = _first(root, lambda n: n.tag == "title")
    return "".join(k for k in node.kids if isinstance(k, str)).strip() if node is not None else ""


def with_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """Parse each page once; adds ``title`` and ``markdown`` and drops the raw page."""
    keep = [f for f in pages.schema.fields if f.name not in (html, "title", "markdown")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [f.name for f in keep]

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            titles, texts = [], []
            for page in batch[html].fillna(""):  # one tree at a time
                root = parse(page)
                titles.append(title_text(root))
                texts.append(markdown_of(root))
            yield batch[names].assign(title=titles, markdown=texts)

    return pages.select(*[F.col(n) for n in names], html).mapInPandas(
        convert, schema + ", title string, markdown string"
    )
