"""Profile Markdown to HTML.

Subset: ATX headings with ids, paragraphs, ``*``/``-``/``1.`` lists, fenced code, pipe
tables, ``**``/``*`` emphasis, back-ticks and links.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

EMPTY = "<p>Kein Inhalt verfügbar</p>"


def _inline(text: str) -> str:
    codes: list[str] = []

    def keep(match):
        codes.append(f"<code>{match[1]}</code>")
        return f"\x00{len(codes) - 1}\x00"

    text = re.sub(r"`([^`]+)`", keep, html.escape(text, quote=False))
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"\*(\S(?:.*?\S)?)\*", r"<em>\1</em>", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: codes[int(m[1])], text)


def _slug(text: str, used: dict[str, int]) -> str:
    slug = re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", text).strip().lower())
    used[slug] = used.get(slug, 0) + 1
    return slug if used[slug] == 1 else f"{slug}-{used[slug]}"


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def to_html(markdown: str | None) -> str:
    if not markdown or not markdown.strip():
        return EMPTY
    out, used = [], {}
    lines = markdown.replace("\r\n", "\n").split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        heading = re.match(r"^(#{1,6})\s*(.*?)\s*#*$", line)
        bullet = re.match(r"^\s*([*+-]|\d+\.)\s+", line)
        if not line.strip():
            at += 1
        elif line.startswith("```"):
            end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("```")), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[at + 1 : end]), quote=False) + "\n</code></pre>")
            at = end + 1
        elif heading and heading[2]:
            level = len(heading[1])
            out.append(f'<h{level} id="{_slug(heading[2], used)}">{_inline(heading[2])}</h{level}>')
            at += 1
        elif bullet:
            tag = "ol" if bullet[1][0].isdigit() else "ul"
            items = []
            while at < len(lines) and (found := re.match(r"^\s*([*+-]|\d+\.)\s+(.*)$", lines[at])):
                items.append(f"<li>{_inline(found[2])}</li>")
                at += 1
            out.append(f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>")
        elif line.lstrip().startswith("|") and at + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]+\|?\s*$", lines[at + 1]) and "-" in lines[at + 1]:
            head = "".join(f"<th>{_inline(c)}</th>" for c in _cells(line))
            at += 2
            body = []
            while at < len(lines) and lines[at].lstrip().startswith("|"):
                body.append("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in _cells(lines[at])) + "</tr>")
                at += 1
            out.append(f"<table>\n<thead><tr>{head}</tr></thead>\n<tbody>\n" + "\n".join(body) + "\n</tbody>\n</table>")
        else:
            block = []
            while at < len(lines) and lines[at].strip() and not lines[at].startswith(("#", "```")) and not re.match(r"^\s*([*+-]|\d+\.)\s+", lines[at]):
                block.append(lines[at].strip())
                at += 1
            if not block:
                block, at = [line.strip()], at + 1
            out.append(f"<p>{_inline(chr(10).join(block))}</p>")
    return "\n\n".join(out) + "\n"


@F.pandas_udf(T.StringType())
def markdown_to_html(markdown: pd.Series) -> pd.Series:
    return pd.Series([to_html(m) for m in markdown], dtype=object)
