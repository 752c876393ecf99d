"""Main text of pages by consensus on where each host puts it.

Every page scores its containers by the text they hold; the paths of its best containers,
made of tags and generalised classes, are votes.  Votes are summed per host and path, and
each host's winning path is raised to the highest container around it that holds nearly the
same text on nearly all pages that vote for it, so a title or lead outside an inner container
stays.  A path is carried as a hash.  That path is used to extract the text of all the host's pages.  A page whose own best
container is around its host's path takes its own; one whose own best container is elsewhere,
named as main text and more than ``FAR_MORE`` times as long, takes both.  A page that has
nothing at its host's path falls back on its own best container, then on all of its text
outside menus, headers and the like, at last without regard to classes.

Votes are a few rows per page and are summed before they are shuffled, so a host with a third
of all pages is no burden.  Winning paths are one row per host: up to ``BROADCAST_HOSTS``
they are sent to all tasks, beyond that they are joined to the pages by host.

Defined cases: a null or empty page gives an empty text; a page with a null or odd address
belongs to the host ``''``; repeated rows vote and are extracted each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.llm.html_pages import Container, Page, around, containers, extract, raised

#: Paths that a page votes for, and hosts whose paths are sent to all tasks.
VOTES, BROADCAST_HOSTS = 3, 100_000
#: Share of the voting pages that must agree to raise a path, and when a page's own container counts besides its host's.
AGREE, FAR_MORE = 0.9, 2


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _best(found: dict[str, Container], n: int) -> list[tuple[str, float]]:
    scores = sorted(((c.score, c.level, path) for path, c in found.items() if c.score > 0), key=lambda s: (-s[0], s[1], s[2]))[:n]
    return [(path, score / scores[0][0]) for score, _, path in scores]


def _paths(found: dict[str, Container], path: str | None) -> tuple[str, ...]:
    """Where a page's text is, if its host's is at ``path``."""
    own = next((p for p, _ in _best(found, 1)), None)
    if own is None:
        return (path,) if path else ()
    if path not in found or own in around(path, found):
        return (raised(own, found),)
    elsewhere = own != path and path not in around(own, found)
    if elsewhere and found[own].weight > 1 and found[own].size > FAR_MORE * found[path].size:
        return path, raised(own, found)
    return (path,)


def vote_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host's pages (host, html), raised."""

    def votes(batches):
        for batch in batches:
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                found = containers(page.as_py() or "")
                rows += [(host, path, top := raised(path, found), found[top].level, share) for path, share in _best(found, VOTES)]
            yield pa.record_batch({
                "host": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()),
                "raised": pa.array([r[2] for r in rows], pa.string()), "level": pa.array([r[3] for r in rows], pa.int32()),
                "share": pa.array([r[4] for r in rows], pa.float64()),
            })

    # Shares are summed as whole numbers, so the order of the rows can't change a winner.
    found = pages.select("host", "html").mapInArrow(votes, "host string, path string, raised string, level int, share double")
    sums = found.groupBy("host", "path", "raised", "level").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("long")).alias("votes"), F.count(F.lit(1)).alias("n"))
    # A page that raises a path to a container agrees to all between them; at most a row per level of the path.
    same = Window.partitionBy("host", "path")
    agreed = sums.select(
        "host", "path", "raised", "level", F.sum("votes").over(same).alias("votes"),
        (F.sum("n").over(same.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) >= AGREE * F.sum("n").over(same)).alias("agreed"),
    )
    return agreed.where("agreed").groupBy("host").agg(F.max_by("raised", F.struct("votes", "path", -F.col("level"))).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        host_of(F.col("url").cast("string")).alias("host"),
    )
    hosts = pages.select("host").distinct().limit(BROADCAST_HOSTS + 1).count()
    winners = vote_paths(pages)
    aimed = pages.join(F.broadcast(winners) if hosts <= BROADCAST_HOSTS else winners, "host", "left").drop("host")

    def texts(batches):
        for batch in batches:
            found = []
            for page, path in zip(batch.column("html"), batch.column("path"), strict=True):
                page, path = Page(page.as_py() or ""), path.as_py()
                paths = _paths(containers(page), path)
                text = extract(page, paths) if paths else ""
                found.append(text or extract(page, None) or extract(page, None, by_class=False))
            yield pa.record_batch({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()),
                "n_chars": pa.array([len(t) for t in found], pa.int64()),
            })

    return aimed.select("page_id", "url", "html", "path").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
