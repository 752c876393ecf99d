"""Personal data in texts: exact base rules, and candidates judged by boosted trees.

The base rules give e-mail and IP addresses, card and phone numbers of strict forms.
Beyond them, generators of high recall propose overlapping spans of looser forms; boosted
trees judge them by their form and context, and a calibrated threshold for each kind selects
those to add.  Added spans never touch a base span or each other.

There are no marked texts to learn from, so the trees learn from all texts by the base
rules: spans that pass, and loose spellings of them, are examples; spans that only look
alike, and damaged copies of those that pass, are counter-examples.  Equal examples are one
row with their number; trees, curve and thresholds come from sums over these rows, which stay
dealt over the tasks.  A quarter of the texts, by a hash, is kept from the trees and gives
the curve and the thresholds.

Defined cases: a null or empty text has no spans; repeated rows and rows without an id are
treated as any other; without examples nothing is added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm.boosting import Block, Trees, boost_blocks, cells_of, coded, fit_curve, joined, threshold_of
from fieldloom.llm.memory import returning
from fieldloom.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
#: Distinct examples a task counts before it passes them on; distinct examples of a task that sums.
TASK_EXAMPLES, PART_EXAMPLES = 50_000, 50_000
#: Steps of a trees' sum by which right and wrong spans are counted.
STEPS = 1024
#: Share of right spans that a kind's threshold must keep on rows that boosting did not see.
PRECISION = 0.98


class Span(NamedTuple):
    start: int
    end: int
    kind: str


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, so nothing is tried again inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPELLED = re.compile(r" [Dd][Oo][Tt] |[\[(][Dd][Oo][Tt][\])]")

# Looser forms.
_LOOSE_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]{1,64}(?: ?@ ?| ?[\[(](?:at|AT)[\])] ?| (?:at|AT) )[\w-]{1,63}(?:(?: ?\. ?| ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) )[\w-]{1,63}){1,4}", re.A
)
_LOOSE_NUMBER = re.compile(r"(?<![\w.])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,24}(?!\w)", re.A)
_CUE = re.compile(r"\b(?:tel|phone|mobile|fax|call|e-?mail|mail|contact|card|visa|iban|ip|host|addr|address|server)\b\W*$", re.I | re.A)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append(Span(start, free, "email"))
        at = text.find("@", max(at + 1, free))
    return found


def _octet(part: str) -> int:
    """Value of a part of an address, 256 if it has more than three digits: int() refuses thousands of zeros."""
    digits = part.lstrip("0") or "0"
    return int(digits) if len(digits) <= 3 else 256


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by start, then kind."""
    if not _ANY.search(text):
        return []
    found = _emails(text)
    found += [Span(*m.span(), "ip") for m in _IP.finditer(text) if all(_octet(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span(*m.span(), "card"))
    found += [Span(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data; a run of digits is proposed for each kind that it may be."""
    if not _ANY.search(text) and not _SPELLED.search(text):
        return []
    found = [Span(*m.span(), "email") for m in _LOOSE_EMAIL.finditer(text)]
    for m in _LOOSE_NUMBER.finditer(text):
        n = len(_digits(m[0]))
        kinds = [k for k, ok in (("ip", m[0].count(".") >= 3 and n <= 12), ("card", 12 <= n <= 19), ("phone", 7 <= n <= 15)) if ok]
        found += [Span(*m.span(), k) for k in kinds]
    return found


def features(text: str, before: str, after: str, kind: str) -> list[float]:
    """Form of a span's text and its context."""
    digits = _digits(text)
    letters = sum(c.isalpha() for c in text)
    groups = re.findall(r"[0-9]+", text)
    sizes = [len(g) for g in groups] or [0]
    labels = re.split(r"\.| dot |\[dot\]|\(dot\)", re.split(r"@| at |\[at\]|\(at\)", text.lower())[-1])
    return [
        KINDS.index(kind), len(text), len(digits), letters, len(text) - len(digits) - letters, len(digits) / max(len(text), 1),
        text.startswith("+"), "(" in text, len(digits) >= 12 and luhn(digits), len(groups), max(sizes), min(sizes), sizes[-1] == 4,
        text.count("."), text.count("-"), text.count(" "), "@" in text, bool(re.search(r"\bat\b", text.lower())), len(labels), len(labels[-1].strip()),
        labels[-1].strip().isalpha(), sum(int(g) > 255 if len(g) < 9 else 1 for g in groups), len(set(digits)), digits[:1] in ("3", "4", "5", "6"),
        before[-1:].isalnum(), after[:1].isalnum(), bool(_CUE.search(before)), before[-1:] == "\n" or not before, "=" in before[-4:],
    ]


def coarse(x: np.ndarray) -> np.ndarray:
    """To seven binary digits, so that a feature has few values however long spans are; integers to 128 stay."""
    m, e = np.frexp(x)
    return np.ldexp(np.floor(m * 128) / 128, e)


def _around(text: str, span: Span) -> tuple[str, str, str]:
    return text[span.start : span.end], text[max(0, span.start - 24) : span.start], text[span.end : span.end + 8]


def _variants(text: str, kind: str) -> list[tuple[str, int]]:
    """(loose or damaged spelling, 1 if it is still personal data) of a base span's text."""
    digits = _digits(text)
    if kind == "email":
        user, _, host = text.partition("@")
        return [
            (f"{user} at {host.replace('.', ' dot ')}", 1), (f"{user} [at] {host.replace('.', ' [dot] ')}", 1), (f"{user} @ {host}", 1),
            (f"{user}@{host.split('.')[0]}.{digits or '1'}", 0), (f"{user} at {host.split('.')[0]}. {user}", 0),
        ]
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        grouped = " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        return [(grouped.replace(" ", "."), 1), (grouped.replace(" ", "/"), 1), (wrong, 0), (grouped.replace(" ", ".")[:-1] + wrong[-1], 0)]
    if kind == "phone":
        local = digits[-10:]
        shapes = (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}")
        return [*((s, 1) for s in shapes if len(local) == 10), (local, 0), (digits[:7], 0), (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", 0)]
    parts = text.split(".")
    return [(".".join([*parts[:3], str(_octet(parts[3]) + 256)]), 0), (".".join([*parts, "1"]), 0)]


def _examples(text: str) -> Iterator[tuple[int, list[float]]]:
    """(1 if personal data, features) of spans in a text and of variants of them."""
    base = base_spans(text)
    taken = {(s.start, s.end) for s in base}
    for span in base:
        own, before, after = _around(text, span)
        yield 1, features(own, before, after, span.kind)
        for v, y in _variants(own, span.kind):
            yield y, features(v, before, after, span.kind)
    for span in candidates(text):
        if (span.start, span.end) not in taken and not any(s.start < span.end and span.start < s.end for s in base):
            yield 0, features(*_around(text, span), span.kind)


@dataclass
class Judge:
    trees: Trees | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans) of a text, by start, then kind."""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        loose = [s for s in candidates(text) if not any(b.start < s.end and s.start < b.end for b in base)]
        if not loose:
            return base, base
        chance = self.trees.probability(coarse(np.array([features(*_around(text, s), s.kind) for s in loose], float)))
        added: list[Span] = []
        for i in np.lexsort((np.arange(len(loose)), -chance)):
            span = loose[i]
            if chance[i] >= self.thresholds.get(span.kind, 1.1) and not any(a.start < span.end and span.start < a.end for a in added):
                added.append(span)
        return base, sorted([*base, *added], key=lambda s: (s.start, KINDS.index(s.kind)))


def _distinct_examples(docs: DataFrame) -> DataFrame:
    """(x, n0, n1, n2, n3) of the examples of all texts: coarse features, and how often they are
    counter-examples and examples of texts for the trees, then of the texts kept from them."""

    def counted(found: dict[bytes, list[int]]) -> pa.RecordBatch:
        times = np.array(list(found.values()), np.int64).reshape(-1, 4)
        return pa.record_batch({"x": pa.array(list(found), pa.binary()), **{f"n{i}": pa.array(times[:, i]) for i in range(4)}})

    def examples(batches):
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held").to_pylist(), strict=True):
                for y, x in _examples(text.as_py()):
                    found.setdefault(coarse(np.array(x, float)).astype("<f4").tobytes(), [0] * 4)[2 * held + y] += 1
                    if len(found) >= TASK_EXAMPLES:
                        yield counted(found)
                        found.clear()
        yield counted(found)

    marked = docs.where(F.col("text").rlike(f"{_ANY.pattern}|{_SPELLED.pattern}"))  # no other text has spans
    marked = marked.select("text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 3).alias("held"))
    found = marked.mapInArrow(returning(examples), "x binary, n0 long, n1 long, n2 long, n3 long")
    return found.groupBy("x").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)))


def _step_counts(block: Block, trees: Trees) -> list[np.ndarray]:
    """[(kind, step of the trees' sum), (counter-examples, examples)] of a block's rows."""
    x, times = block
    steps = np.floor(np.clip(trees.raw(x), -30, 30) * STEPS)
    return _united([np.stack([x[:, 0], steps], axis=1).astype(np.int64), times])


def _united(*parts: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of equal keys added."""
    keys, times = (np.concatenate([p[i] for p in parts]) for i in range(2))
    keys, at = np.unique(keys, axis=0, return_inverse=True)
    out = np.zeros((len(keys), 2), np.int64)
    np.add.at(out, at.ravel(), times)
    return [keys, out]


def learn(docs: DataFrame) -> Judge:
    """Train on the spans of all of ``docs`` (text); tasks keep the examples, only sums of bounded size leave them."""
    table = stored(_distinct_examples(docs), "pii-examples")
    n, *times = table.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(4))).first()
    if not times[0] or not times[1]:
        return Judge()

    def blocks(batches):
        for batch in batches:
            if batch.num_rows:
                counts = np.stack([batch.column(f"n{i}").to_numpy() for i in range(4)], axis=1)
                yield pa.record_batch({"x": pa.array([b"".join(batch.column("x").to_pylist())], pa.binary()), "times": pa.array([counts.tobytes()], pa.binary())})

    def opened(row) -> Block:
        counts = np.frombuffer(row["times"], np.int64).reshape(-1, 4)
        return np.frombuffer(row["x"], "<f4").reshape(len(counts), -1), counts

    rows = table.coalesce(-(-n // PART_EXAMPLES)).mapInArrow(blocks, "x binary, times binary").rdd.map(opened)
    cells = rows.map(lambda block: cells_of(block[0])).treeReduce(joined)
    learned = rows.map(lambda block: (coded(block[0], cells), block[1][:, :2])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = boost_blocks(cells, lambda of: learned.map(of).treeReduce(np.add))
    finally:
        learned.unpersist()
    kept = times[2] + times[3] > 0
    (kind, steps), counts = (v.T for v in rows.map(lambda block: _step_counts((block[0], block[1][:, 2 * kept :][:, :2]), trees)).treeReduce(_united))
    kind, raw, y, counts = np.tile(kind, 2), np.tile(steps / STEPS, 2), np.repeat([0, 1], len(kind)), counts.ravel()
    if kept:
        trees = fit_curve(trees, raw, y, counts)
    chance = trees.curve(raw)
    own = [(kind == i) & (counts > 0) for i in range(len(KINDS))]
    return Judge(trees, {name: threshold_of(chance[o], y[o], PRECISION, times=counts[o]) for name, o in zip(KINDS, own, strict=True)})


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_personal_data(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(judge or learn(docs))

    def find(batches):
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for text in batch.column("text"):
                base, every = shared.value.spans(text.as_py() or "")
                for k in KINDS:
                    counts[k].append(sum(s.kind == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), **{f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS},
                "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()),
            })

    return docs.mapInArrow(
        returning(find), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    )


def redact(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null stays null, other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(judge or learn(docs.select(F.col("text").cast("string").alias("text"))))

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for span in shared.value.spans(text)[1]:
            if span.end > end:
                out.append(text[end : max(span.start, end)])
                out.append(f"[{span.kind.upper()}]" if span.start >= end else "")
                end = span.end
        return "".join([*out, text[end:]]) if end else text

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], pa.string())
            yield batch.set_column(at, "text", texts)

    return docs.mapInArrow(returning(work), docs.schema)
