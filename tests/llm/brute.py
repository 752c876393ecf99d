"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def near_duplicates(rows):
    """doc_id -> (n_shingles, component_id, kept); ids are unique and not null."""
    sets, holders = {}, defaultdict(list)
    for doc, text in rows:
        words = WORD.findall((text or "").translate(LOW))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for s in sets[doc]:
            holders[s].append(doc)
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    common = defaultdict(int)
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def repeated_words(rows, window=50):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first, words = {}, {}
    for doc, text in rows:
        words[doc] = WORD.findall(text or "")
        for i in range(len(words[doc]) - window + 1):
            key = tuple(words[doc][i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = {}
    for doc, own in words.items():
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[doc] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contaminated(docs, benchmark):
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in benchmark:
        words = ALNUM.findall((text or "").translate(LOW))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(LOW))
        hit, items = [False] * len(words), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    items |= found
                    hit[i : i + n] = [True] * n
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(words), sum(hit), len(items), digest, any(hit)))
    return out


def best_vectors(rows, k=20):
    """Rows (query_id, rank, vec_id, score) for ids divisible by 20."""
    whole = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in rows}
    out = []
    for q, v in whole.items():
        if q % 20 == 0:
            scores = sorted((-int(v @ c), i) for i, c in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


_RULES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m, d: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m, d: 12 <= len(d) <= 19 and sum(
        n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(reversed(d))) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m, d: 9 <= len(d) <= 15),
)


def personal_data(text):
    """Base spans as kind:start:end, comma-joined."""
    found = []
    for order, (kind, rule, good) in enumerate(_RULES):
        for m in rule.finditer(text or ""):
            if good(m[0], [int(c) for c in m[0] if c in "0123456789"]):
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def token_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def token_rows(tokenizer, rows):
    """(doc_id, start, n_tokens, ids_crc32) in ascending order of ids."""
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = token_ids(tokenizer, text)
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def check_pieces(pieces, ids_of, window=2048):
    """Assert that pieces partition every document's ids and fill sequences without gaps or padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = ids_of[p.doc_id]
        assert p.length > 0 and p.doc_tokens == len(ids)
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for runs, whole in [(by_doc[d], len(ids)) for d, ids in ids_of.items()] + [(r, None) for r in by_sequence.values()]:
        at = 0
        for start, length in sorted(runs):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= window and at & (at - 1) == 0
