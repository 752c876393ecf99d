"""Closeness of two names.

Equal names score 1.  Otherwise the best of 0.8 when one contains the other,
0.7 x word Jaccard and 0.6 x difflib ratio.  The first three parts are native; the
ratio runs in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from difflib import SequenceMatcher
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from fieldloom.functions.text import strip

_WORD = re.compile(r"\w+")


def name_key(name: Column) -> Column:
    return strip(F.lower(name))


def native_similarity(text: Column, name: Column) -> Column:
    """Lower bound of the score from equality, containment and shared words."""
    a, b = name_key(text), name_key(name)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    shared, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    overlap = F.coalesce(shared / F.nullif(either, F.lit(0)), F.lit(0.0)) * 0.7
    contained = F.when(a.contains(b) | b.contains(a), 0.8).otherwise(0.0)
    score = F.when(a == b, 1.0).otherwise(F.greatest(contained, overlap))
    return F.when((a == "") | (b == ""), 0.0).otherwise(score)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(text, name)], dtype="float64")


def name_similarity(text: Column, name: Column) -> Column:
    a, b = name_key(text), name_key(name)
    rough = F.when((a == "") | (b == ""), 0.0).otherwise(sequence_ratio(a, b) * 0.6)
    return F.greatest(native_similarity(text, name), rough)


def matched_length(a: str, b: str) -> int:
    """Characters difflib matches between two texts: the longest common piece
    (leftmost in ``a``, then in ``b``), and the same left and right of it.

    Pieces are found by substring tests, which is several times faster than
    difflib on names.  Long texts go to difflib, which ignores popular letters there.
    """
    if len(b) >= 200:
        return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    total, todo = 0, [(a, b)]
    while todo:
        left, right = todo.pop()
        size, at = 0, 0
        for i in range(len(left)):
            while i + size < len(left) and left[i : i + size + 1] in right:
                size, at = size + 1, i
            if size >= len(left) - i:
                break
        if size:
            j = right.find(left[at : at + size])
            total += size
            if at and j:
                todo.append((left[:at], right[:j]))
            if at + size < len(left) and j + size < len(right):
                todo.append((left[at + size :], right[j + size :]))
    return total


#: Letters are counted in so many classes, by code point; names of a cell are bounded together.
CLASSES, CELL = 89, 64
#: Words are noted in so many bits of a summary.
WORD_BITS = 4096


def letter_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(points % CLASSES, minlength=CLASSES).astype(np.int32)


def counts_of(names: list[str]) -> np.ndarray:
    """``letter_counts`` of many names, one row each."""
    sizes = np.array([len(n) for n in names], np.int64)
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32) % CLASSES
    rows = np.repeat(np.arange(len(names)), sizes)
    return np.bincount(rows * CLASSES + points, minlength=len(names) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text))


def word_bits(words) -> np.ndarray:
    """Which bits of a summary the words set."""
    return np.array([zlib.crc32(w.encode()) % WORD_BITS for w in words], np.int64)


def ratio_caps(common: np.ndarray, shortest: np.ndarray, longest: np.ndarray, width: int) -> np.ndarray:
    """The greatest difflib ratio of a text of ``width`` letters with a name of those lengths and at most ``common`` letters in common."""
    best = np.clip(common, shortest, longest)
    return 2.0 * np.minimum(common, best) / (width + best)


class Summary:
    """What bounds the scores of groups of names: letters, lengths and, for blocks, words."""

    def __init__(self, counts: np.ndarray, shortest: np.ndarray, longest: np.ndarray, words: np.ndarray | None = None):
        self.counts, self.shortest, self.longest, self.words = counts, shortest, longest, words

    def caps(self, needle: str) -> np.ndarray:
        """No name of a group scores more; without ``words``, shared words are left out."""
        mine = letter_counts(needle)
        kinds = np.flatnonzero(mine)
        common = np.minimum(self.counts[:, kinds], mine[kinds]).sum(axis=1)
        caps = 0.6 * ratio_caps(common, self.shortest, self.longest, len(needle))
        # Containment needs all letters of the shorter text.
        caps[common >= np.minimum(self.shortest, len(needle))] = 1.0
        if self.words is not None:
            mine = word_set(needle)
            if mine:
                found = self.words[:, word_bits(mine)].sum(axis=1)
                caps = np.maximum(caps, 0.7 * found / len(mine))
        return caps


class Substrings:
    """Suffix automaton of a text, as tables over an alphabet of letter numbers.

    Reading names letter by letter gives, for all names at once, the longest piece of the
    text that ends at each letter.
    """

    def __init__(self, text: str, letters: dict[str, int]):
        size = len(letters) + 1
        codes = [letters.get(c, -1) for c in text]
        moves, link, length, first = [{}], [-1], [0], [-1]
        last = 0
        for end, c in enumerate(codes):
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(end)
            at, last = last, new
            if c < 0:  # no name has this letter
                at = -1
            while at >= 0 and c not in moves[at]:
                moves[at][c] = new
                at = link[at]
            if at < 0:
                continue
            other = moves[at][c]
            if length[other] != length[at] + 1:
                twin = len(moves)
                moves.append(dict(moves[other]))
                link.append(link[other])
                length.append(length[at] + 1)
                first.append(first[other])
                while at >= 0 and moves[at].get(c) == other:
                    moves[at][c] = twin
                    at = link[at]
                link[other] = twin
                other = twin
            link[new] = other
        self.first = np.array(first, np.int32)
        self.next = np.zeros((len(moves), size), np.int32)
        self.most = np.full((len(moves), size), -1, np.int32)
        for state in sorted(range(len(moves)), key=length.__getitem__):
            if state:
                self.next[state], self.most[state] = self.next[link[state]], self.most[link[state]]
            for c, to in moves[state].items():
                self.next[state, c], self.most[state, c] = to, length[state]

    def longest(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, place in the text, place in the name) of the longest common piece with each name: leftmost in the text, then in the name.

        Names are runs of ``codes``, in falling order of their lengths.
        """
        n = len(starts)
        size, of_text, of_name = (np.zeros(n, np.int32) for _ in range(3))
        state, run = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for j in range(int(lengths[0]) if n else 0):
            active = int(np.searchsorted(-lengths, -j, side="left"))  # names longer than j
            s, letter = state[:active], codes[starts[:active] + j]
            run = np.minimum(run[:active], self.most[s, letter]) + 1
            state = self.next[s, letter]
            begin = self.first[state] - run + 1
            better = (run > size[:active]) | ((run == size[:active]) & (run > 0) & (begin < of_text[:active]))
            at = np.flatnonzero(better)
            size[at], of_text[at], of_name[at] = run[at], begin[at], j + 1 - run[at]
        return size, of_text, of_name


class Prefixes:
    """The distinct beginnings of names, level by level: a letter is read once for all names that share it and what stands before."""

    def __init__(self, order: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """``order`` sorts the names; names are runs of ``codes``, none empty."""
        starts, lengths = starts[order], lengths[order]
        same = np.ones(len(order), bool)  # the row begins as the one before it
        same[:1] = False
        node = np.zeros(len(order), np.int64)
        self.names, self.levels, self.widest = len(order), [], 1
        for depth in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > depth)
            letters = codes[starts[rows] + depth]
            before = np.maximum(rows - 1, 0)
            same[rows] &= lengths[before] > depth
            shared = np.flatnonzero(same[rows])
            same[rows[shared]] = codes[starts[before[shared]] + depth] == letters[shared]
            fresh = ~same[rows]
            parents = node[rows][fresh]
            node[rows] = np.cumsum(fresh) - 1
            ended = rows[lengths[rows] == depth + 1]
            nodes = node[ended].astype(np.intp)
            every = np.array_equal(nodes, np.arange(len(parents)))  # no need to pick
            self.levels.append((letters[fresh].astype(np.intp), parents.astype(np.intp), order[ended], None if every else nodes))
            self.widest = max(self.widest, len(parents))

    def subsequences(self, texts: list[str], letters: dict[str, int], out: np.ndarray) -> None:
        """Write the length of the longest common subsequence of each text, of at most 64 letters, with each name into ``out`` (name, text), in bits of one number (Hyyrö)."""
        kind = np.uint32 if max(map(len, texts)) <= 32 else np.uint64
        masks = np.zeros((len(letters), len(texts)), kind)
        for t, text in enumerate(texts):
            places: dict[int, int] = {}
            for i, c in enumerate(text):
                if c in letters:
                    places[letters[c]] = places.get(letters[c], 0) | 1 << i
            for letter, bits in places.items():
                masks[letter, t] = bits
        cells = out.view(f"V{len(texts)}")[:, 0]  # a name is one value
        state, after, met = (np.empty((self.widest, len(texts)), kind) for _ in range(3))
        state[:1] = np.iinfo(kind).max
        for codes, parents, names, nodes in self.levels:
            size = len(codes)
            now = np.take(state, parents, axis=0, out=after[:size], mode="clip")
            hit = np.take(masks, codes, axis=0, out=met[:size], mode="clip")
            np.bitwise_and(hit, now, out=hit)
            added = np.add(now, hit, out=state[:size])
            np.subtract(now, hit, out=now)
            np.bitwise_or(now, added, out=now)
            state, after = after, state
            if len(names):
                # A bit is lost for each common letter.
                common = np.bitwise_count(now if nodes is None else np.take(now, nodes, axis=0, mode="clip"))
                np.subtract(8 * now.itemsize, common, out=common)
                cells[names] = common.view(cells.dtype)[:, 0]

    def subsequence(self, text: str, letters: dict[str, int]) -> np.ndarray:
        """``subsequences`` of one text."""
        out = np.zeros((self.names, 1), np.uint8)
        self.subsequences([text], letters, out)
        return out[:, 0].astype(np.int64)


#: Names whose beginnings are found together; lookups that read them together; lookups whose names are read together.
BEGINNINGS, ABREAST, TOGETHER = 20_000, 8, 64
#: Pairs that are read at once, and about as many as one round of lookups has at most.
PAIRS, ROUND = 4_096, 400_000


class _Lookup:
    """What a lookup has found, and which names it reads next.

    Names of one length with as many common letters are a cell; cells are read by falling bound.
    """

    def __init__(self, block: NameBlock, needle: str, matchable: np.ndarray, most: np.ndarray, k: int, floor: float):
        """``matchable``: length of the longest common subsequence with each name; ``most``: the greatest of each length of names."""
        self.block, self.needle, self.matchable, self.k, self.floor, self.bound = block, needle, matchable, k, floor, floor
        kind = np.repeat(np.arange(len(most)), most + 1)
        common = np.arange(len(kind)) - np.repeat(np.cumsum(most + 1) - most - 1, most + 1)
        sizes, width = block.sizes[kind], len(needle)
        # Containment needs all letters of the shorter text.
        caps = np.where(common >= np.minimum(sizes, width), 1.0, 0.6 * (2.0 * common / (sizes + width)))
        order = np.argsort(-caps, kind="stable")
        self.kind, self.common, self.caps = kind[order], common[order], caps[order]
        self.at, self.budget, self.fresh = 0, max(2 * k, 64), True
        self.entity, self.score = np.zeros(0, np.int64), np.zeros(0)

    def open(self) -> bool:
        return self.at < len(self.caps) and self.caps[self.at] >= self.bound

    def rows(self) -> np.ndarray:
        """The next names, of whole cells."""
        found, many = [np.zeros(0, np.int64)], 0
        while many < self.budget and self.open():
            start, stop = self.block.edges[self.kind[self.at]], self.block.edges[self.kind[self.at] + 1]
            some = np.flatnonzero(self.matchable[start:stop] == self.common[self.at])
            if len(some):
                found.append(some + start)
                many += len(some)
            self.at += 1
        self.budget = min(4 * self.budget, 8_192)
        return np.concatenate(found)

    def take(self, rows: np.ndarray, scores: np.ndarray) -> None:
        """Keep the k best entities so far; the k-th best score never falls."""
        self._keep(self.block.entity[rows], scores)
        if self.fresh:
            self._share()

    def _share(self) -> None:
        """Names with words of the lookup count once by these; few are left when others were read."""
        self.fresh = False
        rows, scores = self.block.overlaps(self.needle)
        self._keep(self.block.entity[rows], scores)

    def _keep(self, entity: np.ndarray, score: np.ndarray) -> None:
        near = score >= self.bound
        if not near.any():
            return
        entity, score = np.concatenate([self.entity, entity[near]]), np.concatenate([self.score, score[near]])
        order = np.lexsort((-score, entity))
        entity, score = entity[order], score[order]
        first = np.ones(len(entity), bool)
        first[1:] = entity[1:] != entity[:-1]
        entity, score = entity[first], score[first]
        if len(score) >= self.k:
            self.bound = max(self.bound, float(np.partition(score, len(score) - self.k)[len(score) - self.k]))
            near = score >= self.bound
            entity, score = entity[near], score[near]
        self.entity, self.score = entity, score

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            self._share()
        kept = np.flatnonzero(self.score >= max(self.floor, 0.0))
        kept = kept[np.lexsort((self.entity[kept], -self.score[kept]))][: self.k]
        return self.block.entities[self.entity[kept]], self.score[kept]


class NameBlock:
    """A bounded set of names prepared for exact best-k lookups.

    What difflib matches is a common subsequence, whose greatest length bounds a name's
    score.  Lookups of at most 64 letters find these lengths for all names, by their
    distinct beginnings and several lookups at a time, and read names by falling bound until
    none reaches the k-th best score; names of many lookups are read at once.  For a longer
    lookup, names in the order of their lengths and letters are bounded in cells of
    neighbours, and cells are visited so.
    """

    def __init__(self, entity_ids, names):
        names = list(names)
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        by_length = np.argsort(np.array([len(names[i]) for i in order]), kind="stable")
        self.sorted, order = np.argsort(by_length), order[by_length]
        self.ids, self.names = np.asarray(entity_ids)[order], [names[i] for i in order]
        self.entities, self.entity = np.unique(self.ids, return_inverse=True)
        self.lengths = np.array([len(n) for n in self.names], dtype=np.int64)
        text = "".join(self.names)
        self.letters = {c: i for i, c in enumerate(sorted(set(text)))}
        code = np.zeros(max(map(ord, self.letters), default=0) + 1, np.int32)
        code[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        self.codes = code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.sizes, first = np.unique(self.lengths, return_index=True)
        self.edges = [*first.tolist(), len(names)]
        words, self.posting = [], {}
        for row, name in enumerate(self.names):
            found = word_set(name)
            words.append(len(found))
            for word in found:
                self.posting.setdefault(word, []).append(row)
        self.words, self._rows = np.array(words, np.int64), {}

    @cached_property
    def counts(self) -> np.ndarray:
        return counts_of(self.names)

    @cached_property
    def neighbours(self) -> np.ndarray:
        """The names in order of their lengths and letters, for cells."""
        return np.array(sorted(range(len(self.names)), key=lambda i: (len(self.names[i]), "".join(sorted(set(self.names[i]))), i)), np.int64)

    @cached_property
    def cells(self) -> Summary:
        edges, counts, lengths = np.arange(0, len(self.names), CELL), self.counts[self.neighbours], self.lengths[self.neighbours]
        return Summary(np.maximum.reduceat(counts, edges), np.minimum.reduceat(lengths, edges), np.maximum.reduceat(lengths, edges))

    @cached_property
    def prefixes(self) -> list[Prefixes]:
        return [Prefixes(self.sorted[i : i + BEGINNINGS], self.codes, self.starts, self.lengths) for i in range(0, len(self.names), BEGINNINGS)]

    def summary(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(shortest, longest, letter counts, word bits) of the whole block."""
        bits = np.zeros(WORD_BITS, bool)
        bits[word_bits(self.posting)] = True
        return int(self.lengths.min()), int(self.lengths.max()), self.counts.max(axis=0), bits

    def overlaps(self, needle: str) -> tuple[np.ndarray, np.ndarray]:
        """(names, 0.7 x word overlap) of the names that share a word."""
        mine, some = word_set(needle), []
        for word in mine:
            if word in self.posting:
                if word not in self._rows:
                    self._rows[word] = np.array(self.posting[word], np.int64)
                some.append(self._rows[word])
        if not some:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(some) == 1:
            rows, shared = some[0], 1
        else:
            shared = np.bincount(np.concatenate(some), minlength=len(self.names))
            rows = np.flatnonzero(shared)
            shared = shared[rows]
        return rows, 0.7 * (shared / (len(mine) + self.words[rows] - shared))

    def best(self, needle: str, k: int, floor: float = -1.0) -> list[tuple[int, float]]:
        """The k entities of the block closest to ``needle``, ties by entity id; entities below ``floor`` may be left out."""
        ((_, entities, scores),) = self.best_of([needle], k, [floor])
        return list(zip(entities.tolist(), scores.tolist(), strict=True))

    def best_of(self, needles: list[str], k: int, floors: list[float]):
        """``best`` of many needles: yields (place of the needle, entities, scores), in any order."""
        short = []
        for place, needle in enumerate(needles):
            if not needle:
                entities = self.entities[:k]
                yield place, entities, np.zeros(len(entities))
            elif len(needle) > 64:
                yield place, *self._best_of_long(needle, k, floors[place])
            else:
                short.append(place)
        short.sort(key=lambda i: len(needles[i]))  # half as many bits serve up to 32 letters
        for at in range(0, len(short), TOGETHER):
            places = short[at : at + TOGETHER]
            found = self._best_of_short([needles[i] for i in places], k, [floors[i] for i in places])
            yield from ((place, *one.best()) for place, one in zip(places, found, strict=True))

    def _best_of_short(self, needles: list[str], k: int, floors: list[float]) -> list[_Lookup]:
        matchable = np.empty((len(needles), len(self.names)), np.uint8)
        for at in range(0, len(needles), ABREAST):
            some = needles[at : at + ABREAST]
            common = np.empty((len(self.names), len(some)), np.uint8)
            for prefixes in self.prefixes:
                prefixes.subsequences(some, self.letters, common)
            matchable[at : at + ABREAST] = common.T
        # Letters of a needle are numbered from 1; those of names that it lacks are 0.
        texts, known = np.full((len(needles), 64), 255, np.uint8), np.zeros((len(needles), len(self.letters)), np.uint8)
        for row, needle in enumerate(needles):
            numbers = {c: i for i, c in enumerate(dict.fromkeys(needle), 1)}
            texts[row, : len(needle)] = [numbers[c] for c in needle]
            for c, number in numbers.items():
                if c in self.letters:
                    known[row, self.letters[c]] = number
        most = np.stack([matchable[:, a:b].max(axis=1) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)], axis=1).astype(np.int64)
        found = [_Lookup(self, *one, k, floor) for *one, floor in zip(needles, matchable, most, floors, strict=True)]
        widths = np.array([len(n) for n in needles])
        while active := [i for i, one in enumerate(found) if one.open()]:
            rows, pairs = [], 0
            for i in active:
                if pairs > ROUND:
                    break
                rows.append(found[i].rows())
                pairs += len(rows[-1])
            active = active[: len(rows)]
            sizes = [len(r) for r in rows]
            text, row = np.repeat(active, sizes), np.concatenate(rows)

            def keep(scores: np.ndarray) -> np.ndarray:
                """Scores, or what is sure of them, raise the bounds of their lookups."""
                for i, some, score in zip(active, rows, np.split(scores, np.cumsum(sizes)[:-1]), strict=True):
                    found[i].take(some, score)
                return np.repeat([found[i].bound for i in active], sizes)

            keep(self._scores(needles, texts, known, widths[text], text, row, matchable[text, row].astype(np.int64), keep))
        return found

    def _scores(self, needles, texts, known, widths, text, row, common, keep) -> np.ndarray:
        """Containment and ratio of (text, row) pairs, ``common`` letters at most matched; below the bounds that ``keep`` gives for longest pieces, a score may be too low."""
        lengths = self.lengths[row]
        shorter, both = np.minimum(lengths, widths), lengths + widths
        # One common letter is matched; difflib drops letters of long names.
        total = np.where((common <= 1) & (lengths < 200), common, 0)
        inside = total == shorter
        for p in np.flatnonzero(lengths >= 200).tolist():
            needle, name = needles[text[p]], self.names[row[p]]
            total[p], inside[p] = matched_length(needle, name), needle in name
        pair = np.flatnonzero((common > 1) & (lengths < 200))
        a, a_size, b, b_size = np.zeros(len(pair), np.int64), widths[pair], self.starts[row[pair]], lengths[pair]
        scores = lambda: np.where(inside, np.where(lengths == widths, 1.0, 0.8), 0.6 * (2.0 * total / both))
        bounds = None
        while len(pair):
            size, x, y = self._pieces(texts, known, text[pair], a, a_size, b, b_size)
            np.add.at(total, pair, size)
            if bounds is None:
                inside[pair] = size == shorter[pair]
                bounds = keep(scores())
            # The same left and right of the longest piece, while the bound can be reached.
            pair = np.concatenate([pair, pair])
            a, a_size = np.concatenate([a, a + x + size]), np.concatenate([x, a_size - x - size])
            b, b_size = np.concatenate([b, b + y + size]), np.concatenate([y, b_size - y - size])
            going = np.concatenate([size, size]) > 0
            rest = np.where(going, np.minimum(a_size, b_size), 0)
            more = np.minimum(np.bincount(pair, rest, len(total)).astype(np.int64), common - total)
            hope = (more > 0) & ~inside & (0.6 * (2.0 * (total + more) / both) >= bounds)
            left = np.flatnonzero((rest > 0) & hope[pair])
            pair, a, a_size, b, b_size = pair[left], a[left], a_size[left], b[left], b_size[left]
        return scores()

    def _pieces(self, texts, known, text, a, a_size, b, b_size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, place in the text, place in the name) of the longest common piece of parts of texts and of names of less than 200 letters: leftmost in the text, then in the name."""
        size, x, y = (np.zeros(len(text), np.int64) for _ in range(3))
        order = np.lexsort((a_size, b_size))
        for at in range(0, len(order), PAIRS):
            p = order[at : at + PAIRS]
            i, j = np.arange(a_size[p].max())[:, None], np.arange(b_size[p].max())[:, None]
            mine = texts.ravel().take(text[p] * texts.shape[1] + a[p] + i, mode="clip")
            mine[i >= a_size[p]] = 255
            theirs = known.ravel().take(text[p] * known.shape[1] + self.codes.take(b[p] + j, mode="clip"))
            theirs[j >= b_size[p]] = 0
            # Pieces that end at each letter of the text: here, the longest so far, and where that ended first in the name.
            run, longest, ended, longer = np.zeros((len(i) + 1, len(p)), np.uint8), *(np.zeros(mine.shape, np.uint8) for _ in range(3))
            yes = np.empty(mine.shape, bool)
            mask = yes.view(np.uint8)
            for place, letter in enumerate(theirs):
                np.equal(mine, letter, out=yes)
                np.negative(mask, out=mask)
                np.add(run[:-1], 1, out=longer)
                np.bitwise_and(longer, mask, out=run[1:])
                np.greater(run[1:], longest, out=yes)
                np.negative(mask, out=mask)
                np.bitwise_and(mask, place, out=mask)
                np.maximum(ended, mask, out=ended)
                np.maximum(longest, run[1:], out=longest)
            end, each = longest.argmax(axis=0), np.arange(len(p))
            found = longest[end, each].astype(np.int64)
            size[p], x[p], y[p] = found, np.where(found, end + 1 - found, 0), np.where(found, ended[end, each] + 1 - found, 0)
        return size, x, y

    def _best_of_long(self, needle: str, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        width, mine, substrings = len(needle), letter_counts(needle), None
        native, kinds = np.zeros(len(self.names)), np.flatnonzero(mine)
        rows, overlap = self.overlaps(needle)
        native[rows] = overlap
        best = np.full(len(self.entities), -1.0)
        bound, at, step = floor, 0, 4
        caps = self.cells.caps(needle)
        np.maximum.at(caps, np.arange(len(native)) // CELL, native[self.neighbours])
        visits = np.argsort(-caps, kind="stable")

        def kth() -> float:
            top = best[best >= bound]  # the k-th best never falls
            return max(bound, float(np.partition(top, len(top) - k)[len(top) - k])) if len(top) >= k else bound

        while at < len(visits) and caps[visits[at]] >= bound:
            some = visits[at : at + step]
            some = some[caps[some] >= bound]
            at, step = at + step, step * 2
            rows = (some[:, None] * CELL + np.arange(CELL)).ravel()
            rows = self.neighbours[rows[rows < len(self.names)]]
            common = np.minimum(self.counts[rows[:, None], kinds], mine[kinds]).sum(axis=1)
            cap = np.maximum(native[rows], 0.6 * ratio_caps(common, self.lengths[rows], self.lengths[rows], width))
            keep = (cap >= bound) | (common >= np.minimum(self.lengths[rows], width))
            rows, common = rows[keep], common[keep]
            order = np.argsort(-self.lengths[rows], kind="stable")
            rows, common = rows[order], common[order]
            substrings = substrings or Substrings(needle, self.letters)
            size, a, b = substrings.longest(self.codes, self.starts[rows], self.lengths[rows])
            length = self.lengths[rows]
            # The pieces left and right of the longest one are no longer than the shorter side; difflib drops letters of long names.
            sides = np.where(size > 0, np.minimum(a, b) + np.minimum(width - a - size, length - b - size), 0)
            sides = np.where(length < 200, np.minimum(sides, common - size), common)
            matched = np.where(length < 200, size, 0)
            contained = (size == np.minimum(length, width)) & (size > 0)
            score = np.maximum(native[rows], np.where(contained, np.where(length == width, 1.0, 0.8), 0.0))
            score = np.maximum(score, 0.6 * (2.0 * matched / (length + width)))
            cap = np.maximum(score, 0.6 * (2.0 * (matched + sides) / (length + width)))
            entity = self.entity[rows]
            np.maximum.at(best, entity, score)
            bound = kth()
            # What is left depends on the pieces beside the longest one.
            rest = np.flatnonzero((cap > score) & (cap >= bound) & (cap > best[entity]))
            rest = rest[np.argsort(-cap[rest], kind="stable")]
            first, batch = 0, 32
            while first < len(rest) and cap[rest[first]] >= bound:
                part = rest[first : first + batch]
                part = part[cap[part] >= bound]
                first, batch = first + batch, 2 * batch
                totals = [
                    s + _sides(needle[:x], name[:y]) + _sides(needle[x + s :], name[y + s :]) if len(name) < 200 else matched_length(needle, name)
                    for name, s, x, y in zip([self.names[r] for r in rows[part].tolist()], size[part].tolist(), a[part].tolist(), b[part].tolist(), strict=True)
                ]
                np.maximum.at(best, entity[part], 0.6 * (2.0 * np.array(totals) / (width + length[part])))
                bound = kth()
        found = np.flatnonzero(best >= max(floor, 0.0))
        found = found[np.lexsort((self.entities[found], -best[found]))][:k]
        return self.entities[found], best[found]


@lru_cache(maxsize=100_000)
def _sides(left: str, right: str) -> int:
    """``matched_length`` of what stands beside a longest piece; such rests repeat between names."""
    return matched_length(left, right) if left and right else 0
