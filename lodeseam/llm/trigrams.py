"""Trigram queries for regular expressions, and a trigram index over blocks of texts.

A query is the trigrams a text must hold for the expression to match: a conjunction of alternatives, each a conjunction
of trigrams, derived from the parsed expression (literal runs give their trigrams, branches alternatives; what may be
absent or isn't literal gives nothing). Case is folded on both sides, so a query never loses a match.

The index covers every text of a block (an Arrow batch): a posting bitmap for each trigram that some query needs, found
by a table lookup at every byte of the block at once. Queries intersect and unite bitmaps; what remains are candidates.
"""

from __future__ import annotations

from re import _constants as rc
from re import _parser as rp

import numpy as np

#: A conjunction of alternatives; an alternative is a set of trigrams that must all occur.
Query = list[list[frozenset[bytes]]]
MAX_ALTERNATIVES = 64


def _trigrams(text: bytes) -> frozenset[bytes]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _literals(items) -> list[list[bytes]]:
    """For a sequence: sets of strings of which one must occur, for every stretch that is a product of small choices."""
    found: list[list[bytes]] = []
    run = [b""]

    def close() -> None:
        nonlocal run
        if all(len(x) >= 3 for x in run):
            found.append(run)
        run = [b""]

    def extend(choices: list[bytes]) -> None:
        nonlocal run
        if len(run) * len(choices) > MAX_ALTERNATIVES:
            close()
        run = [a + b for a in run for b in choices]

    for op, arg in items:
        if op is rc.LITERAL:
            extend([chr(arg).lower().encode()])
        elif op is rc.IN and (chars := _choices(arg)):
            extend(chars)
        elif op is rc.SUBPATTERN:
            if (whole := _whole(arg[3])) and len(whole) <= MAX_ALTERNATIVES:
                extend(whole)
            else:
                close()
                found += _literals(arg[3])
        elif op is rc.BRANCH:
            if (whole := _whole([(op, arg)])) and len(whole) <= MAX_ALTERNATIVES:
                extend(whole)
            else:
                close()
                found += _branch(arg[1])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, body = arg
            whole = _whole(body)
            if whole and low == high and low <= 4 and len(whole) ** low <= MAX_ALTERNATIVES:
                for _ in range(low):
                    extend(whole)
            elif whole and (low, high) == (0, 1) and len(whole) < 8:
                extend([b"", *whole])
            else:
                close()
                if low:
                    found += _literals(body)
        elif op is rc.ASSERT:
            found += _literals(arg[1])  # what an assertion sees stands in the text as well
        elif op in (rc.AT, rc.ASSERT_NOT):
            continue
        else:
            close()
    close()
    return found


def _choices(members) -> list[bytes] | None:
    out: set[bytes] = set()
    for op, arg in members:
        if op is rc.LITERAL:
            out.add(chr(arg).lower().encode())
        elif op is rc.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower().encode() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return sorted(out) if len(out) <= 8 else None


def _whole(items) -> list[bytes] | None:
    """All strings the sequence can match, if they are few."""
    out = [b""]
    for op, arg in items:
        if op is rc.LITERAL:
            nxt: list[bytes] | None = [chr(arg).lower().encode()]
        elif op is rc.IN:
            nxt = _choices(arg)
        elif op is rc.SUBPATTERN:
            nxt = _whole(arg[3])
        elif op is rc.BRANCH:
            parts = [_whole(x) for x in arg[1]]
            nxt = None if None in parts else [s for p in parts for s in p]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and tuple(arg[:2]) == (0, 1):
            nxt = _whole(arg[2])
            nxt = None if nxt is None else ["".encode(), *nxt]
        elif op is rc.AT:
            continue
        else:
            return None
        if nxt is None or len(out) * len(nxt) > MAX_ALTERNATIVES:
            return None
        out = [a + b for a in out for b in nxt]
    return out


def _branch(branches) -> list[list[bytes]]:
    """One set of strings such that every branch needs one of its own, if every branch needs any."""
    union: list[bytes] = []
    for items in branches:
        own = _literals(items)
        if not own:
            return []
        union += min(own, key=lambda x: (len(x), -min(map(len, x))))
    return [union]


def required(pattern: str) -> Query:
    """The trigram query of a regular expression."""
    return [[_trigrams(s) for s in choices] for choices in _literals(rp.parse(pattern))]


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32


class TrigramIndex:
    """Posting bitmaps, over the texts of one block, of the trigrams that the queries need."""

    def __init__(self, queries: dict[str, Query]) -> None:
        self.queries = queries
        grams = sorted({g for q in queries.values() for alternatives in q for a in alternatives for g in a})
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.full(1 << 24, -1, np.int16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """bool[trigram, text]."""
        out = np.zeros((len(self.number), len(texts)), bool)
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = _FOLD[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
        if len(raw) < 3:
            return out
        number = self.table[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
        at = np.flatnonzero(number >= 0)
        out[number[at], np.searchsorted(ends, at, side="right")] = True
        return out

    def candidates(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """For each query the numbers of the texts that may match."""
        bitmap = self.postings(texts)
        found = {}
        for name, query in self.queries.items():
            keep = np.ones(len(texts), bool)
            for alternatives in query:
                some = np.zeros(len(texts), bool)
                for grams in alternatives:
                    some |= bitmap[[self.number[g] for g in grams]].all(axis=0)
                keep &= some
            found[name] = np.flatnonzero(keep)
        return found
