"""A word lexicon as a minimal acyclic transducer, and the vectorised splitting of text into words.

Words (the pieces the tokenizer's split pattern yields, as UTF-8 bytes) are compiled in sorted order into the smallest
acyclic automaton, states with equal right languages being shared. Every edge carries the number of words it skips, so
that the sum along a word's path is the word's rank; the ranks index a flat table of id sequences. The edges lie in one
open-addressing table, so a whole batch of words is walked at once, a byte a step, on memory-mapped arrays.
"""

from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER, BREAK = range(5)
SENTINEL = 0x110000


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merges of one word: the pair of least rank first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def merger(path: str):
    """word -> ids by exact merges; tiktoken's compiled merge loop where installed, else the loop above."""
    ranks = read_ranks(path)
    try:
        import tiktoken

        single = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda word: [ranks[word]] if word in ranks else single(word)
    except ImportError:
        return lambda word: merge_word(word, ranks)


# -- splitting ---------------------------------------------------------------------------------------------------------


#: Letters and numbers of Unicode 16.0 that the interpreter's 15.1 tables lack; the public tokenizer
#: libraries class them by 16.0.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
#: The code points of the White_Space property.
BLANKS = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point as the split pattern sees it."""
    table = np.full(SENTINEL + 1, OTHER, np.uint8)
    kinds = "".join([unicodedata.category(chr(c))[0] for c in range(SENTINEL)]).encode()
    kinds = np.frombuffer(kinds, np.uint8)
    table[:SENTINEL][kinds == ord("L")] = LETTER
    table[:SENTINEL][kinds == ord("N")] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER), (BLANKS, SPACE)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[SENTINEL] = BREAK
    return table


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start and length in bytes of every word, number of words of each text)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.empty(int(lens.sum()) + len(texts) + 1, np.uint32)
    ends = np.cumsum(lens + 1)
    cps[0] = SENTINEL
    cps[1:] = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    cps[ends] = SENTINEL
    kind = char_classes()[cps]
    edge = np.empty(len(cps), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    runs = np.flatnonzero(edge)
    run_kind = kind[runs]
    run_end = np.append(runs[1:], len(cps))
    # white space before something else of the same text: its last character stands alone, or goes with what follows
    blank = np.flatnonzero(run_kind == SPACE)
    followed = run_kind[np.minimum(blank + 1, len(runs) - 1)] != BREAK
    blank = blank[followed]
    last = run_end[blank] - 1
    edge[last] = True
    joined = blank[cps[last] == 0x20]
    edge[run_end[joined]] = False
    # contractions: an apostrophe that begins a word, and the letters after it
    apo = np.flatnonzero((run_kind == OTHER) & (run_end - runs == 1) & (cps[runs] == 0x27) & edge[runs])
    apo = apo[run_kind[np.minimum(apo + 1, len(runs) - 1)] == LETTER]
    if len(apo):
        at = runs[apo]
        a, b = cps[at + 1], cps[np.minimum(at + 2, len(cps) - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        hit = one | two
        at, size = at[hit], np.where(one[hit], 2, 3)
        edge[at + 1] = False
        edge[at + size] = True
    edge[kind == BREAK] = True
    starts = np.flatnonzero(edge)
    width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4))).astype(np.int64)
    width[kind == BREAK] = 0
    offset = np.concatenate([[0], np.cumsum(width)])
    keep = kind[starts] != BREAK
    begin = offset[starts]
    size = np.append(begin[1:], offset[-1]) - begin
    text_of = np.searchsorted(ends, starts[keep], side="left")
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    return buf, begin[keep], size[keep], np.bincount(text_of, minlength=len(texts))


def hash_words(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for every word, by one pass over word positions for all words at a time."""
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active = np.arange(len(begin))
    step = 0
    mul = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        while len(active):
            active = active[size[active] > step]
            out[active] = (out[active] ^ buf[begin[active] + step]) * mul
            step += 1
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


# -- the automaton -----------------------------------------------------------------------------------------------------


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of sorted distinct non-empty words, built incrementally: a state is final in form as soon
    as the next word leaves it, and is then replaced by an equal state already registered."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) along the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (final[child], *edges[child].items())
            known = register.setdefault(key, child)
            if known != child:
                edges[parent][byte] = known

    previous = b""
    for word in words:
        common = 0
        for x, y in zip(previous, word):
            if x != y:
                break
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            child = len(edges) - 1
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        previous = word
    settle(0)
    # states renumbered in the order met; words below each state; each edge's skip = words before it
    count: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            count[state] = final[state] + sum(count[c] for c in edges[state].values())
            order.append(state)
        elif state not in count:
            count[state] = -1
            stack.append((state, True))
            stack.extend((c, False) for c in edges[state].values() if c not in count)
    number = {s: i for i, s in enumerate(reversed(order))}
    keys, targets, skips = [], [], []
    for state in order:
        skip = int(final[state])
        for byte, child in sorted(edges[state].items()):
            keys.append(number[state] << 8 | byte)
            targets.append(number[child])
            skips.append(skip)
            skip += count[child]
    finals = np.zeros(max(1, len(order)), bool)
    for s, i in number.items():
        finals[i] = final[s]
    size = 1 << max(4, (2 * len(keys)).bit_length())
    table = np.full(size, -1, np.int64)
    value = np.zeros((size, 2), np.int32)
    key = np.array(keys, np.int64)
    val = np.array([targets, skips], np.int32).T.reshape(-1, 2)
    slot = _slot(key, size)
    todo = np.arange(len(key))
    while len(todo):
        free = todo[table[slot[todo]] == -1]
        table[slot[free]] = key[free]  # of those meeting in a slot one stays
        won = free[table[slot[free]] == key[free]]
        value[slot[won]] = val[won]
        todo = np.setdiff1d(todo, won, assume_unique=True)
        slot[todo] = (slot[todo] + 1) & (size - 1)
    return {"table": table, "value": value, "final": finals}


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def pack_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """One file of all arrays, words in any order: the size of the header, the header (JSON: name to type, length and
    offset), then the arrays, each at a multiple of 64."""
    order = sorted(range(len(words)), key=words.__getitem__)
    arrays = compile_words([words[i] for i in order])
    arrays["value"] = arrays["value"].reshape(-1)
    arrays["ids"] = np.array([t for i in order for t in ids[i]], np.int32)
    arrays["id_at"] = np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])]).astype(np.int64)
    header, at = {}, 4096
    for name, array in arrays.items():
        header[name] = [array.dtype.str, len(array), at]
        at += -(-array.nbytes // 64) * 64
    head = json.dumps(header).encode()
    out = bytearray(at)
    out[:8] = len(head).to_bytes(8, "little")
    out[8 : 8 + len(head)] = head
    for name, array in arrays.items():
        out[header[name][2] : header[name][2] + array.nbytes] = array.tobytes()
    return bytes(out)


class Lexicon:
    """The memory-mapped automaton; one per worker process and file."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        header = json.loads(raw[8 : 8 + int.from_bytes(raw[:8].tobytes(), "little")].tobytes())
        array = {name: raw[at : at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, n, at) in header.items()}
        self.table, self.final, self.ids, self.id_at = (array[n] for n in ("table", "final", "ids", "id_at"))
        self.value = array["value"].reshape(-1, 2)

    def ranks(self, buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The rank of every word, -1 for words that aren't in the lexicon."""
        rank = np.full(len(begin), -1, np.int64)
        active = np.arange(len(begin))
        state = np.zeros(len(begin), np.int64)
        acc = np.zeros(len(begin), np.int64)
        mask = len(self.table) - 1
        step = 0
        while len(active):
            over = size[active] == step
            if over.any():
                done = over & self.final[state]
                rank[active[done]] = acc[done]
                active, state, acc = active[~over], state[~over], acc[~over]
            key = state << 8 | buf[begin[active] + step]
            slot = _slot(key, len(self.table))
            seen = self.table[slot]
            while True:
                again = np.flatnonzero((seen != key) & (seen != -1))
                if not len(again):
                    break
                slot[again] = (slot[again] + 1) & mask
                seen[again] = self.table[slot[again]]
            hit = seen == key
            active, slot = active[hit], slot[hit]
            step_value = self.value[slot]
            state = step_value[:, 0].astype(np.int64)
            acc = acc[hit] + step_value[:, 1]
            step += 1
        return rank


@functools.lru_cache(maxsize=4)
def open_lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def encode_texts(texts: list[str], lexicon: Lexicon, merge) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each text)."""
    buf, begin, size, words = split_words(texts)
    rank = lexicon.ranks(buf, begin, size)
    unseen = np.flatnonzero(rank < 0)
    n_lex = len(lexicon.id_at) - 1
    ids, id_at = lexicon.ids, lexicon.id_at
    if len(unseen):
        known: dict[bytes, int] = {}
        flat: list[int] = []
        at = [0]
        raw = buf.tobytes()
        where = np.empty(len(unseen), np.int64)
        for j, (b, s) in enumerate(zip(begin[unseen].tolist(), size[unseen].tolist())):
            word = raw[b : b + s]
            k = known.get(word)
            if k is None:
                k = known[word] = len(known)
                flat.extend(merge(word))
                at.append(len(flat))
            where[j] = k
        rank[unseen] = n_lex + where
        ids = np.concatenate([ids, np.array(flat, np.int32)])
        id_at = np.concatenate([id_at, id_at[-1] + np.array(at[1:], np.int64)])
    count = id_at[rank + 1] - id_at[rank]
    total = np.concatenate([[0], np.cumsum(count)])
    word_of = np.repeat(np.arange(len(rank)), count)
    out = ids[id_at[rank][word_of] + np.arange(total[-1]) - total[word_of]]
    ends = np.concatenate([[0], np.cumsum(words)])
    return out, total[ends[1:]] - total[ends[:-1]]
