"""Statistics of lines and texts, taken over whole texts in Arrow batches."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from tidemill.llm.tokens import SPACE, WORD, chunks, starts

#: Character kinds that lines are described by.
BLANK, BREAK, LOWER, UPPER, DIGIT, STOP, SOFT, COMMA, SEMICOLON, BAR, BULLET, MARKUP, STRANGE = range(13)
KINDS = 13
NONE = KINDS
GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    table = np.full(0x110000, STRANGE, np.uint8)
    of = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": BLANK, "Zl": BLANK, "Zp": BLANK, "Cc": BLANK, "Pd": SOFT, "Ps": SOFT, "Pe": SOFT, "Pi": SOFT, "Pf": SOFT}
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] in "LM" and category not in ("Lu", "Lt"):
            table[c] = LOWER
        elif category in of:
            table[c] = of[category]
    for kind, chars in ((BREAK, "\n"), (STOP, ".!?…。"), (SOFT, "'\"()-–—’‘“”„«»:/&"), (COMMA, ","), (SEMICOLON, ";"), (BAR, "|\t"), (BULLET, "*#•·+"), (MARKUP, "<>{}[]=_~\\")):
        for c in chars:
            table[ord(c)] = kind
    return table


@cache
def lowered() -> np.ndarray:
    """The lower case of every code point that has a single one."""
    table = np.arange(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) == 1 and low != chr(c):
            table[c] = ord(low)
    return table


class Powers:
    """Powers of a base modulo 2**64, made as far as they are asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            more = np.full(max(n, 2 * len(self.held)), self.base, np.uint64)
            more[0] = 1
            self.held = np.cumprod(more, dtype=np.uint64)
        return self.held[:n]


POWERS, INVERSES = Powers(BASE), Powers(BASE_INVERSE)


def span_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of lower-cased code points; equal spans have equal hashes wherever they stand."""
    n = points.size
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((lowered()[points] + np.uint64(1)) * POWERS.upto(n), dtype=np.uint64, out=running[1:])
    return (running[end] - running[begin]) * INVERSES.upto(n + 1)[begin]


def word_hash(word: str) -> int:
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return int(span_hashes(points, np.array([0]), np.array([points.size]))[0])


@dataclass
class CommonWords:
    """Common words of each language; a text whose language has none is held against those of all."""

    langs: list[str]
    tables: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> CommonWords:
        langs = sorted({lang for lang, _ in rows})
        each = [np.array(sorted({word_hash(w) for at, w in rows if at == lang}), np.uint64) for lang in langs]
        every = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]))
        return cls(langs, [*each, every])

    def of_texts(self, langs: pa.Array) -> np.ndarray:
        """The number of each text's table."""
        by = {lang: k for k, lang in enumerate(self.langs)}
        return np.array([by.get((x or "").strip().lower(), len(self.langs)) for x in langs.to_pylist()], np.int64)

    def common(self, hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.size, bool)
        for k in np.unique(table):
            words = self.tables[k]
            if words.size:
                mine = np.flatnonzero(table == k)
                at = np.minimum(np.searchsorted(words, hashes[mine]), words.size - 1)
                out[mine] = words[at] == hashes[mine]
        return out


@dataclass
class Lines:
    """Lines that aren't blank, in order, and sums over whole texts."""

    doc: np.ndarray
    chars: np.ndarray
    codes: np.ndarray
    docs: dict[str, np.ndarray]


#: Edges of the binned statistics of a line; after them come the kinds of its first and last character and whether
#: it starts in lower case (1) and follows a line that didn't end in a stop (2).
BINS = {
    "length": [4, 20, 40, 60, 72, 120, 300],
    "stops": [0.001, 0.006, 0.012, 0.025, 0.05],
    "symbols": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4],
    "bars": [0.001, 0.01, 0.03, 0.08],
    "semicolons": [0.001, 0.01, 0.03, 0.08],
    "commas": [0.001, 0.012, 0.03, 0.08],
    "digits": [0.001, 0.03, 0.1, 0.2, 0.4],
    "common": [0.01, 0.1, 0.2, 0.3, 0.4, 0.5],
    "word_length": [2.5, 3.5, 4.5, 5.5, 7, 10],
    "capitals": [0.01, 0.1, 0.25, 0.45, 0.7],
    "repeats": [0.01, 0.2, 0.5, 0.8],
    "words": [1, 3, 5, 9, 16],
    "around": [0.001, 0.004, 0.008, 0.014, 0.022, 0.035],
    "inner_capitals": [0.001, 0.03, 0.15],
    "lines": [2, 3, 6, 20],
}
SIZES = [*[len(edges) + 1 for edges in BINS.values()], KINDS + 1, KINDS + 1, 4]


def describe(texts: pa.Array, langs: pa.Array, words: CommonWords) -> Lines:
    """The lines of all texts with the codes of their statistics, and the statistics of each text.

    Blank lines have no statistics; a null text is an empty one. ``repeats`` is the share of a line's runs of
    eight words that occurred before in the text, or 1 for a whole line that did.
    """
    parts = [_describe(points, ends, words.of_texts(langs.slice(first, ends.size)), words, first) for first, points, ends in chunks(texts)]
    if not parts:
        parts = [_describe(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), words, 0)]
    return Lines(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "chars", "codes")], {c: np.concatenate([p.docs[c] for p in parts]) for c in parts[0].docs})


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """Which rows have a key that no earlier row has."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(keys.size, bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.zeros(keys.size, bool)
    out[order[new]] = True
    return out


def _describe(points: np.ndarray, ends: np.ndarray, table: np.ndarray, words: CommonWords, first: int) -> Lines:
    n, docs = points.size, ends.size
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if docs else ends
    kind, (token, begun) = kinds()[points], starts(points, ends)
    breaks = np.flatnonzero(points == 10)
    a, b = np.sort(np.concatenate([begins, breaks + 1])), np.sort(np.concatenate([breaks, ends]))
    per_doc = np.bincount(np.searchsorted(ends, breaks, side="right"), minlength=docs)[:docs] + 1
    doc = np.repeat(np.arange(docs), per_doc)
    lines = a.size
    line = np.repeat(np.arange(lines), np.diff(np.concatenate([a, [n]]))) if lines else np.zeros(0, np.int64)
    counts = np.bincount(line * KINDS + kind, minlength=lines * KINDS).reshape(lines, KINDS)
    visible = np.flatnonzero(token != SPACE)
    lo, hi = np.searchsorted(visible, a), np.searchsorted(visible, b)
    seen = hi - lo
    full = seen > 0
    head, tail = np.full(lines, NONE, np.int64), np.full(lines, NONE, np.int64)
    head[full], tail[full] = kind[visible[lo[full]]], kind[visible[hi[full] - 1]]
    # a stop ends a sentence if a word came before it and it is followed by white space, a quote or a tag
    after = np.full(n, BREAK, np.uint8)
    after[:-1] = kind[1:]
    before = np.full(n, BREAK, np.uint8)
    before[1:] = kind[:-1]
    if docs:
        after[ends[ends > begins] - 1] = BREAK
    at = np.flatnonzero(kind == STOP)
    stop = at[np.isin(after[at], (BLANK, BREAK, MARKUP, SOFT)) & np.isin(before[at], (LOWER, UPPER, DIGIT, SOFT, MARKUP))]
    stops = np.bincount(line[stop], minlength=lines)
    inner = np.bincount(line[np.flatnonzero((kind[1:] == UPPER) & (before[1:] == LOWER)) + 1], minlength=lines) if n else np.zeros(lines)
    # words
    is_word = token == WORD
    word_begin = np.flatnonzero(is_word & begun)
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = is_word[1:] & ~begun[1:]
    word_end = np.flatnonzero(is_word & ~goes_on) + 1
    hashes = span_hashes(points, word_begin, word_end) if n else np.zeros(0, np.uint64)
    word_line = line[word_begin]
    word_doc = doc[word_line]
    common = words.common(hashes, table[word_doc])
    n_words, n_common = np.bincount(word_line, minlength=lines), np.bincount(word_line[common], minlength=lines)
    word_chars = np.bincount(word_line, word_end - word_begin, minlength=lines)
    capitals = np.bincount(word_line[kind[word_begin] == UPPER], minlength=lines)
    # runs of words that occurred before in their text
    again = np.zeros(lines)
    runs = np.zeros(lines)
    m = hashes.size - GRAM + 1
    if m > 0:
        gram = np.zeros(m, np.uint64)
        for k in range(GRAM):
            gram = gram * BASE + hashes[k : k + m]
        inside = np.flatnonzero(word_doc[:m] == word_doc[GRAM - 1 :])
        # mixed, since sums of products alone would let texts' numbers cancel out
        key = (gram[inside] ^ (gram[inside] >> np.uint64(29))) * BASE + word_doc[inside].astype(np.uint64) * INVERSES.base
        seen_before = ~_first_seen(key)
        runs = np.bincount(word_line[inside], minlength=lines).astype(float)
        again = np.bincount(word_line[inside][seen_before], minlength=lines).astype(float)
    repeats = again / np.maximum(runs, 1)
    if n:
        whole = span_hashes(points, a, b)
        key = (whole ^ (whole >> np.uint64(31))) * BASE + doc.astype(np.uint64) * INVERSES.base
        twice = np.flatnonzero(full)
        repeats[twice[~_first_seen(key[twice])]] = 1.0
    # what stands around a line: stops in the two lines before and after it, and how the line before it ended
    shown = np.flatnonzero(full)
    around_stops, around_chars = np.zeros(lines), np.ones(lines)
    follows = np.zeros(lines, np.int64)
    if shown.size:
        of = doc[shown]
        lo_line = np.maximum(np.arange(shown.size) - 2, np.searchsorted(of, of))
        hi_line = np.minimum(np.arange(shown.size) + 3, np.searchsorted(of, of, side="right"))
        sums, widths = np.concatenate([[0], np.cumsum(stops[shown])]), np.concatenate([[0], np.cumsum(seen[shown])])
        around_stops[shown], around_chars[shown] = sums[hi_line] - sums[lo_line], widths[hi_line] - widths[lo_line]
        ended = np.ones(shown.size, bool)
        ended[1:] = (tail[shown[:-1]] == STOP) | (of[1:] != of[:-1])
        follows[shown] = np.where(head[shown] == LOWER, 1, 0) + np.where(ended, 0, 2)
    in_text = np.bincount(doc, full, minlength=docs)[doc]
    size, some = np.maximum(seen, 1), np.maximum(n_words, 1)
    symbols = counts[:, [BULLET, MARKUP, STRANGE, BAR]].sum(axis=1)
    stats = {
        "length": b - a,
        "stops": stops / size,
        "symbols": symbols / size,
        "bars": counts[:, BAR] / size,
        "semicolons": counts[:, SEMICOLON] / size,
        "commas": counts[:, COMMA] / size,
        "digits": counts[:, DIGIT] / size,
        "common": n_common / some,
        "word_length": word_chars / some,
        "capitals": capitals / some,
        "repeats": repeats,
        "words": n_words,
        "around": around_stops / around_chars,
        "inner_capitals": inner / some,
        "lines": in_text,
    }
    codes = np.stack([*[np.digitize(stats[c][shown], BINS[c]) for c in BINS], head[shown], tail[shown], follows[shown]], axis=1).astype(np.uint8)
    total = lambda x: np.bincount(doc, x, minlength=docs).astype(np.int64)
    sums = {
        "words": total(n_words),
        "word_chars": total(word_chars),
        "visible": total(seen),
        "symbols": total(seen - word_chars.astype(np.int64)),
        "lines": total(full),
        "stopped": total(full & (tail == STOP)),
        "common": total(n_common),
    }
    return Lines((doc[full] + first).astype(np.int64), seen[full].astype(np.int64), codes, sums)
