"""Greedy line breaking of whole Arrow batches in linear time: running sums of sizes, a search for each word's next break, and pointer doubling for the breaks that are taken."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

#: The code points with the property White_Space.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points of text that are laid out at once.
STEP = 1 << 20
_white = np.zeros(0x3002, bool)
_white[WHITE] = True


def column_widths(points: np.ndarray, no_width, two_wide) -> np.ndarray:
    """Columns that each character takes; ranges as in layout."""
    own, where = np.unique(points, return_inverse=True)
    inside = lambda c, ranges: any(a <= c <= b for a, b in ranges)
    size = [1 if 0x20 <= c < 0x7F else 0 if inside(c, no_width) or unicodedata.combining(chr(c)) else 2 if inside(c, two_wide) else 1 for c in own.tolist()]
    return np.array(size, np.int64)[where]


def byte_widths(points: np.ndarray) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _starts(nxt: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks what is reached from `first` over nxt, whose last entry points to itself: after k rounds all within 2 ** k steps."""
    reached, jump = first.copy(), nxt
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        more[-1] = reached[-1]
        if (more == reached).all():
            return reached
        reached, jump = more, jump[jump]


def break_lines(points: np.ndarray, ends: np.ndarray, sizes: np.ndarray, limit: int, blank: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, line ends, lines of each row) of rows that end at `ends` in points; words are put on lines of at most `limit` by sizes, with one space between.

    blank False: each newline begins a paragraph, a paragraph without words is an empty line, and a word of over limit is broken and has its lines to itself. blank True: two newlines begin a paragraph, one of at most limit
    stays as it is, empty ones go, and a longer word is a line.
    """
    n, rows = len(points), len(ends)
    begins = np.r_[0, ends[:-1]]
    white = _white[np.minimum(points, 0x3001)]
    row_start = np.zeros(n + 1, bool)
    row_start[begins] = True
    row_start[-1] = True
    before = np.r_[True, white[:-1]] if n else np.zeros(0, bool)
    word_at = np.flatnonzero(~white & (before | row_start[:n]))
    after = np.r_[white[1:], True] if n else np.zeros(0, bool)
    word_end = np.flatnonzero(~white & (after | row_start[1:])) + 1
    row = np.searchsorted(ends, word_at, "right")
    upto = np.r_[0, np.cumsum(sizes)]
    size = upto[word_end] - upto[word_at]
    newline = points == 10
    mark = newline & np.r_[newline[1:], False] & ~row_start[1:] if blank else newline
    paragraph = np.r_[0, np.cumsum(mark)][word_at]
    count = len(word_at)
    opens = np.ones(count, bool)
    opens[1:] = (row[1:] != row[:-1]) | (paragraph[1:] != paragraph[:-1])
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], count] - 1  # of each paragraph
    long = size > limit
    segment = opens.copy()
    if not blank:
        segment |= long
        segment[1:] |= long[:-1]
    at = np.flatnonzero(segment)
    until = np.r_[at[1:], count][np.cumsum(segment) - 1] if count else np.zeros(0, np.int64)
    sums = np.r_[0, np.cumsum(size + 1)]
    nxt = np.searchsorted(sums, sums[:-1] + limit + 1, "right") - 1
    nxt = np.minimum(np.maximum(nxt, np.arange(count) + 1), until)
    whole = np.zeros(len(first), bool)
    if blank and count:
        whole = upto[word_end[last]] - upto[word_at[first]] <= limit
        nxt[first[whole]] = last[whole] + 1
    reached = _starts(np.r_[nxt, count], np.r_[segment, False])[:count]
    line = np.flatnonzero(reached)
    # what stays of the text: words, one space between two of a line, and paragraphs that stay as they are
    keep = ~white
    inner = np.ones(count, bool)
    inner[np.r_[line[1:], count][: len(line)] - 1] = False  # the last word of each line has no space after it
    gap = word_end[inner]
    out = points.copy()
    if whole.any():
        edge = np.zeros(n + 1, np.int64)
        edge[word_at[first[whole]]] += 1
        edge[word_end[last[whole]]] -= 1
        same = np.cumsum(edge)[:n] > 0
        keep |= same
        gap = gap[~same[gap]]
    keep[gap] = True
    out[gap] = 32
    place, owner = word_at[line], row[line]
    if not blank:
        cuts = [np.zeros(0, np.int64)]
        for w in np.flatnonzero(long):
            cuts.append(_cuts(sizes[word_at[w] : word_end[w]], limit) + word_at[w])
        more = np.concatenate(cuts)
        start = np.sort(np.r_[begins, np.flatnonzero(newline) + 1])  # of every paragraph, by characters
        own = np.r_[np.searchsorted(ends, np.flatnonzero(newline), "right"), np.arange(rows)]
        start, own = np.r_[np.flatnonzero(newline) + 1, begins], own
        stop = np.r_[np.flatnonzero(newline), n]
        stop = np.minimum(stop[np.searchsorted(stop, start)], ends[own])
        empty = np.searchsorted(word_at, start) == np.searchsorted(word_at, stop)
        place = np.r_[place, more, start[empty]]
        owner = np.r_[owner, np.searchsorted(ends, more, "right"), own[empty]]
        order = np.lexsort((place, owner))
        place, owner = place[order], owner[order]
    kept = np.r_[0, np.cumsum(keep)]
    return out[keep], np.r_[kept[place][1:], kept[-1:]][: len(place)], np.bincount(owner, minlength=rows)


def _cuts(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Where a word is broken into pieces that fit, a character at least each; without its start."""
    sums = np.r_[0, np.cumsum(sizes)]
    nxt = np.maximum(np.searchsorted(sums, sums[:-1] + limit, "right") - 1, np.arange(len(sizes)) + 1)
    first = np.zeros(len(sizes) + 1, bool)
    first[0] = True
    return np.flatnonzero(_starts(np.r_[nxt, len(sizes)], first)[:-1])[1:]


def broken(column: pa.Array, limit: int, measure, blank: bool) -> pa.Array:
    """A list of lines for each text of a string column; null for null. measure gives the sizes of characters."""
    column = column.cast(pa.large_string())
    null = np.asarray(column.is_null())
    column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    texts, ends, counts = [], [0], []
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(at, at[begin] + STEP, "right")) - 1)
        raw = data[at[begin] : at[stop]]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][at[begin + 1 : stop + 1] - at[begin]]
        kept, lines, each = break_lines(points, chars, measure(points), limit, blank)
        texts.append(kept.astype("<u4").tobytes().decode("utf-32-le").encode())
        ends += (np.r_[0, np.cumsum(byte_widths(kept))][lines] + ends[-1]).tolist()
        counts.append(each)
        begin = stop
    counts_ = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    counts_[null] = 0
    offsets = pa.array(np.r_[0, np.cumsum(counts_)].astype(np.int32))
    lines = _without_null_lines(ends, counts, null)
    strings = pa.Array.from_buffers(pa.large_string(), len(lines) - 1, [None, pa.py_buffer(np.array(lines, np.int64).tobytes()), pa.py_buffer(b"".join(texts))]).cast(pa.string())
    return pa.ListArray.from_arrays(offsets, strings, mask=pa.array(null))


def _without_null_lines(ends: list[int], counts: list[np.ndarray], null: np.ndarray) -> list[int]:
    """The line ends without the empty line that stands for a null text."""
    if not null.any():
        return ends
    each = np.concatenate(counts)
    row = np.repeat(np.arange(len(each)), each)
    return [ends[0], *np.array(ends[1:])[~null[row]].tolist()]
