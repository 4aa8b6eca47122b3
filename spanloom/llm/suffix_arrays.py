"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than the one behind them.
Leftmost S suffixes (LMS) are put into their first symbol's bucket; going through
the buckets upwards places the L suffixes, and downwards the S suffixes, which
also sorts the LMS substrings.  Equal substrings, compared symbol by symbol, get equal
names.  Where names repeat, the string of names is sorted the same way, recursively;
one more round of inducing gives the order of all suffixes.

Strings of bytes are handled with NumPy, a bucket's suffixes as whole arrays: those
that a bucket places into itself (runs of its symbol) follow in waves.  Strings of
names have about as many buckets as symbols, and are handled one suffix at a time.

Prefix hashes are for the choice of anchors only; nothing here takes equal hashes
for equal bytes.
"""

from __future__ import annotations

import numpy as np

#: A random value for each byte, and an odd factor, for hashes of substrings.
_rng = np.random.default_rng(20240301)
SYMBOLS = _rng.integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR**i and FACTOR**-i for i < n, kept in the worker."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", FACTOR), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """out[j] - out[i], times the inverse power of i, is a hash of symbols[i:j]."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(SYMBOLS[symbols] * powers(len(symbols))[0], out=out[1:])
    return out


def hashes_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of data[a:] and data[b:], up to ``most``; data are bytes.

    Eight bytes of all pairs at a time; pairs that differ leave.
    """
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 9,), "<u8", padded.data, strides=(1,))
    most = np.minimum(most, n - np.maximum(a, b))
    out = np.zeros(len(a), np.int64)
    alive = np.flatnonzero(most > 0)
    at = 0
    while len(alive):
        differ = words[a[alive] + at] ^ words[b[alive] + at]
        lowest = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1)).astype(np.int64) >> 3)
        out[alive] = at + equal
        at += 8
        alive = alive[(equal == 8) & (most[alive] > at)]
    return np.minimum(out, np.maximum(most, 0))


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is the smallest and unique."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(np.diff(text))
    rise[-1] = 1
    # equal symbols take the type of the next place where symbols differ
    place = np.where(rise != 0, np.arange(n), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return rise[following] > 0


def _split(items: np.ndarray, symbols: np.ndarray):
    """(symbol, items) for each symbol, items in their order."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    yield from zip(symbols[np.r_[0, cuts]].tolist(), np.split(items, cuts), strict=True)


def _induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    size = int(text.max()) + 1
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    seeds: list[np.ndarray] = [np.zeros(0, np.int64)] * size
    for symbol, items in _split(leftmost, text[leftmost]):
        seeds[symbol] = items

    def scan(found: np.ndarray, wanted: bool, out: list[list[np.ndarray]], symbol: int) -> np.ndarray:
        """Place the suffixes before ``found``; those of the same bucket are returned."""
        before = found[found > 0] - 1
        before = before[small[before] == wanted]
        symbols = text[before]
        same = symbols == symbol
        for other, items in _split(before[~same], symbols[~same]):
            out[other].append(items)
        return before[same]

    def waves(found: np.ndarray, wanted: bool, out: list[list[np.ndarray]], symbol: int) -> np.ndarray:
        """The bucket's own part, with all that it places into itself."""
        parts = []
        while len(found):
            parts.append(found)
            found = scan(found, wanted, out, symbol)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    empty = np.zeros(0, np.int64)
    ordered_large = [empty] * size
    for symbol in range(size):
        first = np.concatenate(large[symbol]) if large[symbol] else empty
        ordered_large[symbol] = waves(first, False, large, symbol)
        scan(seeds[symbol], False, large, symbol)
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    parts = []
    for symbol in range(size - 1, -1, -1):
        first = np.concatenate(smaller[symbol]) if smaller[symbol] else empty
        if symbol == 0:
            first = np.array([len(text) - 1])
        ordered = waves(first, True, smaller, symbol)
        scan(ordered_large[symbol][::-1], True, smaller, symbol)
        parts += [ordered[::-1], ordered_large[symbol]]
    return np.concatenate(parts[::-1])


def _name_order(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of names, 0 to its largest one, by induced sorting.

    The end is no symbol of the string, and counts as smaller than all of them.
    """
    n = len(names)
    if n < 2:
        return np.arange(n)
    rise = np.r_[np.sign(np.diff(names)), -1]
    place = np.where(rise != 0, np.arange(n), n - 1)
    small = rise[np.minimum.accumulate(place[::-1])[::-1]] > 0
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(names))
    begins = np.r_[0, ends[:-1]].tolist()
    ends = ends.tolist()
    # of the suffix before each one: its symbol, and whether it is L or S; -1 (nothing) has neither
    before = [0, *names[:-1].tolist(), 0]
    before_large = [False, *(~small[:-1]).tolist(), False]
    before_small = [False, *small[:-1].tolist(), False]

    def induced(seeds: np.ndarray) -> list[int]:
        order = [-1] * n
        free = ends.copy()
        for i, x in zip(seeds[::-1].tolist(), names[seeds[::-1]].tolist(), strict=True):
            free[x] -= 1
            order[free[x]] = i
        free = begins.copy()
        x = int(names[-1])
        order[free[x]] = n - 1
        free[x] += 1
        for j in order:  # sees what it places
            if before_large[j]:
                x = before[j]
                order[free[x]] = j - 1
                free[x] += 1
        free = ends.copy()
        for j in reversed(order):
            if before_small[j]:
                x = before[j]
                free[x] = at = free[x] - 1
                order[at] = j - 1
        return order

    if len(leftmost) > 1:
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        first = np.array(induced(leftmost))
        first = first[is_leftmost[first]]
        behind = np.full(n, n)  # the last substring runs to the end, and is one of its own
        behind[leftmost[:-1]] = leftmost[1:] + 1
        a, b = first[:-1], first[1:]
        alike = (behind[a] - a == behind[b] - b) & (a != leftmost[-1]) & (b != leftmost[-1])
        pairs, at = np.flatnonzero(alike), 0
        while len(pairs):
            same = names[a[pairs] + at] == names[b[pairs] + at]
            alike[pairs[~same]] = False
            at += 1
            pairs = pairs[same & (a[pairs] + at < behind[a[pairs]])]
        named = np.empty(n, np.int64)
        named[first] = np.cumsum(np.r_[0, ~alike])
        named = named[leftmost]
        leftmost = leftmost[_name_order(named)] if named.max() < len(named) - 1 else first
    return np.array(induced(leftmost))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of an array of bytes."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    n = len(symbols)
    text = np.zeros(n + 1, np.int64)
    text[:-1] = symbols
    text[:-1] += 1
    small = _types(text)
    is_leftmost = small.copy()
    is_leftmost[0] = False
    is_leftmost[1:] &= ~small[:-1]
    leftmost = np.flatnonzero(is_leftmost)
    if len(leftmost) > 1:
        order = _induce(text, small, leftmost)
        order = order[is_leftmost[order]]
        # an LMS substring ends with the first symbol of the next one; the end is one of its own
        ends = np.full(n + 1, n + 1, np.int64)
        ends[leftmost[:-1]] = leftmost[1:] + 1
        a, b = order[:-1], order[1:]
        size = ends[a] - a
        alike = (size == ends[b] - b) & (ends[a] <= n) & (ends[b] <= n)
        alike[alike] = common_prefixes(symbols, a[alike], b[alike], size[alike]) == size[alike]
        names = np.empty(n + 1, np.int64)
        names[order] = np.cumsum(np.r_[0, ~alike])
        names = names[leftmost]
        if names.max() < len(names) - 1:
            leftmost = leftmost[_name_order(names)]
        else:
            leftmost = order
    return _induce(text, small, leftmost)[1:]


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the suffix sorted before it, that suffix) of each position, in text order.

    Where a suffix and the one sorted before it follow equal bytes, the prefix is that of
    the position before, less one.  Only the others are compared; their sum is about linear.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    if n < 2:
        return out, before
    here = np.arange(n)
    known = np.ones(n, bool)
    known[1:] = (before[1:] <= 0) | (before[:-1] < 0) | (data[:-1] != data[before[1:] - 1])
    at = np.flatnonzero(known & (before >= 0))
    out[at] = common_prefixes(data, at, before[at], np.full(len(at), n))
    last = np.maximum.accumulate(np.where(known, here, 0))
    return np.maximum(out[last] - (here - last), 0), before
