"""Words of whole text batches as 64-bit hashes, on the UTF-8 bytes.

Every separator used here is a single byte, so bytes give the same words as characters.
"""

import numpy as np

WINDOW = 4 << 20  # bytes hashed at once, cut at a word end

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = {}


def _power(base, n):
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * WINDOW:
            _powers[int(base)] = have
    return have[:n]


def mix(h):
    """Finaliser that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data, starts, ends):
    """A hash of the bytes of each span; spans are ascending and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = int(starts[0])
    data = data[low:int(ends[-1])]
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    h = (sums[ends - low] - sums[starts - low]) * _power(_INVERSE, n + 1)[starts - low]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data, offsets, separators):
    """Starts and ends of the words of all rows; a word never crosses a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data, offsets, separators):
    """Hashes of the words, A-Z lower-cased, and the row bounds among them (n_rows + 1)."""
    data = LOWER[data]
    starts, ends = word_spans(data, offsets, separators)
    parts, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, side="right")))
        parts.append(span_hashes(data, starts[at:to], ends[at:to]))
        at = to
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingle_hashes(words, bounds, width):
    """Hashes of ``width`` consecutive words of each row (all rows' shingles in order) and the
    row bounds; a row of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(counts)), n)
    start = bounds[:-1][row] + np.arange(out_bounds[-1]) - out_bounds[:-1][row]
    have = np.minimum(counts, width)[row]
    out = have.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(width):
        word = words[np.minimum(start + k, len(words) - 1)] if len(words) else words
        step = mix(out * np.uint64(0x9FB21C651E98DF25) + word)
        out = np.where(k < have, step, out)
    return out, out_bounds
