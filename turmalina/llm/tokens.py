"""Token ids of whole text batches with a byte-level BPE file of the ``tokenizers`` library.

The file's vocabulary is applied by ``tiktoken``, which is several times faster; it must rank
merges by id, as these vocabularies do.  The tests hold the ids against ``tokenizers``.

The vocabulary's split pattern always breaks before a single blank between two words and
between an ASCII letter and punctuation.  Texts are cut there, each distinct piece is encoded
once, and the ids are gathered back; texts with other white space than ASCII's are encoded
whole.  Texts that hold one of the file's added tokens are encoded by ``tokenizers`` itself.  The
ids equal those of encoding each text with ``add_special_tokens=False``.
"""

from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from .common import caches
from .wordhash import WINDOW, span_hashes

TABLE = 1 << 20  # places for distinct pieces in a worker
CACHE = 400_000  # pieces a worker encodes before it starts anew; its arrays take some 30 MB then
#: Fixed value: the split pattern of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that begin a white-space character outside ASCII (U+0085, U+00A0, U+1680, U+2000..U+3000),
#: and the ASCII separators that Unicode counts as white space, or that may.
ODD_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
ODD_SPACES = "\u0085                 　\x1c\x1d\x1e\x1f"

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
ODD = np.zeros(256, bool)
ODD[[*ODD_LEADS, 0x1C, 0x1D, 0x1E, 0x1F]] = True

_encoders = caches.setdefault("encoders", {})


def byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is
    printable, else the next free character from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of text batches; one per worker and vocabulary."""

    def __init__(self, path: str):
        plain = Tokenizer.from_file(path)
        self.path, self._plain = path, None
        self.added = [t.content.encode() for t in plain.get_added_tokens_decoder().values()]
        vocabulary = plain.get_vocab(with_added_tokens=False)
        letters = {c: bytes([b]) for b, c in byte_letters().items()}
        ranks = {b"".join(letters[c] for c in word): i for word, i in vocabulary.items()
                 if all(c in letters for c in word)}
        # Texts with added tokens don't come here, so the merges go without them.
        self.merges = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.reset()

    @property
    def plain(self):
        """The library's own tokenizer, kept from the first text that needs it."""
        if self._plain is None:
            self._plain = Tokenizer.from_file(self.path)
        return self._plain

    def reset(self):
        self.keys, self.values = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int32)
        self.count, self.used = 0, 0
        self.ids, self.ends = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64)

    def _add(self, pieces):
        """Slots of newly encoded pieces."""
        ids = [self.merges.encode_ordinary(p) for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(ids) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.ends[self.count:self.count + len(ids)] = self.used + np.cumsum(lengths)
        first = self.count
        self.used, self.count = self.used + total, self.count + len(ids)
        return np.arange(first, self.count, dtype=np.int32)

    def _slots(self, data, starts, ends, hashes):
        """The slot of each piece.  The table keeps a piece at one of two places and may forget
        it; a forgotten piece is encoded again."""
        if self.count > CACHE:
            self.reset()
        mask = np.uint64(TABLE - 1)
        one, two = (hashes & mask).astype(np.int64), (hashes >> np.uint64(40) & mask).astype(np.int64)
        found = np.where(self.keys[one] == hashes, self.values[one],
                         np.where(self.keys[two] == hashes, self.values[two], -1))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            unique, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw, first = data.tobytes(), missing[first]
            slots = self._add([raw[a:b].decode("utf-8", "replace")
                               for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            one, two = one[first], two[first]
            at = np.where((self.keys[one] != 0) & (self.keys[two] == 0), two, one)
            self.keys[at], self.values[at] = unique, slots
            found[missing] = slots[inverse]
        return found

    def _block(self, data, offsets):
        """Ids of rows without odd white space, and the row bounds."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        blank, letter = BLANK[data], LETTER[data]
        cut = np.zeros(len(data), bool)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        cut[1:] |= letter[:-1] & PUNCT[data[1:]]
        lone = blank[1:-1] & ~blank[:-2] & ~blank[2:]  # one blank between two other characters
        inner = np.ones(len(data) + 1, bool)
        inner[offsets] = False  # a blank that begins or ends a row is not between two
        lone &= inner[1:-2] & inner[2:-1]
        cut[1:-1] |= lone
        newline = lone & (data[1:-1] != 32)
        cut[2:] |= newline
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        slots = self._slots(data, starts, ends, span_hashes(data, starts, ends))
        to = self.ends[slots]
        begin = np.where(slots > 0, self.ends[np.maximum(slots - 1, 0)], 0)
        lengths = to - begin
        filled = np.concatenate(([0], np.cumsum(lengths)))
        index = np.repeat(begin - filled[:-1], lengths) + np.arange(filled[-1])
        return self.ids[index], filled[np.searchsorted(starts, offsets)]

    def _with_added(self, part, bounds):
        """The rows that hold an added token."""
        raw, found = part.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                r = int(np.searchsorted(bounds, at, side="right")) - 1
                inside = at + len(token) <= bounds[r + 1]
                if inside:
                    found.add(r)
                at = raw.find(token, int(bounds[r + 1]) if inside else at + 1)
        return found

    def rows(self, data, offsets):
        """Yield the ids of each row, in order."""
        at, n = 0, len(offsets) - 1
        while at < n:
            to = min(max(int(np.searchsorted(offsets, offsets[at] + WINDOW, side="right")) - 1, at + 1), n)
            part, bounds = data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            odd = ODD[part]
            if odd.any():
                rows = np.unique(np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1)
            else:
                rows = ()
            whole = {}
            for r in rows:
                text = part[bounds[r]:bounds[r + 1]].tobytes().decode("utf-8", "replace")
                if any(c in text for c in ODD_SPACES):
                    whole[r] = np.asarray(self.merges.encode_ordinary(text), np.uint32)
            for r in self._with_added(part, bounds):
                text = part[bounds[r]:bounds[r + 1]].tobytes().decode("utf-8", "replace")
                whole[r] = np.asarray(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, row_bounds = self._block(part, bounds)
            for r in range(to - at):
                yield whole[r] if r in whole else ids[row_bounds[r]:row_bounds[r + 1]]
            at = to


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
