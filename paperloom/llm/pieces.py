"""Vocabulary, units and unigram weights of a SentencePiece model with byte fallback.

The model's text is the input with each space as U+2581 and one more in front. It is cut into units
where no piece of the vocabulary reaches across (which is checked for each model), so neither the
encoding nor any segmentation does, and each distinct unit is worked out once.
The model's scores are ranks, not probabilities: a piece of rank r weighs 1 / (r + 10), Zipf's
law, and a byte of the fallback weighs as much as the last rank.

Defined cases: a null or empty text has no units; characters outside the vocabulary are byte pieces;
a model of another kind than the package reads, or a path that isn't there, is an error.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

SPACE = "▁"
HASH_BASE, HASH_MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Line breaks, words with the spaces before them, and other runs of spaces.
UNITS = re.compile("\\n|[ ▁]*[^ ▁\\n]+|[ ▁]+")


class Vocabulary:
    """What the operators need of a model, from the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = p.vocab_size()
        self.bytes = {int(p.id_to_piece(i)[3:-1], 16): i for i in range(size) if p.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        if any("\n" in x or len(UNITS.findall(x)) > 1 for x in self.ids):
            raise ValueError("a piece crosses the borders of units")
        self.line_break = self.bytes[10]
        self.weights = np.full(size, -np.log(size + 10.0))
        for i in plain:
            self.weights[i] = -np.log(10.0 - p.get_score(i))
        self.longest = max(map(len, self.ids))
        #: Every ending of a piece: what isn't one can't be made longer to the left.
        self.endings = {x[k:] for x in self.ids for k in range(len(x))}
        raw = [b""] * size
        for x, i in self.ids.items():
            raw[i] = x.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

        self._index()

    def _index(self) -> None:
        """A hash table of all endings of pieces, for looking up many strings at once."""
        self.bits = max(16, (8 * len(self.endings)).bit_length())
        mask = (1 << self.bits) - 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        hashes, pieces = [], []
        for x in self.endings:
            h = 0
            for c in x:
                h = (h * HASH_BASE + ord(c) + 1) & 2**64 - 1
            at = h * HASH_MIX % 2**64 >> 64 - self.bits
            while self.slots[at] >= 0:
                at = at + 1 & mask
            self.slots[at] = len(hashes)
            hashes.append(h)
            pieces.append(self.ids.get(x, -1))
        if len(set(hashes)) < len(hashes):
            raise ValueError("two endings of pieces have one hash")
        self.hashes, self.piece_of = np.array(hashes, np.uint64), np.array(pieces, np.int64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the ending of each hash; -1 for none."""
        at = (hashes * np.uint64(HASH_MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at].astype(np.int64)
        miss = np.flatnonzero((found >= 0) & (self.hashes[found] != hashes))
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            found[miss] = self.slots[at[miss]]
            miss = miss[(found[miss] >= 0) & (self.hashes[found[miss]] != hashes[miss])]
        return found

    def edges(self, codes: np.ndarray, place: np.ndarray):
        """For each piece that ends at any of ``codes``: where, its length and its id, by ascending length.

        ``place`` is each character's place in its unit; no piece crosses a unit's start.
        """
        at, h, power = np.arange(len(codes)), np.zeros(len(codes), np.uint64), np.uint64(1)
        wide = codes.astype(np.uint64) + np.uint64(1)
        for n in range(1, self.longest + 1):
            fits = place[at] >= n - 1
            at, h = at[fits], h[fits] + wide[at[fits] - (n - 1)] * power
            found = self.look_up(h)
            known = found >= 0
            at, h, found = at[known], h[known], found[known]
            if not len(at):
                return
            piece = self.piece_of[found]
            real = piece >= 0
            yield at[real], n, piece[real]
            power = np.uint64(int(power) * HASH_BASE & 2**64 - 1)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def units(self, text: str | None) -> list[str]:
        return UNITS.findall(" " + text) if text else []

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the model's own encoding of all units, and how many each has.

        Units are encoded many at a time with a line break before each, which no piece crosses.
        """
        lines = ["\n" + "\n".join(u if u != "\n" else "" for u in units[at : at + 50]) for at in range(0, len(units), 50)]
        ids = np.fromiter(chain.from_iterable(x[1:] for x in self.processor.encode(lines, num_threads=1)), np.int32)
        breaks = np.flatnonzero(ids == self.line_break)
        counts = np.diff(np.append(breaks, len(ids))) - 1
        for k in (k for k, u in enumerate(units) if u == "\n"):  # the break itself is the unit
            ids = np.insert(ids, int(counts[:k].sum()) + k + 1, self.line_break)
            counts[k] = 1
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(counts + 1) - counts - 1] = False
        return ids[keep], counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, without the space that the model puts in front."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        out = self.pool[at].tobytes()
        return out[1:] if out[:1] == b" " else out


_loaded: dict[int, Vocabulary] = {}


def vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast model file, once for each worker."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(shared.value)
    return _loaded[key]
