"""Words of many lines at once: their places, XXH64, bit sums and least hashes as array operations.

A buffer holds lines that each end with a line feed. A word is a run of ASCII digits, letters (A-Z
in lower case) and non-ASCII characters. The arrays need about 20 bytes a byte of the buffer, so
callers pass ``pieces`` of about a megabyte; only a longer line is a piece of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from paperloom.llm.decontaminate import NORMAL

#: As NORMAL, but line feeds stay.
BY_LINE = bytes(10 if b == 10 else NORMAL[b] for b in range(256))
PIECE, WEIGHT, SEGMENT = 1 << 20, 64, 1000
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The four bits of each half byte, as counters of 16 bits side by side.
_SPREAD = np.array([sum((v >> b & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each string ``data[start : start + size]``; ``data`` has 8 more bytes at its end."""
    raw = np.frombuffer(data, np.uint8)
    eights = np.ndarray((len(raw) - 7,), "<u8", buffer=data, strides=(1,))  # at every byte
    out = P5 + sizes.astype(np.uint64)
    rest = starts.copy()
    for k in range(3):
        own = np.flatnonzero(sizes >= 8 * (k + 1))
        lane = _turn(eights[rest[own]] * P2, 31) * P1
        out[own] = _turn(out[own] ^ lane, 27) * P1 + P4
        rest[own] += 8
    own = np.flatnonzero(sizes & 4)
    out[own] = _turn(out[own] ^ (eights[rest[own]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    rest[own] += 4
    for k in range(3):
        own = np.flatnonzero((sizes & 3) > k)
        out[own] = _turn(out[own] ^ raw[rest[own] + k] * P5, 11) * P1
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    for k in np.flatnonzero(sizes >= 32).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return out


def pieces(texts: list[bytes | None], size: int = PIECE):
    """Buffers of whole lines, of ``size`` bytes at most unless one line has more; a null text has no lines."""
    held, total = [], 0
    for x in texts:
        if x is None:
            continue
        for part in [x] if len(x) <= size else x.split(b"\n"):
            if total + len(part) > size and held:
                yield b"\n".join(held) + b"\n"
                held, total = [], 0
            held.append(part)
            total += len(part) + 1
    if held:
        yield b"\n".join(held) + b"\n"


def _bits(hashes: np.ndarray, sizes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each line: its bits are those that words with more than half of the length have."""
    weights = np.minimum(sizes, WEIGHT).astype(np.uint64)
    each = -(-counts // SEGMENT)  # so few words that no counter overflows
    segments = first
    if each.max(initial=0) > 1:
        segments = np.repeat(first, each) + SEGMENT * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    octets, sums = hashes.astype("<u8").view(np.uint8).reshape(-1, 8), []
    for k in range(16):
        half = octets[:, k // 2] >> 4 if k % 2 else octets[:, k // 2] & 15
        sums.append(np.add.reduceat(_SPREAD[half] * weights, segments).astype("<u8").view(np.uint16).reshape(-1, 4))
    ones, total = np.concatenate(sums, axis=1).astype(np.int64), np.add.reduceat(weights.astype(np.int64), first)
    if len(segments) > len(first):
        ones = np.add.reduceat(ones, np.cumsum(each) - each)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _least(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A column a band: a hash of the words of each line that come first in ``rows`` orders by hash."""
    orders = np.array([xxhash.xxh64_intdigest(b"%d" % k) | 1 for k in range(bands * rows + rows)], np.uint64)
    mix, out = orders[bands * rows :], np.zeros((len(first), bands), np.uint32)
    for k in range(bands):
        total = np.zeros(len(first), np.uint64)
        for j in range(rows):
            total += np.minimum.reduceat(hashes * orders[k * rows + j], first) * mix[j]
        out[:, k] = total >> np.uint64(32)
    return out


def sketches(buffer: bytes, bands: int = 0, rows: int = 4) -> dict[str, np.ndarray]:
    """For each line its number of words and of characters of its normal form, a hash of that form in two
    halves, its SimHash (words weighted by their length in bytes) and ``bands`` MinHash keys; all zero for
    a line without words."""
    data = buffer.translate(BY_LINE)
    body = np.frombuffer(data, np.uint8)
    gap = (body == 32) | (body == 10)
    edges = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    sizes = ends - starts
    last = np.searchsorted(starts, np.flatnonzero(body == 10))
    counts = np.diff(last, prepend=0)
    full = np.flatnonzero(counts)
    first, stop, counts_full = last[full] - counts[full], last[full], counts[full]
    out = {"words": counts.astype(np.int32)}
    out |= {n: np.zeros(len(counts), t) for n, t in (("chars", np.int32), ("h1", np.int64), ("h2", np.int64), ("sim", np.uint64))}
    out["bands"] = np.zeros((len(counts), bands), np.uint32)
    if not len(full):
        return out
    out["chars"][full] = np.add.reduceat(sizes, first) + counts_full - 1
    if not buffer.isascii():  # bytes that go on with a character are no further ones
        more = np.searchsorted(np.flatnonzero((body & 0xC0) == 0x80), np.append(starts[first], len(body)))
        out["chars"][full] -= np.diff(more)
    after = np.concatenate(([0], np.cumsum(sizes + 1)))  # where words start if one byte is between them
    form = memoryview(body[~(gap & np.concatenate(([True], gap[:-1])))].tobytes())
    digest = xxhash.xxh3_128_digest
    whole = b"".join([digest(form[a:b]) for a, b in zip(after[first].tolist(), (after[stop] - 1).tolist())])
    both = np.frombuffer(whole, np.int64).reshape(-1, 2)
    out["h1"][full], out["h2"][full] = both[:, 0], both[:, 1]
    hashes = xxh64(data + b"\0" * 8, starts, sizes)
    out["sim"][full] = _bits(hashes, sizes, first, counts_full)
    if bands:
        out["bands"][full] = _least(hashes, first, bands, rows)
    return out


#: Lines of fewer bytes have profiles: counts of the characters of each of SINGLES classes, and of the pairs of neighbours of each of DOUBLES.
BRIEF, SINGLES, DOUBLES = 300, 32, 128
_CLASS = np.array([b - 97 if 97 <= b <= 122 else 27 + b % 2 if 48 <= b <= 57 else 29 + b % 3 if b >= 0xC0 else 26 for b in range(256)])
_DOUBLE = SINGLES + (np.arange(SINGLES * SINGLES) * 0x9E3779B1 >> 9) % DOUBLES


class Profiles:
    """Counts of brief lines that rule out most pairs of a low edit similarity: an edit changes one character and two pairs of neighbours."""

    def __init__(self, lines: pa.StringArray):
        ends = np.frombuffer(lines.buffers()[1], np.int64 if pa.types.is_large_string(lines.type) else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        sizes, data = np.diff(ends), memoryview(lines.buffers()[2] or b"")
        brief = np.flatnonzero((sizes < BRIEF) & (sizes > 0))
        self.place = np.full(len(lines), -1)
        self.place[brief] = np.arange(len(brief))
        self.chars, self.counts = np.zeros(len(brief), np.int64), np.zeros((len(brief), SINGLES + DOUBLES), np.int16)
        for at in range(0, len(brief), 2048):
            some = brief[at : at + 2048]
            raw = b"".join([data[a:b] for a, b in zip(ends[some].tolist(), ends[some + 1].tolist())])
            body, row = np.frombuffer(raw.translate(NORMAL), np.uint8), np.repeat(np.arange(len(some)), sizes[some])
            head = np.diff(row, prepend=-1) > 0
            gap = body == 32
            kept = np.flatnonzero(~(gap & (head | np.concatenate(([True], gap[:-1])))) & ((body & 0xC0) != 0x80))
            row, kind = row[kept], _CLASS[body[kept]]
            tail = (np.diff(row, append=len(some)) > 0) & (kind == 26)  # a space at a line's end
            row, kind = row[~tail], kind[~tail]
            near = row[1:] == row[:-1]
            width = SINGLES + DOUBLES
            one, two = row * width + kind, row[1:][near] * width + _DOUBLE[kind[:-1][near] * SINGLES + kind[1:][near]]
            self.counts[at : at + len(some)] = np.bincount(np.concatenate((one, two)), minlength=len(some) * width).reshape(-1, width)
            self.chars[at : at + len(some)] = np.bincount(row, minlength=len(some))

    def may(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether the lines ``i`` and ``j`` may have the edit similarity ``least``, as far as their counts tell."""
        i, j = self.place[i], self.place[j]
        out = np.ones(len(i), bool)
        both = np.flatnonzero((i >= 0) & (j >= 0))
        for at in range(0, len(both), 4096):
            part = both[at : at + 4096]
            a, b = i[part], j[part]
            apart, more = np.abs(self.counts[a] - self.counts[b]), np.abs(self.chars[a] - self.chars[b])
            most = ((1 - least) * np.maximum(self.chars[a], self.chars[b]) + 1e-9).astype(np.int64)
            one, two = apart[:, :SINGLES].sum(axis=1, dtype=np.int64), apart[:, SINGLES:].sum(axis=1, dtype=np.int64)
            out[part] = (one + more <= 2 * most) & (two + more <= 4 * most)
        return out
