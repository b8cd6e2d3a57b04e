"""Edit similarity of many pairs of strings at once, by a bit-parallel table over all pairs.

Most similar pairs are told without their distance: words that each string has once, in the longest
common order, are anchors, and what lies between two anchors takes as many edits as the longer side
has characters at most. If that bound doesn't decide, the distance does: after equal ends are cut off,
the shorter string of a pair lies in words of 64 bits and the longer one is read a character at a time
(Myers' recurrences, carries between the words). All words of all pairs are one flat row of a table, each word a column
behind the one above, so that a step is a few array operations whatever the lengths. Only words near the diagonal are
computed: alignments within a pair's bound stay there. A pair leaves the table as soon as its distance must exceed its bound.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np

#: Words of a table, at most; pairs that are so few that each goes alone, and words of a pair that does; cells of its characters.
MOST, FEW, LONG, CELLS = 8192, 12, 256, 1 << 22
_ONE, _TOP = np.uint64(1), np.uint64(63)
#: Words from which on only those near the diagonal are computed.
BANDED = 3
#: Columns between two looks at which pairs and words go on, at most 64.
BLOCK = 32


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance of one pair, bit-parallel over the shorter string after equal ends are cut off; ``most + 1`` if it exceeds ``most``."""
    a, b = trimmed(a, b)
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left_over, c in zip(range(len(b) - 1, -1, -1), b):
        if most is not None and not left_over & 31 and (score - left_over - 1 > most or not left_over & 255 and _far(up, down, len(a), len(b), len(b) - left_over - 1, most)):
            return most + 1
        eq = places.get(c, 0)
        upright = eq | down
        level = ((((eq & up) + up) ^ up) | eq) & full
        right, left = down | (full & ~(level | up)), up & level
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (full & ~(upright | right)), right & upright
    return score


def _far(up: int, down: int, m: int, n: int, column: int, most: int) -> bool:
    """Whether all alignments through a column must exceed ``most``: from the distances of rows some way apart near the diagonal."""
    spare, step = (most - (n - m)) // 2, max(16, most // 8)
    start, stop = max(0, column - (n - m) - spare - 1), min(m, column + spare + 1)
    part = (1 << start) - 1
    here = column + (up & part).bit_count() - (down & part).bit_count()
    if start >= stop:
        return False
    for row in range(start, stop, step):
        below = min(row + step, stop)
        part = (1 << below - row) - 1
        low = here + (up >> row & part).bit_count() - (down >> row & part).bit_count()
        if here + low - (below - row) <= 2 * most:
            return False
        here = low
    return True


def trimmed(a: str, b: str) -> tuple[str, str]:
    """The pair, shorter first, without its equal ends."""
    if len(a) > len(b):
        a, b = b, a
    start, most = 0, len(a)
    for step in (64, 8, 1):
        while start + step <= most and a[start : start + step] == b[start : start + step]:
            start += step
    end, most = 0, len(a) - start
    for step in (64, 8, 1):
        while end + step <= most and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end += step
    return a[start : len(a) - end], b[start : len(b) - end]


def _codes(strings: list[str]) -> np.ndarray:
    """Code points of all strings, one after another."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)


def _within_each(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _table(shorter: list[str], longer: list[str], bound: np.ndarray) -> np.ndarray:
    """Whether the distance of each pair is at most its bound; no string is empty, and lengths differ by the bound at most.

    Row w of a pair is its word w. In one step it takes the column that the word above took in the step before.
    """
    m, n = np.array([len(s) for s in shorter]), np.array([len(s) for s in longer])
    a, b = _codes(shorter), _codes(longer)
    count = -(-m // 64)
    seen = np.zeros(int(max(a.max(), b.max())) + 1, bool)
    seen[a] = True
    size = int(np.count_nonzero(seen)) + 1
    if len(m) > 1 and int(count.sum()) * size > CELLS:
        half = len(m) // 2
        return np.concatenate([_table(shorter[x], longer[x], bound[x]) for x in (slice(half), slice(half, None))])
    code = np.where(seen, np.cumsum(seen) - 1, size - 1)  # the last one is of no character of a shorter string
    pair, word = np.repeat(np.arange(len(m)), count), _within_each(count)
    start = np.cumsum(count) - count
    eq, place = np.zeros(len(pair) * size, np.uint64), _within_each(m)
    np.add.at(eq, (np.repeat(start, m) + (place >> 6)) * size + code[a], _ONE << (place & 63).astype(np.uint64))
    # Columns before the first and after the last have no character; before the first, they leave a word as it is.
    before = np.cumsum(n + count + BLOCK + 1) - (n + count + BLOCK + 1) + count
    read = np.full(int((n + count + BLOCK + 1).sum()), size - 1, np.int64)
    read[np.repeat(before, n) + _within_each(n)] = code[b]
    # An alignment of few edits goes so far above and below the diagonal, the difference of the lengths included.
    spare = np.where(count < BANDED, m + n, (bound - (n - m)) // 2)[pair]
    rows = np.minimum(64 * word + 64, m[pair])
    first = np.maximum(0, 64 * word - spare - 2) + word
    first[64 * word - spare - 2 <= 0] = 0
    last = np.minimum(64 * word + 66 + (n - m)[pair] + spare, n[pair]) + word
    is_last, shift = word == count[pair] - 1, ((rows - 1) & 63).astype(np.uint64)
    base, at = np.arange(len(pair)) * size, before[pair] - word
    up, down = np.full(len(pair), ~np.uint64(0)), np.zeros(len(pair), np.uint64)
    foot = rows.copy()  # the distance at a word's last row
    out_right, out_left, out_carry = np.zeros((3, len(pair)), np.uint64)
    begun, alive, out = first < BLOCK, np.ones(len(m), bool), np.zeros(len(m), bool)
    for step in range(0, int((n + count).max()), BLOCK):
        # Words that come near the diagonal: above, the distance goes on as the last row before does.
        new = np.flatnonzero(~begun & (first < step + BLOCK))
        foot[new] = foot[new - 1] - out_right[new - 1].view(np.int64) + out_left[new - 1].view(np.int64) + rows[new] - 64 * word[new]
        begun[new] = True
        act = np.flatnonzero(begun & (last >= step) & alive[pair])
        if not len(act):
            break
        if step:
            low = _least(up[act], down[act], foot[act], rows[act], 64 * word[act], (m - n)[pair[act]] + np.maximum(0, step - word[act]))
            tops = np.flatnonzero(np.diff(pair[act], prepend=-1))
            over = np.minimum.reduceat(low, tops) - 1 > bound[pair[act[tops]]]
            if over.any():
                alive[pair[act[tops[over]]]] = False
                act = act[alive[pair[act]]]
                if not len(act):
                    break
        tops = np.flatnonzero(np.diff(pair[act], prepend=-1))
        rights, lefts, carries = np.zeros((3, len(act) + 1), np.uint64)
        for x, y in ((rights, out_right), (lefts, out_left), (carries, out_carry)):
            x[1:] = y[act]
        p, q, sh, d, where, ptr = up[act], down[act], shift[act], foot[act], base[act], at[act] + step
        x, part, total, level, right, left = np.empty((6, len(act)), np.uint64)
        chars = np.empty(len(act), np.int64)
        ends: dict[int, list[int]] = {}
        for k in np.flatnonzero(is_last[act] & (n[pair[act]] - 1 + word[act] < step + BLOCK)).tolist():
            ends.setdefault(int(n[pair[act[k]]] - 1 + word[act[k]]), []).append(k)
        for now in range(step, step + BLOCK):
            # Above a pair's first word, a column more takes an edit more.
            rights[tops], lefts[tops], carries[tops] = 1, 0, 0
            read.take(ptr, out=chars, mode="clip")
            chars += where
            ptr += 1
            eq.take(chars, out=x, mode="clip")
            np.bitwise_and(x, p, out=part)
            np.add(part, p, out=total)
            total += carries[:-1]
            np.bitwise_xor(total, p, out=level)
            level |= x
            x |= q  # only now with what came down
            np.bitwise_or(level, p, out=right)
            np.invert(right, out=right)
            right |= q
            np.bitwise_and(p, level, out=left)
            np.invert(total, out=total)
            total &= p
            total |= part
            np.right_shift(total, _TOP, out=carries[1:])
            np.right_shift(right, sh, out=part)
            part &= _ONE
            np.right_shift(left, sh, out=level)
            level &= _ONE
            d += part.view(np.int64)
            d -= level.view(np.int64)
            right <<= _ONE
            right |= rights[:-1]
            left <<= _ONE
            left |= lefts[:-1]
            rights[1:], lefts[1:] = part, level
            np.bitwise_and(right, x, out=q)
            right |= x
            np.invert(right, out=right)
            np.bitwise_or(left, right, out=p)
            if now in ends:
                over = act[ends[now]]
                out[pair[over]] = d[ends[now]] <= bound[pair[over]]
                alive[pair[over]] = False
        up[act], down[act], foot[act] = p, q, d
        out_right[act], out_left[act], out_carry[act] = rights[1:], lefts[1:], carries[1:]
    return out


def _least(up: np.ndarray, down: np.ndarray, foot: np.ndarray, rows: np.ndarray, top: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """What alignments through the last columns of some words take at least: between two rows 16 apart, half the sum of their distances
    less 8, and as many edits as the rest of the pair's lengths differ (``ahead`` less the row)."""
    out, low, before = np.full(len(up), 1 << 40), foot.copy(), rows
    for k in (48, 32, 16, 0):
        part = np.uint64(0xFFFF << k)
        inner = np.minimum(top + k, rows)
        mask = np.where(rows - top >= k + 16, part, part & ((_ONE << np.maximum(rows - top, 0).astype(np.uint64) % np.uint64(64)) - _ONE))
        high = low - np.bitwise_count(up & mask) + np.bitwise_count(down & mask)
        x, y = ahead - before, ahead - inner
        rest = np.where((x < 0) == (y < 0), np.minimum(np.abs(x), np.abs(y)), 0)
        here = (low + high - (before - inner)) // 2 + rest
        np.minimum(out, np.where(rows > inner, here, out), out=out)
        low, before = high, inner
    return out


class Form:
    """A string, its words, and where those start that it has once."""

    __slots__ = ("text", "_words", "_once")

    def __init__(self, text: str):
        self.text, self._words, self._once = text, None, None

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = self.text.split(" ")
        return self._words

    @property
    def once(self) -> dict[str, int]:
        if self._once is None:
            at, places = 0, {}
            for w in self.words:
                places[w] = at
                at += len(w) + 1
            for w, n in Counter(self.words).items():
                if n > 1:
                    del places[w]
            self._once = places
        return self._once


def at_most(a: Form, b: Form, most: int) -> bool:
    """Whether the anchors show that the distance is ``most`` or less."""
    x, y = a.once, b.once
    common = sorted((x[w], y[w], w) for w in x.keys() & y.keys())
    tails, ends, before = [], [], [-1] * len(common)  # the longest run of anchors that ascends in both
    for k, (_, j, _) in enumerate(common):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
        before[k] = ends[at - 1] if at else -1
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(common[k])
        k = before[k]
    s, t, i, j, total = a.text, b.text, 0, 0, 0
    for p, q, w in [*reversed(run), (len(s), len(t), "")]:
        if p - i > 1 or q - j > 1 or not i:
            u, v = s[i:p], t[j:q]
            if u != v:
                u, v = trimmed(u, v)
                total += len(v)
                if total > most:
                    return False
        i, j = p + len(w), q + len(w)
    return True


def bound(f: Form, g: Form, least: float) -> int:
    """The most edits that a pair of edit similarity ``least`` (one less the distance by the longer length) takes."""
    return int((1 - least) * max(len(f.text), len(g.text)) + 1e-9)


def told(f: Form, g: Form, least: float) -> bool | None:
    """Whether the edit similarity is at least ``least``; None if only the distance can tell."""
    a, b, most = f.text, g.text, bound(f, g, least)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = f.words, g.words
    if len(x) == len(y) and sum([max(len(p), len(q)) for p, q in zip(x, y) if p != q]) <= most:
        return True  # word by word, it takes few enough edits
    return True if at_most(f, g, most) else None


def similar(pairs: list[tuple[Form, Form]], least: float) -> np.ndarray:
    """For each pair whether its edit similarity is at least ``least``."""
    out, todo = np.zeros(len(pairs), bool), []
    for k, (f, g) in enumerate(pairs):
        known = told(f, g, least)
        if known is None:
            todo.append(k)
        else:
            out[k] = known
    out[todo] = within([pairs[k] for k in todo], least)
    return out


def within(pairs: list[tuple[Form, Form]], least: float) -> np.ndarray:
    """As ``similar``, by the distances of all pairs."""
    out, todo = np.zeros(len(pairs), bool), []
    for k, (f, g) in enumerate(pairs):
        a, b = trimmed(f.text, g.text)
        most = bound(f, g, least)
        if not a:
            out[k] = len(b) <= most
        elif len(b) - len(a) <= most:
            todo.append((len(b), k, a, b, most))
    todo.sort(key=lambda t: t[:2])
    at = 0
    while at < len(todo):
        stop, words = at, 0
        # Pairs of near lengths share a table; while they are few, of up to twice the length.
        while stop < len(todo) and words < MOST and todo[stop][0] <= (2 if stop - at < 4 * FEW else 1.25) * todo[at][0] + 64:
            words += -(-len(todo[stop][2]) // 64)
            stop += 1
        part = todo[at:stop]
        if len(part) < FEW or len(part[-1][2]) > 64 * LONG:
            got = [distance(t[2], t[3], t[4]) <= t[4] for t in part]
        else:
            got = _table([t[2] for t in part], [t[3] for t in part], np.array([t[4] for t in part]))
        out[[t[1] for t in part]] = got
        at = stop
    return out
