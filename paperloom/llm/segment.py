"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations.

The best encoding is the model's own, worked out once for each distinct unit of a text. Sampled
segmentations follow the unigram weights of the vocabulary over the lattice of all segmentations
of the whole text. Forward sums over the lattice give the exact mass of every set of paths that
share their first choices, so a perturbed A-star search needs no bound that is loose: the best
path of the whole is drawn together with its Gumbel value; what differs from it first at its i-th
choice is a set whose value is a Gumbel of that set's mass, truncated at the value of the path; the
set of the highest value is opened next, and so on. The paths so found are the ``k`` of highest
value among all: a sample without replacement, distinct by construction. The value that comes
next tells each path's inclusion probability, whose logarithm is its score.

Random numbers are hashes of the row's key, the number of the draw and the place, so they depend
neither on the order of rows nor on batches.

Defined cases: a null or empty text has no tokens and no samples; a text with fewer than ``k``
segmentations gives them all, with inclusion one; characters outside the vocabulary are UTF-8 byte
pieces; U+2581 decodes to a space; rows with equal keys and texts draw equal samples; columns of
the new names are replaced; an empty table gives an empty one. Of equally good segmentations the model's
own choice is the encoding. A very long text is worked on as a part of its own, with about 100 bytes
for each of its characters.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import list_array
from paperloom.llm.pieces import SPACE, Vocabulary, vocabulary

#: Lattice places (characters of distinct units) that a worker keeps for the next rows, about 90 bytes each.
KEPT_PLACES = 1_000_000


def uniform(key: np.ndarray, draw: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by a 64-bit mix of key, draw and place."""
    x = key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((draw + 1) * 0xD1B54A32D192ED03 & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Numbers(dict):
    """Consecutive numbers of units; ``new`` has those numbered lately."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Pool:
    """An array that grows at its end; room that isn't used yet takes no memory."""

    def __init__(self, kind, room: int, first=()):
        self.all = np.empty(max(room, len(first)), kind)
        self.all[: len(first)] = first
        self.n = len(first)

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.all):
            self.all = np.concatenate((self.all[: self.n], np.empty(2 * end - self.n, self.all.dtype)))
        self.all[self.n : end] = values
        self.n = end

    @property
    def now(self) -> np.ndarray:
        return self.all[: self.n]


class Lattices:
    """Lattices of distinct units. A place is the end of one of a unit's characters.

    The edges of place p, ``edge_from[p]`` to ``edge_from[p + 1]``, are the pieces that end there:
    how many characters each goes back, its pieces, and its probability given that place.
    """

    def __init__(self, vocab: Vocabulary, alpha: float = 1.0, kept: int = KEPT_PLACES):
        self.vocab, self.alpha, self.kept = vocab, alpha, kept
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.chars = 0
        room = self.kept + (1 << 20)
        self._last, self._sizes = Pool(np.int64, room // 4), Pool(np.int32, room // 4)  # of each unit: its last place, its characters
        self._edge_from = Pool(np.int64, room, [0])
        self._back, self._piece = Pool(np.int16, 4 * room), Pool(np.int32, 4 * room)
        self._log_p, self._upto = Pool(np.float64, 4 * room), Pool(np.float32, 4 * room)
        self._best, self._best_from = Pool(np.int32, room), Pool(np.int64, room // 4, [0])
        self._look()
        # Characters of several bytes that have no piece: their bytes' pieces, numbered on from the vocabulary.
        self.byte_number: dict[str, int] = {}
        self.byte_pieces, self.byte_from = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _look(self) -> None:
        self.last, self.sizes, self.edge_from, self.back = self._last.now, self._sizes.now, self._edge_from.now, self._back.now
        self.piece, self.log_p, self.upto, self.best, self.best_from = self._piece.now, self._log_p.now, self._upto.now, self._best.now, self._best_from.now

    def learn(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the units of each text; new ones are added, all at once."""
        if self.chars > self.kept:
            self.clear()
        look_up = self.number.__getitem__
        numbers = [np.fromiter(map(look_up, t), np.int64, len(t)) for t in texts]
        new = self.number.new
        if new:
            self._add(new)
            new.clear()
        return numbers

    def _add(self, new: list[str]) -> None:
        best, counts = self.vocab.encode_units(new)
        self._best.add(best)
        self._best_from.add(self._best_from.now[-1] + np.cumsum(counts))

        text = "".join(new).replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        parts = list(self.vocab.edges(codes, place))
        alone = np.ones(len(codes), bool)
        for at, n, _ in parts:
            if n == 1:
                alone[at] = False
        alone = np.flatnonzero(alone)
        weights = self.alpha * self.vocab.weights
        counts = np.bincount(np.concatenate([alone, *(at for at, _, _ in parts)]), minlength=len(codes))
        edge_from = np.concatenate(([0], np.cumsum(counts)))
        filled, total = edge_from[:-1].copy(), int(edge_from[-1])
        back, piece, score = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        if len(alone):
            by_code = {c: self._bytes(chr(c)) for c in np.unique(codes[alone]).tolist()}
            found = [by_code[c] for c in codes[alone].tolist()]
            own = filled[alone]
            back[own], piece[own], score[own] = 1, [p for p, _ in found], [w for _, w in found]
            filled[alone] += 1
        for at, n, ids in parts:
            own = filled[at]
            back[own], piece[own], score[own] = n, ids, weights[ids]
            filled[at] += 1
        self._last.add(self.chars + starts + lengths - 1)
        self._sizes.add(lengths)
        self._sum_up(starts, lengths, edge_from, back, piece, score)
        self.chars += len(codes)
        self._look()

    def _bytes(self, char: str) -> tuple[int, float]:
        """The piece, real or numbered on, and the weight of a character that has none of its own."""
        ids = self.vocab.fallback(char)
        weight = self.alpha * float(self.vocab.weights[ids].sum())
        if len(ids) == 1:
            return ids[0], weight
        if char not in self.byte_number:
            self.byte_number[char] = len(self.byte_number)
            self.byte_pieces = np.concatenate((self.byte_pieces, ids))
            self.byte_from = np.append(self.byte_from, len(self.byte_pieces))
        return len(self.vocab.weights) + self.byte_number[char], weight

    def _sum_up(self, starts, lengths, edge_from, back, piece, score) -> None:
        """Forward sums over the new units, all their k-th places at once, and edge probabilities."""
        counts = np.diff(edge_from)
        forward, log_p, upto = np.zeros(len(counts)), np.empty(len(piece)), np.empty(len(piece), np.float32)
        order = np.argsort(-lengths, kind="stable")
        alive, ordered, begins = len(order), lengths[order], starts[order]
        for k in range(int(lengths.max(initial=0))):
            alive = int(np.searchsorted(-ordered, -k, side="left"))
            places = begins[:alive] + k
            n = counts[places]
            heads = np.cumsum(n) - n
            edges = np.arange(int(n.sum())) + np.repeat(edge_from[places] - heads, n)
            steps = back[edges]
            whole = score[edges]
            if k:
                inner = forward[np.maximum(np.repeat(places, n) - steps, 0)]
                inner[steps > k] = 0.0
                whole += inner
            top = np.maximum.reduceat(whole, heads)
            mass = np.exp(whole - np.repeat(top, n))
            total = np.add.reduceat(mass, heads)
            forward[places] = ends = top + np.log(total)
            log_p[edges] = whole - np.repeat(ends, n)
            share, sums, some, j = mass / np.repeat(total, n), np.zeros(len(n)), np.arange(len(n)), 0
            while len(some):  # the j-th edge of each place; no sum depends on other places
                sums[some] += share[heads[some] + j]
                upto[edges[heads[some] + j]] = sums[some]
                j += 1
                some = some[n[some] > j]
        upto[edge_from[1:] - 1] = 2.0  # more than any random number
        self._edge_from.add(self._edge_from.now[-1] + edge_from[1:])
        for pool, values in ((self._back, back), (self._piece, piece), (self._log_p, log_p), (self._upto, upto)):
            pool.add(values)

    def best_ids(self, numbers: np.ndarray) -> np.ndarray:
        starts = self.best_from[numbers]
        n = self.best_from[numbers + 1] - starts
        return self.best[spread(starts, n)]

    def walk(self, place: np.ndarray, left: np.ndarray, key: np.ndarray, draw: int, seat: np.ndarray):
        """Paths from each place to its unit's start: (walk, edge) pairs in the order of choice.

        ``left`` is how many characters there are to go, ``seat`` the walk's place in its row.
        """
        who, edges = [], []
        now = np.flatnonzero(left > 0)
        place, left, key, seat = place[now], left[now], key[now], seat[now].astype(np.int64) << 20
        while len(now):
            u = uniform(key, draw, seat + left)
            e = self.edge_from[place]
            on = np.flatnonzero(self.upto[e] < u)
            while len(on):
                e[on] += 1
                on = on[self.upto[e[on]] < u[on]]
            who.append(now)
            edges.append(e)
            back = self.back[e]
            left = left - back
            more = np.flatnonzero(left > 0)
            now, left, place, key, seat = now[more], left[more], (place - back)[more], key[more], seat[more]
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, edges = np.concatenate(who), np.concatenate(edges)
        order = np.argsort(who, kind="stable")
        return who[order], edges[order]

    def piece_lengths(self, pieces: np.ndarray) -> np.ndarray:
        """Of how many pieces each one stands for."""
        size = len(self.vocab.weights)
        n, odd = np.ones(len(pieces), np.int64), np.flatnonzero(pieces >= size)
        which = pieces[odd] - size
        n[odd] = self.byte_from[which + 1] - self.byte_from[which]
        return n

    def expand(self, pieces: np.ndarray) -> np.ndarray:
        """Pieces, with each that is numbered on replaced by its bytes' pieces."""
        size = len(self.vocab.weights)
        odd = np.flatnonzero(pieces >= size)
        if not len(odd):
            return pieces
        n, which = self.piece_lengths(pieces), pieces[odd] - size
        out = np.repeat(pieces.astype(np.int64), n)
        out[spread((np.cumsum(n) - n)[odd], n[odd])] = self.byte_pieces[spread(self.byte_from[which], n[odd])]
        return out


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of each."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def truncated(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values of ``location``, given that they are below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = -np.logaddexp(-bound, np.log(-np.log(u)) - location)
    return np.where(np.isneginf(location), -np.inf, out)


def log_inclusion(log_p: float, next_value: float) -> float:
    """log(1 - exp(-exp(log_p - next_value)))."""
    x = log_p - next_value
    return 0.0 if x > 4 else float(x) if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


#: Choices of a path at which the sets that leave it are told apart at once; the rest is one set.
FRONT = 32


def draw_samples(lattices: Lattices, numbers: list[np.ndarray], lengths: list[np.ndarray], keys: np.ndarray, k: int, front: int = FRONT) -> list[list[dict]]:
    """The ``k`` segmentations of highest perturbed value of each text, all texts a round at once.

    ``numbers`` and ``lengths`` are those of each text's units.
    """
    l = lattices  # noqa: E741
    rows = [r for r, n in enumerate(numbers) if len(n)] if k else []
    found: list[list[dict]] = [[] for _ in numbers]
    if not rows:
        return found
    last = {r: l.last[numbers[r]] for r in rows}
    one = keys[rows]
    value = dict(zip(rows, (-np.log(-np.log(uniform(one, 10_000, np.zeros(len(one), np.int64))))).tolist()))
    sizes = np.array([len(numbers[r]) for r in rows])
    who, edges = l.walk(np.concatenate([last[r] for r in rows]), np.concatenate([lengths[r] for r in rows]), np.repeat(one, sizes), 0, np.concatenate([np.arange(n) for n in sizes]))
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(who, np.concatenate(([0], ends)))
    now = {r: (who[a:b] - (e - n), edges[a:b], {}) for r, a, b, e, n in zip(rows, cuts[:-1], cuts[1:], ends, sizes)}
    paths: dict[int, list[Path]] = {r: [] for r in rows}
    for draw in range(k):
        ids = _pieces(l, now)
        wanted, following = [], {}
        for r, path in _opened(l, now, last, keys, value, draw, front).items():
            found[r].append({"ids": ids[r], "log_p": path.log_p, "value": value[r]})
            paths[r].append(path)
            best = max(paths[r], key=lambda p: p.top)
            if draw == k - 1 or best.top == -np.inf:
                for f in found[r]:
                    f["log_inclusion"] = 0.0 if best.top == -np.inf else log_inclusion(f["log_p"], best.top)
                continue
            # The set of the highest value: paths that share the first i choices of ``best`` and not the next.
            value[r] = best.top
            i, p, u, out = best.leave()
            options = [e for e in range(int(l.edge_from[p]), int(l.edge_from[p + 1])) if e not in out]
            weights = np.cumsum(np.exp(l.log_p[options]))
            x = float(uniform(keys[r : r + 1], 30_000 + draw, np.zeros(1, np.int64))[0]) * weights[-1]
            chosen = options[min(int(np.searchsorted(weights, x)), len(options) - 1)]
            places, left = last[r][u:].copy(), lengths[r][u:].copy()
            done = int(last[r][u]) - p + int(l.back[chosen])
            places[0] -= done
            left[0] -= done
            wanted.append((r, places, left, u))
            following[r] = (best.unit[:i], best.edge[:i], u, chosen, {i: out})
        if not wanted:
            break
        sizes = np.array([len(w[1]) for w in wanted])
        seats = np.concatenate([np.arange(w[3], w[3] + n) for w, n in zip(wanted, sizes)])
        who, edges = l.walk(np.concatenate([w[1] for w in wanted]), np.concatenate([w[2] for w in wanted]), np.repeat(keys[[w[0] for w in wanted]], sizes), 40_000 + draw, seats)
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(who, np.concatenate(([0], ends)))
        now = {}
        for (r, _, _, _), a, b, e, n in zip(wanted, cuts[:-1], cuts[1:], ends, sizes):
            unit, edge, u, chosen, barred = following[r]
            now[r] = (np.concatenate((unit, [u], who[a:b] - (e - n) + u)), np.concatenate((edge, [chosen], edges[a:b])), barred)
    return found


class Path:
    """A path of the search and the sets of paths that leave it.

    ``values[j]`` is the highest perturbed value among the paths that share the first
    ``start + j`` choices and not the next (nor what is barred there); ``rest`` is that of all paths
    that share ``start + len(values)`` choices, but this one. The mass of ``rest`` is nearly always tiny.
    """

    def __init__(self, l, last, unit, edge, barred, key, draw, start, log_p, values, rest):  # noqa: E741
        self.l, self.last, self.unit, self.edge, self.barred, self.key, self.draw = l, last, unit, edge, barred, key, draw
        self.start, self.log_p, self.values, self.rest = start, log_p, values, rest
        self._rank()

    def _rank(self) -> None:
        self.top = max(float(self.values.max(initial=-np.inf)), self.rest)

    def _locations(self, start: int, n: int) -> tuple[np.ndarray, float]:
        """Log masses of the sets that leave at ``n`` choices from ``start`` on, where none is barred, and of sharing all those."""
        l = self.l  # noqa: E741
        edge = self.edge[start : start + n]
        steps = l.log_p[edge]
        shared = float(np.add.reduce(l.log_p[self.edge[:start]])) if start else 0.0
        before = shared + np.concatenate(([0.0], np.cumsum(steps)))
        free = -np.expm1(np.minimum(steps, 0.0))
        free[steps == 0.0] = 0.0
        with np.errstate(divide="ignore"):
            return before[:-1] + np.log(free), float(before[-1])

    def leave(self) -> tuple[int, int, int, list[int]]:
        """Take the set of the highest value: its choice, place and unit, and the edges barred there."""
        if self.rest == self.top:  # tell apart what was one set; the set that has its value is drawn by mass
            start = self.start + len(self.values)
            location, _ = self._locations(start, len(self.edge) - start)
            mass = np.cumsum(np.exp(location - location.max()))
            x = float(uniform(self.key, 60_000 + self.draw, np.array([start]))[0]) * mass[-1]
            first = min(int(np.searchsorted(mass, x)), len(mass) - 1)
            more = truncated(location, self.rest, uniform(self.key, 70_000 + self.draw, np.arange(len(location))))
            more[first] = self.rest
            self.values, self.rest = np.concatenate((self.values, more)), -np.inf
        j = int(self.values.argmax())
        self.values[j] = -np.inf
        self._rank()
        i = self.start + j
        return i, _place(self.l, self.last, self.unit, self.edge, i), int(self.unit[i]), [int(self.edge[i]), *self.barred.get(i, [])]


def _opened(l: Lattices, now: dict, last: dict, keys: np.ndarray, value: dict, draw: int, front: int) -> dict[int, Path]:  # noqa: E741
    """The path of each row with the highest values of the sets that leave it, for all rows at once."""
    rows = list(now)
    n = np.array([len(now[r][1]) for r in rows])
    begins = np.cumsum(n) - n
    edge = np.concatenate([now[r][1] for r in rows])
    steps = l.log_p[edge]
    log_p = np.add.reduceat(steps, begins)
    # Before the choice where a path left its parent all sets are the parent's.
    start = np.array([min(now[r][2], default=0) for r in rows])
    shared = np.array([float(np.add.reduce(steps[a : a + s])) if s else 0.0 for a, s in zip(begins.tolist(), start.tolist())])
    place = start[:, None] + np.arange(front)
    inside = place < n[:, None]
    first = np.where(inside, steps[np.minimum(begins[:, None] + place, len(steps) - 1)], 0.0)
    before = np.concatenate((np.zeros((len(rows), 1)), np.cumsum(first, axis=1)), axis=1) + shared[:, None]
    free = np.where(inside & (first < 0), -np.expm1(first), 0.0)
    for k, r in enumerate(rows):
        if now[r][2]:
            free[k, 0] = _unbarred(l, last[r], *now[r])
    with np.errstate(divide="ignore", invalid="ignore"):
        location = before[:, :-1] + np.log(free)
        left = np.where(log_p < before[:, -1], before[:, -1] + np.log1p(-np.exp(np.minimum(log_p - before[:, -1], -1e-300))), -np.inf)
    bound = np.array([value[r] for r in rows])
    one = keys[rows]
    values = truncated(location, bound[:, None], uniform(one[:, None], 20_000 + draw, place))
    rest = np.where(n > start + front, truncated(left, bound, uniform(one, 50_000 + draw, np.zeros(len(rows), np.int64))), -np.inf)
    size = np.minimum(front, n - start)
    return {r: Path(l, last[r], *now[r], one[k : k + 1], draw, int(start[k]), float(log_p[k]), values[k, : size[k]].copy(), float(rest[k])) for k, r in enumerate(rows)}


def _place(l: Lattices, last: np.ndarray, unit: np.ndarray, edge: np.ndarray, i: int) -> int:  # noqa: E741
    """The place at which choice i was made: the unit's last, less what the choices before took of it."""
    p, j = int(last[unit[i]]), i - 1
    while j >= 0 and unit[j] == unit[i]:
        p -= int(l.back[edge[j]])
        j -= 1
    return p


def _unbarred(l: Lattices, last: np.ndarray, unit: np.ndarray, edge: np.ndarray, barred: dict) -> float:  # noqa: E741
    """The probability of the choices that neither a path nor what is barred with it takes, at the first barred choice."""
    i = min(barred)
    p = _place(l, last, unit, edge, i)
    if int(l.edge_from[p + 1] - l.edge_from[p]) <= 1 + len(barred[i]):
        return 0.0
    return max(0.0, 1.0 - float(np.exp(l.log_p[[edge[i], *barred[i]]]).sum()))


def _pieces(l: Lattices, now: dict) -> dict[int, np.ndarray]:  # noqa: E741
    """The piece ids of each row's path in the order of the text."""
    rows = list(now)
    n = np.array([len(now[r][1]) for r in rows])
    unit, edge = np.concatenate([now[r][0] for r in rows]), np.concatenate([now[r][1] for r in rows])
    turn = np.concatenate(([True], unit[1:] != unit[:-1]))
    turn[(np.cumsum(n) - n)[1:]] = True
    turn = np.flatnonzero(turn)
    size = np.diff(np.append(turn, len(unit)))
    back_to_front = np.repeat(2 * turn + size - 1, size) - np.arange(len(unit))  # within a unit pieces were chosen from its end
    pieces = l.piece[edge[back_to_front]].astype(np.int64)
    ends = np.cumsum(l.piece_lengths(pieces))[np.cumsum(n) - 1]
    ids = l.expand(pieces)
    return {r: ids[a:b] for r, a, b in zip(rows, np.concatenate(([0], ends[:-1])), ends)}


def by_size(batch: pa.RecordBatch, text: str, rows: int = 256, size: int = 400_000):
    """``batch`` in parts of ``rows`` at most, and of ``size`` bytes of text unless a row alone has more."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for at, n in enumerate(lengths):
        if at > start and (total + n > size or at - start == rows):
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def row_keys(column: pa.Array, seed: int) -> np.ndarray:
    """A key for each row's id; all null ids have one."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(str(x), seed) for x in column.to_pylist()], np.uint64)


SAMPLE = "struct<ids:array<int>,log_prob:double,value:double,log_inclusion:double>"


def encode(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", samples: int = 2, alpha: float = 1.0, seed: int = 1, kept: int = KEPT_PLACES) -> DataFrame:
    """``docs`` with ``ids`` (the model's encoding), ``decodes`` and ``samples``.

    ``decodes`` tells whether ``ids`` decode to the text's bytes. Samples come in descending order
    of their perturbed ``value``; ``alpha`` sharpens (above one) or flattens the weights. ``kept``
    trades a worker's memory for time, and changes no result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(os.fspath(model_path), "rb") as f:  # on the driver; the file is sent to the executors
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "decodes", "samples")
    schema = T.StructType(docs.schema.fields + T._parse_datatype_string(f"ids array<int>, decodes boolean, samples array<{SAMPLE}>").fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        lattices = Lattices(vocabulary(shared), alpha, kept)
        for batch in batches:
            for part in by_size(batch, text):
                texts, keys = part.column(text).to_pylist(), row_keys(part.column(id), seed)
                numbers = lattices.learn([lattices.vocab.units(t) for t in texts])
                lengths = [lattices.sizes[n] for n in numbers]
                got = draw_samples(lattices, numbers, lengths, keys, samples)
                best, right, drawn, drawn_counts = [], [], [x for g in got for x in g], [len(g) for g in got]
                for k, t in enumerate(texts):
                    ids = lattices.best_ids(numbers[k])
                    best.append(ids)
                    right.append(lattices.vocab.decode(ids) == (t or "").replace(SPACE, " ").encode())
                whole = lambda xs: pa.array(np.concatenate(xs).astype(np.int32) if xs else np.zeros(0, np.int32))
                each = list_array([len(s["ids"]) for s in drawn], whole([s["ids"] for s in drawn]))
                fields = [each, *(pa.array([s[x] for s in drawn], pa.float64()) for x in ("log_p", "value", "log_inclusion"))]
                listed = list_array(drawn_counts, pa.StructArray.from_arrays(fields, ["ids", "log_prob", "value", "log_inclusion"]))
                yield pa.RecordBatch.from_arrays([*part.columns, list_array([len(b) for b in best], whole(best)), pa.array(right), listed], names=arrow.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of ``ids``; null for a null list, U+FFFD for bytes that aren't UTF-8."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(os.fspath(model_path), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(to)
    schema = T.StructType(docs.schema.fields + [T.StructField(to, T.StringType())])
    names = to_arrow_schema(schema).names

    def run(batches):
        vocab = vocabulary(shared)
        for batch in batches:
            lists = batch.column(ids)
            texts = [vocab.decode(x.values.to_numpy().astype(np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return docs.mapInArrow(run, schema)
