"""URL filter: rules on hosts and paths, and gradient-boosted trees on lexical features where no rule fits.

The host lies between the first ``://`` and the next ``/``, ``?`` or ``#`` (A-Z in lower case), the path between it and
the next ``?`` or ``#``. A rule (host, path, verdict) fits its host and all hosts below it if the path starts with its own; the longest
rule wins, of equally long ones that with the longer host, of equal ones ``block``.

The trees see a URL's lengths, depth, digit ratio, entropies, numbers of parameters, labels and hyphens, and the
statistics of its suffixes: for the last one, two and three labels of the host and for the file suffix, the
smoothed log odds of ``block`` among all labelled URLs that have it. These counts come from every
labelled row and lie in ``SLOTS`` slots by hash and ``FOLDS`` folds, so that a row that teaches meets only what
other folds know. The trees are fitted on ``sample`` labelled rows at most (by a hash of the URL and the row's
key), a quarter of which chooses their number. Slots, trees and rules travel to all tasks; the rules are checked against ``RULE_BYTES``.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is judged by the trees; rows without
a label teach nothing; repeated rows teach as often as they occur; without any labelled row, or none that is
blocked, all is allowed; of the input's columns named as new ones the new ones stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLOTS, FOLDS, RULE_BYTES = 1 << 16, 4, 64 << 20
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "host_entropy", "parameters", "labels", "hyphens", "longest_label", "suffix1", "suffix2", "suffix3", "file_suffix")
OWN = len(FEATURES) - 4
LOWER = {c: c + 32 for c in range(65, 91)}
NEW = ("host", "path", "rule", "verdict", "score")


def parts(url: str | None) -> tuple[str, str]:
    found = PARTS.search(url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


class Rules:
    """Rules by host; ``find`` walks up from a host to its last label."""

    def __init__(self, rules):
        self.by_host: dict[str, list] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host.translate(LOWER), []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | tuple[None, None]:
        best, at = None, 0
        while at >= 0:
            own = host[at:]
            for start, verdict in self.by_host.get(own, ()):
                if path.startswith(start):
                    key = (len(own) + len(start), len(own), verdict == "block")
                    if best is None or key > best[0]:
                        best = key, own + start, verdict
            at = host.find(".", at) + 1 or -1
        return best[1:] if best else (None, None)


def entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def lexical(url: str | None) -> tuple[list[float], list[int]]:
    """The URL's own features, and the slots of its suffixes (-1 where it has none)."""
    url = url or ""
    host, path = parts(url)
    labels = host.split(".") if host else []
    query = url.split("#", 1)[0].partition("?")[2]
    own = [
        len(url), len(host), len(path), sum(1 for x in path.split("/") if x), sum(c.isdigit() for c in url) / max(1, len(url)), entropy(url), entropy(host),
        sum(1 for x in query.split("&") if x), len(labels), host.count("-"), max(map(len, labels), default=0),
    ]
    slot = lambda kind, x: zlib.crc32(f"{kind}:{x}".encode("utf-8", "replace")) % SLOTS
    suffixes = [slot(n, ".".join(labels[-n:])) if len(labels) >= n else -1 for n in (1, 2, 3)]
    name, dot, ending = path.rpartition("/")[2].rpartition(".")
    return own, [*suffixes, slot("f", ending) if dot and name else -1]


def matrix(urls: list) -> tuple[np.ndarray, np.ndarray]:
    found = [lexical(u) for u in urls]
    return np.array([x for x, _ in found], np.float64).reshape(-1, OWN), np.array([x for _, x in found], np.int64).reshape(-1, 4)


def fold_of(urls: list) -> np.ndarray:
    return np.array([zlib.crc32((u or "").encode("utf-8", "replace")) % FOLDS for u in urls], np.int64)


def odds(blocked: np.ndarray, count: np.ndarray, slots: np.ndarray, prior: float, weight: float = 10.0) -> np.ndarray:
    """Smoothed log odds of each slot; those of the prior for an absent one."""
    b, n = np.where(slots >= 0, blocked[slots], 0), np.where(slots >= 0, count[slots], 0)
    return np.log((b + weight * prior) / (n - b + weight * (1 - prior)))


class Trees:
    """Boosted trees for log loss: histograms of ``BINS`` bins a feature, level by level, all of one depth."""

    BINS = 32

    def __init__(self, depth: int = 4, rate: float = 0.1, most: int = 80, l2: float = 1.0, least: float = 5.0):
        self.depth, self.rate, self.most, self.l2, self.least = depth, rate, most, l2, least
        self.base, self.features, self.thresholds, self.leaves = 0.0, [], [], []

    def _tree(self, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray) -> tuple:
        inner = (1 << self.depth) - 1
        feature, bound, threshold = np.zeros(inner, np.int64), np.full(inner, self.BINS), np.full(inner, np.inf)
        node, d = np.zeros(len(g), np.int64), binned.shape[1]
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            gain, cut = np.full((width, d), -np.inf), np.zeros((width, d), np.int64)
            for f in range(d):
                cell = (node - first) * self.BINS + binned[:, f]
                left_g, left_h = (np.cumsum(np.bincount(cell, x, width * self.BINS).reshape(width, -1), axis=1) for x in (g, h))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                value = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - all_g**2 / (all_h + self.l2)
                value[(left_h < self.least) | (right_h < self.least)] = -np.inf
                cut[:, f] = value.argmax(axis=1)
                gain[:, f] = value.max(axis=1)
            best = gain.argmax(axis=1)
            for k in range(width):  # a node that no cut betters sends all rows left
                if gain[k, best[k]] > 1e-9:
                    f, c = int(best[k]), int(cut[k, best[k]])
                    feature[first + k], bound[first + k], threshold[first + k] = f, c, edges[f][c] if c < len(edges[f]) else np.inf
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > bound[node])
        leaf, size = node - inner, 1 << self.depth
        values = -self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.l2)
        return feature, threshold, values, values[leaf]

    def fit(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> Trees:
        """``hold``: rows that don't teach but choose the number of trees."""
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(prior / (1 - prior))
        teach = ~hold
        if len(set(y[teach].tolist())) < 2:
            return self
        edges = [np.unique(np.quantile(x[teach, f], np.arange(1, self.BINS) / self.BINS, method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edges[f], x[teach, f]) for f in range(x.shape[1])], axis=1)
        z, held, best = np.full(int(teach.sum()), self.base), np.full(int(hold.sum()), self.base), (np.inf, 0)
        for _ in range(self.most):
            p = 1 / (1 + np.exp(-z))
            feature, threshold, values, step = self._tree(binned, edges, p - y[teach], p * (1 - p))
            self.features.append(feature), self.thresholds.append(threshold), self.leaves.append(values)
            z += step
            held += self._step(x[hold], -1)
            loss = float(np.logaddexp(0, np.where(y[hold] > 0, -held, held)).mean()) if len(held) else 0.0
            best = min(best, (loss, len(self.leaves))) if len(held) else (0.0, len(self.leaves))
        for kept in (self.features, self.thresholds, self.leaves):
            del kept[best[1] :]
        return self

    def _step(self, x: np.ndarray, tree: int) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.features[tree][node]] > self.thresholds[tree][node])
        return self.leaves[tree][node - (1 << self.depth) + 1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in range(len(self.leaves)):
            z += self._step(x, tree)
        return 1 / (1 + np.exp(-z))


def learn(labelled: DataFrame, url: str = "url", blocked: str = "blocked", key: str | None = None, sample: int = 20_000, lift: float = 2.0) -> dict:
    """A model from all rows with a URL and a label ``blocked`` (boolean; null teaches nothing).

    A URL is blocked at a probability of one half or more that also has ``lift`` times the odds of all labelled rows, so
    that many blocked rows alone don't block what the trees know nothing of.
    """
    row = [F.col(key).cast("string")] if key else []
    known = labelled.filter(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(F.col(url).alias("url"), F.col(blocked).alias("blocked"), F.xxhash64(F.col(url), *row).alias("draw"))

    def count(batches):
        total = np.zeros((2, FOLDS * SLOTS))
        rows = np.zeros(2)
        for batch in batches:
            urls, y = batch.column("url").to_pylist(), batch.column("blocked").to_numpy(zero_copy_only=False).astype(np.float64)
            slots, fold = matrix(urls)[1], fold_of(urls)
            rows += (y.sum(), len(y))
            for k in range(4):
                own = slots[:, k] >= 0
                cell = fold[own] * SLOTS + slots[own, k]
                total += np.stack([np.bincount(cell, y[own], FOLDS * SLOTS), np.bincount(cell, minlength=FOLDS * SLOTS)])
        full = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(total[0][full], rows[0]).astype(np.int64)), pa.array(np.append(total[1][full], rows[1]).astype(np.int64))], names=["cell", "blocked", "n"])

    b, n, all_b, all_n = np.zeros(FOLDS * SLOTS), np.zeros(FOLDS * SLOTS), 0, 0
    for r in known.mapInArrow(count, "cell long, blocked long, n long").groupBy("cell").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")).collect():  # FOLDS * SLOTS rows at most
        if r["cell"] < 0:
            all_b, all_n = r["blocked"], r["n"]
        else:
            b[r["cell"]], n[r["cell"]] = r["blocked"], r["n"]
    b, n, prior = b.reshape(FOLDS, SLOTS), n.reshape(FOLDS, SLOTS), (all_b + 0.5) / (all_n + 1)
    below = F.pmod("draw", F.lit(1 << 40)) < int(min(1.0, 2 * sample / max(1, all_n)) * (1 << 40))
    drawn = known.filter(below).orderBy("draw", "url", "blocked").limit(sample).toArrow()  # sample rows at most
    urls, y = drawn.column("url").to_pylist(), np.array(drawn.column("blocked").to_pylist(), np.float64)
    (own, slots), fold = matrix(urls), fold_of(urls)
    statistics = np.zeros((len(urls), 4))
    for k in range(FOLDS):
        rows = fold == k
        statistics[rows] = odds(b.sum(axis=0) - b[k], n.sum(axis=0) - n[k], slots[rows], prior)
    trees = Trees().fit(np.concatenate((own, statistics), axis=1), y, fold == FOLDS - 1) if len(urls) else None
    return {"trees": trees, "blocked": b.sum(axis=0), "count": n.sum(axis=0), "prior": prior, "least": 1 / (1 + min(1.0, (1 - prior) / prior / lift))}


def scores(urls: list, model: dict) -> np.ndarray:
    """The probability of ``block`` of each URL."""
    if model["trees"] is None:
        return np.zeros(len(urls))
    own, slots = matrix(urls)
    return model["trees"].predict(np.concatenate((own, odds(model["blocked"], model["count"], slots, model["prior"])), axis=1))


def judged(urls: DataFrame, rules, model: dict | None = None, url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict, score``; without a model the last two are null where no rule fits."""
    size = sum(len(x.encode()) for r in rules for x in r)
    if size > RULE_BYTES:
        raise ValueError(f"{size} bytes of rules: more than {RULE_BYTES} don't travel to every task")
    urls = urls.drop(*(n for n in NEW if n != url))
    schema = T.StructType(urls.schema.fields + [T.StructField(n, T.DoubleType() if n == "score" else T.StringType()) for n in NEW])
    names, shared = to_arrow_schema(schema).names, urls.sparkSession.sparkContext.broadcast((Rules(rules), model))

    def run(batches):
        known, model = shared.value
        for batch in batches:
            given = batch.column(url).to_pylist()
            split = [parts(u) for u in given]
            ruled = [known.find(*p) for p in split]
            score = scores(given, model).tolist() if model else [None] * len(given)
            verdicts = [v or (s is not None and ("block" if s >= model["least"] else "allow")) or None for (_, v), s in zip(ruled, score)]
            new = [[p[0] for p in split], [p[1] for p in split], [r for r, _ in ruled], verdicts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in new), pa.array(score, pa.float64())], names=names)

    return urls.mapInArrow(run, schema)
