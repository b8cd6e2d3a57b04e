"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, anything but letters becomes one space, and the n-grams of one to three
characters are hashed into ``BUCKETS``. The weights are learned by follow-the-regularised-leader
with an elastic net (both penalties at once), one example at a time, and a temperature is then
fitted on labelled rows that the weights have not seen.

The model is fitted on a bounded sample of labelled rows (``sample`` distinct rows at most, dealt
evenly over the labels by a hash of id and text, one a label at least); predictions cover every row
and its whole text. Long texts are read in chunks of a million characters.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; so is every row
if there is no labelled row; rows with a null label or a null id teach nothing; repeated rows
teach once and each get their prediction; of equally likely labels the first in order is predicted; columns named as the new ones are replaced, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import slices, text_bytes

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams; none for a text without letters."""
    none = np.empty(0, np.int32), np.empty(0, np.float32)
    if not text:
        return none
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return none
    codes = np.where(is_letter, codes, np.uint32(32))
    codes = np.concatenate((np.array([32], np.uint32), codes, np.array([32], np.uint32)))
    spaces = codes == 32
    codes = codes[~(spaces & np.concatenate(([False], spaces[:-1])))]
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes) - 1, 1 << 20):  # n-grams by where they start, so that long texts need little memory
        part = codes[at : at + (1 << 20) + 2]
        one = part * np.uint32(2654435761)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
        starts = min(1 << 20, len(codes) - at)
        grams = np.concatenate((one[:starts][part[:starts] != 32], two[:starts] + np.uint32(0x9E3779B1), three[:starts] + np.uint32(0x85EBCA77)))
        mixed = (grams ^ (grams >> np.uint32(16))) * np.uint32(0x7FEB352D)
        counts += np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    own = np.flatnonzero(counts)
    return own.astype(np.int32), counts[own].astype(np.float32)


def weighted(own: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[own]
    return x / max(1e-12, float(np.sqrt((x * x).sum())))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal for multinomial logistic regression with an elastic net."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((BUCKETS + 1, classes))  # the last row is the bias
        self.n = np.zeros((BUCKETS + 1, classes))

    def weights(self, own) -> np.ndarray:
        z, n = self.z[own], self.n[own]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, own: np.ndarray, x: np.ndarray, label: int) -> None:
        own, x = np.append(own, BUCKETS), np.append(x, 1.0)
        w = self.weights(own)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        squares = g * g
        sigma = (np.sqrt(self.n[own] + squares) - np.sqrt(self.n[own])) / self.alpha
        self.z[own] += g - sigma * w
        self.n[own] += squares


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    The targets are smoothed as in Platt's method, so that rows which are all right don't ask
    for certainty.
    """
    n, kinds = logits.shape
    if not n or kinds < 2:
        return 1.0
    slack = 1 / (n + 2)
    target = np.full(logits.shape, slack / (kinds - 1))
    target[np.arange(n), labels] = 1 - slack
    loss = lambda t: -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()
    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], epochs: int = 4, seed: int = 5) -> dict:
    """A model from (label, calibrate, buckets, counts) rows.

    ``lead`` is how many times the likeliest label is as likely as the least likely one in all but the hundredth of the rows
    with the smallest leads: what the model can't tell better than these, it can't tell.
    """
    labels = sorted({r[0] for r in rows if len(r[2])})
    rows = [r for r in rows if len(r[2])]
    teach, hold = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    teach = teach or hold
    df = np.zeros(BUCKETS)
    for r in teach:
        df[r[2]] += 1
    idf = np.log((1 + len(teach)) / (1 + df)) + 1
    number = {x: i for i, x in enumerate(labels)}
    learner, rng = FollowTheLeader(max(1, len(labels))), np.random.default_rng(seed)
    ready = [(r[2], weighted(r[2], r[3], idf), number[r[0]]) for r in teach]
    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            learner.learn(*ready[i])
    w = learner.weights(np.arange(BUCKETS + 1))
    logits = np.array([weighted(r[2], r[3], idf) @ w[r[2]] + w[BUCKETS] for r in hold]).reshape(-1, max(1, len(labels)))
    model = {"labels": labels, "w": w.astype(np.float32), "idf": idf.astype(np.float32), "t": temperature(logits, np.array([number[r[0]] for r in hold], np.int64))}
    leads = [float(p.max() / p.min()) for p in (probabilities(r[2], r[3], model) for r in rows)]
    return model | {"lead": sorted(leads)[len(leads) // 100] if leads else 1.0}


def probabilities(own: np.ndarray, counts: np.ndarray, model: dict) -> np.ndarray:
    """Of each label, for a text of these features."""
    w = model["w"]
    return softmax((weighted(own, counts, model["idf"]) @ w[own] + w[BUCKETS]).astype(np.float64) / model["t"])


def predict(text: bytes | None, model: dict) -> tuple[str, float, float]:
    """The likeliest label, its probability, and that of the least likely (0 if there is but one label)."""
    own, counts = features(text)
    if not len(own) or not model["labels"]:
        return UNKNOWN, 0.0, 0.0
    p = probabilities(own, counts, model)
    best = int(p.argmax())
    return model["labels"][best], float(p[best]), float(p.min()) if len(p) > 1 else 0.0


def train(docs: DataFrame, id: str, text: str, label: str, teach: Column, calibrate: Column, sample: int = 3000) -> dict:
    """Fit on at most ``sample`` of the distinct rows for which ``teach`` holds, evenly over the labels, one a label at least."""
    draw = F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("draw")
    held = F.coalesce(calibrate, F.lit(False)).alias("calibrate")
    known = docs.filter(teach & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(label).cast("string").alias("label"), draw, held, F.col(text).alias("text"))
    sizes = known.groupBy("label").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).collect()  # one row a label
    if not sizes:
        return {"labels": []}
    each, below = max(1, sample // len(sizes)), F.lit(None).cast("long")
    for r in sizes:  # about four times the rows that are needed, and the first one for sure
        bound = max(r["least"], -(1 << 63) + int(min(1.0, 4 * each / max(1, r["n"])) * ((1 << 64) - 1)))
        below = F.when(F.col("label") == r["label"], F.lit(min(bound, (1 << 63) - 1)).cast("long")).otherwise(below)
    drawn = known.filter(F.col("draw") <= below).select("label", "draw").distinct()
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("draw"))).filter(F.col("rank") <= each).drop("rank")
    # At most `each` keys a label go to all tasks; of equal rows one is taken.
    chosen = known.join(F.broadcast(ranked), ["label", "draw"]).dropDuplicates(["label", "draw"]).select("text", "label", "calibrate")

    def gather(batches):
        for batch in batches:
            for part in slices(batch):
                found = [features(x) for x in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("calibrate"), pa.array([x.tobytes() for x, _ in found]), pa.array([x.tobytes() for _, x in found])], names=["label", "calibrate", "own", "counts"])

    got = chosen.mapInArrow(gather, "label string, calibrate boolean, own binary, counts binary").toPandas()
    rows = [(a, b, np.frombuffer(c, np.int32), np.frombuffer(d, np.float32)) for a, b, c, d in got.itertuples(index=False)]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    return fit(rows)


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``least_score``, the probability of the least likely label.

    A text of known languages, even of two at once, rules others out; one that the model knows nothing of leaves all
    labels near each other, however many there are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("lang_pred", "score", "least_score")
    schema = T.StructType(docs.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("least_score", T.DoubleType())])
    names, shared = to_arrow_schema(schema).names, docs.sparkSession.sparkContext.broadcast(model)  # buckets times labels

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                found = [predict(x, model) for x in text_bytes(part.column(text))]
                label, score, least = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(least, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)
