"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of the lower-cased text (A-Z only), then one end token. The model's symbols
are the end, the most frequent training words, and kinds of other words, told apart by a hash of
their last three bytes. There are ``WORDS`` times the fifth root of the training tokens of words, ``LEAST`` at least, and
a quarter as many kinds, so what is learned of pairs grows with the input. A token's probability is the model's probability of
its symbol after the symbol before, times, for a kind, the smoothed share of the word within its
kind (with one unseen word in each kind), so the probabilities of all words sum to one.

Learning reads all training rows: word counts (one row a word, never gathered), and counts of
symbol pairs, which are as many as the model has cells. On these pairs the parameters (one vector
a symbol, a context matrix, biases) are trained in numpy by noise-contrastive estimation, with
unigram noise taken in expectation and a Gaussian prior on the vectors. Batched matrix products then give each symbol's
normaliser; a score is a product of two vectors less that. The driver holds all cells, the tasks vectors only. While scoring, the ``KNOWN`` most frequent words are looked up on the spot; all
others are joined with the word counts.

Defined cases: a null text is an empty one, of one token; rows with a null id are scored, but
teach nothing and aren't held out; without any training row every word is unseen; repeated
rows each get a score; other columns don't matter; an empty table gives an empty one. Of words of
equal count the first in order of their bytes is the more frequent one. A very long text is held
whole, with its list of words.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LOWER, list_array, slices, stored, text_bytes, with_row

WORDS, LEAST, KNOWN, SIZE = 49, 1024, 100_000, 32
#: Words that a task counts before it hands its counts on.
HELD = 400_000
#: Tokens whose pairs a task counts at once, and tokens scored at once.
PAIRS, SCORED = 1 << 22, 1 << 14
SMOOTH = 0.1


def tokens(text: bytes | None) -> list[bytes]:
    """The words; the end token is left to the caller."""
    return text.translate(LOWER).split() if text else []


def kind(word: bytes, kinds: int) -> int:
    return zlib.crc32(word[-3:]) % kinds


class Numbers(dict):
    """Numbers of known words; any other word has its kind, counted on from ``first``."""

    def __init__(self, words: list[bytes], first: int, kinds: int):
        super().__init__((w, i) for i, w in enumerate(words))
        self.first, self.kinds, self.room = first, kinds, len(words) + HELD

    def __missing__(self, word: bytes) -> int:
        n = self.first + kind(word, self.kinds)
        if len(self) < self.room:
            self[word] = n
        return n


def symbols(n_tokens: int) -> tuple[int, int]:
    """How many words and kinds the model tells apart, by the number of training tokens."""
    n = max(LEAST, round(WORDS * n_tokens**0.2))
    return n, n // 4


def count_words(docs: DataFrame, text: str, held_most: int = HELD) -> DataFrame:
    """``word, c``; the end token is the empty word."""

    def run(batches):
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in slices(batch):
                for x in text_bytes(part.column(0)):
                    held.update(tokens(x))
                held[b""] += part.num_rows
                if len(held) >= held_most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def count_pairs(docs: DataFrame, text: str, words: list[bytes], kinds: int) -> np.ndarray:
    """How often each symbol follows each symbol, over all rows."""
    size = 1 + len(words) + kinds
    shared = docs.sparkSession.sparkContext.broadcast(words)  # as many as the model has

    def run(batches):
        numbers, held, n = Numbers([b"", *shared.value], 1 + len(shared.value), kinds), [], 0

        def counted():
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times.astype(np.int64))], names=["cell", "n"])

        for batch in batches:
            for part in slices(batch):
                line = [0]
                for x in text_bytes(part.column(0)):
                    line += map(numbers.__getitem__, tokens(x))
                    line.append(0)
                line = np.array(line, np.int64)
                held.append(line[:-1] * size + line[1:])
                n += len(line)
                if n >= PAIRS:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    got = docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # size * size rows at most
    out = np.zeros(size * size, np.int64)
    for part in got.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.reshape(size, size)


def train(pairs: np.ndarray, size: int = SIZE, noise: int = 25, steps: int = 200, rate: float = 0.05, decay: float = 30.0, seed: int = 3) -> dict:
    """Vectors, context matrix and biases by noise-contrastive estimation on the pair counts."""
    rng, n = np.random.default_rng(seed), len(pairs)
    total = max(1, pairs.sum())
    joint = (pairs / total).astype(np.float32)
    before = joint.sum(axis=1, keepdims=True)
    unigram = (pairs.sum(axis=0) + SMOOTH) / (total + SMOOTH * n)
    drawn = (noise * before * unigram).astype(np.float32)
    log_noise = np.log(noise * unigram).astype(np.float32)
    p = {"r": rng.normal(0, 0.1, (n, size)), "c": np.eye(size) + rng.normal(0, 0.01, (size, size)), "b": np.log(unigram)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    real, both = np.empty_like(joint), joint + drawn
    for step in range(1, steps + 1):
        said = p["r"] @ p["c"]
        np.matmul(said, p["r"].T, out=real)
        real += p["b"] - log_noise
        np.clip(real, -30, 30, out=real)
        np.exp(np.negative(real, out=real), out=real)
        real += 1
        np.divide(both, real, out=real)  # the chance that a cell's pair is a real one, times how often it is met
        g = np.subtract(joint, real, out=real)  # of the objective by each score
        back = g @ p["r"]
        grad = {"r": g.T @ said + back @ p["c"].T, "c": p["r"].T @ back, "b": g.sum(axis=0)}
        grad["r"] -= decay / total * p["r"]
        grad["c"] -= decay / total * (p["c"] - np.eye(size, dtype=np.float32))
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, v in grad.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            p[k] += now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return p


def table(p: dict) -> np.ndarray:
    """log10 probability of each symbol after each symbol; every row's probabilities sum to one."""
    r, c = p["r"].astype(np.float64), p["c"].astype(np.float64)
    out = r @ c @ r.T
    out += p["b"]
    for at in range(0, len(out), 256):
        rows = out[at : at + 256]
        rows -= rows.max(axis=1, keepdims=True)
        rows -= np.log(np.exp(rows).sum(axis=1, keepdims=True))
    out /= np.log(10)
    return out


def vectors(p: dict, of_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol what it says as the one before and as the one after: their product is the table's cell.

    Two more places hold the bias and the normaliser.
    """
    said = (p["r"].astype(np.float64) @ p["c"].astype(np.float64)) / np.log(10)
    after = np.column_stack((p["r"].astype(np.float64), p["b"].astype(np.float64) / np.log(10), np.ones(len(said))))
    norm = of_pairs[:, 0] - said @ after[0, :-2] - after[0, -2] if len(said) else np.zeros(0)
    return np.column_stack((said, np.ones(len(said)), norm)), after


def _most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words of the highest counts, ``most`` at most, in descending order, and their counts.

    Where the cut is, is told by the numbers of words in narrow bands of the count, so tasks send
    nothing but what is kept.
    """
    band = F.floor(F.log2("c") * 64)
    sizes = sorted(((r["band"], r["n"]) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 4096 bands at most
    room, least = most, None
    for at, n in sizes:
        room -= n
        if room < 0:
            break
        least = at
    if least is None:
        return [], np.zeros(0, np.int64)
    got = counts.filter(band >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return got.column("word").to_pylist(), got.column("c").to_numpy()


def learn(docs: DataFrame, text: str = "text", n_words: int | None = None, n_kinds: int | None = None, n_known: int = KNOWN, held_most: int = HELD) -> dict:
    """The model from all rows of ``docs``. ``counts`` is the stored table of word counts.

    Words and kinds are as many as ``symbols`` says where their numbers aren't given.
    """
    counts = stored(count_words(docs, text, held_most), "words")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    by_size = symbols(int(sums["n"] or 0))
    n_words, n_kinds = (own if given is None else given for own, given in zip(by_size, (n_words, n_kinds)))
    known, c = _most_frequent(counts.filter(F.length("word") > 0), max(n_known, n_words))
    words = known[:n_words]
    rest = counts.filter(F.length("word") > 0)
    if words:
        last, at = int(c[len(words) - 1]), words[-1]
        rest = rest.filter((F.col("c") < last) | ((F.col("c") == last) & (F.col("word") > F.lit(bytearray(at)))))
    of = F.crc32(F.substring("word", -3, 3)) % n_kinds
    kinds = rest.groupBy(of.cast("int").alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # a row a kind
    share = np.full(n_kinds, SMOOTH)  # what the smoothed counts of a kind's words sum to, the unseen word included
    for r in kinds:
        share[r["kind"]] = r["n"] + SMOOTH * (r["v"] + 1)
    end = counts.filter(F.length("word") == 0).select("c").first()
    pairs = count_pairs(docs, text, words, n_kinds)
    p = train(pairs)
    return {
        "counts": counts, "n": int(sums["n"] or 0), "v": sums["v"], "end": int(end["c"]) if end else 0,
        "known": known, "c": c, "words": words, "share": share, "pairs": pairs, "table": (of_pairs := table(p)), "vectors": vectors(p, of_pairs),
    }


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` for each row; scores are log10."""
    sent = {k: model[k] for k in ("known", "c", "share", "vectors", "end")} | {"words": len(model["words"])}
    shared = docs.sparkSession.sparkContext.broadcast(sent)  # words and vectors, a few a symbol
    rows = with_row(docs.select(F.col(id).alias("id"), F.col(text).alias("text")))

    def run(batches):
        m = shared.value
        known, first, n_kinds = len(m["known"]) + 1, 1 + m["words"], len(m["share"])
        numbers = Numbers([b"", *m["known"]], known, n_kinds)
        (before, after), base = m["vectors"], np.log10(np.concatenate(([m["end"]], m["c"])) + SMOOTH)
        there = np.concatenate(([m["end"]], m["c"])) > 0
        kinds = np.array([kind(w, n_kinds) for w in m["known"][m["words"] :]], np.int64)
        symbol = np.concatenate((np.arange(min(first, known)), first + kinds, first + np.arange(n_kinds)))
        within = np.zeros(len(symbol))  # besides the symbol, what a known word adds, and what a kind takes off
        rare = symbol >= first
        within[rare] = -np.log10(m["share"][symbol[rare] - first])
        within[first:known] += base[first:known]
        for batch in batches:
            for part in slices(batch):
                out, others, lengths = [], [], []
                for x in text_bytes(part.column("text")):
                    words = tokens(x)
                    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    at = np.append(at, 0)
                    s = symbol[at]
                    here = at < known
                    more = np.flatnonzero(~here)
                    others += [words[i] for i in more.tolist()]
                    lengths.append(len(more))
                    came = np.concatenate(([0], s[:-1]))
                    said = sum(float(np.vdot(before[came[i : i + SCORED]], after[s[i : i + SCORED]])) for i in range(0, len(s), SCORED))
                    out.append((len(at), int(there[at[here]].sum()), float(base[at[here]].sum()), said + float(within[at].sum())))
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))), list_array(lengths, pa.array(others, pa.binary()))],
                    names=["_row", "id", "n_tokens", "n_known", "base", "said", "others"],
                )

    kind_of = docs.schema[id].dataType.simpleString()
    local = stored(rows.mapInArrow(run, f"_row long, id {kind_of}, n_tokens long, n_known long, base double, said double, others array<binary>"), "scored")
    apart = local.select("_row", F.explode("others").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("times"))
    met = apart.join(model["counts"], "word", "left").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    out = local.drop("others").join(met, "_row", "left")
    more, of_all = F.coalesce("more", F.lit(0.0)), float(np.log10(model["n"] + SMOOTH * (model["v"] + 1)))
    return out.select(
        F.col("id").alias(id), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * of_all).alias("base_score"), (F.col("said") + more).alias("score"),
    )


def score_held_out(docs: DataFrame, teach: Column, held_out: Column, id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """Learn from the rows for which ``teach`` holds and score all rows. ``sizes``: those of ``learn``."""
    model = learn(docs.filter(teach), text, **sizes)
    return score(docs, model, id, text).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
