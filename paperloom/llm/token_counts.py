"""Token counts under a unigram model, with forward scores shared along a trie of pre-tokens.

Distinct pre-tokens go into a trie. The best score of a prefix and the pieces it takes depend on
the prefix only, so they are computed once for each node, from its ancestors, and a pre-token's
count is the one at its last node. The trie is walked in sorted order: only the path to the
current node is held, and the nodes that a pre-token shares with the one before are not visited
again. Of equally good segmentations the one of fewest pieces counts.

Counts of pre-tokens are kept for the next rows, up to ``KEPT`` of them.

Defined cases: a null or empty text has no tokens; characters outside the vocabulary count as
their UTF-8 bytes; repeated rows each get their count; columns of the new names are replaced; an
empty table gives an empty one. A very long text is held whole, with its list of pre-tokens.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.common import slices
from paperloom.llm.pieces import SPACE, Vocabulary, vocabulary

KEPT = 300_000


def trie_counts(pre_tokens, vocab: Vocabulary) -> dict[str, int]:
    """Tokens of the best segmentation of each pre-token."""
    ids, endings, weights, longest = vocab.ids, vocab.endings, vocab.weights.tolist(), vocab.longest
    by_byte = weights[next(iter(vocab.bytes.values()))]
    out, before = {}, ""
    best, taken = [0.0], [0]  # for each node on the path from the root
    for token in sorted(pre_tokens):
        text = token.replace(" ", SPACE)
        shared, most = 0, min(len(text), len(before))
        while shared < most and text[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], taken[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            score, count = float("-inf"), 0
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                piece = text[start:end]
                if piece not in endings:
                    break
                if (i := ids.get(piece)) is not None:
                    s, c = best[start] + weights[i], taken[start] + 1
                    if s > score or (s == score and c < count):
                        score, count = s, c
            if text[end - 1] not in ids:
                n = len(text[end - 1].encode())
                s, c = best[end - 1] + n * by_byte, taken[end - 1] + n
                if s > score or (s == score and c < count):
                    score, count = s, c
            best.append(score)
            taken.append(count)
        out[token] = taken[-1]
        before = text
    return out


class Counts(dict):
    """Counts of pre-tokens, those unknown worked out for a whole batch at once."""

    def __init__(self, vocab: Vocabulary, kept: int = KEPT):
        super().__init__()
        self.vocab, self.kept = vocab, kept

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) > self.kept:
            self.clear()
        new = {u for t in texts for u in t if u not in self}
        self.update(trie_counts(new, self.vocab))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_pretokens``, ``n_tokens`` and ``n_characters``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(os.fspath(model_path), "rb") as f:  # on the driver; the file is sent to the executors
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("n_pretokens", "n_tokens", "n_characters")
    schema = T.StructType(docs.schema.fields + [T.StructField(x, T.LongType()) for x in ("n_pretokens", "n_tokens", "n_characters")])
    names = to_arrow_schema(schema).names

    def run(batches):
        vocab = vocabulary(shared)
        counts = Counts(vocab)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(text).to_pylist()
                cut = [vocab.units(t) for t in texts]
                counts.learn(cut)
                found = [pa.array([len(u) for u in cut], pa.int64()), pa.array([sum(map(counts.__getitem__, u)) for u in cut], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=names)

    return docs.mapInArrow(run, schema)
