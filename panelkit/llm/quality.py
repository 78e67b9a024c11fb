"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line is described by shares of byte classes, word shape and repetition, and by the
same shares of the lines around it. The field is fitted by gradient ascent on the likelihood of labelled
documents whose lines all carry their document's label; a document's score is the mean of its lines'
forward-backward marginals of "good", weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common

#: The fit reads at most so many labelled documents (those of the smallest id hashes), of so many lines at most.
FIT_ROWS = 3000
FIT_LINES = 200
THRESHOLD = 0.3
FOLDS = 5
SLICE = 1 << 20

LOWER, UPPER, DIGIT, SPACE, STOP, BANG, BAR, SYMBOL, WIDE = range(9)
CLASS = np.full(256, SYMBOL, np.uint8)
CLASS[[*range(97, 123)]] = LOWER
CLASS[[*range(65, 91)]] = UPPER
CLASS[[*range(48, 58)]] = DIGIT
CLASS[[*range(9, 14), 32]] = SPACE
CLASS[list(b".,;:'\"-()?")] = STOP
CLASS[list(b"!")] = BANG
CLASS[list(b"|")] = BAR
CLASS[128:] = WIDE
CLASSES = 9
#: Shares that the lines around a line lend to it.
ODD = [UPPER, DIGIT, BANG, BAR, SYMBOL]


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: number of lines of each text, and where each line begins and ends."""
    breaks = np.flatnonzero(data == 10)
    ends = np.concatenate([offsets[1:], breaks])
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    closes = order < len(offsets) - 1
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1] + ~closes[:-1]
    return np.diff(np.flatnonzero(closes), prepend=-1), starts, ends


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, features of each line, bytes of each line)."""
    counts, starts, ends = lines_of(data, offsets)
    n, length = len(starts), ends - starts
    # A byte belongs to the last line that begins at or before it; line breaks count as white space.
    line = np.repeat(np.arange(n), np.diff(np.append(starts, len(data))))
    kind = CLASS[data]
    table = np.bincount(line * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    black = kind != SPACE
    begins = black.copy()
    begins[1:] &= ~black[:-1] | (line[1:] != line[:-1])
    at = np.flatnonzero(begins)
    stops = np.flatnonzero(black & ~np.concatenate([black[1:], [False]])
                           | black & np.concatenate([line[1:] != line[:-1], [True]]))
    size = stops - at + 1
    # Two words count as equal if their lengths and first eight bytes are.
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)[at]
    head = np.ascontiguousarray(eight).view("<u8")[:, 0] if len(at) else np.zeros(0, np.uint64)
    head = head & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64)))
    again = np.zeros(len(at), bool)
    again[1:] = (head[1:] == head[:-1]) & (size[1:] == size[:-1]) & (line[at[1:]] == line[at[:-1]])
    words = np.bincount(line[at], minlength=n)
    repeats = np.bincount(line[at[again]], minlength=n)
    share = table / np.maximum(table.sum(axis=1), 1)[:, None]
    repeated = repeats / np.maximum(words, 1)
    long_words = np.bincount(line[at], weights=size, minlength=n) / np.maximum(words, 1) / 10
    odd = np.column_stack([share[:, ODD], repeated])
    before, after = np.zeros_like(odd), np.zeros_like(odd)
    last = np.cumsum(counts) - 1
    inner = np.ones(n, bool)
    inner[last] = False
    after[:-1] = odd[1:]
    after[~inner] = 0
    first = last - counts + 1
    before[1:] = odd[:-1]
    before[first] = 0
    shape = np.column_stack([np.log1p(length) / 5, long_words, words == 0, repeated])
    return counts, np.column_stack([share, shape, before, after]).astype(np.float64), length


@dataclass
class Field:
    """Weights of a line's features for "good" against "bad", transition scores and start scores."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        good = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return np.column_stack([np.zeros(len(good)), good])

    def marginals(self, counts: np.ndarray, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log marginals of both states for each line, of both states of each pair of lines, and where pairs begin."""
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        # Chains in order of falling length: at step t the first live[t] have a line.
        live = len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max(initial=0)), side="right")
        heads = first[order]
        forward, backward = unary.copy(), np.zeros_like(unary)
        forward[first] += self.start
        for t in range(1, len(live)):
            at = heads[:live[t]] + t
            forward[at] += np.logaddexp(*(forward[at - 1, s, None] + self.transitions[s] for s in (0, 1)))
        for t in range(len(live) - 1, 0, -1):
            at = heads[:live[t]] + t
            later = unary[at] + backward[at]
            backward[at - 1] = np.logaddexp(*(later[:, s, None] + self.transitions[:, s] for s in (0, 1)))
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        inner = np.ones(len(unary), bool)
        inner[first + counts - 1] = False
        pair = np.flatnonzero(inner)
        pairs = (forward[pair, :, None] + self.transitions + (unary + backward)[pair + 1, None, :]
                 - total[pair, None, None])
        return both - total[:, None], pairs, pair

    def scores(self, counts: np.ndarray, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        marginal, _, _ = self.marginals(counts, self.unary(x))
        weight = length + 1.0
        first = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(np.exp(marginal[:, 1]) * weight, first)
                       / np.add.reduceat(weight, first), 0, 1)


def fit(counts: np.ndarray, x: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-3,
        rate: float = 0.1) -> Field:
    """Adam on the penalised mean log-likelihood of documents whose lines all have the document's label."""
    wide = x.shape[1] if x.ndim == 2 else 0
    field = Field(x.mean(axis=0) if len(x) else np.zeros(wide), x.std(axis=0) + 1e-3 if len(x) else np.ones(wide),
                  np.zeros(wide + 1), np.zeros((2, 2)), np.zeros(2))
    if not len(counts):
        return field
    z = np.column_stack([(x - field.mean) / field.scale, np.ones(len(x))])
    first = np.cumsum(counts) - counts
    truth = np.repeat(labels, counts)
    moving = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weights, field.transitions, field.start)]
    for step in range(1, rounds + 1):
        marginal, pairs, pair = field.marginals(counts, field.unary(x))
        p = np.exp(marginal)
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[pair], truth[pair]), 1)
        starts = np.array([(labels == 0).sum(), (labels == 1).sum()])
        slopes = [z.T @ (truth - p[:, 1]), seen - np.exp(pairs).sum(axis=0), starts - p[first].sum(axis=0)]
        for value, slope, state in zip((field.weights, field.transitions, field.start), slopes, moving):
            slope = slope / len(counts) - ridge * value
            state[0] = 0.9 * state[0] + 0.1 * slope
            state[1] = 0.99 * state[1] + 0.01 * slope * slope
            value += rate * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-8)
    return field


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.flat_bytes(batch.column(2))
        if not batch.num_rows:
            continue
        counts, x, _ = features(data, offsets)
        ends = np.cumsum(counts)
        rows = [x[e - c:e].reshape(-1) if c <= FIT_LINES else None for c, e in zip(counts, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Field:
    """Fits the field to labelled documents outside the held-out fold (crc32 of the id as text mod 5 is 0).

    Reads the whole texts of ``fit_rows`` documents; their features, at most fit_rows x FIT_LINES lines, come to
    the driver. Null labels and ids are left out; an id labelled twice counts as bad if any label is 0. Without
    labelled documents every line is as likely good as bad.
    """
    known = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (texts.join(F.broadcast(known), "id").select("id", "label", "text")
            .mapInArrow(_sample_batches, "id long, label int, x array<double>").where("x IS NOT NULL")
            .orderBy("id", "label", F.hash("x")).limit(fit_rows).toPandas())
    wide = features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[1].shape[1]
    x = [np.asarray(v, np.float64).reshape(-1, wide) for v in rows["x"]]
    counts = np.array([len(v) for v in x], np.int64)
    return fit(counts, np.concatenate(x) if x else np.zeros((0, wide)), rows["label"].to_numpy(np.int64))


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def with_score(docs: DataFrame, field: Field, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the quality of the whole text, from 0 to 1.

    A null or empty text is one empty line. Other columns pass through, whatever their names or values.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = []
            for start, stop in common.slices(texts, SLICE):
                found.append(field.scores(*features(*common.flat_bytes(texts.slice(start, stop - start)))))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)],
                                             names=[*batch.schema.names[:-1], "mk_score"])

    named = [f"mk_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*named)
    schema = plain.schema.add("mk_score", "double")
    text = F.col(named[docs.columns.index(text_col)])
    out = plain.select("*", text.alias("mk_text")).mapInArrow(score, schema)
    return out.toDF(*docs.columns, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    field = learn(docs, common.read(spark, sf_dir, "labels"))
    ids = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = with_score(ids, field)
    return scored.select("doc_id", "held_out", "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
