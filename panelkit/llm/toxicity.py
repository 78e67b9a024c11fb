"""Toxicity of texts: a support vector machine over a subsequence string kernel with Nyström landmarks.

A sentence is as toxic as its most toxic unit. Units are words, windows of very long words, and runs of single
letters written apart, joined. The kernel of two units sums, over all subsequences of ORDER symbols that both hold,
the products of their weights; a subsequence weighs DECAY for each place it spans in a unit, up to REACH places, so
letters put between those of an insult, or marks that only leave a gap, lower the kernel but don't end it. The start
of a unit counts as a symbol. Kernels are scaled to one for a unit with itself.

Landmarks are chosen by pivoted Cholesky among the units of toxic and clean sentences; the features of a unit are its
kernels with the landmarks times the inverse root of theirs with each other. A linear machine with squared hinge loss
is fitted to them by Newton steps. Labels say which documents are toxic, not which of their sentences: units are
first ranked by how much oftener toxic documents hold their subsequences, and then the machine picks its own again,
a few times. Copies of the picked units with letters put in are learned along.

The fitted function is linear in the landmarks' subsequences, so it is kept as one weight for each of these, and a
unit's score needs no landmark. Documents are scored by a logistic function of their units' scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common

#: The fit reads at most so many labelled documents of each class (those of the smallest id hashes), and none of them
#: that have more distinct units than this.
FIT_ROWS = 1500
FIT_UNITS = 3000
FOLDS = 5
THRESHOLD = 0.5
#: Symbols of a subsequence, places it may span, and its weight for each place.
ORDER, REACH, DECAY = 4, 7, 0.5
#: Symbols of a unit: 0 is its start, GAP stands for marks. Units are this long at most.
SYMBOLS, GAP, LONGEST = 64, -1, 24
LANDMARKS = 192
ROUNDS = 3
#: Share of clean documents' units that may score like insults; what a unit's score adds to a document at most.
CHANCE, MARGIN = 0.002, 1.5
#: Share of a toxic document's usual best score that a unit needs to be learned as an insult.
NEAR = 0.4
#: Places for counts of subsequences, subsequences computed at once, unit scores that a task remembers, and bytes of
#: text that it scores at once.
COUNTED, CHUNK, REMEMBERED, SLICE = 1_048_573, 1 << 20, 400_000, 1 << 20

MARKS = re.compile(r"^[\W\d_]+|[\W\d_]+$")
INSIDE = re.compile(r"[\W\d_]+")
APART = re.compile(r"(?<!\w)(?:[^\W\d_]\s{1,3}){2,}[^\W\d_](?!\w)")


def units(text: str) -> set[str]:
    """Distinct units of a text: lower-cased words without marks around them, marks inside as one hyphen each."""
    low, found = text.lower(), set()

    def add(word: str) -> None:
        if len(word) <= LONGEST:
            found.add(word)
        else:
            found.update(word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2))

    for word in set(low.split()):
        add(word if word.isalpha() else INSIDE.sub("-", MARKS.sub("", word)))
    for run in APART.findall(low):
        add("".join(run.split()))
    return {u for u in found if len(u) >= ORDER - 1}


@lru_cache(maxsize=4096)
def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (SYMBOLS - 27) if c.isalpha() else GAP


@lru_cache(maxsize=LONGEST + 1)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All rising tuples of ORDER places below n that span at most REACH, and their weights."""
    found = [(i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + REACH)), ORDER - 1)]
    places = np.array(found, np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0) if len(places) else np.zeros(0)


def subsequences(same_length: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences of units of one length, -1 where a gap takes part, and their weights."""
    symbols = np.array([[0, *map(_symbol, u)] for u in same_length], np.int32)
    places, weight = _places(symbols.shape[1])
    codes = np.zeros((len(symbols), len(places)), np.int32)
    for at in places.T:
        codes = codes * SYMBOLS + symbols[:, at]
    gaps = symbols == GAP
    if gaps.any():
        codes = np.where(gaps[:, places].any(axis=2), -1, codes)
    return codes, weight


def by_length(some: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Units grouped by length, in chunks that bound the memory of their subsequences: (places, units)."""
    groups: dict[int, list[int]] = {}
    for at, u in enumerate(some):
        groups.setdefault(len(u), []).append(at)
    for n, places in groups.items():
        step = max(1, CHUNK // max(1, len(_places(n + 1)[0])))
        for at in range(0, len(places), step):
            part = places[at:at + step]
            yield part, [some[p] for p in part]


def lengths(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Norm of each unit's subsequence weights; equal subsequences add up first. One for units without any."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered = np.take_along_axis(codes, order, axis=1)
    run = np.where(ordered >= 0, weight[order], 0.0)
    first = np.ones(ordered.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.flatnonzero(first.ravel())
    if not len(at):
        return np.ones(len(codes))
    squares = np.add.reduceat(run.ravel(), at) ** 2
    norm = np.sqrt(np.bincount(at // codes.shape[1], weights=squares, minlength=len(codes)))
    return np.where(norm > 0, norm, 1.0)


class Table:
    """Where each of some codes stands, and the last place for all others, by one hashed lookup."""

    def __init__(self, codes: np.ndarray):
        self.codes, size = np.append(codes, -2).astype(np.int32), 1 << 16
        while size < 8 * len(self.codes):
            size *= 2
        self.size = size
        self.slots = np.full(size, len(codes), np.int32)
        # Codes that meet in a slot are moved to the next free one; tries tells how far a search has to go.
        self.tries = 1
        for at, code in enumerate(codes.tolist()):
            slot, n = self.slot(code), 1
            while self.slots[slot] != len(codes):
                slot, n = (slot + 1) % size, n + 1
            self.slots[slot] = at
            self.tries = max(self.tries, n)

    def slot(self, code):
        return (code * 40_503 ^ code >> 9) & (self.size - 1)

    def find(self, codes: np.ndarray) -> np.ndarray:
        last, slot = len(self.codes) - 1, self.slot(codes.astype(np.int64))
        out = np.full(codes.shape, last, np.int32)
        for n in range(self.tries):
            at = self.slots[(slot + n) & (self.size - 1)]
            out = np.where(self.codes[at] == codes, at, out)
        return out


class Landmarks:
    """Kernels with a few units: rows of ``table`` are the subsequences that these hold, columns the units."""

    def __init__(self, chosen: list[str]):
        found = []
        for places, some in by_length(chosen):
            codes, weight = subsequences(some)
            at = np.broadcast_to(np.array(places)[:, None], codes.shape)
            scaled = weight[None, :] / lengths(codes, weight)[:, None]
            keep = codes >= 0
            found.append((codes[keep], at[keep], scaled[keep]))
        codes, at, scaled = (np.concatenate(c) for c in zip(*found))
        self.chosen = chosen
        self.held, row = np.unique(codes, return_inverse=True)
        self.table = np.zeros((len(self.held) + 1, len(chosen)), np.float32)
        np.add.at(self.table, (row, at), scaled.astype(np.float32))
        self.rows = Table(self.held)

    def kernels(self, some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(self.chosen)))
        for places, part in by_length(some):
            codes, weight = subsequences(part)
            rows, total = self.rows.find(codes), np.zeros((len(part), len(self.chosen)))
            for c in range(codes.shape[1]):
                hit = np.flatnonzero(rows[:, c] < len(self.held))
                total[hit] += weight[c] * self.table[rows[hit, c]]
            out[places] = total / lengths(codes, weight)[:, None]
        return out


def choose(candidates: list[str], count: int) -> list[str]:
    """Landmarks by pivoted Cholesky of the candidates' kernel: each the least explained by those before it."""
    if len(candidates) <= count:
        return candidates
    kernel = Landmarks(candidates).kernels(candidates)
    left, factor, picked = np.diag(kernel).copy(), np.zeros((len(candidates), count)), []
    for k in range(count):
        at = int(np.argmax(left))
        if left[at] < 1e-6:
            break
        picked.append(at)
        factor[:, k] = (kernel[:, at] - factor[:, :k] @ factor[at, :k]) / np.sqrt(left[at])
        left = left - factor[:, k] ** 2
        left[picked] = 0
    return [candidates[p] for p in picked]


def newton_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3,
               steps: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss and a last column of ones, by Newton's method."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = ridge / 100
    loss = lambda v: 0.5 * (keep * v * v).sum() + 0.5 * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs = x[on] * weight[on, None]
        slope = keep * w - xs.T @ (y[on] * slack[on])
        step = np.linalg.solve(x[on].T @ xs + np.diag(keep), slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now - 1e-4 * size * (slope @ step):
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a last column of ones, by damped Newton steps.

    Classes weigh as the roots of their sizes.
    """
    w = np.zeros(x.shape[1])
    weight = 1 / np.sqrt(np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum())))
    weight = weight * len(y) / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge + 1e-6)
        step = np.linalg.solve(curve, slope)
        w = w + step / max(1.0, np.abs(step).max())
    return w


def varied(some: Iterable[str]) -> list[str]:
    """Units with a letter or a mark put in, at places that the unit itself decides."""
    out = []
    for u in some:
        for n, put in enumerate(("x", "-", "e")):
            at = 1 + (len(u) * 7 + n * 3 + ord(u[0])) % max(1, len(u) - 1)
            out.append(u[:at] + put + u[at:])
        out.append("-".join(u))
    return [u[:LONGEST] for u in out]


@dataclass
class Machine:
    """A weight for each subsequence (the last for all others), a bias, and the logistic weights of a document."""
    rows: Table
    weights: np.ndarray
    bias: float
    document: np.ndarray
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def scores(self, some: list[str]) -> np.ndarray:
        out = np.zeros(len(some))
        for places, part in by_length(some):
            codes, weight = subsequences(part)
            rows = self.rows.find(codes)
            hit = np.flatnonzero((rows < len(self.weights) - 1).any(axis=1))
            norm = lengths(codes[hit], weight)
            out[np.array(places)[hit]] = self.weights[rows[hit]] @ weight / norm
        return out + self.bias

    def features(self, bags: Iterable[set[str]]) -> np.ndarray:
        """Of each document's distinct units: the highest score, and how much there is above zero, also for each."""
        rows = [list(bag) for bag in bags]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list({u for row in rows for u in row if u not in self.known})
        self.known.update(zip(fresh, self.scores(fresh).tolist()))
        out = np.zeros((len(rows), 4))
        for i, row in enumerate(rows):
            found = np.fromiter(map(self.known.__getitem__, row), np.float64, len(row))
            extra = np.clip(found, 0.0, MARGIN).sum()
            out[i] = (np.clip(found.max(initial=-1.0), -1.0, MARGIN), np.log1p(extra),
                      np.sqrt(extra / (len(row) + 10)), 1.0)
        return out

    def documents(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.document, -30, 30)))


def seeds(bags: list[list[str]], toxic: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """A first score of each unit: the mean, over its subsequences, of how surprisingly often toxic documents hold them.

    Subsequences are counted in COUNTED places, once for each document.
    """
    counts = np.zeros((2, COUNTED))
    for bag, label in zip(bags, toxic):
        codes = [np.zeros(0, np.int64)]
        for _, part in by_length(bag):
            found = subsequences(part)[0]
            codes.append(np.unique(found[found >= 0]) % COUNTED)
        counts[int(label), np.unique(np.concatenate(codes))] += 1
    n = np.maximum(1, np.bincount(toxic.astype(int), minlength=2))[:, None]
    share, both = (counts + 0.5) / (n + 1), (counts.sum(axis=0) + 1) / (n.sum() + 2)
    surprise = np.clip((share[1] - share[0]) / np.sqrt(both * (1 - both) * (1 / n).sum()), -5, 15)
    out = np.zeros(len(vocabulary))
    for places, part in by_length(vocabulary):
        codes, weight = subsequences(part)
        found = np.where(codes >= 0, surprise[codes % COUNTED], 0.0)
        out[places] = found @ weight / max(weight.sum(), 1e-9)
    return out


def fit(bags: list[list[str]], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    """The machine from documents as lists of distinct units, and their labels."""
    machine = Machine(Table(np.zeros(0, int)), np.zeros(1), 0.0, np.array([0.0, 0.0, 0.0, -3.0]))
    hits: dict[str, list[int]] = {}
    for bag, label in zip(bags, toxic):
        for u in bag:
            hits.setdefault(u, [0, 0])[int(label)] += 1
    vocabulary = sorted(hits)
    seen = np.array([hits[u] for u in vocabulary], float).reshape(-1, 2)
    if not seen[:, 0].any() or not seen[:, 1].any():
        # One class only: its own share decides.
        machine.document[-1] = 3.0 if len(bags) and toxic.all() else -3.0
        return machine
    place = {u: i for i, u in enumerate(vocabulary)}
    guilty = [np.array([place[u] for u in bag], int) for bag, label in zip(bags, toxic) if label and len(bag)]
    clean = np.flatnonzero(seen[:, 0] > 0)
    score = seeds(bags, toxic, vocabulary)
    for _ in range(rounds):
        # A toxic document's insults: units near the best of most such documents, or else those that score above
        # nearly all units of clean documents.
        rare = np.quantile(score[clean], 1 - CHANCE)
        bar = max(rare, NEAR * np.median([score[rows].max() for rows in guilty]))
        found = [rows[score[rows] >= (bar if (score[rows] >= bar).any() else rare)] for rows in guilty]
        share = np.zeros(len(vocabulary))
        for rows in found:
            share[rows] += 1 / max(1, len(rows))
        picked = np.flatnonzero(share)
        picked = picked[seen[picked, 1] > 2 * seen[picked, 0]]
        strong = picked[np.argsort(-(score[picked] * np.log1p(seen[picked, 1])), kind="stable")][:600]
        hard = clean[np.argsort(-score[clean], kind="stable")][:500]
        plain = clean[::max(1, len(clean) // 300)]
        named = lambda rows: [vocabulary[i] for i in rows]
        insults = choose(named(strong), landmarks // 2)
        marks = Landmarks(sorted({*insults, *choose(named(np.union1d(hard, plain)), landmarks // 2)}))
        own = marks.kernels(marks.chosen)
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-3))
        again = varied(insults)
        rest = np.union1d(clean[::max(1, len(clean) // 30_000)], hard)
        some = named(picked) + again + named(rest)
        x = np.column_stack([marks.kernels(some) @ root, np.ones(len(some))])
        good = len(picked) + len(again)
        y = np.r_[np.ones(good), -np.ones(len(rest))]
        weight = np.r_[share[picked], np.full(len(again), 0.2 * share.sum() / max(1, len(again))), np.sqrt(seen[rest, 0])]
        weight[:good] *= 0.3 * weight[good:].sum() / weight[:good].sum()
        w = newton_svm(x, y, weight)
        machine = Machine(marks.rows, np.append(marks.table[:-1] @ (root @ w[:-1]), 0.0), float(w[-1]), machine.document)
        score = machine.scores(vocabulary)
    machine.known = dict(zip(vocabulary, score.tolist()))
    machine.document = logistic(machine.features(bags), toxic.astype(float))
    machine.known = {}
    return machine


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [units(t.decode()) for t in common.texts_of(batch.column(2))]
        joined = ["\n".join(sorted(bag)) if len(bag) <= FIT_UNITS else None for bag in bags]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.string())],
                                         names=["id", "label", "bag"])


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fits the machine to labelled documents outside the held-out fold (crc32 of the id as text mod 5 is 0).

    Reads the whole texts of ``fit_rows`` documents of each class; their distinct units, at most FIT_UNITS of a
    document, come to the driver. Null labels and ids are left out; an id labelled twice is toxic if any label is 1.
    Without labelled documents nothing is toxic.
    """
    known = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label")))
    first = lambda label: known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (texts.join(F.broadcast(first(0).union(first(1))), "id").select("id", "label", "text")
            .mapInArrow(_bag_batches, "id long, label int, bag string").where("bag IS NOT NULL")
            .orderBy(F.xxhash64("id"), "id", F.xxhash64("bag")).limit(2 * fit_rows).toPandas())
    bags = [bag.split("\n") if bag else [] for bag in rows["bag"]]
    return fit(bags, rows["label"].to_numpy(np.int64) == 1)


def with_score(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the toxicity of the whole text, from 0 to 1.

    A null text counts as empty; texts without units get the score of none. Other columns pass through, whatever
    their names or values.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(batch.num_columns - 1), [np.zeros(0)]
            for start, stop in common.slices(texts, SLICE):
                bags = [units(t.decode()) for t in common.texts_of(texts.slice(start, stop - start))]
                found.append(machine.documents(machine.features(bags)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found))],
                                             names=[*batch.schema.names[:-1], "mk_score"])

    named = [f"mk_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*named)
    schema = plain.schema.add("mk_score", "double")
    text = F.col(named[docs.columns.index(text_col)])
    return plain.select("*", text.alias("mk_text")).mapInArrow(score, schema).toDF(*docs.columns, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = learn(docs, common.read(spark, sf_dir, "labels"))
    ids = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_score(ids, machine).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
