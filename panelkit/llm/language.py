"""Language of texts from a bidirectional gated recurrent network over bytes.

A text is cut into spans of 64 bytes. In each direction a gated recurrent unit reads a span byte by byte; at
every position the two states give a probability for each language, and a document's distribution is the mean
over all its positions. The network is trained here by backpropagation through time on spans of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common

SPAN = 64
UNITS = 8
FOLDS = 3
#: The fit reads about so many texts of each language, and at most so many spans of each text.
FIT_ROWS = 400
FIT_SPANS = 6
STEPS = 400
BATCH = 192
CHUNK = 1024
SLICE = 1 << 20
NONE = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; arguments are far from overflow."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights by name; a direction d has tables of byte inputs (Wd) and recurrent weights (Ud), both for the
    gates r, z and the candidate n, and its share Vd of the output layer; c is the output's bias."""
    langs: list[str]
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, langs: list[str], units: int = UNITS, seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        w = {"c": np.zeros(len(langs))}
        for d in "fb":
            w[f"W{d}"] = draw.normal(0, 0.3, (3, 256, units))
            w[f"U{d}"] = draw.normal(0, 0.3, (3, units, units))
            w[f"V{d}"] = draw.normal(0, 0.3, (units, len(langs)))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, spans: np.ndarray, sizes: np.ndarray, d: str, keep: dict | None = None) -> np.ndarray:
        """State of a direction at every position: [SPAN, spans, units]. Beyond a span's size it stays as it was."""
        table, rec = self.w[f"W{d}"], self.w[f"U{d}"]
        n, units = len(spans), rec.shape[1]
        out = np.empty((SPAN, n, units), table.dtype)
        gates, pull = np.empty((3, n, units), table.dtype), np.empty((3, n, units), table.dtype)
        h = np.zeros((n, units), table.dtype)
        full = int(sizes.min(initial=SPAN))
        for t in range(SPAN) if d == "f" else range(SPAN - 1, -1, -1):
            codes = spans[:, t]
            for g in range(3):
                np.take(table[g], codes, axis=0, out=gates[g], mode="clip")
                np.dot(h, rec[g], out=pull[g])
            gates[:2] += pull[:2]
            rz = sigmoid(gates[:2])
            inner = np.multiply(rz[0], pull[2], out=pull[0])
            inner += gates[2]
            inner *= -2
            np.exp(inner, out=inner)
            inner += 1
            candidate = np.divide(2, inner, out=inner)
            candidate -= 1
            if t >= full:
                rz[1][sizes <= t] = 1
            new = out[t]
            np.subtract(h, candidate, out=new)
            new *= rz[1]
            new += candidate
            if keep is not None:
                keep[d, t] = h, rz.copy(), candidate.copy(), pull[2].copy()
            h = new
        return out

    def positions(self, spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of each language at every position: [languages, SPAN, spans]."""
        odds = self.w["Vf"].T @ self.states(spans, sizes, "f").reshape(-1, len(self.w["Vf"])).T
        odds += self.w["Vb"].T @ self.states(spans, sizes, "b").reshape(-1, len(self.w["Vb"])).T
        odds += self.w["c"][:, None]
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=0)
        return odds.reshape(-1, SPAN, len(spans))

    def slopes(self, spans: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over all positions, by backpropagation through time."""
        kept: dict = {}
        h = {d: self.states(spans, sizes, d, kept) for d in "fb"}
        odds = h["f"] @ self.w["Vf"] + h["b"] @ self.w["Vb"] + self.w["c"]
        p = np.exp(odds - odds.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(spans)), truth] -= 1
        valid = np.arange(SPAN)[:, None] < sizes
        p *= (valid / max(1, valid.sum()))[:, :, None].astype(np.float32)
        out = {k: np.zeros_like(v) for k, v in self.w.items()}
        out["c"] = p.sum(axis=(0, 1))
        for d in "fb":
            rec = self.w[f"U{d}"]
            out[f"V{d}"] = np.tensordot(h[d], p, axes=((0, 1), (0, 1)))
            back = p @ self.w[f"V{d}"].T
            later = np.zeros_like(back[0])
            for t in range(SPAN - 1, -1, -1) if d == "f" else range(SPAN):
                before, (r, z), n, pulled = kept[d, t]
                dh = back[t] + later
                dz = dh * (before - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                dr = dn * pulled * r * (1 - r)
                into = (dr, dz, dn * r)
                later = dh * z
                for g, (x, own) in enumerate(zip((dr, dz, dn), into)):
                    np.add.at(out[f"W{d}"][g], spans[:, t], x)
                    out[f"U{d}"][g] += before.T @ own
                    later += own @ rec[g].T
        return out

    def train(self, spans: np.ndarray, sizes: np.ndarray, truth: np.ndarray, steps: int = STEPS,
              rate: float = 0.02, seed: int = 5) -> None:
        """Adam on batches that hold every language alike."""
        draw = np.random.default_rng(seed)
        rows = [np.flatnonzero(truth == k) for k in range(len(self.langs))]
        moving = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            own = np.concatenate([draw.choice(r, max(1, BATCH // len(rows))) for r in rows])
            for k, slope in self.slopes(spans[own], sizes[own], truth[own]).items():
                m, v = moving[k]
                m *= 0.9
                m += 0.1 * slope
                v *= 0.99
                v += 0.01 * slope * slope
                pace = rate * min(1, 2 * (1 - step / (steps + 1)))
                self.w[k] -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution over the positions of each text; even over the languages for empty texts."""
        spans, sizes, owner = cut(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        for at in range(0, len(spans), CHUNK):
            part, size = spans[at:at + CHUNK], sizes[at:at + CHUNK]
            p = self.positions(part, size)
            if size.min() < SPAN:
                p *= np.arange(SPAN)[:, None] < size
            np.add.at(total, owner[at:at + CHUNK], p.sum(axis=1).T)
        total[np.diff(offsets) == 0] = 1
        return total / total.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each text, padded with zeros; their sizes; the text that each belongs to."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // SPAN)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[:-1][owner] + nth * SPAN
    sizes = np.minimum(SPAN, offsets[1:][owner] - starts)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(SPAN, np.uint8)]), SPAN)
    spans = windows[starts]
    spans[np.arange(SPAN) >= sizes[:, None]] = 0
    return spans, sizes, owner


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 1, F.lit(False))


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out = batch.column(0).to_pylist(), []
        for i, text in enumerate(common.texts_of(batch.column(1))):
            pieces = -(-len(text) // SPAN)
            for k in np.unique(np.linspace(0, pieces - 1, min(pieces, FIT_SPANS)).astype(int)):
                out.append((langs[i], text[k * SPAN:(k + 1) * SPAN]))
        names, spans = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(spans, pa.binary())],
                                         names=["lang", "span"])


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, steps: int = STEPS) -> Network | None:
    """A network trained on documents outside the held-out fold (crc32 of the id as text mod 3 is 1).

    Counts the documents of each language, then takes about ``fit_rows`` of each by id hash; their spans, at
    most FIT_SPANS of 64 bytes each, spread over the whole text, come to the driver. Null texts, languages and
    ids teach nothing. None if there is nothing to learn from.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(
        ~held_out(F.col("doc_id")))
    counts = known.where(F.length("text") > 0).groupBy("lang").agg(F.count("*").alias("n"))
    share = F.xxhash64("doc_id").cast("double") / 2.0 ** 64 + 0.5
    rows = (known.join(F.broadcast(counts), "lang").where(share < F.lit(float(fit_rows)) / F.col("n"))
            .select("lang", "text").mapInArrow(_span_batches, "lang string, span binary")
            .orderBy("lang", "span").toPandas())
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    flat = np.frombuffer(b"".join(rows["span"]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in rows["span"]])]).astype(np.int64)
    spans, sizes, _ = cut(flat, offsets)
    net = Network.start(langs)
    net.train(spans, sizes, np.array([langs.index(x) for x in rows["lang"]]), steps)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row; ``und`` with score 0 for null texts, texts without a letter, or
    without a network. Equal texts get equal results; ties go to the first language in order."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, scores = batch.column(1), [], []
            for start, stop in common.slices(texts, SLICE):
                part = texts.slice(start, stop - start)
                lettered = [has_letter(t) for t in common.texts_of(part)]
                if net is None:
                    lettered, best, top = [False] * len(part), [0] * len(part), [0.0] * len(part)
                else:
                    p = net.pooled(*common.flat_bytes(part))
                    best, top = p.argmax(axis=1), p.max(axis=1)
                langs += [net.langs[b] if ok else NONE for ok, b in zip(lettered, best)]
                scores += [float(s) if ok else 0.0 for ok, s in zip(lettered, top)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        label, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
