"""Document fingerprints by MinHash, and near-duplicates by banded signatures.

Shingles are five words of the lower-cased text (A-Z), joined by one space; a shorter text is one shingle.
Each shingle gets a 64-bit polynomial hash, computed for some short texts or a window of a long one at once, and each
of 128 universal hash permutations ``a * x + b`` of its 32-bit digest keeps a minimum. A fingerprint is the low 16 bits of each
minimum; the likeness of two fingerprints is the share of equal positions, an estimate of the Jaccard
similarity of the shingle sets. Near-duplicates come from bands of these minima, verified by Jaccard: ``copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm import common

WORDS = 5
PERMUTATIONS = 128
#: Words hashed together; bounds the memory of a long text.
WINDOW = 16_384
#: Bytes of texts hashed together; a text with more is hashed alone, in such windows.
TOGETHER = 1 << 18
#: Hashes that a permutation is applied to at once.
LANES = 1 << 16
#: A-Z in lower case, white space as a space.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Hasher:
    """The permutations, drawn from a seed, and tables of powers that grow with the longest window."""

    def __init__(self, permutations: int = PERMUTATIONS, words: int = WORDS, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.words = words
        self.a = (draw.integers(0, 1 << 31, permutations, dtype=np.uint64).astype(np.uint32) * 2 + 1)[:, None]
        self.b = draw.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32)[:, None]
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            up, down = np.full(n, BASE), np.full(n, INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def shingles(self, text: bytes) -> Iterator[np.ndarray]:
        """64-bit hashes of the text's shingles, window by window; repeats stay."""
        tokens = text.lower().split()
        step = self.words - 1
        for at in range(0, max(1, len(tokens) - step), WINDOW):
            part = tokens[at:at + WINDOW + step]
            if not part:
                return
            flat = np.frombuffer(b" ".join(part), np.uint8)
            self.powers(len(flat) + 1)
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.up[:len(flat)], out=sums[1:])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            starts, ends = starts[:max(1, len(part) - step)], ends[min(step, len(part) - 1):]
            yield common.mixed((sums[ends] - sums[starts]) * self.down[starts])

    def hashed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``shingles`` of several texts, and where those of each begin (one entry more than texts)."""
        if len(texts) == 1 and len(texts[0]) > TOGETHER:
            hashes = np.concatenate([np.zeros(0, np.uint64), *self.shingles(texts[0])])
            return hashes, np.array([0, len(hashes)])
        flat = np.frombuffer(b" ".join(texts).translate(PLAIN), np.uint8)
        word = np.zeros(len(flat) + 2, bool)
        np.not_equal(flat, 32, out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        begins, sizes = edges[::2], edges[1::2] - edges[::2] + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(begins, bounds)
        if len(begins) and begins[-1] - begins[0] != starts[-1]:
            # One space between two words, none in front.
            flat = flat[word[1:-1] | word[:-2]]
        elif len(begins):
            flat = flat[begins[0]:]
        self.powers(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.up[:len(flat)], out=sums[1:])
        counts, own = np.diff(first), np.arange(len(begins))
        past = np.repeat(first[1:], counts)
        last = own + self.words - 1
        at = np.flatnonzero((last < past) | (own == np.repeat(first[:-1], counts)))
        start, end = starts[at], ends[np.minimum(last, past - 1)[at]]
        shingles = np.where(counts > 0, np.maximum(counts - self.words + 1, 1), 0)
        return common.mixed((sums[end] - sums[start]) * self.down[start]), np.concatenate([[0], np.cumsum(shingles)])

    def slices(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``hashed`` of consecutive texts, as many at once as are hashed together."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > TOGETHER:
                yield self.hashed(held)
                held, size = [], 0
            held.append(text)
            size += len(text) + 1
        if held:
            yield self.hashed(held)

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Low halves of the minima, a row for each text; all ones for a text without words."""
        low = np.full((len(self.a), len(starts) - 1), 0xFFFFFFFF, np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        buffer = np.empty(min(len(x), LANES), np.uint32)
        for at in range(0, len(x), LANES):
            part = x[at:at + LANES]
            here = np.flatnonzero((starts[:-1] < at + len(part)) & (starts[1:] > at) & (starts[1:] > starts[:-1]))
            cuts, own = np.maximum(starts[here] - at, 0), buffer[:len(part)]
            for i, (a, b) in enumerate(zip(self.a[:, 0], self.b[:, 0])):
                np.multiply(part, a, out=own)
                np.add(own, b, out=own)
                low[i, here] = np.minimum(low[i, here], np.minimum.reduceat(own, cuts))
        return np.ascontiguousarray(low.T.astype(np.uint16))

    def signature(self, text: bytes) -> np.ndarray:
        """Low halves of the minima; all ones for a text without words."""
        return self.signatures(*self.hashed([text]))[0]


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float(np.count_nonzero(one == other)) / len(one)


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        out = [written(s) for own in hasher.slices(common.texts_of(batch.column(1))) for s in hasher.signatures(*own)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for each row; null texts count as empty, equal texts get equal fingerprints."""
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (out.mapInArrow(_fingerprint_batches, "id long, fp string")
            .select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint")))


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guest, id, text, set, component) in order; each own row is paired with the row after it.

    Rows with a set have no text: they come before the texts of their id and name their component.
    """
    from panelkit.llm import copies

    hasher = Hasher()
    held = None
    told: tuple = (None, None, {})
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))))
        out: list[tuple] = []
        for start, stop in common.slices(batch.column(3), TOGETHER):
            texts = common.texts_of(batch.column(3).slice(start, stop - start))
            placed = [(row, text) for row, text in zip(rows[start:stop], texts)]
            own = hasher.slices(text for row, text in placed if row[3] is None)
            marks = ((hashes[a:b], low) for hashes, starts in own
                     for (a, b), low in zip(pairwise(starts), hasher.signatures(hashes, starts)))
            pairs = []
            for (bucket, guest, doc, own, component), text in placed:
                if own is not None:
                    if told[:2] != (bucket, doc):
                        told = (bucket, doc, {})
                    told[2][own] = component
                    continue
                hashes, signature = next(marks)
                known = not guest and told[:2] == (bucket, doc) and told[2]
                component = known[copies.set_id(copies.distinct(hashes))] if known else None
                now = (bucket, doc, text.decode(), signature, component)
                if held is not None and held[0] == bucket:
                    pairs.append((held, now))
                held = None if guest else now
            out += _edited(hasher, pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(TYPES), TYPES)], names=NAMES)


NAMES = "id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next component_id".split()
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
         pa.int64()]


def _edited(hasher: Hasher, pairs: list[tuple[tuple, tuple]]) -> Iterator[tuple]:
    """A row for each text and the one after it."""
    texts = []
    for own, after in pairs:
        half = len(own[2]) // 2
        texts.append((own[2][:len(own[2]) - half] + after[2][:half]).encode())
    changed = (s for hashed in hasher.slices(texts) for s in hasher.signatures(*hashed))
    for (own, after), edited, low in zip(pairs, texts, changed, strict=True):
        _, doc, text, signature, component = own
        yield (doc, len(text), hashlib.sha256(edited).hexdigest(), written(signature), written(low),
               likeness(signature, low), likeness(signature, after[3]), component)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          components: DataFrame | None = None) -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many, or all, of the next
    document in ascending id; the first follows the last. Null ids come first, equal ids are ordered by text,
    null texts count as empty. One row per row of ``docs``, named by ``id_col``; other columns are left out.

    With ``components``, rows (id, set, component_id) as ``copies.near_copies`` gives them, each row also has its
    component_id.

    The texts move once, into ranges of ids between approximate quantiles; each range also gets the first row
    of the next range as a guest. A task works on a few short texts or one long text and its neighbour at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = common.partitions(docs.sparkSession)
    shares = [i / (3 * n) for i in range(1, 3 * n)]
    cuts = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), 10_000)).first()[0]
    splits = [-np.inf, *sorted(set(map(float, cuts or [0.0]))), np.inf]
    ranges = lambda df: Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(
        df.withColumn("place", F.coalesce(F.col("id").cast("double"), F.lit(-np.inf)))).withColumn(
        "bucket", F.col("range").cast("int"))
    ranged = ranges(rows).select("bucket", F.lit(False).alias("guest"), "id", "text")
    first = ranged.groupBy("bucket").agg(F.min(F.struct("id", "text")).alias("head"))
    # One row for each range: a few times the number of partitions, whatever the number of documents.
    order = Window.orderBy("bucket")
    hosts = ranged.select("bucket").distinct().select(
        "bucket", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("host"))
    guests = first.join(hosts, "bucket").select(
        F.col("host").alias("bucket"), F.lit(True).alias("guest"), "head.id", "head.text")
    none = F.lit(None).cast("long")
    dealt = ranged.union(guests).select("*", none.alias("set"), none.alias("component_id"))
    if components is not None:
        dealt = dealt.union(ranges(components).select(
            "bucket", F.lit(False), "id", F.lit(None).cast("string"), "set", "component_id"))
    columns = [c for c in NAMES if c != "component_id" or components is not None]
    return (dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "id", "text")
            .mapInArrow(_pair_batches, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                       "edited_fingerprint string, near_edited double, near_next double, "
                                       "component_id long")
            .select(*columns).withColumnRenamed("id", id_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelkit.llm import copies

    docs = common.read(spark, sf_dir, "documents")
    return edits(docs, components=copies.near_copies(docs))
