"""Near-duplicates by SimHash: fingerprints from word shingles, linked within a Hamming radius.

Fingerprints that differ in at most two bits agree in two of four 16-bit bands at least, so each distinct
fingerprint is posted under its six pairs of bands. The fingerprints of a posting are compared bit-sliced:
bit planes stand vertically, one machine word holds a bit of 64 fingerprints, carry-save counters add up 64
distances at a time, and a block is abandoned once all its distances exceed the radius. Postings above
``block_cap`` go another exact way: two fingerprints within two bits of each other have a common neighbour at
one bit, so grouping by all one-bit neighbours (65 rows each, groups of 65 at most) links them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm import common
from panelkit.llm.graph import components

RADIUS = 2
WORDS = 3
SEED = 42
BLOCK_CAP = 2048
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint of a UTF-8 text; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles, total = iter([b" ".join(tokens)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(tokens[i:] for i in range(words)))), len(tokens) - words + 1
    ones = np.zeros(64, np.int64)
    while digests := b"".join(map(xxhash.xxh64_digest, islice(shingles, 65_280), repeat(seed))):
        bits = np.unpackbits(np.frombuffer(digests, np.uint8))
        padded = np.zeros((-(-len(bits) // (64 * 255)) * 255, 64), np.uint8)
        padded.reshape(-1)[:len(bits)] = bits
        # 255 rows of bytes add up inside the bytes of a word.
        lanes = padded.view(np.uint64).reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        ones += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(simhash, common.texts_of(batch.column("mk_text"))), np.uint64, batch.num_rows)
        keep = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(prints.view(np.int64))],
                                         names=[*batch.schema.names[:-1], "mk_fp"])


def distances_within(planes: np.ndarray, probe: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each row, which of its 64 lanes differ from ``probe`` in at most ``radius`` bits.

    planes[i, b] holds bit b of the 64 fingerprints in block i; probe[i] is a fingerprint, valid[i] the lanes
    in use. Counters saturate: a lane beyond their reach stays marked.
    """
    found = np.zeros(len(probe), np.uint64)
    live = np.arange(len(probe))
    counters = [np.zeros(len(probe), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(probe), np.uint64)
    for b in range(64):
        bit = (probe >> np.uint64(b)) & np.uint64(1)
        carry = planes[:, b] ^ (np.uint64(0) - bit)
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        over |= carry
        if b % 8 == 7:
            beyond, equal = over.copy(), np.full(len(probe), ALL)
            for i in range(len(counters) - 1, -1, -1):
                if radius >> i & 1:
                    equal &= counters[i]
                else:
                    beyond |= equal & counters[i]
                    equal &= ~counters[i]
            inside = valid & ~beyond
            keep = inside != 0
            if b == 63:
                found[live] = inside
            elif not keep.all():
                planes, probe, valid, live, over = planes[keep], probe[keep], valid[keep], live[keep], over[keep]
                counters = [c[keep] for c in counters]
    return found


def linked(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, chunk: int = 16_384) -> np.ndarray:
    """For consecutive groups of fingerprints, the first row of the group that each row is connected to."""
    rows, starts = len(fps), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blocks_of = -(-sizes // 64)
    first = np.concatenate([s + 64 * np.arange(b) for s, b in zip(starts, blocks_of)] or [np.zeros(0, int)]).astype(int)
    ends = np.repeat(starts + sizes, blocks_of)
    lanes = first[:, None] + np.arange(64)
    used = lanes < ends[:, None]
    block = np.where(used, fps[np.minimum(lanes, rows - 1)], np.uint64(0))
    words = lambda bits: np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    valid = words(used)
    planes = np.stack([words((block >> np.uint64(b)) & np.uint64(1) != 0) for b in range(64)], axis=1)
    base = np.concatenate([[0], np.cumsum(blocks_of)[:-1]])
    labels = np.arange(rows)
    # Every row against every block of its group.
    blocks_of_row = np.repeat(blocks_of, sizes)
    probe = np.repeat(np.arange(rows), blocks_of_row)
    nth = np.arange(len(probe)) - np.repeat(np.cumsum(blocks_of_row) - blocks_of_row, blocks_of_row)
    against = np.repeat(np.repeat(base, sizes), blocks_of_row) + nth
    left, right = [], []
    for at in range(0, len(probe), chunk):
        p, k = probe[at:at + chunk], against[at:at + chunk]
        later = first[k] + 63 > p
        p, k = p[later], k[later]
        near = distances_within(planes[k], fps[p], valid[k], radius)
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        a, b = p[hit[i]], first[k[hit[i]]] + lane
        left.append(a[a < b])
        right.append(b[a < b])
    a, b = np.concatenate(left or [labels[:0]]), np.concatenate(right or [labels[:0]])
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mk_key, mk_fp) sorted by key; star edges of each key's components."""
    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        roots = linked(fps.view(np.uint64), np.diff(np.append(cuts, len(keys)))) if len(keys) else np.zeros(0, int)
        other = np.flatnonzero(roots != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(fps[other]), pa.array(fps[roots[other]])], names=["a", "b"])

    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([rest_k, batch.column(0).to_numpy()])
        fps = np.concatenate([rest_f, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        rest_k, rest_f = keys[cut:], fps[cut:]
        if cut:
            yield edges(keys[:cut], fps[:cut])
    yield edges(rest_k, rest_f)


def links(prints: DataFrame, block_cap: int = BLOCK_CAP, rows: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``mk_fp`` just as all links within two bits do.

    ``rows``: how many there are at most, if known; then what they share takes no more files than needed.
    """
    n = common.partitions(prints.sparkSession)
    band = lambda i: F.shiftrightunsigned("mk_fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [(F.shiftleft(F.lit(k).cast("long"), 32) + F.shiftleft(band(i), 16) + band(j))
            for k, (i, j) in enumerate(combinations(range(4), 2))]
    posted = prints.select("mk_fp", F.explode(F.array(*keys)).alias("mk_key"))
    sizes = posted.groupBy("mk_key").agg(F.count("*").alias("mk_n")).where("mk_n > 1")
    shared = common.settle(posted.join(sizes, "mk_key"), rows and len(keys) * rows)
    sliced = (shared.where(F.col("mk_n") <= block_cap).select("mk_key", "mk_fp")
              .repartition(n, "mk_key").sortWithinPartitions("mk_key")
              .mapInArrow(_link_batches, "a long, b long"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -1 << 63).cast("long") for b in range(64)])
    around = (shared.where(F.col("mk_n") > block_cap).select("mk_fp").distinct()
              .select("mk_fp", F.explode(flips).alias("mk_flip"))
              .select("mk_fp", F.col("mk_fp").bitwiseXOR(F.col("mk_flip")).alias("mk_mid")))
    lowest = F.min("mk_fp").over(Window.partitionBy("mk_mid"))
    return sliced.union(around.select(F.col("mk_fp").alias("a"), lowest.alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block_cap: int = BLOCK_CAP) -> DataFrame:
    """One row per document: its id, fingerprint, component_id and root.

    component_id is the smallest id reachable over links; root is one fingerprint that stands for the
    component. A null text counts as empty, and empty texts share fingerprint 0. Null ids never become a
    component_id; a component of null ids only has none. Repeated rows and equal ids are rows like any other.
    Other columns are left out, whatever their names; an empty table gives no rows.
    """
    prints = common.settle(docs.select(F.col(id_col).alias("mk_id"), F.col(text_col).alias("mk_text"))
                           .mapInArrow(_fingerprint_batches, "mk_id long, mk_fp long"))
    rows = prints.count()
    distinct = common.settle(prints.groupBy("mk_fp").agg(F.min("mk_id").alias("mk_low")), rows)
    roots = components(links(distinct.select("mk_fp"), block_cap, rows)).withColumnRenamed("v", "mk_fp")
    placed = distinct.join(roots, "mk_fp", "left").select(
        "mk_fp", "mk_low", F.coalesce("root", "mk_fp").alias("mk_root"))
    lows = placed.groupBy("mk_root").agg(F.min("mk_low").alias("mk_component"))
    placed = placed.join(lows, "mk_root").select("mk_fp", "mk_root", "mk_component")
    return prints.join(placed, "mk_fp").select(
        F.col("mk_id").alias(id_col), common.hex64(F.col("mk_fp")).alias("fingerprint"),
        F.col("mk_component").alias("component_id"), common.hex64(F.col("mk_root")).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             block_cap: int = BLOCK_CAP) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Null ids come last; among equal ids the row with the smallest hash stays, and of equal rows one. All
    columns of ``docs`` are returned as they were.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.withColumn("mk_row", row).withColumn("mk_own", F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    prints = common.settle(
        marked.select("mk_row", "mk_own", F.col(id_col).alias("mk_id"), F.col(text_col).alias("mk_text"))
        .mapInArrow(_fingerprint_batches, "mk_row long, mk_own long, mk_id long, mk_fp long"))
    roots = components(links(prints.select("mk_fp").distinct(), block_cap, prints.count()))
    roots = roots.withColumnRenamed("v", "mk_fp")
    best = F.min(F.struct(F.col("mk_id").isNull(), "mk_own", "mk_row")).alias("mk_best")
    # Fingerprints first, so that the groups of a component are few rows by then.
    per_print = prints.groupBy("mk_fp").agg(best)
    winners = (per_print.join(roots, "mk_fp", "left").groupBy(F.coalesce("root", "mk_fp"))
               .agg(F.min("mk_best").alias("mk_best")).select("mk_best.mk_row", "mk_best.mk_own").distinct())
    first = F.row_number().over(Window.partitionBy("mk_row", "mk_own").orderBy(F.lit(1)))
    return (marked.join(winners, ["mk_row", "mk_own"], "left_semi").withColumn("mk_first", first)
            .where("mk_first = 1").select(*[f"`{c}`" for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
