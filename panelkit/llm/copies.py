"""Near copies of texts: sets of five-word shingles with a Jaccard similarity of 0.8 or more, in components.

Candidates come from MinHash bands: 32 bands of 4 of 128 minima, of which a pair at similarity 0.8 shares none with
a probability of 5e-8. ``keep_one`` also takes them from SimHash: fingerprints linked within two bits, bit-sliced
(``simhash``), make one more band of all sets behind them. Each distinct shingle set counts once. Links are found in
three steps, and each step leaves out what is in one component already:

* Leaders: a set is compared with one leader, the smallest set of any of its bands; twice, the second time for the
  sets that are still apart from a band's leader.
* Sets apart from a band's leader are compared with all sets of the leader's component.
* What then still lies apart in a band is compared set by set.

The last two steps work in groups of bounded parts: a task holds the shingles of one part of the hosts and one of the
guests, counts what each two have in common, and returns only those links that join two components. So no step emits
pairs, and the sum of its rows grows with the sets. Hosts and guests are dealt by size too, as sets of similarity 0.8
differ in size by a quarter at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm import common, graph, simhash
from panelkit.llm.minhash import PERMUTATIONS, WORDS, Hasher

#: Jaccard similarity of a link, as a fraction; minima of a band.
NUMERATOR, DENOMINATOR = 4, 5
ROWS = 4
#: Sets of a part of hosts and of guests at most, and shingles in one unless a single set has more.
PART, GUESTS, SHINGLES = 16_384, 16_384, 1 << 22
#: Words of the bit map of wanted sets: 16 bits for each of them, within these limits.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 20
#: Counts of guests against hosts that a task holds at once, shingles of those guests unless a single set has more, and
#: shingles in common that it counts at once.
CELLS, GUEST_SHINGLES, HITS = 1 << 19, 1 << 18, 1 << 18
#: Set ids that a task remembers to have returned.
REMEMBERED = 1 << 18


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, sorted."""
    hashes = np.sort(hashes)
    keep = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=keep[1:])
    return hashes[keep]


def shingle_set(hasher: Hasher, text: bytes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; empty for a text without words."""
    return distinct(hasher.hashed([text])[0])


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def set_signature(hasher: Hasher, shingles: np.ndarray) -> np.ndarray:
    """The signature of ``Hasher.signature`` from a set of shingle hashes."""
    return hasher.signatures(shingles, np.array([0, len(shingles)]))[0]


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band: its minima and number, mixed. Of one signature, or of many in rows."""
    keys = np.ascontiguousarray(signature).view(np.uint64)
    return common.mixed(keys ^ common.mixed(np.arange(1, keys.shape[-1] + 1, dtype=np.uint64)))


def _own_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column, which is the last, becomes mk_set and mk_bands."""
    hasher = Hasher()
    for batch in batches:
        ids, keys = [], [np.zeros((0, PERMUTATIONS // ROWS), np.uint64)]
        for hashes, starts in hasher.slices(common.texts_of(batch.column(batch.num_columns - 1))):
            ids += [set_id(distinct(hashes[a:b])) for a, b in pairwise(starts)]
            keys.append(bands(hasher.signatures(hashes, starts)))
        found = np.concatenate(keys).view(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * found.shape[1], found.reshape(-1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.int64()), lists],
                                         names=[*batch.schema.names[:-1], "mk_set", "mk_bands"])


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_own_batches`` with mk_fp, the text's SimHash over the same shingles."""
    for batch in batches:
        texts = common.texts_of(batch.column(batch.num_columns - 1))
        prints = np.fromiter((simhash.simhash(t, WORDS) for t in texts), np.uint64, batch.num_rows)
        for own in _own_batches(iter([batch])):
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(prints.view(np.int64))],
                                             names=[*own.schema.names, "mk_fp"])


def bit_map(rows: DataFrame, column: str) -> np.ndarray:
    """Bits of the 64-bit values in a column, of bounded size; a fuller one lets more other values through."""
    words = LEAST_WORDS
    while words < min(MOST_WORDS, rows.count() // 4):
        words *= 2
    word = F.shiftrightunsigned(F.col(column), 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast({column} & 63L AS INT))")
    found = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(words, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_map(bits: np.ndarray, value: int) -> bool:
    value &= 0xFFFFFFFFFFFFFFFF
    return bool(int(bits[value >> 6 & len(bits) - 1]) >> (value & 63) & 1)


def _set_batches(bits: np.ndarray) -> Callable:
    """(mk_set, mk_n, mk_shingles) of the texts whose set is in the bit map."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            for hashes, starts in hasher.slices(common.texts_of(batch.column(0))):
                ids, sets = [], []
                for a, b in pairwise(starts):
                    shingles = distinct(hashes[a:b])
                    own = set_id(shingles)
                    if own in seen or not in_map(bits, own):
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(own)
                    ids.append(own)
                    sets.append(shingles.view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()),
                         pa.array(sets, pa.list_(pa.int64()))], names=["mk_set", "mk_n", "mk_shingles"])
    return read


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose Jaccard similarity is at least 0.8."""
    named = lambda x: sets.select(F.col("mk_set").alias(x), F.col("mk_n").alias(f"n_{x}"),
                                  F.col("mk_shingles").alias(f"s_{x}"))
    sized = pairs.join(named("b"), "b").join(named("a"), "a").where(
        DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return sized.where((NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (F.col("n_a") + F.col("n_b"))).select("a", "b")


class Common:
    """How many shingles each of some sets has in common with others: held by many in bit rows, others in lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = len(sets)
        values = np.concatenate([np.zeros(0, np.int64), *sets])
        order = np.argsort(values, kind="stable")
        values = values[order]
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        del order
        self.start = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
        self.values, self.count = values[self.start], np.diff(np.append(self.start, len(values)))
        del values
        dense = np.flatnonzero(self.count >= max(8, self.sets // 16))
        self.bit = np.full(len(self.values) + 1, -1, np.int64)
        self.bit[dense] = np.arange(len(dense))
        self.words = -(-len(dense) // 64)
        column = np.repeat(self.bit[:-1], self.count)
        keep = np.flatnonzero(column >= 0)
        self.bits = self._rows(self.owner[keep], column[keep], self.sets)

    def _rows(self, row: np.ndarray, bit: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.words), np.uint64)
        np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out

    def counts(self, guests: list[np.ndarray]) -> np.ndarray:
        """guests x sets."""
        values = np.concatenate([np.zeros(0, np.int64), *guests])
        guest = np.repeat(np.arange(len(guests)), [len(g) for g in guests])
        at = np.searchsorted(self.values, values)
        at = np.where(at < len(self.values), at, 0)
        hit = self.values[at] == values if len(self.values) else np.zeros(len(values), bool)
        at, guest = at[hit], guest[hit]
        many = self.bit[at] >= 0
        rows = self._rows(guest[many], self.bit[at[many]], len(guests))
        out = np.zeros((len(guests), self.sets), np.int64)
        for w in range(self.words):
            out += np.bitwise_count(rows[:, w, None] & self.bits[None, :, w])
        at, guest = at[~many], guest[~many]
        for part in _slices(self.count[at], len(at), HITS):
            long, own = self.count[at[part]], guest[part]
            nth = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            owner = self.owner[np.repeat(self.start[at[part]], long) + nth]
            # Guests stand in order, so that a slice counts for a few of them.
            low, high = int(own[0]), int(own[-1]) + 1
            cell = np.repeat((own - low) * self.sets, long) + owner
            out[low:high] += np.bincount(cell, minlength=(high - low) * self.sets).reshape(-1, self.sets)
        return out


def _slices(sizes: np.ndarray, rows: int, total: int) -> Iterator[slice]:
    """Consecutive slices of at most ``rows`` entries of ``sizes`` that add up to at most ``total``, or of one entry."""
    ends = np.cumsum(sizes)
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + total, side="right"))))
        yield slice(start, stop)
        start, before = stop, int(ends[stop - 1])


def _linked(hosts: pa.Table, guests: pa.Table) -> pa.Table:
    """Links (a, b) between hosts and guests that join two components: a spanning forest of all that there are."""
    a: list[int] = []
    b: list[int] = []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    if hosts.num_rows and guests.num_rows:
        column = lambda t, c: t.column(c).to_numpy()
        arrays = lambda t: [s.values.to_numpy(zero_copy_only=False) for s in t.column("mk_shingles")]
        ours, own, n = (column(hosts, c) for c in ("mk_set", "mk_comp", "mk_n"))
        theirs, comp, m = (column(guests, c) for c in ("mk_set", "mk_comp", "mk_n"))
        known, others = Common(arrays(hosts)), arrays(guests)
        for part in _slices(m, max(1, CELLS // len(ours)), GUEST_SHINGLES):
            near = ((NUMERATOR + DENOMINATOR) * known.counts(others[part])
                    >= NUMERATOR * (n[None, :] + m[part, None])) & (own[None, :] != comp[part, None])
            for g, h in zip(*np.nonzero(near)):
                x, y = find(int(comp[part.start + g])), find(int(own[h]))
                if x != y:
                    parent[x] = y
                    a.append(int(ours[h]))
                    b.append(int(theirs[part.start + g]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _parts(rows: DataFrame, group: list[str], most: int, name: str) -> DataFrame:
    """For each group, into how many parts its sets are dealt."""
    parts = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("mk_n") / SHINGLES), F.lit(1))
    return rows.groupBy(*group).agg(parts.cast("int").alias(name))


def _size_class(n: Column) -> Column:
    """Sets of similarity 0.8 lie in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + 1e-9).cast("int")


def block_links(hosts: DataFrame, guests: DataFrame, sets: DataFrame, among: bool) -> DataFrame:
    """Links (a, b) that join components, between hosts and guests (mk_group, mk_set, mk_comp) of a group.

    With ``among`` hosts and guests are the same sets, and each two need to meet once.
    """
    sized = sets.select("mk_set", "mk_n")
    classed = lambda rows: rows.join(sized, "mk_set").withColumn("mk_class", _size_class(F.col("mk_n")))
    hosts, guests = classed(hosts), classed(guests)
    near = [0, -1] if among else [0, -1, 1]
    guests = guests.withColumn("mk_class", F.explode(F.array(*[F.col("mk_class") + d for d in near])))
    group = ["mk_group", "mk_class"]
    # Groups and classes with hosts and guests only, and how often each side is dealt out.
    dealt = _parts(hosts, group, PART, "mk_ours").join(_parts(guests, group, GUESTS, "mk_theirs"), group)
    part = lambda rows, own, other: rows.join(dealt, group).select(
        *group, "mk_set", "mk_comp", "mk_n", F.pmod(F.xxhash64("mk_set"), F.col(own)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
    full = sets.select("mk_set", "mk_shingles")
    keys = [*group, "mk_ours", "mk_theirs"]
    columns = [*keys, "mk_set", "mk_comp", "mk_n", "mk_shingles"]
    # Named anew, since both sides may come from the same rows.
    side = lambda rows, own, other: part(rows, own, other).join(full, "mk_set").select(
        *columns).toDF(*columns).groupBy(*keys)
    return (side(hosts, "mk_ours", "mk_theirs").cogroup(side(guests, "mk_theirs", "mk_ours"))
            .applyInArrow(_linked, "a long, b long"))


def print_postings(own: DataFrame) -> DataFrame:
    """(mk_set, mk_key): the sets of texts whose fingerprints mk_fp are linked within two bits share a key."""
    linked = graph.components(simhash.links(own.select("mk_fp").distinct(), rows=own.count()))
    placed = own.select("mk_set", "mk_fp").distinct().join(linked.withColumnRenamed("v", "mk_fp"), "mk_fp", "left")
    return placed.select("mk_set", F.xxhash64(F.lit("simhash"), F.coalesce("root", "mk_fp")).alias("mk_key")).distinct()


def set_roots(own: DataFrame, texts: DataFrame, scratch: common.Scratch, more: DataFrame | None = None) -> DataFrame:
    """(mk_set, mk_root) of each shingle set that has a near copy; the root stands for its component.

    ``own`` has mk_set and mk_bands of each text; ``texts`` has the texts as its only column. ``more`` has further
    (mk_set, mk_key), by which sets are compared as by bands.
    """
    posted = own.groupBy("mk_set").agg(F.first("mk_bands").alias("mk_bands")).select(
        "mk_set", F.explode("mk_bands").alias("mk_key"))
    if more is not None:
        posted = posted.union(more)
    bounds = posted.groupBy("mk_key").agg(F.min("mk_set").alias("mk_lead"), F.max("mk_set").alias("mk_last"))
    shared = scratch.keep(bounds.where("mk_lead < mk_last").select("mk_key", "mk_lead"))
    members = scratch.keep(posted.join(shared, "mk_key"))
    wanted = members.select("mk_set").distinct()
    sets = texts.mapInArrow(_set_batches(bit_map(scratch.keep(wanted), "mk_set")),
                            "mk_set long, mk_n long, mk_shingles array<long>")
    sets = scratch.keep(sets.groupBy("mk_set").agg(F.first("mk_n").alias("mk_n"),
                                                   F.first("mk_shingles").alias("mk_shingles")))
    edges, roots = None, members.select(F.col("mk_set").alias("v"), F.col("mk_set").alias("root")).limit(0)

    def placed() -> DataFrame:
        """Members with their own component and that of their band's leader."""
        comp = roots.select(F.col("v").alias("mk_set"), F.col("root").alias("mk_comp"))
        lead = roots.select(F.col("v").alias("mk_lead"), F.col("root").alias("mk_led"))
        return (members.join(comp, "mk_set", "left").join(lead, "mk_lead", "left")
                .withColumn("mk_comp", F.coalesce("mk_comp", "mk_set"))
                .withColumn("mk_led", F.coalesce("mk_led", "mk_lead")))

    def joined(more: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = scratch.keep(more if edges is None else edges.union(more))
        return more, scratch.keep(graph.components(more))

    for _ in range(2):
        pairs = placed().where("mk_comp <> mk_led").groupBy(F.col("mk_set").alias("b")).agg(F.min("mk_lead").alias("a"))
        edges, roots = joined(verified(pairs, sets))
    apart = placed().where("mk_comp <> mk_led").select(F.col("mk_led").alias("mk_group"), "mk_set", "mk_comp").distinct()
    guests = scratch.keep(apart)
    comps = sets.select("mk_set").join(roots.select(F.col("v").alias("mk_set"), F.col("root").alias("mk_comp")),
                                       "mk_set", "left").withColumn("mk_comp", F.coalesce("mk_comp", "mk_set"))
    hosts = comps.join(guests.select(F.col("mk_group").alias("mk_comp")).distinct(), "mk_comp", "left_semi")
    edges, roots = joined(block_links(hosts.withColumn("mk_group", F.col("mk_comp")), guests, sets, False))
    strays = placed().where("mk_comp <> mk_led").select(F.col("mk_key").alias("mk_group"), "mk_set", "mk_comp")
    split = strays.groupBy("mk_group").agg(F.min("mk_comp").alias("low"), F.max("mk_comp").alias("high"))
    strays = scratch.keep(strays.join(split.where("low < high").select("mk_group"), "mk_group", "left_semi"))
    edges, roots = joined(block_links(strays, strays, sets, True))
    return roots.select(F.col("v").alias("mk_set"), F.col("root").alias("mk_root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, set, component_id) of each id and shingle set: the smallest id among the near copies, and their copies.

    Null ids never become a component_id; a component of null ids only has none.
    """
    scratch = common.Scratch(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("mk_text"))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("mk_id"), F.col(f"`{text_col}`").alias("mk_text"))
    own = scratch.keep(own.mapInArrow(_own_batches, "mk_id long, mk_set long, mk_bands array<long>"))
    per_set = own.groupBy("mk_set").agg(F.min("mk_id").alias("mk_low")).join(
        set_roots(own, texts, scratch), "mk_set", "left").withColumn("mk_root", F.coalesce("mk_root", "mk_set"))
    per_set = scratch.keep(per_set)
    lows = per_set.groupBy("mk_root").agg(F.min("mk_low").alias("component_id"))
    placed = per_set.join(lows, "mk_root").select("mk_set", "component_id")
    out = common.settle(own.select("mk_id", "mk_set").distinct().join(placed, "mk_set").select(
        F.col("mk_id").alias("id"), F.col("mk_set").alias("set"), "component_id"))
    scratch.drop()
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays.

    A null text counts as empty, and texts without words are copies of each other. Null ids come last; among equal
    ids the row with the smallest hash stays, and of equal rows one. All columns are returned as they were, whatever
    their names.
    """
    named = [f"mk_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*named)
    doc, text = (F.col(named[docs.columns.index(c)]) for c in (id_col, text_col))
    marked = plain.withColumn("mk_row", F.xxhash64(*named)).withColumn("mk_own", F.coalesce(doc.cast("long"), F.lit(0)))
    scratch = common.Scratch(docs.sparkSession)
    own = marked.select("mk_row", "mk_own", doc.cast("long").alias("mk_id"), text.alias("mk_text"))
    own = scratch.keep(own.mapInArrow(
        _marked_batches, "mk_row long, mk_own long, mk_id long, mk_set long, mk_bands array<long>, mk_fp long"))
    best = F.min(F.struct(F.col("mk_id").isNull(), "mk_own", "mk_row")).alias("mk_best")
    # Sets first, so that the groups of a component are few rows by then.
    per_set = own.groupBy("mk_set").agg(best)
    roots = set_roots(own, plain.select(text.alias("mk_text")), scratch, scratch.keep(print_postings(own)))
    winners = common.settle(
        per_set.join(roots, "mk_set", "left").groupBy(F.coalesce("mk_root", "mk_set"))
        .agg(F.min("mk_best").alias("mk_best")).select("mk_best.mk_row", "mk_best.mk_own").distinct())
    scratch.drop()
    first = F.row_number().over(Window.partitionBy("mk_row", "mk_own").orderBy(F.lit(1)))
    return (marked.join(winners, ["mk_row", "mk_own"], "left_semi").withColumn("mk_first", first)
            .where("mk_first = 1").select(*named).toDF(*docs.columns))
