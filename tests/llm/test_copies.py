import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelkit.llm import common, copies, minhash, simhash
from tests.llm.test_minhash import jaccard, shingles


def groups(texts):
    """Smallest place that each text is linked to, by comparing all pairs."""
    sets, label = [shingles(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def planted(seed=5):
    """Chains of edits, families with a common half, and texts of their own."""
    draw = random.Random(seed)
    words = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    texts = [words(120) for _ in range(20)]
    for _ in range(6):
        now = words(200)
        for _ in range(10):
            texts.append(now)
            now = list(now)
            for _ in range(draw.randint(1, 5)):
                now[draw.randrange(len(now))] = words(1)[0]
    half = words(150)
    for _ in range(30):
        tail = words(draw.choice([10, 15, 60]))
        texts += [half + tail, half + tail[:-2]]
    draw.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("part", [16_384, 7])
def test_stage_keeps_one_of_planted_near_copies(spark, part, monkeypatch):
    monkeypatch.setattr(copies, "PART", part)
    monkeypatch.setattr(copies, "GUESTS", part + 2)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(texts)))


def test_odd_texts(spark, odd_docs):
    rows = odd_docs.collect()
    kept = copies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(groups([r.text for r in rows])))
    assert {r.doc_id for r in kept.collect()} >= {0, 5, 6, 7, 8}
    assert copies.keep_one(odd_docs.limit(0)).count() == 0


def test_signature_of_a_set():
    hasher = minhash.Hasher()
    for text in (b"", b"one", b"a b c d e f g a b c d e f g"):
        own = copies.set_signature(hasher, copies.shingle_set(hasher, text))
        assert (own == hasher.signature(text)).all() and len(copies.bands(own)) == 32
    assert not np.intersect1d(copies.bands(own), copies.bands(np.roll(own, 4))).size


def test_counts_in_common():
    draw = np.random.default_rng(1)
    for sizes, top in (([0, 1, 5, 60, 200] * 8, 300), ([40] * 70, 10 ** 6), ([], 5), ([0], 5)):
        sets = [np.unique(draw.integers(-top, top, n)) for n in sizes]
        guests = sets[::2] + [np.array([], np.int64), np.array([top + 1])]
        want = [[len(np.intersect1d(g, s)) for s in sets] for g in guests]
        assert copies.Common(sets).counts(guests).tolist() == want


def test_links_join_components_once():
    """A crowd of near copies that are all linked gives a spanning forest, not its pairs."""
    base = np.arange(100)
    rows = [(i, i, 100, np.r_[base[:95], 1000 * i + np.arange(5)]) for i in range(1, 60)]
    table = pa.table({"mk_set": [r[0] for r in rows], "mk_comp": [r[1] for r in rows], "mk_n": [100] * len(rows),
                      "mk_shingles": [r[3] for r in rows]})
    assert copies._linked(table, table).num_rows == len(rows) - 1
    assert copies._linked(table, table.slice(0, 0)).num_rows == 0


def test_links_in_bounded_memory(monkeypatch):
    """Shingles that a few sets of many share are counted in parts, and parts change no link."""
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 1500, 200)) for _ in range(4000)]
    sets[3000:3040] = [np.append(s, 10 ** 6 + i) for i, s in enumerate(sets[:40])]
    table = pa.table({"mk_set": np.arange(4000), "mk_comp": np.arange(4000), "mk_n": [len(s) for s in sets],
                      "mk_shingles": sets})
    tracemalloc.start()
    found = copies._linked(table.slice(0, 50), table.slice(1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(*found.to_pydict().values())) == [(i, 3000 + i) for i in range(40)]
    assert peak < 60e6
    for cells, shingles_, hits in ((1, 1, 1), (70, 500, 90)):
        for name, most in (("CELLS", cells), ("GUEST_SHINGLES", shingles_), ("HITS", hits)):
            monkeypatch.setattr(copies, name, most)
        assert copies._linked(table.slice(0, 50), table.slice(2990, 60)).equals(found)


def test_bit_map_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(copies, "LEAST_WORDS", 4)
    monkeypatch.setattr(copies, "MOST_WORDS", 64)
    values = [int(v) for v in np.random.default_rng(0).integers(-2**63, 2**63 - 1, 2000)]
    bits = copies.bit_map(spark.createDataFrame([(v,) for v in values], "v long"), "v")
    assert len(bits) == 64 and all(copies.in_map(bits, v) for v in values)


def test_clashing_names_come_back(spark):
    rows = [(1, "a b c d e f", 3, 1, 2, "s"), (2, "a b c d e f", 4, 5, 6, "t"), (3, "other words", 7, 8, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mk_row long, mk_own long, mk_first int, mk_set string")
    assert sorted(map(tuple, copies.keep_one(docs).collect())) == [rows[0], rows[2]]


def test_components_beside_the_edits(spark):
    texts = planted(9)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other"), (None, texts[0])],
                                 "doc_id long, text string").repartition(3)
    got = minhash.edits(docs, components=copies.near_copies(docs)).collect()
    want = groups(texts)
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted(
        [(str(i), c) for i, c in enumerate(want)] + [("3", want[3]), ("3", 3), ("None", want[0])])


def marked(spark, texts):
    """The rows of the stage, with bands that no two sets share."""
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    own = docs.mapInArrow(copies._marked_batches, "mk_set long, mk_bands array<long>, mk_fp long")
    return docs, own.withColumn("mk_bands", F.array("mk_set")).cache()


def test_fingerprints_give_candidates(spark):
    """Sets share a key just as their fingerprints are connected within two bits."""
    texts = planted()[:40] + ["a b c d e f", "A b c d e f", "a b c d e f a b c d e f", "", "one"]
    texts += [f"{t} {t}" for t in texts[:5]]
    _, own = marked(spark, texts)
    prints = [simhash.simhash(t.encode(), 5) for t in texts]
    label = list(range(len(texts)))
    for i, one in enumerate(prints):
        for j in range(i):
            if (one ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    hasher, want = minhash.Hasher(), {}
    for t, group in zip(texts, label):
        want.setdefault(group, set()).add(copies.set_id(copies.shingle_set(hasher, t.encode())))
    got = {}
    for r in copies.print_postings(own).collect():
        got.setdefault(r.mk_key, set()).add(r.mk_set)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_fingerprints_link_what_no_band_does(spark):
    """Candidates by SimHash alone are compared by Jaccard."""
    words = [f"w{i}" for i in range(400)]
    near, scratch = " ".join([*words, "end"]), common.Scratch(spark)
    texts = [" ".join(words), near, "other words altogether", "still other words"]
    prints = [simhash.simhash(t.encode(), 5) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    docs, own = marked(spark, texts)
    assert copies.set_roots(own, docs, scratch).count() == 0
    roots = copies.set_roots(own, docs, scratch, copies.print_postings(own)).collect()
    hasher = minhash.Hasher()
    assert {r.mk_set for r in roots} == {copies.set_id(copies.shingle_set(hasher, t.encode())) for t in texts[:2]}
    assert len({r.mk_root for r in roots}) == 1
    # Fingerprints within two bits are no link by themselves.
    forced = own.select("mk_set", F.lit(1).cast("long").alias("mk_key"))
    assert len(copies.set_roots(own, docs, scratch, forced).collect()) == 2
    scratch.drop()
