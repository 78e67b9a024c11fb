import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash

from panelkit.llm import common, simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= radius) + i + 1:
            parent[find(j)] = find(i)
    roots = [find(i) for i in range(len(ids))]
    return [min((ids[j] for j in range(len(ids)) if roots[j] == roots[i] and ids[j] is not None), default=None)
            for i in range(len(ids))]


def test_fingerprints(texts):
    for text in texts:
        assert simhash.simhash((text or "").encode()) == brute_print(text)


@pytest.mark.parametrize("seed", range(4))
def test_bit_sliced_links(seed):
    draw = np.random.default_rng(seed)
    sizes = np.array([2, 3, 70, 1, 130, 64, 65, 2])
    fps = []
    for n in sizes:
        centre = draw.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(n):
            for b in draw.choice(64, draw.integers(0, 4), replace=False):
                centre = centre ^ np.uint64(1 << int(b)) if draw.random() < 0.5 else centre
            fps.append(centre if draw.random() < 0.8 else draw.integers(0, 1 << 63, dtype=np.uint64))
    fps = np.array(fps, np.uint64)
    got = simhash.linked(fps, sizes)
    for start, n in zip(np.cumsum(sizes) - sizes, sizes):
        rows = list(range(start, start + n))
        assert got[rows].tolist() == brute_components(rows, fps[rows])


@pytest.mark.parametrize("cap", [2048, 1])
def test_components_either_way(spark, cap):
    draw = random.Random(3)
    prints = []
    for _ in range(12):
        now = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            prints.append(now)
            for _ in range(draw.randint(0, 3)):
                now ^= 1 << draw.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(s,) for s in set(signed)], "mk_fp long")
    roots = {r.v: r.root for r in simhash.components(simhash.links(rows, cap)).collect()}
    want = brute_components(signed, np.array(prints, np.uint64))
    assert [roots.get(s, s) for s in signed] == want


def test_near_duplicates_and_winners(spark, odd_docs):
    rows = odd_docs.collect()
    prints = np.array([brute_print(r.text) for r in rows], np.uint64)
    want = sorted(zip([str(r.doc_id) for r in rows], [f"{p:016x}" for p in prints],
                      map(str, brute_components([r.doc_id for r in rows], prints))))
    got = simhash.near_duplicates(odd_docs, block_cap=2).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(brute_components(list(range(len(rows))), prints)))
    assert {r.doc_id for r in kept.collect()} >= {0, 5, 6, 8, 18}
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0 and simhash.keep_one(odd_docs.limit(0)).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = np.array([brute_print(r.text) for r in rows], np.uint64)
    got = simhash.query(spark, sf).orderBy("doc_id").collect()
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == brute_components([r.doc_id for r in rows], prints)


def test_rounds_write_no_more_files_than_their_edges_fill(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    files = lambda: {f for f in folder.rglob("part-*")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        there = files()
        found = simhash.components(edges)
        assert 0 < len(files() - there) < 2 * 40
        assert {r.root for r in found.collect()} == {0} and found.count() == 101
        monkeypatch.setattr(common, "FILE_ROWS", 8)
        assert {r.root for r in simhash.components(edges).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 199)]
    found = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 199, 199: 199}
