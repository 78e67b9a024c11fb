import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest

from panelkit.llm import copies, minhash


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """rows: (id, text) in the operator's order."""
    texts = [t or "" for _, t in rows]
    for i, (doc, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        yield (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(),
               jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(after)))


def in_order(rows):
    return sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))


def test_signature_is_a_function_of_the_shingle_set():
    hasher = minhash.Hasher()
    text = ("alpha beta gamma delta epsilon zeta eta theta " * 3000).encode()
    assert (hasher.signature(text) == hasher.signature(text + b" alpha beta")).all()
    assert minhash.likeness(hasher.signature(b""), hasher.signature(b" \n")) == 1
    assert minhash.likeness(hasher.signature(b"a b"), hasher.signature(b"")) < 0.1
    assert (hasher.signature(b"A  b\tc") == hasher.signature(b"a b c")).all()
    assert len(minhash.written(hasher.signature(b"x"))) == 512


def test_windows_of_a_long_text_leave_no_gap(monkeypatch):
    words = [f"w{i % 977}x{i % 31}" for i in range(4000)]
    whole = np.concatenate(list(minhash.Hasher().shingles(" ".join(words).encode())))
    monkeypatch.setattr(minhash, "WINDOW", 64)
    parts = np.concatenate(list(minhash.Hasher().shingles(" ".join(words).encode())))
    assert len(whole) == 3996 and (whole == parts).all()


def plain(hasher, text):
    """Shingle hashes and signature of one text alone."""
    hashes = np.concatenate([np.zeros(0, np.uint64), *hasher.shingles(text)])
    low, x = np.full(len(hasher.a), 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (hasher.a * x[None, at:at + 2048] + hasher.b).min(axis=1), out=low)
    return hashes, low.astype(np.uint16)


def test_texts_hashed_together_as_alone(texts, monkeypatch):
    draw = np.random.default_rng(4)
    own = [(t or "").encode() for t in texts] + [bytes(draw.choice(list(b"aB \n\t\x0b\x0c\r\x00\x1c"), n)) for n in range(400)]
    hasher = minhash.Hasher()
    for together, lanes in ((1 << 18, 1 << 16), (300, 7), (1, 1 << 16)):
        monkeypatch.setattr(minhash, "TOGETHER", together)
        monkeypatch.setattr(minhash, "LANES", lanes)
        got = [(hashes[a:b], low) for hashes, starts in hasher.slices(own if lanes > 7 else own[19:])
               for a, b, low in zip(starts, starts[1:], hasher.signatures(hashes, starts))]
        for text, (hashes, low) in zip(own if lanes > 7 else own[19:], got, strict=True):
            want = plain(hasher, text)
            assert (len(hashes), low.dtype) == (len(want[0]), np.uint16)
            assert (hashes == want[0]).all() and (low == want[1]).all()
    assert list(hasher.slices([])) == []


def test_texts_hashed_together_take_less_time():
    """Sets, bands and edits of texts take a good part less than the hashes and minima of each text alone."""
    draw = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 10 ** 5, 400)) for _ in range(400)]
    hasher = minhash.Hasher()
    column, none = pa.array(texts), pa.nulls(len(texts), pa.int64())
    ids = pa.array(range(len(texts)), pa.int64())
    docs = pa.RecordBatch.from_arrays([ids, column], names=["mk_id", "mk_text"])
    dealt = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array([False] * len(texts)), ids, column, none, none],
                                       names="bucket guest id text set component_id".split())

    def seconds(work):
        least = np.inf
        for _ in range(3):
            begun = time.process_time()
            work()
            least = min(least, time.process_time() - begun)
        return least

    alone = seconds(lambda: [np.unique(plain(hasher, t.encode())[0]) for t in texts])
    assert seconds(lambda: list(copies._own_batches(iter([docs])))) < 0.7 * alone
    assert seconds(lambda: list(minhash._pair_batches(iter([dealt])))) < 1.4 * alone


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_likeness_estimates_jaccard(share):
    draw = np.random.default_rng(1)
    hasher, errors = minhash.Hasher(), []
    for _ in range(20):
        a = [f"w{x}" for x in draw.integers(0, 10 ** 6, 600)]
        b = a[:int(600 * share)] + [f"v{x}" for x in draw.integers(0, 10 ** 6, 600 - int(600 * share))]
        a, b = " ".join(a), " ".join(b)
        like = minhash.likeness(hasher.signature(a.encode()), hasher.signature(b.encode()))
        errors.append(like - jaccard(shingles(a), shingles(b)))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.17


def test_edits_against_brute_force(spark, odd_docs):
    got = minhash.edits(odd_docs.repartition(3)).collect()
    want = list(brute(in_order(odd_docs.collect())))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(key(r) for r in got) == sorted(key(r) for r in want)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {"ffff" * 128}
    assert minhash.edits(odd_docs.limit(0)).count() == 0
    one = minhash.edits(odd_docs.where("doc_id = 8").limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = in_order(spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(minhash.query(spark, sf).collect(), key=lambda r: r.doc_id)
    prints = {r.doc_id: r.fingerprint for r in minhash.fingerprints(
        spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r, w in zip(got, brute(rows), strict=True):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == w[:3] and r.fingerprint == prints[r.doc_id]
        assert abs(r.near_edited - w[3]) < 0.2 and abs(r.near_next - w[4]) < 0.2
