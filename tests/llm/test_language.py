import zlib

import numpy as np

from panelkit.llm import language


def test_gradient_by_finite_differences():
    net = language.Network.start(["a", "b", "c"], units=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    draw = np.random.default_rng(2)
    spans = draw.integers(97, 101, (5, language.SPAN)).astype(np.uint8)
    sizes, truth = np.array([64, 7, 1, 30, 64]), np.array([0, 1, 2, 1, 0])
    valid = np.arange(language.SPAN)[:, None] < sizes

    def loss():
        p = net.positions(spans, sizes)
        return -np.log(np.take_along_axis(p, truth[None, None, :], axis=0)[0][valid]).mean()

    slopes = net.slopes(spans, sizes, truth)
    for name, value in net.w.items():
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in value.shape)
            if name[0] == "W":
                at = (at[0], int(spans[0, 3]), at[2])
            kept, step = value[at], 1e-3
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - slopes[name][at]) < 2e-3, (name, at)


def test_pooling_is_the_mean_over_positions():
    net = language.Network.start(["a", "b"])
    text = ("héllo wörld " * 20).encode()
    data, offsets = np.frombuffer(text + b"xy", np.uint8), np.array([0, len(text), len(text), len(text) + 2])
    got = net.pooled(data, offsets)
    spans, sizes, owner = language.cut(data, offsets)
    p = net.positions(spans, sizes)
    want = np.mean([p[:, t, s] for s in np.flatnonzero(owner == 0) for t in range(sizes[s])], axis=0)
    assert np.allclose(got[0], want, atol=1e-5) and np.allclose(got[1], 0.5)
    assert b"".join(bytes(s[:n]) for s, n in zip(spans, sizes)) == bytes(data)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.query(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.985
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, odd_docs):
    net = language.learn(odd_docs, fit_rows=5, steps=3)
    assert net.langs == ["de", "en"]
    got = language.predict(odd_docs, net).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (0, 1, 2, 3, 17, 18)] == ["und"] * 6 and by_id[10] in net.langs
    nothing = odd_docs.limit(0)
    assert language.learn(nothing) is None and language.predict(nothing, None).count() == 0
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}
