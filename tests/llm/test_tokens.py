import numpy as np
import pytest

from panelkit.llm import tokens


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.RANKS, "rb") as file:
        return tokens.Encoder(file.read())


def brute(ends, sections, rule):
    count, crossing, start = [0.0] * len(sections), [0] * len(sections), 0
    for end in ends:
        over = [max(0, min(b, end) - max(a, start)) for a, b in sections]
        hit = [i for i, o in enumerate(over) if o]
        if hit:
            first, most = hit[0], max(hit, key=lambda i: (over[i], -i))
            if rule == "share":
                for i in hit:
                    count[i] += over[i] / sum(over)
            else:
                count[first if rule == "first" else most] += 1
            if len(hit) > 1:
                crossing[most if rule == "largest" else first] += 1
        start = end
    return count, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_allotment_against_brute_force(rule):
    draw = np.random.default_rng(8)
    for _ in range(300):
        ends = np.cumsum(draw.integers(1, 6, draw.integers(0, 30)))
        cuts = np.sort(draw.integers(0, 70, 2 * draw.integers(0, 8)))
        a, b = cuts[::2], cuts[1::2]
        count, crossing = tokens.allot(ends, a, b, rule)
        want = brute(ends.tolist(), list(zip(a.tolist(), b.tolist())), rule)
        assert np.allclose(count, want[0]) and crossing.tolist() == want[1]


def test_lines_of_odd_rows(spark, odd_docs, encoder):
    got: dict = {}
    for r in tokens.counted(odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    source = {r.doc_id: r.text or "" for r in rows}
    assert set(got) == set(source)
    for doc, text in source.items():
        found = sorted(got[doc], key=lambda r: r.section)
        if doc != 5:
            assert "".join(text[r.start:r.end] for r in found) == text
            assert len(found) == text.count("\n") + 1
        assert sum(r.section_tokens for r in found) == found[0].n_tokens
    assert tokens.counted(odd_docs.limit(0)).count() == 0


def test_given_sections_in_code_points(spark, encoder):
    text = "ééé ñandú \U0001f600\U0001f600 end of the text"
    spans = [(0, 4), (4, 9), (9, 12), (14, 20)]
    df = spark.createDataFrame([(1, text, [{"start": a, "end": b} for a, b in spans], "x"), (2, text, [], "y"),
                                (3, None, None, "z")], "doc_id long, text string, fields array<struct<start:int,end:int>>, section string")
    for rule in tokens.RULES:
        rows = tokens.counted(df, rule=rule, sections_col="fields").collect()
        assert [r.doc_id for r in rows] == [1] * 4
        to_bytes = lambda n: len(text[:n].encode())
        want = brute(encoder.ends(text).tolist(), [(to_bytes(a), to_bytes(b)) for a, b in spans], rule)
        assert np.allclose([r[4 if False else "section_tokens"] for r in rows], want[0])
        assert [(r.start, r.end) for r in rows] == spans
    with pytest.raises(ValueError):
        tokens.counted(df, rule="last")


def test_query_on_a_table(spark, encoder):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = {}
    for r in tokens.query(spark, sf).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.section_tokens
        assert r.n_tokens == len(encoder.encoding.encode_ordinary(texts[r.doc_id]))
        a, b = len(texts[r.doc_id][:r.start].encode()), len(texts[r.doc_id][:r.end].encode())
        ends = encoder.ends(texts[r.doc_id])
        inside = np.sum((ends <= b) & (np.concatenate([[0], ends[:-1]]) >= a))
        assert inside <= r.section_tokens <= inside + 2
    assert total == {d: len(encoder.encoding.encode_ordinary(t)) for d, t in texts.items()}
