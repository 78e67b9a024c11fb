import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from panelkit.llm import pieces


@pytest.fixture(scope="module")
def both():
    with open(pieces.MODEL, "rb") as file:
        return pieces.compiled(file.read()), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


WORDS = ["the", " ", "  ", "   ", "\n", "é", "ß", "hello", "World", "ation", "ing", "123", "..", "  a", "\t", "\U0001f600",
         "<s>", "0x", "ou", "$$$", "can't", "_x_", "Ⅷ", "ª", "日本", "\x00", "\r\n"]


def test_ids_equal_the_library(both, texts):
    transducer, library = both
    draw = random.Random(5)
    made = ["".join(draw.choice(WORDS) for _ in range(draw.randint(1, 16))) for _ in range(3000)]
    made += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)) for _ in range(1000)]
    for text in made + [t for t in texts if t and "▁" not in t]:
        ids = transducer.encode(text).tolist()
        assert ids == library.encode(text), text
        assert transducer.decode(ids) == text == library.decode(ids)


def test_shortest_path_against_all_paths(both):
    """Of a unigram model: every way to cut the text, scored."""
    transducer = pieces.Transducer(pieces.Model(
        [(p, s, k) for p, s, k in both[0].model.pieces if k == pieces.BYTE]
        + [(p, -float(c), pieces.NORMAL) for p, c in
           [("▁", 3), ("a", 5), ("b", 6), ("ab", 7), ("▁a", 6), ("ba", 4), ("abab", 13), ("▁ab", 9)]], pieces.UNIGRAM))

    def costs(text):
        if not text:
            return [(0.0, [])]
        out = []
        for i in range(1, len(text) + 1):
            own = transducer.ids.get(text[:i])
            if own is not None:
                head, arc = -transducer.score[own], [own]
            elif i == 1:
                head, arc = pieces.FALLBACK, [transducer.bytes[x] for x in text[0].encode()]
            else:
                continue
            out += [(head + c, arc + rest) for c, rest in costs(text[i:])]
        return out

    for text in ("ab", "abab", "aabba", "é ab", "ab ab ba", "baé"):
        normal = "▁" + text.replace(" ", "▁")
        every = costs(normal)
        low = min(c for c, _ in every)
        assert transducer.encode(text).tolist() in [ids for c, ids in every if abs(c - low) < 1e-9]
        assert transducer.decode(transducer.encode(text).tolist()) == text


def test_pairs_alone_find_the_encoding(both, texts):
    """Of the registered model: no text needs the merges, and its path is the only one of finite weight."""
    transducer, library = both
    draw = random.Random(8)
    made = ["".join(draw.choice(WORDS + ["th", "e ", " an", "st"]) for _ in range(draw.randint(1, 9))) for _ in range(800)]
    for text in made + [" " * n for n in range(1, 130)]:
        assert transducer.shortest(" " + text) == library.encode(text), text

    def finite(text, at, left):
        if at == len(text):
            return [[]]
        out = []
        for end in range(at + 1, len(text) + 1):
            own = transducer.ids.get(text[at:end], -1)
            if own >= 0 and (left < 0 or transducer.pair(left, own) == 0):
                out += [[own, *rest] for rest in finite(text, end, own)]
        return out

    for text in ("the cathedral", "   x", "banana bread", "transduction"):
        assert finite("▁" + text.replace(" ", "▁"), 0, -1) == [library.encode(text)]


def test_composition_reads_what_the_normaliser_reads():
    lexicon = pieces.Lexicon(weights=[0.0] * 3, bytes=list(range(256)))
    for own, piece in enumerate(("▁a", "a▁", "b")):
        lexicon.add(piece, own)
    machine = lexicon.after(pieces.Normaliser(arcs={" ": "▁", "B": "b"}))

    def read(symbols):
        state = 0
        for c in symbols:
            state = machine.arcs[state].get(c, -1)
            if state < 0:
                return None
        return machine.ends[state]

    assert [read(x) for x in (" a", "▁a", "a ", "a▁", "b", "B", "A", " ")] == [0, 0, 1, 1, 2, 2, None, -1]
    assert machine.spelled(" ") == list("▁".encode()) and machine.spelled("é") == list("é".encode())


def test_merges_with_a_heap(both):
    transducer = both[0]

    def plain(text):
        parts = list(text)
        while True:
            offers = [(-transducer.score[transducer.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                      if a + b in transducer.ids]
            if not offers:
                return parts
            i = min(offers)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(3)
    for _ in range(800):
        text = "".join(draw.choice(["▁", "▁", "a", "e", "t", "h", "in", "..", "é", "日"]) for _ in range(draw.randint(0, 25)))
        assert transducer.merged(text) == plain(text), text


def test_long_runs(both):
    transducer, library = both
    for text in (" " * 100_000, " " * 100_000 + "x", "x" + " " * 50_000 + "\n", "a" * 50_000, "é日" * 20_000, "=" * 50_000):
        begun = time.time()
        assert transducer.encode(text).tolist() == library.encode(text)
        assert time.time() - begun < 10


def test_kept_paths_are_bounded_and_stay_right(both, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 8)
    transducer = pieces.Transducer(both[0].model)
    text = " ".join(f"word{i % 13}x{i}" for i in range(200))
    assert transducer.encode(text).tolist() == both[1].encode(text)
    assert len(transducer.kept) <= 4 and len(transducer.kept.older) <= 4


def test_round_trip_of_tables(spark, odd_docs):
    got = pieces.encoded(odd_docs)
    assert got.columns == [*odd_docs.columns, "ids", "decoded", "round_trip"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.text is None:
            assert r.ids is None and r.decoded is None and r.round_trip is None
        else:
            assert r.decoded == r.text.replace("▁", " ") and r.round_trip == ("▁" not in r.text)
    assert pieces.encoded(odd_docs.limit(0)).count() == 0
    table = pieces.query(spark, "/root/testdata/sf0.001").collect()
    assert len(table) == 200 and all(r.round_trip and r.n_ids == len(r.ids) for r in table)


def test_a_task_encodes_in_slices(spark, monkeypatch):
    """Ten thousand long texts come in one batch: what is made of them at once is bounded, and nothing comes twice."""
    texts = [None, "", *[f"some {i} words " * 3000 for i in range(60)], None, "x" * (3 * pieces.SLICE), "end"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, other int")
    handed, kind = [], type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: handed.append((self, f)) or real(self, f, schema))
    pieces.encoded(docs)
    rows, task = handed[0]
    # The documents' columns, the text once.
    assert len(rows.columns) == 3
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    assert batch.num_rows == len(texts)
    out = list(task(iter([batch])))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= pieces.SLICE for b in out)
    got = [row for b in out for row in zip(*(c.to_pylist() for c in b.columns))]
    assert [r[:3] for r in got] == [(i, t, i) for i, t in enumerate(texts)]
    assert all((r[3] is None, r[4], r[5]) == (t is None, t, None if t is None else True) for r, t in zip(got, texts))
    assert len(out) > 3 and list(task(iter([batch.slice(0, 0)]))) == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model.parse(b"")


def test_texts_decoded_together():
    """Null and empty texts, bytes that are no UTF-8 and controls come out as one by one."""
    with open(pieces.MODEL, "rb") as file:
        machine = pieces.Transducer(pieces.Model.parse(file.read()))
    rows = [machine.encode(t).tolist() for t in ("", "one two", " lead", "\U0001f600 é\n", "▁")]
    rows += [[], machine.bytes[200:203], machine.bytes[0xC3:0xC4], [0, 1, 2], list(range(300))]
    sizes = np.cumsum([0, *map(len, rows)])
    none = [i == 5 for i in range(len(rows))]
    got = machine.decoded(pa.array(np.concatenate([np.asarray(r, np.int32) for r in rows])), sizes, pa.array(none))
    assert got.to_pylist() == [None if n else machine.decode(r) for r, n in zip(rows, none)]
    empty = machine.decoded(pa.array([], pa.int32()), np.zeros(1, np.int64), pa.array([], pa.bool_()))
    assert empty.to_pylist() == []
