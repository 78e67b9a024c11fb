"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file. The normaliser writes spaces as U+2581 and one more in front.
The lexicon reads the characters of a piece along its states, writes the piece's id where one ends, and begins
anew. The byte fallback reads a character that no piece covers and writes the ids of its bytes. The lexicon with
its fallback is composed with the normaliser once, and with each text lazily, state by state, while the shortest path in the
tropical semiring is sought: the cheapest state first, and the longest piece first among arcs that weigh nothing.

In a unigram model a piece weighs its negative score. In a BPE model the weights come from an acceptor over pairs of
pieces, composed in as well: 0 if the model's merges leave the two side by side, infinity if not. A sequence is the
model's own encoding just if all its pairs weigh 0 (its states are the last piece written, so a place may be reached
in several of them). Where ties among merges leave no path of finite weight, the merges themselves are carried out.

No piece crosses from another character to U+2581, nor covers a line break; the composed machine returns to its start there,
and paths of the parts are kept for reuse.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import common

#: The vocabulary of the registered query; a parameter of everything else.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Parts kept for reuse in a worker, and the longest of them.
KEPT = 600_000
LONGEST = 64
#: Pairs whose weight a worker remembers.
PAIRS = 500_000
#: Bytes of text encoded together, unless a single text has more.
SLICE = 1 << 20
#: Weight of a character written as bytes.
FALLBACK = 1e6


def fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message's fields."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if message[i - 1] < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = message[i:i + size], i + size
            if kind == 5:
                value = struct.unpack("<f", value)[0]
        yield key >> 3, value


@dataclass
class Model:
    """A model file's vocabulary and normaliser; raises for those that are not built here."""
    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    prefix: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls([])
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                model.pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                model.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(fields(value))
                model.prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("the normaliser must be the identity, keep white space and escape it")
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("the model must be BPE or unigram")
        if sum(k == BYTE for _, _, k in model.pieces) != 256:
            raise ValueError("the model must have byte fallback")
        return model


@dataclass
class Normaliser:
    """A transducer of one state: a symbol is written as ``arcs`` has it, others as they are. ``front`` is read as if
    it stood before the text."""
    front: str = " "
    arcs: dict[str, str] = field(default_factory=lambda: {" ": SPACE})


@dataclass
class Lexicon:
    """The pieces and their byte fallback: arcs[state][symbol] is the next state, 0 the first.

    ends[state] is the id written where a piece ends (-1: none does), from where it begins anew; weights[id] is what
    that adds. A symbol that is no piece itself is written as the ids of ``spelled``.
    """
    arcs: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [-1])
    weights: list[float] = field(default_factory=list)
    normal: dict[str, str] = field(default_factory=dict)
    bytes: list[int] = field(default_factory=list)

    def add(self, piece: str, own: int) -> None:
        state = 0
        for symbol in piece:
            after = self.arcs[state].get(symbol)
            if after is None:
                after = self.arcs[state][symbol] = len(self.arcs)
                self.arcs.append({})
                self.ends.append(-1)
            state = after
        self.ends[state] = own

    def spelled(self, symbol: str) -> list[int]:
        """The byte fallback."""
        return [self.bytes[b] for b in self.normal.get(symbol, symbol).encode()]

    def after(self, normaliser: Normaliser) -> Lexicon:
        """The composition: reads what the normaliser reads, and goes where its writing leads."""
        changed = normaliser.arcs

        def composed(arcs: dict[str, int]) -> dict[str, int]:
            same = {y: state for y, state in arcs.items() if y not in changed}
            return same | {x: arcs[y] for x, y in changed.items() if y in arcs}

        return Lexicon([composed(own) for own in self.arcs], self.ends, self.weights, changed, self.bytes)


@dataclass
class Transducer:
    """The composed transducers of a model."""
    model: Model
    kept: dict = field(default_factory=dict)

    def __post_init__(self):
        pieces = self.model.pieces
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.scored = self.model.kind == UNIGRAM
        if self.scored and any(self.score[i] > 0 for i in self.ids.values()):
            raise ValueError("scores of a unigram model must be logarithms of probabilities")
        self.bytes = [i for _, i in sorted((int(p[3:5], 16), i) for i, (p, _, k) in enumerate(pieces) if k == BYTE)]
        lexicon = Lexicon(weights=[-s if self.scored else 0.0 for s in self.score], bytes=self.bytes)
        for p, own in self.ids.items():
            lexicon.add(p, own)
        self.normaliser = Normaliser(" " if self.model.prefix else "")
        self.machine = lexicon.after(self.normaliser)
        covered = set("".join(self.ids))
        apart = "".join(c for c in "\n\r\t" if c not in covered)
        letter, other = r"[^\W\d_]", rf"(?:[^\w {SPACE}{apart}]|[\d_])"
        part = rf"[ {SPACE}]*{other}*{letter}+|[ {SPACE}]*{other}+|[ {SPACE}]+"
        if any(re.search(rf"{letter}(?!{letter})(?s:.)", p) for p in self.ids):
            part = rf"[ {SPACE}]*[^ {SPACE}{apart}]+|[ {SPACE}]+"
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            part = "(?s:.+)"
        elif apart:
            part = f"[{apart}]|{part}"
        self.parts = re.compile(part)
        self.pairs: dict[tuple[int, int], float] = {}
        self.written = [b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else
                        bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
                        for p, _, k in pieces]
        self.table = pa.array(self.written, pa.large_binary())
        self.kept = _Kept(self)

    def merged(self, text: str) -> list[str]:
        """What a BPE model's merges make of a normalised text: the best-scored neighbours first, then the leftmost."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                own = self.ids.get(both)
                if own is not None:
                    heapq.heappush(heap, (-self.score[own], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            right = after[i]
            if parts[i] is None or right >= len(parts) or parts[i] + parts[right] != both:
                continue
            parts[i], parts[right] = both, None
            after[i] = after[right]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def pair(self, left: int, right: int) -> float:
        """The acceptor's weight of two pieces side by side."""
        a, b = self.model.pieces[left][0], self.model.pieces[right][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = 0.0 if self.merged(a + b) == [a, b] else math.inf
        return found

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path through the machine composed with a text."""
        found = self.shortest(text)
        if found is None:
            normal = "".join(self.normaliser.arcs.get(c, c) for c in text)
            for p in self.merged(normal):
                found = [*(found or []), *([self.ids[p]] if p in self.ids else self.machine.spelled(p))]
        return found

    def shortest(self, text: str) -> list[int] | None:
        """Those ids; None if every path's weight is infinite.

        A state is a place of the text, and in a BPE model the piece written last (-1 after bytes). The acceptor's
        weight of an arc is looked up only when its turn comes: it is 0 or puts the arc out.
        """
        machine, n, scored, known = self.machine, len(text), self.scored, self.pairs.get
        arcs, ends, weights, push, pop = machine.arcs, machine.ends, machine.weights, heapq.heappush, heapq.heappop
        stride = 1 if scored else len(weights) + 1
        reached, done = [(0, -1, -1)], set()
        heap: list[tuple[float, int, int, int]] = []
        # What weighs no more than the state it comes from, and so precedes all of the heap.
        level: list[tuple[int, int, int]] = []
        cost, at, here = 0.0, 0, 0
        while at < n:
            state, i = 0, at
            while i < n and (state := arcs[state].get(text[i], -1)) >= 0:
                i += 1
                own = ends[state]
                if own >= 0:
                    if weights[own]:
                        push(heap, (cost + weights[own], -i, own, here))
                    else:
                        level.append((i, own, here))
            first = arcs[0].get(text[at], -1)
            if first < 0 or ends[first] < 0:
                push(heap, (cost + FALLBACK, -at - 1, -1, here))
            while level or heap:
                if level:
                    at, own, parent = level.pop()
                else:
                    cost, at, own, parent = pop(heap)
                    at = -at
                if not scored and own >= 0:
                    left = reached[parent][1]
                    if left >= 0:
                        weight = known((left, own))
                        if (self.pair(left, own) if weight is None else weight) > 0:
                            continue
                key = at * stride + (0 if scored else own + 1)
                if key not in done:
                    done.add(key)
                    here = len(reached)
                    reached.append((at, own, parent))
                    break
            else:
                return None
        out: list[list[int]] = []
        while here:
            _, own, parent = reached[here]
            out.append([own] if own >= 0 else machine.spelled(text[reached[parent][0]]))
            here = parent
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoded(text) if text else b"", np.int32)

    def encoded(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, self.parts.findall(self.normaliser.front + text)))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text

    def decoded(self, ids: pa.Array, sizes: np.ndarray, none: pa.Array) -> pa.Array:
        """``decode`` of many: text i has the ids from sizes[i] to sizes[i + 1]; null where ``none`` is true."""
        written = self.table.take(ids)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(written).to_numpy())])[sizes]
        buffer = written.buffers()[2]
        whole = memoryview(buffer) if buffer is not None else memoryview(b"")
        texts = (str(whole[a:b], "utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist()))
        if self.model.prefix:
            texts = (t[1:] if t.startswith(" ") else t for t in texts)
        return pa.array([None if n else t for t, n in zip(texts, none.to_pylist())], pa.string())


class _Kept(dict):
    """Paths of parts as bytes of 32-bit ids, worked out when first asked for.

    Once half of KEPT is full, it becomes the older half; what is asked for again moves back to the newer.
    """

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = array("i", self.transducer.path(part)).tobytes()
        if len(part) <= LONGEST:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[part] = found
        return found


_compiled: dict[bytes, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The transducer of a model file's bytes, one for each worker."""
    if data not in _compiled:
        _compiled[data] = Transducer(Model.parse(data))
    return _compiled[data]


def _encoded_batches(transducer: Transducer, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with what ``encoded`` adds to the texts in column ``at``, in slices of bounded size."""
    for batch in batches:
        for start, stop in common.slices(batch.column(at), SLICE):
            part = batch.slice(start, stop - start)
            column = part.column(at)
            ids, sizes = [], [0]
            for text in column.to_pylist():
                own = transducer.encoded(text) if text else b""
                ids.append(own)
                sizes.append(sizes[-1] + len(own) // 4)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            none = column.is_null()
            lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), flat, mask=none)
            texts = transducer.decoded(flat, np.array(sizes), none)
            yield pa.RecordBatch.from_arrays([*part.columns, lists, texts, pc.equal(texts, column)],
                                             names=[*part.schema.names, "mk_ids", "mk_decoded", "mk_same"])


def encoded(docs: DataFrame, model_path: str = MODEL, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (array of int), decoded (their text) and round_trip (does it equal the text?).

    A null text has null ids and decoded, and no round trip (null). An empty text has no ids. U+2581 in a text
    comes back as a space, all else as it was. The model file is read on the driver and sent along, so executors
    need no copy. Other columns pass through, whatever their names.
    """
    with open(model_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    at = docs.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded_batches(compiled(data.value), at, batches)

    named = docs.toDF(*[f"mk_{i}" for i in range(len(docs.columns))])
    schema = T.StructType(list(named.schema)).add("mk_ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("mk_decoded", "string").add("mk_same", "boolean")
    return named.mapInArrow(rewrite, schema).toDF(*docs.columns, "ids", "decoded", "round_trip")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs).select("doc_id", "ids", F.size("ids").alias("n_ids"),
                                F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
