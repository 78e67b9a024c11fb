"""Token counts of the sections of a text, by offsets.

A document is encoded once, as a whole. The bytes of its tokens give each token's place, and an interval join of
token places with section places tells which sections a token touches. A token inside one section counts there;
one that crosses a boundary is allotted by a stated rule:

* ``first``: to the section that holds its first byte;
* ``largest``: to the section that holds most of its bytes, the earlier one in a tie;
* ``share``: to every section it touches, in proportion to its bytes there.

Bytes outside all sections count nowhere, and a token that touches no section is left over.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import common

#: The vocabulary of the registered query (ranks of a byte-level BPE) and the pattern it was made with; parameters
#: of everything else.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "largest", "share")
RULE = "largest"


class Encoder:
    """A byte-level BPE vocabulary; knows the bytes of each token."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        pairs = [line.split() for line in ranks.splitlines() if line]
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values(), default=-1) + 1, np.int64)
        for token, rank in table.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte at which each token of a text ends."""
        return np.cumsum(self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)])


def allot(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, given token ends and sections in order that don't overlap.

    Each token touches the sections from the first that ends beyond its start to the last that starts before its
    end; empty sections touch nothing. Crossing tokens count where they are allotted, with ``share`` in the
    section of their first byte within a section.
    """
    count, crossing = np.zeros(len(starts_of)), np.zeros(len(starts_of), np.int64)
    real = np.flatnonzero(ends_of > starts_of)
    if not len(real) or not len(ends):
        return count, crossing
    begin, stop = starts_of[real], ends_of[real]
    starts = np.concatenate([[0], ends[:-1]])
    low = np.searchsorted(stop, starts, side="right")
    high = np.searchsorted(begin, ends, side="left") - 1
    touches = low <= high
    inside = touches & (low == high)
    np.add.at(count, real[low[inside]], 1)
    for t in np.flatnonzero(touches & (low < high)):
        own = np.arange(low[t], high[t] + 1)
        shared = np.minimum(stop[own], ends[t]) - np.maximum(begin[own], starts[t])
        if rule == "share":
            count[real[own]] += shared / shared.sum()
            crossing[real[own[0]]] += 1
        else:
            at = real[own[0 if rule == "first" else int(np.argmax(shared))]]
            count[at] += 1
            crossing[at] += 1
    return count, crossing


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places of a text's lines, each with its line break."""
    cuts = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(data)]])


_encoders: dict[tuple[bytes, str], Encoder] = {}


def counted(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN, rule: str = RULE,
            text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """One row per section: the columns of ``docs`` but the text, then n_tokens, section, start, end,
    section_tokens and section_crossing.

    Sections are the text's lines, each with its line break, or those of ``sections_col``: arrays of (start, end)
    in code points, in order and without overlap; others raise. A null text counts as empty. An empty text has one
    empty line; a row with an empty or null array of sections has no rows. n_tokens counts the whole text's tokens,
    section_tokens is a double under every rule, section_crossing counts crossing tokens. Other columns pass
    through, whatever their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks.value, pattern)
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        encoder = _encoders[key]
        for batch in batches:
            given = batch.column(batch.num_columns - 2).to_pylist()
            total, parts, sizes = [], [], [0]
            for raw, spans in zip(common.texts_of(batch.column(batch.num_columns - 1)), given):
                data = np.frombuffer(raw, np.uint8)
                ends = encoder.ends(raw.decode())
                # Where each code point begins, in bytes, and the other way around.
                leads = np.flatnonzero((data & 0xC0) != 0x80)
                if sections_col is None:
                    a, b = _lines(data)
                else:
                    points = np.append(leads, len(data))
                    chars = np.array([(s["start"], s["end"]) for s in spans or []], np.int64).reshape(-1, 2)
                    if (np.diff(chars.ravel()) < 0).any():
                        raise ValueError("sections must be in order and not overlap")
                    a, b = points[np.clip(chars, 0, len(leads))].T if len(chars) else (chars[:, 0], chars[:, 1])
                tokens, crossing = allot(ends, a, b, rule)
                total.append(len(ends))
                sizes.append(sizes[-1] + len(a))
                parts.append((np.arange(len(a)), np.searchsorted(leads, a), np.searchsorted(leads, b), tokens, crossing))
            flat = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0)] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            rows = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(
                (x.astype(t.to_pandas_dtype()) for x, t in zip(flat, types)), types)], names=NAMES)
            lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(total, pa.int64()), lists],
                                             names=[*batch.schema.names[:-2], "mk_total", "mk_sections"])

    kept = [c for c in docs.columns if c not in (text_col, sections_col)]
    named = docs.select(*[F.col(f"`{c}`").alias(f"mk_{i}") for i, c in enumerate(kept)],
                        (F.lit(None).cast("int") if sections_col is None else F.col(sections_col)).alias("mk_given"),
                        F.col(text_col).alias("mk_text"))
    section = T.StructType([T.StructField(n, t) for n, t in zip(NAMES, (
        T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType()))])
    schema = named.drop("mk_given", "mk_text").schema.add("mk_total", "long").add("mk_sections", T.ArrayType(section))
    rows = named.mapInArrow(count, schema).withColumn("mk_sections", F.explode("mk_sections"))
    return rows.select(*[F.col(f"mk_{i}").alias(c) for i, c in enumerate(kept)], F.col("mk_total").alias("n_tokens"),
                       "mk_sections.section", "mk_sections.start", "mk_sections.end",
                       F.col("mk_sections.tokens").alias("section_tokens"),
                       F.col("mk_sections.crossing").alias("section_crossing"))


NAMES = ["section", "start", "end", "tokens", "crossing"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs).withColumn("section_tokens", F.col("section_tokens").cast("long"))
