"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents are dealt to shards by a hash of their id. In each shard every source has votes, its target's share
that falls on the shard, and blocks of equally many words are given to sources one by one at the highest
quotient votes / (2 * blocks + 1). That gives an integer quota for each source in each shard. A source's words in
a shard, documents in seeded order, are then cut into blocks, and a run of as many blocks as the quota asks for
is taken, beginning at a seeded block and going around; a quota above the number of blocks takes every block
once, or twice, first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm import common

#: Weights of the sources in code-point order, repeating; the mix's words as a share of all words; the most
#: that is taken of a source or document, as a multiple of its size.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block, words of a shard, seed of the order and of the first block.
BLOCK = 8
SHARD = 500_000
SEED = 20


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats for each party at the highest quotients votes / 1, / 3, / 5, ...; ties go to the earlier party."""
    votes = np.asarray(votes, np.float64)
    given = np.zeros(len(votes), np.int64)
    if seats <= 0 or not (votes > 0).any():
        return given
    # Rounding down at a slightly larger divisor never gives more than is due; the rest go one by one.
    divisor = votes.sum() / seats
    given = np.floor(votes / (divisor * (1 + (len(votes) + 1) / (2 * seats)))).astype(np.int64)
    given = np.maximum(given - 1, 0)
    for _ in range(seats - int(given.sum())):
        given[np.argmax(votes / (2 * given + 1))] += 1
    return given


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): target words of each source.

    ``sizes`` has one row for each source: (source, source_size). Sources in code-point order, null last, weigh
    ``weights`` repeating and share ``share`` of all words; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight, until none is above. Water rises to one level: a source gets
    weight x level, or its stop. Each round is one aggregate whose two sums come to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = common.settle(sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights) + 1)))
    stop = F.col("source_size") * float(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = stop <= F.col("weight") * F.lit(level)
        filled, open_weight = weighed.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (share * total - (filled or 0.0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), stop).alias("target"))


def quotas(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``quota`` to (shard, source, size, votes): blocks of each source in each shard."""
    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        blocks = -(-pdf["size"].to_numpy() // block)
        dealt = sainte_lague(pdf["votes"].to_numpy(), int(round(pdf["votes"].sum() / block)))
        return pdf.assign(quota=np.minimum(dealt, MOST * blocks))

    return cells.groupBy("shard").applyInPandas(
        deal, "shard long, source string, size long, votes double, quota long")


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD, seed: int = SEED) -> DataFrame:
    """Columns of ``docs`` as mk_row with size, source_size, target, taken and the taken word range.

    ``docs`` has (doc_id, source, size) and may have more columns. taken counts words with repeats: every word
    ``rounds`` times, and once more the words [from, upto) and those before ``wrapped``. Null ids hash like
    a value; a source without words has target 0. Reruns agree: everything hangs on ids, sources and the seed;
    rows with equal ids are ordered by size.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    sharded = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
    cells = sharded.groupBy("shard", "source").agg(F.sum("size").alias("size"))
    on = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("size") / F.col("source_size")).otherwise(0.0)
    cells = cells.join(targets, on(cells, targets, "source"), "left").select(
        "shard", cells.source, "size", votes.alias("votes"), "source_size", "target")
    dealt = quotas(cells.select("shard", "source", "size", "votes"), block)
    dealt = common.settle(dealt.join(targets, on(dealt, targets, "source"), "left").select(
        "shard", dealt.source, F.col("size").alias("cell"), "quota", "source_size", "target"))
    joined = sharded.join(dealt, on(sharded, dealt, "shard", "source"), "left").drop(dealt.shard).drop(dealt.source)
    order = (Window.partitionBy("shard", "source").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = joined.withColumn("mk_end", F.sum("size").over(order))
    blocks = F.ceil(F.col("cell") / block)
    rounds = F.when(blocks > 0, F.floor(F.col("quota") / blocks)).otherwise(0)
    rest = F.when(blocks > 0, F.col("quota") % blocks).otherwise(0)
    first = F.when(blocks > 0, F.pmod(F.xxhash64("shard", "source", F.lit(seed + 2)), blocks)).otherwise(0)
    start = F.col("mk_end") - F.col("size")
    begin, upto = F.col("mk_first") * block, F.least((F.col("mk_first") + F.col("mk_rest")) * block, F.col("cell"))
    over = F.greatest(F.lit(0), (F.col("mk_first") + F.col("mk_rest") - F.col("mk_blocks")) * block)
    inside = lambda x: F.least(F.greatest(x - start, F.lit(0)), F.col("size"))
    return (placed.withColumns({"mk_blocks": blocks, "mk_rest": rest, "mk_first": first, "rounds": rounds})
            .withColumns({"from": inside(begin), "upto": inside(upto), "wrapped": inside(over)})
            .withColumn("taken", (F.col("size") * F.col("rounds") + F.col("upto") - F.col("from")
                                  + F.col("wrapped")).cast("long"))
            .drop("mk_end", "mk_blocks", "mk_rest", "mk_first", "cell", "quota"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(common.settle(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole texts as often as they are taken whole, and for a cut
    document one more row with the words taken of it, joined by spaces; its n_chars follows the text.

    Documents of which nothing is taken are left out. Equal rows are told apart by a running number.
    """
    # The four columns that count here by name, all others by place.
    known = ("doc_id", "source", "text", "n_chars")
    places = [f"mk_{c}" if c in known else f"mk_other_{i}" for i, c in enumerate(docs.columns)]
    named = docs.toDF(*places)
    named = named.withColumn("mk_row", F.xxhash64(*places))
    sized = named.select(F.col("mk_doc_id").alias("doc_id"), F.col("mk_source").alias("source"),
                         word_count(F.col("mk_text")).alias("size"), "mk_row")
    ours, theirs = Window.partitionBy("mk_row", "mk_doc_id"), Window.partitionBy("mk_row", "doc_id")
    plan = mix(common.settle(sized)).where("taken > 0").withColumn(
        "mk_nth", F.row_number().over(theirs.orderBy(F.desc("taken"), "from"))).select(
        F.col("mk_row").alias("row"), F.col("doc_id").alias("id"), F.col("mk_nth").alias("nth"), "size", "rounds",
        "from", "upto", "wrapped")
    own = named.withColumn("mk_nth", F.row_number().over(ours.orderBy(F.lit(1))))
    both = own.join(plan, (own.mk_row == plan.row) & (own.mk_nth == plan.nth) & own.mk_doc_id.eqNullSafe(plan.id))
    words = F.regexp_extract_all("mk_text", F.lit(common.WORD), F.lit(0))
    some = F.col("upto") - F.col("from")
    part = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("wrapped").cast("int")),
                                 F.slice(words, F.col("from").cast("int") + 1, some.cast("int"))), " ")
    last = F.when(some + F.col("wrapped") >= F.col("size"), F.col("mk_text")).otherwise(part)
    copies = F.concat(F.array_repeat("mk_text", F.col("rounds").cast("int")),
                      F.when(some + F.col("wrapped") > 0, F.array(last)).otherwise(F.array().cast("array<string>")))
    rows = both.withColumn("mk_copy", F.explode(copies))
    chars = F.when(F.col("mk_copy") == F.col("mk_text"), F.col("mk_n_chars")).otherwise(F.length("mk_copy"))
    made = {"mk_text": F.col("mk_copy"), "mk_n_chars": chars}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in places]).toDF(*docs.columns)
