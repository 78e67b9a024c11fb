"""What five document filters remove, alone and in every order, from one potential for each part.

A removal game gives each coalition of filters the number of documents that fail any of them. Its Hart-Mas-Colell
potential follows recursively over the 32 coalitions: nothing for none, otherwise the coalition's worth plus the
potentials without one member, divided by the number of members. A filter's Shapley value is the potential of all
filters minus the potential without it; a step of an order is the difference of two worths.

Each document becomes one of 32 masks of failed conditions; only counts of masks for each part are left after that.
Rows that share a text are counted before texts meet, so a text that fills a third of the table is no hot group.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
#: Potentials are multiples of 1 / SCALE; values are reported as sums over all orders.
SCALE = lcm(*range(1, len(FILTERS) + 1))
ORDERS = factorial(len(FILTERS))
COUNTS = ("docs", "good", "toxic")
#: Fewest words, least share of distinct words, largest share of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"


def failed(text: Column, words: Column) -> Column:
    """Mask of the conditions A to D that a text with these words fails; bit 0 is A."""
    n, capitals = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    tests = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
             100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the set of conditions they fail.

    A null text counts as empty, a null part as the empty string. Condition E holds for a row if any row has the same
    text and a smaller id; a row without an id is neither. Repeated rows count each. A document is good or toxic if
    any of its labels says 1; labels without an id are left out. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    # Staged, so that a text is split once.
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.alias("text"), words.alias("words")).select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("print"), failed(F.col("text"), F.col("words")).alias("mask"))
    # Rows without an id have no label; a salt keeps them from meeting in one task.
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("print")).otherwise(0))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(marked, ["id", "salt"], "left")
    some = [F.count("*").alias("docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS[1:]]]
    # One row for each text, part and id, then one for each text and part that knows its smallest id's rows apart.
    by_id = rows.groupBy("print", "part", "mask", "id").agg(*some)
    unnamed = lambda c: F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col(c))), F.lit(0))
    by_part = by_id.groupBy("print", "part", "mask").agg(
        F.min("id").alias("low"), F.min_by(F.struct(*COUNTS), "id").alias("first"),
        F.struct(*[F.sum(c).alias(c) for c in COUNTS]).alias("all"),
        F.struct(*[unnamed(c).alias(c) for c in COUNTS]).alias("unnamed"))
    by_part = common.settle(by_part)
    lows = by_part.groupBy("print").agg(F.min("low").alias("lowest"))
    placed = by_part.join(lows, "print")
    stays = lambda c: F.col(f"unnamed.{c}") + F.when(
        F.col("low") == F.col("lowest"), F.col(f"first.{c}")).otherwise(0)
    both = placed.select("part", F.explode(F.array(
        F.struct(F.col("mask"), *[stays(c).alias(c) for c in COUNTS]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(f"all.{c}") - stays(c)).alias(c) for c in COUNTS]),
    )).alias("m")).select("part", "m.*")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def worths(counts: Column, what: str) -> Column:
    """Array over all coalitions: documents that fail any of its filters."""
    failing = lambda s: F.aggregate(
        counts, F.lit(0).cast("long"),
        lambda n, m: n + F.when(m["mask"].bitwiseAND(s) != 0, m[what]).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), failing)


def potentials(worth: Column) -> Column:
    """Array over all coalitions: SCALE times the potential, a whole number.

    Coalitions come in the order of their masks, so those with one member less are there already.
    """
    def extend(known: Column, s: Column) -> Column:
        parts = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s.bitwiseXOR(F.lit(1 << i)))).otherwise(0)
                     for i in range(len(FILTERS))), SCALE * F.get(worth, s))
        size = F.bit_count(s)
        whole = F.call_function("div", parts, F.when(size > 0, size).otherwise(1)).cast("long")
        return F.concat(known, F.array(F.when(s == 0, F.lit(0)).otherwise(whole).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), F.array().cast("array<long>"), extend)


def orders() -> Column:
    """Array of every step of every order: (filter_order, step, bit of its filter, mask of the filters before it)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[j] for j in order), "step": step, "own": 1 << i,
                         "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; no rows for an empty table.

    kept and removed count the part's documents after and at the step, redundant those that fail its filter but went
    earlier, unique_fails those that fail no other, good_lost and toxic_lost the labelled ones removed here, shapley
    the filter's removals summed over all orders. ``masks`` says what nulls, ties and repeated rows count as.
    """
    counted = masks(docs, labels, id_col, text_col, part_col)
    # At most 32 masks a part.
    games = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"),
                                        F.sum("docs").alias("total"))
    games = games.select("part", "total", *[worths(F.col("counts"), c).alias(f"w_{c}") for c in COUNTS])
    games = games.withColumn("potential", potentials(F.col("w_docs")))
    steps = games.withColumn("at", F.explode(orders())).select("*", "at.*")
    everyone = F.lit(COALITIONS - 1)
    through, rest = F.col("before") + F.col("own"), everyone - F.col("own")
    worth = lambda c, s: F.get(f"w_{c}", s)
    gain = lambda c: worth(c, through) - worth(c, F.col("before"))
    value = F.get("potential", everyone) - F.get("potential", rest)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - worth("docs", through)).alias("kept"),
        gain("docs").alias("removed"), (worth("docs", F.col("own")) - gain("docs")).alias("redundant"),
        (worth("docs", everyone) - worth("docs", rest)).alias("unique_fails"), gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"), (ORDERS // SCALE * value).alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def sql() -> str:
    """The same by definition: every order is applied to every part's documents, no potential is used."""
    return r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT body, min(doc_id) AS lowest FROM texts GROUP BY body),
marks AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
fails AS (
  SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
           CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
           CASE WHEN 100 * length(regexp_replace(t.body, '[^A-Z]', '', 'g')) > 5 * length(t.body)
                THEN 'C' ELSE '' END,
           CASE WHEN regexp_matches(t.body, '[#$%&*|]') THEN 'D' ELSE '' END,
           CASE WHEN coalesce(t.doc_id > f.lowest, false) THEN 'E' ELSE '' END) AS failing
  FROM texts t JOIN firsts f ON t.body = f.body LEFT JOIN marks m ON t.doc_id = m.doc_id),
sets AS (
  SELECT part, failing, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM fails GROUP BY part, failing),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
ways AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (
  SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS own, substr(filter_order, 1, s - 1) AS earlier
  FROM ways, range(1, 6) r(s)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (NOT hit AND translate(failing, earlier, '') = failing) AS kept,
    sum(n) FILTER (hit AND translate(failing, earlier, '') = failing) AS removed,
    sum(n) FILTER (hit AND translate(failing, earlier, '') <> failing) AS redundant,
    sum(n) FILTER (failing = own) AS unique_fails,
    sum(g) FILTER (hit AND translate(failing, earlier, '') = failing) AS good_lost,
    sum(x) FILTER (hit AND translate(failing, earlier, '') = failing) AS toxic_lost
  FROM (SELECT *, contains(failing, own) AS hit FROM sets, steps) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""
