"""Secrets in texts, found with SQL functions only.

Three patterns give the base spans. Beyond them, what base spans and the allow-list's words leave of a text's runs of
20 and more key characters are candidates: a window of 20 characters slides over a candidate, its character counts
change by the one that enters and the one that leaves, and so does the sum that Shannon's entropy needs; a candidate
is a secret if the highest entropy of a window reaches its character class's threshold. Candidates of letters only
need both cases, changing often; lower-case words never count, nor do identifiers of eight, four, four, four and
twelve hex digits.

A candidate is read once from left to right, so time grows with its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import common

# The base patterns and the shortest value of each, in the order of kinds.
KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|" \
          "[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
# Candidates, their window, and for each class of characters the entropy in bits that marks a secret.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
CLASSES = {"hex": ("^[0-9A-Fa-f]+$", 3.0), "lower": ("^[0-9a-z]+$", 3.6), "letters": ("^[^0-9]+$", 3.85),
           "any": ("", 3.7)}
# Letters only: at least so many capitals after small letters.
TURNS = "[a-z][A-Z](?:.*?[a-z][A-Z]){3}"
# What is no secret: whole candidates, and words that are cut out of runs.
IDENTIFIER = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ALLOWED = ("example", "placeholder", "0123456789", "abcdefghij")
# Counts of characters, from + to z, in five bits each: so many to a long.
FIRST, SYMBOLS, BITS, PACKED = 43, 80, 5, 12


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of a pattern's leftmost matches that don't overlap, in code points.

    The pieces between matches and the matches themselves, both in order, add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    struct = lambda end, done: F.struct(end.alias("end"), done.alias("done"))
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["end"] + F.length(pair["piece"])
        end = start + F.length(pair["found"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return struct(end, F.concat(state["done"], F.array(one)))

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("found"))
    return F.aggregate(pairs, struct(F.lit(0), empty), add, lambda s: s["done"])


def _plogp(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def peak_entropy(run: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any ``window`` consecutive characters of a run that long or longer.

    Slides by one: with n characters in the window and c of each kind, the entropy is log2 n - sum(c log2 c) / n,
    and only the counts of the character that leaves and the one that enters change the sum. Counts are packed into
    a few longs; a step reads its two characters off an array of pairs and the run is not touched again.
    """
    state = lambda counts, total, low, seen: F.struct(
        counts.alias("counts"), total.alias("total"), low.alias("low"), seen.alias("seen"))
    shift = lambda c: (BITS * (c % PACKED)).cast("int")
    place = lambda c: F.floor(c / PACKED).cast("int")
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, place(c)), shift(c)).bitwiseAND(
        F.lit((1 << BITS) - 1))

    def step(s: Column, pair: Column) -> Column:
        gone, new = pair["gone"], pair["new"]
        full, same = gone >= 0, gone == new
        left = F.when(full, count(s["counts"], gone)).otherwise(0)
        now = count(s["counts"], new)
        total = s["total"] + _plogp(now + 1) - _plogp(now) + F.when(
            full, _plogp(left - 1) - _plogp(left)).otherwise(0.0)
        counts = F.transform(s["counts"], lambda packed, i: packed + F.when(i == place(new), one(shift(new))).otherwise(0)
                             - F.when(full & (i == place(gone)), one(shift(gone))).otherwise(0))
        moved = state(counts, total, F.when(s["seen"] + 1 >= window, F.least(s["low"], total)).otherwise(s["low"]),
                      s["seen"] + 1)
        # The same character leaves and enters: nothing changes.
        return F.when(full & same, state(s["counts"], s["total"], s["low"], s["seen"] + 1)).otherwise(moved)

    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    ahead = F.array_repeat(F.lit(-1), window)
    pairs = F.zip_with(codes, F.concat(ahead, codes), lambda new, gone: F.struct(
        F.coalesce(new, F.lit(-1)).alias("new"), F.coalesce(gone, F.lit(-1)).alias("gone")))
    none = state(F.array_repeat(F.lit(0).cast("long"), -(-SYMBOLS // PACKED)), F.lit(0.0).cast("double"),
                 F.lit(1e9).cast("double"), F.lit(0))
    low = F.aggregate(F.filter(pairs, lambda p: p["new"] >= 0), none, step, lambda s: s["low"])
    return F.lit(math.log2(window)) - low / window


def looks_secret(run: Column) -> Column:
    bits = F.lit(CLASSES["any"][1])
    for pattern, least in [CLASSES["letters"], CLASSES["lower"], CLASSES["hex"]]:
        bits = F.when(run.rlike(pattern), F.lit(least)).otherwise(bits)
    kinds = (run.rlike("[0-9]") & run.rlike("[A-Za-z]")) | run.rlike(TURNS)
    return kinds & ~run.rlike(IDENTIFIER) & (peak_entropy(run) >= bits)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans (by start) and of the allow-list's words."""
    state = lambda done, at: F.struct(done.alias("done"), at.alias("at"))

    def add(s: Column, span: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0)))
        space = F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(span["start"], s["at"]), F.lit(0)))
        return state(F.concat(s["done"], gap, space), F.greatest(s["at"], span["end"]))

    cut = F.aggregate(spans, state(F.lit(""), F.lit(0)), add,
                      lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    out = F.when(F.size(spans) > 0, cut).otherwise(text)
    for word in ALLOWED:
        out = F.regexp_replace(out, f"(?i){word}", " " * len(word))
    return out


def _spans(found: Column, kind: str, keep) -> Column:
    return F.transform(F.filter(found, keep), lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))


def scan(docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("mk_base", "mk_spans")) -> DataFrame:
    """``docs`` with two columns, named by ``names``: arrays of (start, rank of the kind, end), by start, then kind.

    The first holds the base spans as the patterns give them, the second also the entropy spans, which overlap none
    of them. A null text has none. Other columns pass through by position, whatever their names. Texts without a
    keyword, key id or long run skip the costlier steps.
    """
    named = [f"mk_{i}" for i in range(len(docs.columns))]
    text = F.coalesce(F.col(named[docs.columns.index(text_col)]), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    where = lambda test, pattern: F.when(text.rlike(test), matches(text, pattern)).otherwise(none)
    length = F.length
    staged = docs.toDF(*named).withColumns({
        "mk_assign": where(KEYWORD + "[\"']?\\x20*[:=]", ASSIGN),
        "mk_access": where("AKIA[A-Z0-9]{16}", ACCESS),
        "mk_hex": where("[0-9a-f]{24}", "[0-9a-f]{24,}")})
    base = F.array_sort(F.concat(
        _spans(F.col("mk_assign"), "assign", lambda m: _assigned(m) >= SHORTEST["assign"]),
        _spans(F.col("mk_access"), "access", lambda m: length(m["found"]) >= SHORTEST["access"]),
        _spans(F.col("mk_hex"), "hex", lambda m: length(m["found"]) >= SHORTEST["hex"])))
    staged = staged.withColumn("mk_base", base)
    # Staged, so that each is computed once.
    staged = staged.withColumn("mk_rest", F.when(text.rlike(CANDIDATE), _blanked(text, F.col("mk_base"))))
    staged = staged.withColumn("mk_runs", F.when(F.col("mk_rest").rlike(CANDIDATE), matches(
        F.col("mk_rest"), CANDIDATE)).otherwise(none))
    more = _spans(F.col("mk_runs"), "entropy", lambda m: looks_secret(m["found"]))
    return staged.select(*named, "mk_base", F.array_sort(F.concat("mk_base", more)).alias("mk_spans")).toDF(
        *docs.columns, *names)


def _assigned(m: Column) -> Column:
    """Length of an assignment's value."""
    return F.length(F.regexp_extract(m["found"], "^" + ASSIGN, 2))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``<kind>``; spans that overlap are replaced together.

    All columns come back in place, whatever their names.
    """
    named = [f"mk_{i}" for i in range(len(docs.columns))]
    own = named[docs.columns.index(text_col)]
    scanned, text = scan(docs.toDF(*named), own), F.col(own)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    state = lambda done, at: F.struct(done.alias("done"), at.alias("at"))

    def add(s: Column, span: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0)))
        fresh = F.concat(s["done"], gap, names[span["rank"]])
        return state(F.when(span["start"] >= s["at"], fresh).otherwise(s["done"]), F.greatest(s["at"], span["end"]))

    clean = F.aggregate("mk_spans", state(F.lit(""), F.lit(0)), add,
                        lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = F.when(F.size("mk_spans") > 0, clean).otherwise(text)
    return scanned.withColumn("mk_clean", changed).select(
        *["mk_clean" if c == own else c for c in named]).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("mk_base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("mk_base")), 256).alias("base_sha256"), listed(F.col("mk_spans")).alias("spans"))
