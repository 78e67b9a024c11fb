"""Row-wise clinical rules as Column expressions. None of them shuffles or leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit import catalog


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hit(predicate: Column) -> Column:
    return F.when(predicate, 1).otherwise(0)


def missing_as_null(c) -> Column:
    """NaN means missing; everything downstream only knows NULL."""
    return F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))


def sirs_score(temp="Temp", hr="HR", resp="Resp", wbc="WBC") -> Column:
    """SIRS count 0-4. A missing channel adds nothing, since its predicate is not true."""
    t, h, r, w = _c(temp), _c(hr), _c(resp), _c(wbc)
    thousands = ((w > 12.0) & (w <= 100.0)) | ((w > 0.0) & (w < 4.0))
    absolute = (w > 12000.0) | ((w > 100.0) & (w < 4000.0))
    return (_hit((t > 38.0) | (t < 36.0)) + _hit(h > 90.0) + _hit(r > 20.0)
            + _hit(thousands | absolute)).cast("int")


def with_sirs(df: DataFrame, mode: str = "always", column: str = "SIRS") -> DataFrame:
    """Add SIRS. ``if_any_null`` keeps a present column unless any of its rows is null.

    Channels the frame lacks count as missing.
    """
    have = {c: (F.col(c) if c in df.columns else F.lit(None).cast("double"))
            for c in ("Temp", "HR", "Resp", "WBC")}
    score = sirs_score(have["Temp"], have["HR"], have["Resp"], have["WBC"]).cast("double")
    if mode == "always" or column not in df.columns:
        return df.withColumn(column, score)
    if mode != "if_any_null":
        raise ValueError(f"unknown mode {mode!r}")
    any_null = df.select(F.bool_or(F.col(column).isNull()).alias("any_null")).scalar()
    return df.withColumn(column, F.when(any_null, score).otherwise(F.col(column).cast("double")))


def clip(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; missing stays missing (``least``/``greatest`` alone would fill it)."""
    x = missing_as_null(c)
    return F.when(x.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def clip_limits(df: DataFrame, limits: Mapping[str, tuple] | None = None,
                columns: Sequence[str] | None = None) -> DataFrame:
    """Clamp every known column to its permissible limits."""
    limits = catalog.LIMITS if limits is None else limits
    names = [c for c in (columns or df.columns) if c in limits and c in df.columns]
    return df.withColumns({c: clip(c, *limits[c]) for c in names})


def default_fill(c, feature: str, policy: str = "midpoint") -> Column:
    """Fill a missing value from the normal range: its midpoint or its lower bound."""
    if policy not in ("midpoint", "lower"):
        raise ValueError(f"unknown policy {policy!r}")
    value = catalog.midpoint(feature) if policy == "midpoint" else catalog.NORMAL_RANGE[feature][0]
    return F.coalesce(missing_as_null(c), F.lit(value))


def number_text(x: Column, digits: int) -> Column:
    """Fixed-point text through decimals, which rounds the same way in every engine."""
    return x.cast("decimal(18,6)").cast(f"decimal(18,{digits})").cast("string")


def accept_record(df: DataFrame, values: Mapping[str, Column] | None = None,
                  keep: Sequence[str] = (), warnings: str = "warnings") -> DataFrame:
    """Default, validate and clip all features of a record, and say what was done.

    ``values`` maps a feature to a (possibly textual) column; features left out count as not
    provided. Warnings come as an array in catalogue order.
    """
    out, notes = [], []
    for f in catalog.FEATURES:
        if values is None:
            raw = F.col(f) if f in df.columns else F.lit(None).cast("string")
        else:
            raw = values.get(f, F.lit(None).cast("string"))
        text = raw.cast("string")
        number = F.when(text.rlike(NUMBER), text.try_cast("double"))
        lo, hi = catalog.LIMITS[f]
        mid = catalog.midpoint(f)
        absent = text.isNull() | F.lower(F.trim(text)).isin("", "nan")
        invalid = number.isNull()
        outside = (number < lo) | (number > hi)
        clipped = F.least(F.lit(hi), F.greatest(F.lit(lo), number))
        out.append(F.when(absent | invalid, F.lit(mid)).otherwise(clipped).alias(f))
        notes.append(
            F.when(absent, F.lit(f"{f} was not provided; defaulted to physiological normal ({mid:.2f})."))
            .when(invalid, F.lit(f"{f} was invalid; defaulted to physiological normal ({mid:.2f})."))
            .when(outside, F.concat(
                F.lit(f"{f} ("), plain(number),
                F.lit(f") was outside biological limits [{lo}, {hi}]; clipped to "),
                clipped.cast("string"), F.lit("."))))
    return df.select(*keep, *out, F.array_compact(F.array(*notes)).alias(warnings))


# What counts as a number in a record, and beyond what a double prints with an exponent.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
LONG = 1e7


def plain(number: Column) -> Column:
    """A number in digits, without an exponent where it has at most 30 of them."""
    digits = number.try_cast("decimal(38,2)").cast("string")
    return F.when(F.abs(number) >= LONG, F.coalesce(digits, number.cast("string"))).otherwise(number.cast("string"))


def alert_level(prob: Column, high: float = catalog.HIGH_RISK,
                moderate: float = catalog.DECISION_THRESHOLD) -> Column:
    return F.when(prob >= high, "HIGH").when(prob >= moderate, "MODERATE").otherwise("LOW")


def above(prob: Column, threshold: float) -> Column:
    """Decision at an explicit threshold: 0.30 when operating, 0.50 when evaluating."""
    return (prob >= F.lit(threshold)).cast("int")


# The wording, colours and labels of a score record, by alert level.
COLOURS = {"HIGH": "#ef4444", "MODERATE": "#f59e0b", "LOW": "#10b981"}
LABELS = {"HIGH": "High Risk", "MODERATE": "Moderate Risk", "LOW": "Low Risk"}
WORDING = {
    "HIGH": "Elevated risk of sepsis onset within the next 6 hours. Intensive surveillance and diagnostic workup indicated.",
    "MODERATE": "Elevated risk of sepsis onset within the next 6 hours (probability {p}% exceeds operational threshold of {t}%). Close clinical observation indicated.",
    "LOW": "Low risk of sepsis onset within the next 6 hours (probability {p}% is below operational threshold of {t}%). Routine ICU monitoring indicated.",
}


def risk_band(prob, high: float = catalog.HIGH_RISK,
              moderate: float = catalog.DECISION_THRESHOLD) -> dict[str, Column]:
    """The columns a scored record reports: level, colour, label, decision and wording."""
    p = _c(prob)
    level = alert_level(p, high, moderate)
    percent, limit = number_text(p * 100.0, 1), f"{moderate * 100:.0f}"

    def by_level(texts):
        return F.element_at(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)]), level)

    def worded(text):
        before, mark, after = text.replace("{t}", limit).partition("{p}")
        return F.concat(F.lit(before), percent, F.lit(after)) if mark else F.lit(before)

    return {
        "alert_level": level,
        "alert_color": by_level({k: F.lit(v) for k, v in COLOURS.items()}),
        "risk_classification": by_level({k: F.lit(v) for k, v in LABELS.items()}),
        "is_above_threshold": p >= F.lit(moderate),
        "interpretation_6h": by_level({k: worded(v) for k, v in WORDING.items()}),
    }


# The bedside rule's terms and the value it assumes for a missing input.
RULE_DEFAULTS = {"Temp": 36.65, "Resp": 16.0, "SIRS": 0.0, "BaseExcess": 0.0, "Creatinine": 0.9}
RULE_INTERCEPT = -3.5


def rule_probability(values: Mapping[str, Column] | None = None) -> Column:
    """Additive bedside rule on five features, squashed to a probability."""
    v = {f: F.coalesce(values[f] if values else F.col(f), F.lit(d)) for f, d in RULE_DEFAULTS.items()}
    logit = (
        F.lit(RULE_INTERCEPT)
        + F.when(v["Temp"] > 38.3, 2.0).when(v["Temp"] < 36.0, 1.5).otherwise(0.0)
        + F.when(v["Resp"] > 22.0, 1.2).otherwise(0.0)
        + F.when(v["SIRS"] >= 2.0, 0.8).otherwise(0.0)
        + F.when(F.abs(v["BaseExcess"]) > 3.0, 0.9).otherwise(0.0)
        + F.when(v["Creatinine"] > 1.3, 0.8).otherwise(0.0)
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def rule_attributions(values: Mapping[str, Column] | None = None) -> Column:
    """The bedside rule's fixed attributions, one struct per bottleneck feature."""
    get = (lambda f: values[f]) if values else F.col
    raised = {"Temp": (38.0, 0.35), "Resp": (22.0, 0.18), "Creatinine": (1.3, 0.18)}
    items = []
    for f in catalog.BOTTLENECK:
        if f in raised:
            limit, weight = raised[f]
            value = F.when(F.coalesce(get(f), F.lit(RULE_DEFAULTS[f])) > limit, weight).otherwise(-0.06)
        else:
            value = F.lit(-0.06)
        items.append(F.struct(
            F.lit(f).alias("feature"),
            F.coalesce(get(f), F.lit(0.0)).alias("patient_value"),
            value.alias("shap_value"),
            F.when(value > 0, "contributing").otherwise("offsetting").alias("impact"),
            F.lit(f in raised).alias("is_top_impact")))
    return F.array(*items)
