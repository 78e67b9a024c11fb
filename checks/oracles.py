"""The same results in DuckDB SQL, for every query SQL can express on whole tables."""

from __future__ import annotations

import math

from checks.queries import DIMS, EPOCH_HOURS, MEASURED, TYPES, scale_of
from panelkit import catalog
from panelkit.functions.clinical import RULE_DEFAULTS

FEATURES = list(catalog.FEATURES)
BOTTLENECK = list(catalog.BOTTLENECK)
LABEL = catalog.LABEL


def num(x: float) -> str:
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


def q(name: str) -> str:
    return f'"{name}"'


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {q(name or expr.strip(chr(34)))}"


def cols(names, form="{}") -> str:
    return ", ".join(form.format(q(n)) for n in names)


def rounds(names, digits: int = 6) -> str:
    return ", ".join(r6(q(n), n, digits) for n in names)


def digest(keys: str, salt: str) -> str:
    return f"md5(concat_ws(':', {keys}, '{salt}'))"


def word(keys: str, salt: str, place: int = 1) -> str:
    return f"(('0x' || substr({digest(keys, salt)}, {8 * place - 7}, 8))::BIGINT)"


def uniform(keys: str, salt: str, place: int = 1) -> str:
    return f"({word(keys, salt, place)} / 4294967296e0)"


def pick(keys: str, salt: str, n: str) -> str:
    return f"CAST(floor({uniform(keys, salt)} * {n}) AS BIGINT)"


def _channel(i: int, c: str) -> str:
    lo, width = scale_of(c)
    return f"max(CASE WHEN cell = {i} THEN {num(lo)} + {num(width)} * value / 100e0 END) AS {q(c)}"


_KIND = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES))
PANEL = f"""cells AS (
  SELECT user_id, CAST(floor(epoch(ts) / 3600) - {EPOCH_HOURS} AS BIGINT) AS h,
         (CASE event_type {_KIND} END) * 4 + CAST(json_extract(props, '$.k') AS BIGINT) // 25 AS cell,
         value, event_type = 'purchase' AND value >= 200 AS hit
  FROM events),
panel AS (
  SELECT user_id, h, {', '.join(_channel(i, c) for i, c in enumerate(MEASURED))},
         CAST(max(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS {q(LABEL)}
  FROM cells GROUP BY user_id, h)"""


def sirs(t='"Temp"', h='"HR"', r='"Resp"', w='"WBC"') -> str:
    return (f"(CASE WHEN {t} > 38 OR {t} < 36 THEN 1 ELSE 0 END + CASE WHEN {h} > 90 THEN 1 ELSE 0 END"
            f" + CASE WHEN {r} > 20 THEN 1 ELSE 0 END + CASE WHEN ({w} > 12 AND {w} <= 100) OR"
            f" ({w} > 0 AND {w} < 4) OR {w} > 12000 OR ({w} > 100 AND {w} < 4000) THEN 1 ELSE 0 END)")


VEC = PANEL + f""",
bounds AS (SELECT user_id, min(h) FILTER (WHERE {q(LABEL)} = 1) AS b FROM panel GROUP BY user_id),
hist AS (SELECT panel.* FROM panel JOIN bounds USING (user_id) WHERE b IS NULL OR h <= b),
state AS (
  SELECT user_id, {', '.join(f'arg_max({q(c)}, h) FILTER (WHERE {q(c)} IS NOT NULL) AS {q(c)}' for c in MEASURED)},
         max({q(LABEL)}) AS {q(LABEL)}
  FROM hist GROUP BY user_id),
vec AS (SELECT *, CAST({sirs()} AS DOUBLE) AS "SIRS" FROM state)"""


def clip(f: str) -> str:
    lo, hi = catalog.LIMITS[f]
    return f"CASE WHEN {q(f)} IS NOT NULL THEN least({num(hi)}, greatest({num(lo)}, {q(f)})) END"


def accepted(f: str) -> str:
    return f"coalesce({clip(f)}, {num(catalog.midpoint(f))})"


FILLED = VEC + f""",
filled AS (SELECT user_id, {q(LABEL)}, {', '.join(f'{accepted(f)} AS {q(f)}' for f in FEATURES)} FROM vec)"""


def rule(get) -> str:
    v = {f: f"coalesce({get(f)}, {num(d)})" for f, d in RULE_DEFAULTS.items()}
    logit = (f"(-3.5e0 + CASE WHEN {v['Temp']} > 38.3e0 THEN 2e0 WHEN {v['Temp']} < 36e0 THEN 1.5e0 ELSE 0e0 END"
             f" + CASE WHEN {v['Resp']} > 22e0 THEN 1.2e0 ELSE 0e0 END"
             f" + CASE WHEN {v['SIRS']} >= 2e0 THEN 0.8e0 ELSE 0e0 END"
             f" + CASE WHEN abs({v['BaseExcess']}) > 3e0 THEN 0.9e0 ELSE 0e0 END"
             f" + CASE WHEN {v['Creatinine']} > 1.3e0 THEN 0.8e0 ELSE 0e0 END)")
    return f"(1e0 / (1e0 + exp(-{logit})))"


RULE = rule(q)


def text(x: str, digits: int) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(18,6)) AS DECIMAL(18,{digits})) AS VARCHAR)"


def level(p: str, a="'HIGH'", b="'MODERATE'", c="'LOW'") -> str:
    return f"CASE WHEN {p} >= 0.6e0 THEN {a} WHEN {p} >= 0.3e0 THEN {b} ELSE {c} END"


def warning(f: str) -> str:
    lo, hi = catalog.LIMITS[f]
    mid = f"{catalog.midpoint(f):.2f}"
    clipped = f"least({num(hi)}, greatest({num(lo)}, {q(f)}))"
    return (f"CASE WHEN {q(f)} IS NULL THEN '{f} was not provided; defaulted to physiological normal ({mid}).' "
            f"WHEN {q(f)} < {num(lo)} OR {q(f)} > {num(hi)} THEN '{f} (' || CAST({q(f)} AS VARCHAR) || "
            f"') was outside biological limits [{lo}, {hi}]; clipped to ' || CAST({clipped} AS VARCHAR) || '.' END")


def band(p: str) -> str:
    elevated = "Elevated risk of sepsis onset within the next 6 hours"
    pct = text(f"{p} * 100e0", 1)
    return f"""{level(p)} AS alert_level,
  {level(p, "'#ef4444'", "'#f59e0b'", "'#10b981'")} AS alert_color,
  {level(p, "'High Risk'", "'Moderate Risk'", "'Low Risk'")} AS risk_classification,
  CAST({p} >= 0.3e0 AS BIGINT) AS is_above_threshold,
  {level(p, f"'{elevated}. Intensive surveillance and diagnostic workup indicated.'",
         f"'{elevated} (probability ' || {pct} || '% exceeds operational threshold of 30%). Close clinical observation indicated.'",
         f"'Low risk of sepsis onset within the next 6 hours (probability ' || {pct} || '% is below operational threshold of 30%). Routine ICU monitoring indicated.'")} AS interpretation_6h"""


def ranked(source: str, keys: str, salt: str, strata: str = "") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY {digest(keys, salt)}, {keys}) AS rk FROM {source}"


def long(source: str, names, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{n}' AS feature, {q(n)} AS value FROM {source}" for n in names)


def profile_rows() -> str:
    return f"""melted AS ({long('panel', MEASURED, 'user_id, h')}),
stats AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
  stddev_pop(value) AS std_pop, skewness(value) AS skew, quantile_cont(value, 0.25) AS q25,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM melted GROUP BY feature),
prof AS (SELECT *, q25 - 1.5e0 * (q75 - q25) AS fence_lo, q75 + 1.5e0 * (q75 - q25) AS fence_hi,
  CASE WHEN n < 5 THEN 'none' WHEN abs(skew) > 0.75 THEN 'iqr' WHEN std > 1e-6 THEN 'zscore' ELSE 'none' END AS rule
  FROM stats)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def psi(n: str) -> str:
    """Digamma of a whole number, by its harmonic sum."""
    return (f"(-0.5772156649015329e0 + CASE WHEN {n} > 1 THEN list_sum(list_transform(range(1, CAST({n} AS BIGINT)), "
            f"lambda i: 1e0 / i)) ELSE 0e0 END)")


def mi_ctes(points: str) -> str:
    """Neighbour estimate of mutual information by comparing all points: (feature, id, y, x)."""
    return f"""pts0 AS ({points}),
pts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS nc FROM pts0) WHERE nc > 1),
within AS (SELECT a.feature, a.id, a.x, a.nc, least(3, a.nc - 1) AS kk, abs(b.x - a.x) AS d,
  row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(b.x - a.x)) AS i
  FROM pts a JOIN pts b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id),
radius AS (SELECT feature, id, x, nc, kk, d AS r FROM within WHERE i = kk),
inside AS (SELECT a.feature, a.id, a.nc, a.kk, count(*) AS m FROM radius a JOIN pts b ON a.feature = b.feature
  AND CASE WHEN r > 0 THEN abs(b.x - a.x) < r - 1e-12 * greatest(abs(a.x), r) ELSE b.x = a.x END
  GROUP BY a.feature, a.id, a.nc, a.kk),
mi AS (SELECT feature, greatest(0e0, max(psi_n) + avg(psi_k) - avg(psi_c) - avg(psi_m)) AS mi FROM (
  SELECT feature, {psi('count(*) OVER (PARTITION BY feature)')} AS psi_n, {psi('kk')} AS psi_k,
         {psi('nc')} AS psi_c, {psi('m')} AS psi_m FROM inside) GROUP BY feature)"""


EMB = "emb AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)"


def dist(a: str, b: str) -> str:
    return (f"round(sqrt(list_sum(list_transform(list_zip({a}, {b}), "
            f"lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9)")


PARTS = EMB + """,
cnt AS (SELECT label, count(*) AS c FROM emb GROUP BY label),
rk AS (""" + ranked("emb", "vec_id", "holdout:42", "label") + """),
tagged AS (SELECT rk.*, rk.rk <= floor(c * 0.2e0) AS is_test FROM rk JOIN cnt USING (label)),
tr AS (SELECT * FROM tagged WHERE NOT is_test), te AS (SELECT * FROM tagged WHERE is_test)"""


def shap_ctes() -> str:
    parts = []
    for i, f in enumerate(BOTTLENECK):
        one = rule(lambda g, f=f: f"b.{q(g)}" if g == f else f"x.{q(g)}")
        parts.append(f"avg({rule(lambda g: f'x.{q(g)}')} - {one}) AS d{i}")
    total = " + ".join(f"d{i}" for i in range(len(BOTTLENECK)))
    union = " UNION ALL ".join(
        f"SELECT user_id, {i} AS seq, '{f}' AS feature, CASE WHEN abs(total) > 1e-6 THEN d{i} * gap / total "
        f"ELSE gap / {len(BOTTLENECK)}e0 END AS phi, {q(f)} AS own FROM whole" for i, f in enumerate(BOTTLENECK))
    return FILLED + f""",
bg AS (SELECT * FROM filled ORDER BY {digest('user_id', 'background:42')}, user_id LIMIT 100),
drops AS (SELECT x.user_id, {', '.join(parts)} FROM filled x CROSS JOIN bg b GROUP BY x.user_id),
base AS (SELECT avg({RULE}) AS base FROM bg),
whole AS (SELECT filled.*, drops.* EXCLUDE (user_id), {total} AS total, {RULE} - base AS gap
  FROM filled JOIN drops USING (user_id) CROSS JOIN base),
phis AS ({union}),
bars AS (SELECT *, round(phi, 4) AS shap, CASE WHEN phi > 0 THEN 'contributing' ELSE 'offsetting' END AS impact,
  row_number() OVER (PARTITION BY user_id ORDER BY abs(round(phi, 4)) DESC, seq) - 1 AS place FROM phis)"""


TOP_SQL = "(" + ", ".join(f"'{f}'" for f in catalog.TOP) + ")"


def target_rule(name: str, t0: str, t1: str) -> str:
    return f"SELECT '{name}' AS rule, n0, n1, {t0} AS t0, {t1} AS t1 FROM sizes"


def oracle_sql() -> dict[str, str]:
    m, f19, lab = rounds(MEASURED), rounds(FEATURES), q(LABEL)
    w = "(PARTITION BY user_id ORDER BY h ROWS BETWEEN {})"
    past = w.format("UNBOUNDED PRECEDING AND CURRENT ROW")
    future = w.format("CURRENT ROW AND UNBOUNDED FOLLOWING")
    fwd = {c: f"last_value({q(c)} IGNORE NULLS) OVER {past}" for c in MEASURED}
    both = {c: f"coalesce({fwd[c]}, first_value({q(c)} IGNORE NULLS) OVER {future})" for c in MEASURED}
    bfilled = f"bf AS (SELECT user_id, h, {lab}, {', '.join(f'{both[c]} AS {q(c)}' for c in MEASURED)} FROM panel)"
    hourly = (PANEL + ",\n" + bfilled + f""",
hourly AS (SELECT *, CAST({sirs()} AS DOUBLE) AS "SIRS" FROM bf),
hf AS (SELECT concat_ws('-', user_id, h) AS row_id, {lab}, """
              + ", ".join(f"coalesce({q(f)}, {num(catalog.midpoint(f))}) AS {q(f)}" for f in FEATURES)
              + " FROM hourly)")
    positives = hourly + f",\npos AS (SELECT * FROM hf WHERE {lab} = 1), npos AS (SELECT count(*) AS n FROM pos)"
    chi = f"""base AS (SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
long AS (SELECT quality, 'toxic' AS feature, CAST(toxic AS DOUBLE) AS x FROM base
  UNION ALL SELECT quality, 'n_chars', CAST(n_chars AS DOUBLE) FROM base),
sh AS (SELECT feature, quality, x - min(x) OVER (PARTITION BY feature) AS x FROM long),
obs AS (SELECT feature, quality, count(*) AS n, sum(x) AS o FROM sh GROUP BY 1, 2),
ex AS (SELECT *, n * sum(o) OVER (PARTITION BY feature) / CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS e FROM obs)"""
    fold_metrics = """folds AS (SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY """ + digest("doc_id", "fold:42") + """, doc_id) - 1) % 5 AS fold FROM labels),
conf AS (SELECT fold, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) AS n FROM folds GROUP BY fold),
met AS (SELECT fold, round((n - fp - fn) / CAST(n AS DOUBLE), 4) AS "Accuracy", round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 4) AS "Precision",
  round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 4) AS "Recall",
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 4) AS "F1 Score" FROM conf)"""
    four = ("F1 Score", "Precision", "Recall", "Accuracy")
    n_warn = "CAST(" + " + ".join(
        f"CASE WHEN {q(f)} IS NULL OR {q(f)} < {num(catalog.LIMITS[f][0])} OR {q(f)} > {num(catalog.LIMITS[f][1])} THEN 1 ELSE 0 END"
        for f in FEATURES) + " AS BIGINT)"
    heat = FILLED + ",\nlong AS (" + long("filled", FEATURES, "user_id") + f"""),
cells4 AS (SELECT user_id, 'E' || i AS layer, i, feature, abs(value) / CAST(i AS DOUBLE) AS value FROM long, range(1, 5) t(i)),
dhm AS (SELECT user_id, feature, sum(CASE i WHEN 1 THEN {num(0.9)} WHEN 2 THEN {num(0.9 ** 2)} WHEN 3 THEN {num(0.9 ** 3)} ELSE {num(0.9 ** 4)} END * value) AS score
  FROM cells4 GROUP BY user_id, feature)"""
    order19 = "list_position([" + ", ".join(f"'{f}'" for f in FEATURES) + "], feature)"
    bounded = (f"coalesce(CASE WHEN t IS NOT NULL THEN least({num(43)}, greatest({num(30)}, t)) END, {num(36.65)})")
    o = {
        "boundary": with_(PANEL, f"SELECT user_id, max({lab}) AS is_positive, min(h) FILTER (WHERE {lab} = 1) AS boundary FROM panel GROUP BY user_id"),
        "truncate_history": with_(VEC, f"SELECT user_id, h, {m}, {lab} FROM hist"),
        "locf": with_(PANEL, f"SELECT user_id, h, {', '.join(r6(fwd[c], c) for c in MEASURED)}, {lab} FROM panel"),
        "locf_bfill": with_(PANEL + ",\n" + bfilled, f"SELECT user_id, h, {m}, {lab} FROM bf"),
        "patient_vector": with_(VEC, f"SELECT user_id, {f19}, {lab} FROM vec"),
        "hourly_cohort": with_(hourly, f"SELECT user_id, h, {f19}, {lab} FROM hourly"),
        "panel_extract": with_(PANEL, f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY h) AS "Hour",
  {rounds(catalog.RAW)}, CAST(NULL AS DOUBLE) AS "SIRS", {lab} FROM panel
  WHERE user_id IN (SELECT DISTINCT user_id FROM panel ORDER BY user_id LIMIT 20)"""),
        "sample_entities": with_(PANEL, f"""SELECT user_id, h, {lab} FROM panel WHERE user_id IN (
  SELECT user_id FROM (SELECT DISTINCT user_id FROM panel) ORDER BY {digest('user_id', 'entities:42')}, user_id LIMIT 50)"""),
        "any_measured": with_(PANEL, f"SELECT user_id, h, {m}, {lab} FROM panel WHERE " + " + ".join(f"({q(c)} IS NOT NULL)::INT" for c in MEASURED) + " >= 2"),
        "class_counts": with_(PANEL, f"SELECT {lab}, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM panel GROUP BY {lab}"),
        "sirs_score": with_(PANEL, f'SELECT user_id, h, CAST({sirs()} AS BIGINT) AS "SIRS" FROM panel'),
        "sirs_if_any_null": with_(PANEL, f"""SELECT user_id, h, CASE WHEN (SELECT bool_or("HR" IS NOT NULL) FROM panel)
  THEN CAST({sirs()} AS DOUBLE) ELSE 3e0 END AS "SIRS" FROM panel"""),
        "clip_limits": with_(PANEL, f"SELECT user_id, h, {', '.join(r6(clip(c) if c in catalog.LIMITS else q(c), c) for c in MEASURED)} FROM panel"),
        "default_and_clip": with_(VEC, f"SELECT user_id, {', '.join(r6(accepted(f), f) for f in FEATURES)}, concat_ws('|', {', '.join(warning(f) for f in FEATURES)}) AS warnings FROM vec"),
        "default_lower": with_(VEC, "SELECT user_id, " + ", ".join(r6(f"coalesce({q(f)}, {num(catalog.NORMAL_RANGE[f][0])})", f) for f in FEATURES) + " FROM vec"),
        "feature_vector": with_(VEC, f"SELECT user_id, {', '.join(r6(clip(f), f) for f in FEATURES)} FROM vec"),
        "rule_score": with_(VEC, f"SELECT user_id, round(p, 6) AS prob, round(p, 3) AS prediction_probability, {level('p')} AS alert_level, CAST(p >= 0.3e0 AS BIGINT) AS is_above_threshold FROM (SELECT user_id, {RULE} AS p FROM vec)"),
        "rule_attributions": with_(VEC, " UNION ALL ".join(
            f"SELECT user_id, '{f}' AS feature, round(coalesce({q(f)}, 0e0), 6) AS patient_value, {v} AS shap_value, CASE WHEN {v} > 0 THEN 'contributing' ELSE 'offsetting' END AS impact, CAST({int(f in ('Temp', 'Resp', 'Creatinine'))} AS BIGINT) AS is_top_impact FROM vec"
            for f in BOTTLENECK for v in [
                f"CASE WHEN coalesce({q(f)}, {num(RULE_DEFAULTS[f])}) > {dict(Temp='38e0', Resp='22e0', Creatinine='1.3e0')[f]} THEN {'0.35e0' if f == 'Temp' else '0.18e0'} ELSE -0.06e0 END"
                if f in ("Temp", "Resp", "Creatinine") else "-0.06e0"])),
        "risk_band": with_(VEC, f"SELECT user_id, {band('p')}, CAST(p >= 0.5e0 AS BIGINT) AS above_half FROM (SELECT user_id, {RULE} AS p FROM vec)"),
        "inject_missing": with_(PANEL, "SELECT user_id, h, " + ", ".join(
            r6(f"CASE WHEN {uniform('user_id, h', f'miss:42:{c}')} >= 0.3e0 THEN {q(c)} END", c) for c in MEASURED) + " FROM panel"),
        "column_profile": with_(PANEL + ",\n" + profile_rows(), "SELECT feature, n, " + rounds(["mean", "std", "std_pop", "skew", "q25", "median", "q75", "fence_lo", "fence_hi"], 9) + ", rule FROM prof"),
        "outlier_flags": with_(PANEL + ",\n" + profile_rows() + f""",
flags AS (SELECT user_id, h, feature, CAST(coalesce(CASE rule WHEN 'zscore' THEN abs((value - mean) / std) > 3.5e0
  WHEN 'iqr' THEN value < fence_lo OR value > fence_hi END, false) AS BIGINT) AS flag FROM melted JOIN prof USING (feature))""",
            "SELECT user_id, h, " + ", ".join(f"max(flag) FILTER (WHERE feature = '{c}') AS {q(c + '_outlier')}" for c in MEASURED) + " FROM flags GROUP BY user_id, h"),
        "median_impute": with_(PANEL, "SELECT user_id, h, " + ", ".join(r6(f"coalesce({q(c)}, (SELECT quantile_cont({q(c)}, 0.5) FROM panel), 0e0)", c, 9) for c in MEASURED) + " FROM panel"),
        "standard_scale": with_(PANEL + ",\nst AS (SELECT " + ", ".join(
            f"avg({q(c)}) AS {q('m_' + c)}, CASE WHEN stddev_pop({q(c)}) > 0 THEN stddev_pop({q(c)}) ELSE 1 END AS {q('s_' + c)}" for c in MEASURED) + " FROM panel)",
            "SELECT user_id, h, " + ", ".join(r6(f"({q(c)} - {q('m_' + c)}) / {q('s_' + c)}", c) for c in MEASURED) + " FROM panel CROSS JOIN st"),
        "gram_matrix": with_(FILLED + ",\nlong AS (SELECT user_id, 'one' AS feature, 1e0 AS value FROM filled UNION ALL " + long("filled", FEATURES, "user_id") + ")",
            "SELECT a.feature AS a, b.feature AS b, round(avg(a.value * b.value), 6) AS mean_product FROM long a JOIN long b USING (user_id) GROUP BY 1, 2"),
        "holdout_split": with_(PANEL + f",\ncnt AS (SELECT {lab}, count(*) AS c FROM panel GROUP BY 1),\nrk AS ({ranked('panel', 'user_id, h', 'holdout:42', lab)})",
            f"SELECT user_id, h, {lab}, CAST(rk <= floor(c * 0.2e0) AS BIGINT) AS is_test FROM rk JOIN cnt USING ({lab})"),
        "stratified_folds": with_(PANEL + f",\nrk AS ({ranked('panel', 'user_id, h', 'fold:42', lab)})", f"SELECT user_id, h, {lab}, (rk - 1) % 5 AS fold FROM rk"),
        "kfold": with_(PANEL + f",\nrk AS ({ranked('panel', 'user_id, h', 'fold:42')})", "SELECT user_id, h, (rk - 1) % 5 AS fold FROM rk"),
    }
    groups = PANEL + f""",
grp AS (SELECT user_id, max({lab}) AS stratum, count(*) AS n FROM panel GROUP BY user_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, {digest('user_id', 'groups:42')}, user_id) - 1 AS i FROM grp),
gf AS (SELECT user_id, stratum, n, CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS fold FROM rk)"""
    sizes = PANEL + f",\nsizes AS (SELECT count(*) FILTER (WHERE {lab} = 0) AS n0, count(*) FILTER (WHERE {lab} = 1) AS n1 FROM panel)"
    def fl(x, p):
        return f"CAST(floor({x} * {num(p)}) AS BIGINT)"
    small0 = f"least(32000, greatest(10, {fl('n0', 0.8)}))"
    o |= {
        "group_folds": with_(groups, "SELECT user_id, stratum, n, fold FROM gf"),
        "fold_leak_check": with_(groups, f"SELECT fold, count(*) AS rows, CAST(sum({lab}) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS leaking FROM panel JOIN gf USING (user_id) GROUP BY fold"),
        "balance_targets": with_(sizes, " UNION ALL ".join([
            target_rule("fold", "least(32000, n0)", f"least(25000, greatest(n1, {fl('least(32000, n0)', 0.78)}))"),
            target_rule("holdout", f"least(25600, {fl('(n0 + n1)', 0.56)})", f"least(20000, {fl('(n0 + n1)', 0.44)})"),
            target_rule("final", f"least(32000, {fl('(n0 + n1)', 0.56)})", f"least(25000, {fl('(n0 + n1)', 0.44)})"),
            target_rule("hourly_small", small0, f"least(25000, greatest(5, {fl(small0, 0.78)}))")])),
        "downsample_exact": with_(PANEL, f"SELECT user_id, h FROM panel WHERE {lab} = 0 ORDER BY {digest('user_id, h', 'down:42')}, user_id, h LIMIT 1000"),
        "replicate_up": with_(positives + f",\nidx AS ({ranked('pos', 'row_id', 'copy:42')}),\nslots AS (SELECT i AS slot, {pick('i', 'copy:42:row', 'n')} AS ix FROM range(2000) t(i) CROSS JOIN npos)",
            f"SELECT 'copy:' || slot AS row_id, {f19} FROM slots JOIN idx ON idx.rk - 1 = ix"),
        "interpolate_pairs": with_(positives + f",\nidx AS ({ranked('pos', 'row_id', 'pairs:42')}),\nslots AS (SELECT i AS slot, {pick('i', 'pairs:42:a', 'n')} AS ia, {pick('i', 'pairs:42:b', 'n')} AS ib, 0.1e0 + 0.8e0 * {uniform('i', 'pairs:42:mix')} AS mix FROM range(2000) t(i) CROSS JOIN npos)",
            "SELECT 'pair:' || slot AS row_id, " + ", ".join(r6(f"a.{q(f)} * mix + b.{q(f)} * (1e0 - mix)", f) for f in FEATURES) + " FROM slots JOIN idx a ON a.rk - 1 = ia JOIN idx b ON b.rk - 1 = ib"),
        "smote": with_(EMB + f""",
mino AS (SELECT * FROM emb WHERE label = 3), nmin AS (SELECT count(*) AS n FROM mino),
idx AS ({ranked('mino', 'vec_id', 'smote:42')}),
near AS (SELECT a.vec_id AS a, b.vec_id AS b, b.v AS vb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist('a.v', 'b.v')}, b.vec_id) AS r
  FROM mino a JOIN mino b ON a.vec_id <> b.vec_id),
slots AS (SELECT i AS slot, {pick('i', 'smote:42:row', 'n')} AS ix, {pick('i', 'smote:42:neighbour', '5')} + 1 AS r, {uniform('i', 'smote:42:step')} AS step FROM range(500) t(i) CROSS JOIN nmin)""",
            f"SELECT 'smote:' || slot AS vec_id, 'e' || j AS feature, round(idx.v[j + 1] + step * (vb[j + 1] - idx.v[j + 1]), 6) AS value FROM slots JOIN idx ON idx.rk - 1 = ix JOIN near ON near.a = idx.vec_id AND near.r = slots.r CROSS JOIN range({DIMS}) t(j)"),
        "balance_classes": with_(EMB + f""",
zero AS (SELECT *, row_number() OVER (ORDER BY {digest('vec_id', 'down:42')}, vec_id) AS r FROM emb WHERE label >= 2),
mino AS (SELECT * FROM emb WHERE label < 2), nmin AS (SELECT count(*) AS n FROM mino),
idx AS ({ranked('mino', 'vec_id', 'smote:42')}),
near AS (SELECT a.vec_id AS a, b.v AS vb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist('a.v', 'b.v')}, b.vec_id) AS r
  FROM mino a JOIN mino b ON a.vec_id <> b.vec_id),
many AS (SELECT n, unnest(range(greatest(0, 250 - n))) AS i FROM nmin),
slots AS (SELECT i AS slot, {pick('i', 'smote:42:row', 'n')} AS ix, {pick('i', 'smote:42:neighbour', '5')} + 1 AS r, {uniform('i', 'smote:42:step')} AS step FROM many)""",
            f"""SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(0 AS BIGINT) AS label, 'e' || j AS feature, round(v[j + 1], 6) AS value FROM zero CROSS JOIN range({DIMS}) t(j) WHERE r <= 300
UNION ALL SELECT CAST(vec_id AS VARCHAR), 1, 'e' || j, round(v[j + 1], 6) FROM mino CROSS JOIN range({DIMS}) t(j)
UNION ALL SELECT 'smote:' || slot, 1, 'e' || j, round(idx.v[j + 1] + step * (vb[j + 1] - idx.v[j + 1]), 6) FROM slots JOIN idx ON idx.rk - 1 = ix JOIN near ON near.a = idx.vec_id AND near.r = slots.r CROSS JOIN range({DIMS}) t(j)"""),
        "knn_classify": with_(PARTS + f""",
near AS (SELECT te.vec_id, tr.label AS cls, row_number() OVER (PARTITION BY te.vec_id ORDER BY {dist('te.v', 'tr.v')}, tr.vec_id) AS r FROM te CROSS JOIN tr),
votes AS (SELECT vec_id, cls, count(*) AS n FROM near WHERE r <= 5 GROUP BY 1, 2),
win AS (SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, cls) AS r FROM votes)""",
            "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(cls AS BIGINT) AS prediction FROM te JOIN win USING (vec_id) WHERE r = 1"),
        "gaussian_nb": with_(PARTS + f""",
long AS (SELECT label, j, v[j] AS x FROM tr, range(1, {DIMS + 1}) t(j)),
sm AS (SELECT max(s) AS s FROM (SELECT var_pop(x) AS s FROM long GROUP BY j)),
par AS (SELECT label, j, avg(x) AS mu, var_pop(x) + 1e-9 * (SELECT s FROM sm) AS va, count(*) AS n FROM long GROUP BY 1, 2),
pri AS (SELECT label, max(n) AS n FROM par GROUP BY 1),
ll AS (SELECT vec_id, par.label AS cls, sum(ln({num(2 * math.pi)} * va) + (v[j] - mu) * (v[j] - mu) / va) AS s FROM te CROSS JOIN par GROUP BY 1, 2),
sc AS (SELECT vec_id, cls, ln(n / CAST((SELECT sum(n) FROM pri) AS DOUBLE)) - 0.5e0 * s AS s FROM ll JOIN pri ON pri.label = cls),
win AS (SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS r FROM sc)""",
            "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(cls AS BIGINT) AS prediction FROM te JOIN win USING (vec_id) WHERE r = 1"),
        "recon_mse": with_(EMB, f"SELECT round(avg(power(v[j] - floor(v[j] * 10e0) / 10e0, 2)), 6) AS mse FROM emb, range(1, {DIMS + 1}) t(j)"),
        "chi2_scores": with_(chi, "SELECT feature, round(sum((o - e) * (o - e) / e), 6) AS statistic, count(*) - 1 AS df, CAST(sum((o - e) * (o - e) / e) > 3.841458820694124e0 AS BIGINT) AS significant FROM ex GROUP BY feature"),
        "mi_binned": with_("""base AS (SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
long AS (SELECT quality AS y, 'toxic' AS feature, CAST(toxic AS DOUBLE) AS x FROM base UNION ALL SELECT quality, 'n_chars', CAST(n_chars AS DOUBLE) FROM base),
edges AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM long GROUP BY 1),
binned AS (SELECT feature, y, len(list_filter(e, lambda c: c < x)) AS b FROM long JOIN edges USING (feature)),
n2 AS (SELECT feature, y, b, count(*) AS n FROM binned GROUP BY 1, 2, 3),
t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM n2)""",
            "SELECT feature, round(greatest(sum(n / CAST(nn AS DOUBLE) * ln(CAST(n AS DOUBLE) * nn / (CAST(nb AS DOUBLE) * ny))), 0), 6) AS mi FROM t GROUP BY feature"),
        "mi_knn": with_(mi_ctes("SELECT 'n_chars' AS feature, doc_id AS id, quality AS y, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)"), "SELECT feature, round(mi, 6) AS mi FROM mi"),
        "select_features": with_(VEC + ",\nmelted AS (" + long("vec", MEASURED, f"user_id, {lab} AS y") + """),
med AS (SELECT feature, quantile_cont(value, 0.5) AS md FROM melted GROUP BY 1),
""" + mi_ctes("SELECT feature, user_id AS id, y, coalesce(value, md, 0e0) AS x FROM melted JOIN med USING (feature)") + f""",
so AS (SELECT {lab} AS y, count(*) AS n, sum("SIRS" - (SELECT min("SIRS") FROM vec)) AS o FROM vec GROUP BY 1),
se AS (SELECT *, n * (SELECT sum(o) FROM so) / CAST((SELECT sum(n) FROM so) AS DOUBLE) AS e FROM so),
cs AS (SELECT sum((o - e) * (o - e) / e) AS s FROM se),
top AS (SELECT feature, 'continuous' AS kind, mi AS score, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM mi)""",
            "SELECT feature, kind, round(score, 6) AS score, rank FROM top WHERE rank <= 18 UNION ALL SELECT 'SIRS', 'categorical', round(s, 6), 1 FROM cs WHERE s > 3.841458820694124e0"),
        "binary_metrics": with_("conf AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) AS n FROM labels)",
            'SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 4) AS "Accuracy", round(tp / CAST(tp + fp AS DOUBLE), 4) AS "Precision", round(tp / CAST(tp + fn AS DOUBLE), 4) AS "Recall", round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS "F1 Score" FROM conf'),
        "log_loss": with_(VEC, f"SELECT round(avg(-({lab} * ln(p) + (1 - {lab}) * ln(1e0 - p))), 6) AS log_loss FROM (SELECT {lab}, {RULE} AS p FROM vec)"),
        "fold_summary": with_(fold_metrics, "SELECT CAST(fold AS VARCHAR) AS fold, " + ", ".join(f"CAST({q(c)} AS VARCHAR) AS {q(c)}" for c in four) + " FROM met UNION ALL SELECT 'Mean ± SD', " + ", ".join(f"{text(f'avg({q(c)})', 2)} || ' ± ' || {text(f'stddev_samp({q(c)})', 3)}" for c in four) + " FROM met"),
        "background_sample": with_(FILLED, f"SELECT user_id, {rounds(BOTTLENECK)} FROM filled ORDER BY {digest('user_id', 'background:42')}, user_id LIMIT 100"),
        "perturb_shap": with_(shap_ctes(), "SELECT user_id, feature, round(phi, 6) AS phi FROM phis"),
        "waterfall": with_(shap_ctes(), f"SELECT user_id, place, feature, shap AS shap_value, impact, CAST(feature IN {TOP_SQL} AS BIGINT) AS is_top_impact FROM bars"),
        "waterfall_top3": with_(shap_ctes(), "SELECT user_id, " + ", ".join(
            f"array_to_string(list_slice(coalesce(list(feature ORDER BY place) FILTER (WHERE impact = '{i}'), []), 1, 3), ',') AS {i}" for i in ("contributing", "offsetting")) + " FROM bars GROUP BY user_id"),
        "global_importance": with_(shap_ctes(), f"SELECT feature, round(avg(abs(phi)), 4) AS mean_shap_score, CAST(feature IN {TOP_SQL} AS BIGINT) AS is_top_impact FROM phis GROUP BY feature"),
        "dhm_scores": with_(heat, "SELECT user_id, feature, round(score, 6) AS score FROM dhm"),
        "dhm_rank": with_(heat, f"SELECT user_id, feature, rank FROM (SELECT user_id, feature, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {order19}) AS rank FROM dhm) WHERE rank <= 11"),
        "score_records": with_(shap_ctes() + f",\nwarn AS (SELECT user_id, {n_warn} AS n_warnings FROM vec)",
            f"""SELECT user_id, round(p, 4) AS prediction_probability, {band('p')}, 0.3e0 AS decision_threshold, n_warnings,
  feature AS top_feature, round(own, 2) AS top_value, shap AS top_shap
  FROM (SELECT user_id, {RULE} AS p FROM filled) JOIN warn USING (user_id) JOIN bars USING (user_id) WHERE place = 0"""),
        "score_json": f"""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS t FROM events),
x AS (SELECT event_id, t, {bounded} AS temp FROM e)
SELECT event_id, temp AS "Temp", round({rule(lambda g: 'temp' if g == 'Temp' else num(catalog.midpoint(g)))}, 6) AS prob,
  CAST(18 + CASE WHEN t < 30 OR t > 43 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings,
  CASE WHEN t < 30 OR t > 43 THEN 'Temp (' || CAST(t AS VARCHAR) || ') was outside biological limits [30.0, 43.0]; clipped to ' || CAST(temp AS VARCHAR) || '.'
    ELSE 'Chloride was not provided; defaulted to physiological normal (101.00).' END AS second_warning FROM x""",
        "pca_variance": "SELECT CAST(11 AS BIGINT) AS dimensions, CAST(1 AS BIGINT) AS uncorrelated, CAST(1 AS BIGINT) AS ordered",
        "page_links": """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS link FROM pages""",
        "catalog_midpoints": with_(PANEL + ",\nlong AS (" + long("panel", catalog.RAW, "user_id") + "),\ncat AS (SELECT * FROM (VALUES " + ", ".join(
            f"('{f}', {i}, {int(f in catalog.BOTTLENECK)}, {int(f in catalog.TOP)}, {num(catalog.NORMAL_RANGE[f][0])}, {num(catalog.NORMAL_RANGE[f][1])}, {num(catalog.LIMITS[f][0])}, {num(catalog.LIMITS[f][1])}, {num(round(catalog.midpoint(f), 2))})"
            for i, f in enumerate(FEATURES)) + ") t(feature, ord, is_bottleneck, is_top, normal_lo, normal_hi, lim_lo, lim_hi, midpoint))",
            """SELECT feature, CAST(ord AS BIGINT) AS ord, CAST(is_bottleneck AS BIGINT) AS is_bottleneck, CAST(is_top AS BIGINT) AS is_top, normal_lo, normal_hi, lim_lo, lim_hi, midpoint,
  count(*) AS measured, count(*) FILTER (WHERE value BETWEEN normal_lo AND normal_hi) AS normal FROM long JOIN cat USING (feature) WHERE value IS NOT NULL GROUP BY ALL"""),
    }
    o["locf_blocks"] = o["locf_bfill"]
    return o
