"""DuckDB SQL giving the expected rows of each query, written over the raw tables."""

from __future__ import annotations

from checks.registry import FIXED_BLOCKS, FROZEN, FROZEN_INTERCEPT, RUN, RUN_INTERCEPT

# The event streams: uid, oid, d (and km), distinct.
EVENTS = """
per(set, cutoff_date, f0, f1, l0, l1) AS (VALUES
  ('train', DATE '1998-04-01', DATE '1998-01-01', DATE '1998-04-01', DATE '1998-01-01', DATE '1998-07-01'),
  ('test', DATE '1998-07-01', DATE '1998-04-01', DATE '1998-07-01', DATE '1998-04-01', DATE '1998-07-01')),
hold(set, cutoff_date, f0, f1, l0, l1) AS (VALUES
  ('holdout', DATE '1998-10-01', DATE '1998-07-01', DATE '1998-10-01', DATE '1998-07-01', DATE '1998-10-01')),
ok_account AS (
  SELECT c_custkey AS uid FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_name NOT LIKE '%99%'),
lead AS (
  SELECT DISTINCT o_custkey AS uid, o_orderkey AS oid, CAST(o_orderdate AS DATE) AS d
  FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT uid FROM ok_account)),
booking AS (
  SELECT DISTINCT o_custkey AS uid, o_orderkey AS oid, CAST(o_orderdate AS DATE) AS d
  FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
line AS (
  SELECT o_custkey AS uid, o_orderkey AS oid, o_orderpriority AS prio, l_returnflag AS rf, l_linestatus AS ls,
         CAST(l_shipdate AS DATE) AS d, l_tax AS tax,
         CASE WHEN l_discount >= 0.05 THEN CAST(l_shipdate AS DATE) + 3 END AS d_insp,
         CASE WHEN l_linenumber <> 7 THEN CAST(FLOOR(l_extendedprice / 50) * 50 AS BIGINT) END AS km
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
reg AS (SELECT DISTINCT uid, oid, d FROM line WHERE rf = 'N'),
regkm AS (SELECT DISTINCT uid, oid, d, km FROM line WHERE rf = 'N'),
sched AS (
  SELECT DISTINCT uid, oid, COALESCE(d_insp, d) AS d FROM line WHERE rf = 'N' AND ls = 'O' AND tax >= 0.04),
sales_tx AS (
  SELECT DISTINCT uid, oid, d FROM line WHERE ls = 'F' AND rf = 'R' AND prio IN ('1-URGENT', '2-HIGH')),
supply_tx AS (SELECT DISTINCT uid, oid, d FROM line WHERE ls = 'F' AND rf = 'R' AND prio = '5-LOW'),
deal AS (SELECT uid, d FROM sales_tx UNION ALL SELECT uid, d FROM supply_tx),
sig AS (
  SELECT 'lead' AS k, uid, d FROM lead UNION ALL SELECT 'booking', uid, d FROM booking
  UNION ALL SELECT 'register', uid, d FROM reg UNION ALL SELECT 'schedule', uid, d FROM sched),
sigkm AS (
  SELECT k, uid, d FROM sig WHERE k <> 'register' UNION ALL SELECT 'register', uid, d FROM regkm)
"""


def _km_columns(mode: str) -> str:
    rest = {
        "circular": "LEAST(km % {m}, {m} - km % {m}) / {m}.0::DOUBLE",
        "plain": "(km % {m}) / {m}.0::DOUBLE",
    }[mode]
    flags = ", ".join(
        f"CAST(COALESCE(km % {s} = 0, FALSE) AS INTEGER) AS reg_km_is_round_{s}" for s in (1000, 500, 100, 50, 10)
    )
    return f"""
      km AS reg_km_last, ROUND(LOG10(km + 1.0::DOUBLE), 6) AS reg_km_log1p,
      CAST(LENGTH(CAST(km AS VARCHAR)) - LENGTH(RTRIM(CAST(km AS VARCHAR), '0')) AS INTEGER)
        AS reg_km_trailing_zeros,
      {flags},
      {rest.format(m=1000)} AS reg_km_mod1000_norm, {rest.format(m=100)} AS reg_km_mod100_norm"""


def dataset(periods: str, signals: str, skip_null: bool, mode: str, name: str = "ds") -> str:
    """CTEs building a period dataset under ``name``."""
    keep = "AND r.km IS NOT NULL" if skip_null else ""
    kinds = {
        "lead": ("n_qleads_90d", "recency_last_qlead"),
        "booking": ("n_bookings_90d", "recency_last_booking"),
        "register": ("n_registers_90d", "recency_last_register"),
        "schedule": ("n_online_schedules_90d", "recency_last_online_schedule"),
    }
    columns = ", ".join(
        f"COUNT(*) FILTER (k = '{k}') AS {n}, "
        f"CAST(DATE_DIFF('day', MAX(d) FILTER (k = '{k}'), f1) AS INTEGER) AS {r}"
        for k, (n, r) in kinds.items()
    )
    return f"""
{name}_agg AS (
  SELECT set, cutoff_date, uid, {columns}
  FROM {periods} JOIN {signals} ON d >= f0 AND d < f1 GROUP BY set, cutoff_date, f1, uid),
{name}_km AS (
  SELECT set, uid, km FROM {periods} JOIN regkm r ON r.d >= f0 AND r.d < f1 {keep}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY set, uid ORDER BY r.d DESC, km DESC NULLS LAST) = 1),
{name}_hit AS (SELECT DISTINCT set, uid, 1 AS hit FROM {periods} JOIN deal ON d >= l0 AND d < l1),
{name} AS (
  SELECT a.set, a.cutoff_date, CAST(a.uid AS VARCHAR) AS user_id, a.* EXCLUDE (set, cutoff_date, uid),
         n_qleads_90d + n_registers_90d AS total_signals_90d, {_km_columns(mode)},
         COALESCE(hit, 0)::INTEGER AS target_30d
  FROM {name}_agg a LEFT JOIN {name}_km k ON k.set = a.set AND k.uid = a.uid
  LEFT JOIN {name}_hit h ON h.set = a.set AND h.uid = a.uid)
"""


TRAIN_TEST = "WITH " + EVENTS + "," + dataset("per", "sig", False, "circular")
HOLDOUT = "WITH " + EVENTS + "," + dataset("hold", "sigkm", True, "plain")

COHORT = """
cohort AS (
  SELECT uid FROM ok_account JOIN orders ON o_custkey = uid GROUP BY uid
  HAVING CAST(MIN(o_orderdate) AS DATE) BETWEEN DATE '1995-01-08' AND DATE '1995-02-14')
"""


def weekly(fanout: bool) -> str:
    """CTE ``wk``: the cohort with its trailing columns.

    The fan-out form really joins leads with registers; the other counts each stream.
    """
    if fanout:
        trailing = """
pairs AS (
  SELECT c.uid,
    COUNT(*) FILTER (q.d BETWEEN DATE '1995-02-07' AND DATE '1995-02-13') AS n_qleads_7d,
    COUNT(*) FILTER (q.d BETWEEN DATE '1995-01-15' AND DATE '1995-02-13') AS n_qleads_30d,
    COUNT(*) FILTER (r.d BETWEEN DATE '1995-02-07' AND DATE '1995-02-13') AS n_registers_7d,
    COUNT(*) FILTER (r.d BETWEEN DATE '1995-01-15' AND DATE '1995-02-13') AS n_registers_30d
  FROM cohort c LEFT JOIN lead q ON q.uid = c.uid LEFT JOIN regkm r ON r.uid = c.uid GROUP BY c.uid)"""
    else:
        trailing = """
pairs AS (
  SELECT c.uid,
    COUNT(*) FILTER (k = 'lead' AND d BETWEEN DATE '1995-02-07' AND DATE '1995-02-13') AS n_qleads_7d,
    COUNT(*) FILTER (k = 'lead' AND d BETWEEN DATE '1995-01-15' AND DATE '1995-02-13') AS n_qleads_30d,
    COUNT(*) FILTER (k = 'register' AND d BETWEEN DATE '1995-02-07' AND DATE '1995-02-13') AS n_registers_7d,
    COUNT(*) FILTER (k = 'register' AND d BETWEEN DATE '1995-01-15' AND DATE '1995-02-13') AS n_registers_30d
  FROM cohort c LEFT JOIN sigkm s ON s.uid = c.uid GROUP BY c.uid)"""
    kinds = {
        "lead": ("n_qleads_90d", "recency_last_qlead"),
        "booking": ("n_bookings_90d", "recency_last_booking"),
        "register": ("n_registers_90d", "recency_last_register"),
        "schedule": ("n_online_schedules_90d", "recency_last_online_schedule"),
    }
    columns = ", ".join(
        f"COUNT(*) FILTER (k = '{k}' AND d BETWEEN DATE '1994-11-16' AND DATE '1995-02-13') AS {n}, "
        f"CAST(DATE '1995-02-14' - MAX(d) FILTER (k = '{k}' AND d < DATE '1995-02-14') AS INTEGER) AS {r}"
        for k, (n, r) in kinds.items()
    )
    return f"""WITH {EVENTS}, {COHORT}, {trailing},
base AS (SELECT c.uid, {columns} FROM cohort c LEFT JOIN sigkm s ON s.uid = c.uid GROUP BY c.uid),
wk AS (
  SELECT 'test' AS set, DATE '1995-02-14' AS cutoff_date, CAST(b.uid AS VARCHAR) AS user_id,
    b.* EXCLUDE (uid), n_qleads_90d + n_registers_90d AS total_signals_90d, p.* EXCLUDE (uid),
    IF(n_registers_90d + n_online_schedules_90d >= n_qleads_90d, 'supply', 'sales') AS origin_inferred,
    (SELECT MAX(km) FROM regkm r WHERE r.uid = b.uid AND r.d < DATE '1995-02-14') AS reg_km_last,
    CAST(b.uid IN (SELECT uid FROM deal WHERE d >= DATE '1995-02-14' AND d < DATE '1995-03-16') AS INTEGER)
      AS target_30d
  FROM base b JOIN pairs p ON p.uid = b.uid)
"""


# Scored rows on an integer grid, one row per distinct score with running counts.
SCORED = TRAIN_TEST + """,
scored AS (
  SELECT set, cutoff_date, user_id, target_30d AS y,
    CAST(10 * LEAST(total_signals_90d, 9) + LEAST(n_bookings_90d, 9) AS DOUBLE) / 100.0::DOUBLE AS p
  FROM ds)
"""
TOTALS = SCORED + """,
tot AS (SELECT set, COUNT(*) AS n, SUM(y)::BIGINT AS pos FROM scored GROUP BY set)
"""
PAIRWISE_AUC = """
auc AS (
  SELECT set, SUM(wins) / (MAX(pos) * MAX(neg))::DOUBLE AS auc FROM (
    SELECT a.set, a.pos_n * b.neg_n * (CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)::DOUBLE AS wins
    FROM (SELECT set, p, COUNT(*) AS pos_n FROM scored WHERE y = 1 GROUP BY set, p) a
    JOIN (SELECT set, p, COUNT(*) AS neg_n FROM scored WHERE y = 0 GROUP BY set, p) b ON a.set = b.set) w
  JOIN (SELECT set, pos, n - pos AS neg FROM tot) t USING (set) GROUP BY set)
"""
# Rows at or above each distinct score.
AT_LEAST = """
cut AS (
  SELECT v.set, v.p, COUNT(*) AS flagged, SUM(s.y)::BIGINT AS tp
  FROM (SELECT DISTINCT set, p FROM scored) v JOIN scored s ON s.set = v.set AND s.p >= v.p
  GROUP BY v.set, v.p)
"""
AP = """
ap AS (
  SELECT v.set, SUM(c.tp::DOUBLE / c.flagged) / MAX(t.pos) AS ap
  FROM scored v JOIN cut c ON c.set = v.set AND c.p = v.p JOIN tot t ON t.set = v.set
  WHERE v.y = 1 GROUP BY v.set)
"""


def thresholds(ks: str) -> str:
    """CTE ``thr``: confusion counts at the score of the wanted row, per share in ``ks``."""
    return f"""
ks AS ({ks}),
ordered AS (SELECT set, p, ROW_NUMBER() OVER (PARTITION BY set ORDER BY p DESC) AS rn FROM scored),
thr AS (
  SELECT t.set, ks.k, ks.f, o.p AS threshold, c.tp, c.flagged - c.tp AS fp, t.pos - c.tp AS fn,
    t.n - c.flagged - t.pos + c.tp AS tn,
    ROUND(c.tp::DOUBLE / c.flagged, 6) AS precision, ROUND(c.tp::DOUBLE / t.pos, 6) AS recall
  FROM tot t CROSS JOIN ks
  JOIN ordered o ON o.set = t.set AND o.rn = GREATEST(1, FLOOR(t.n::DOUBLE * ks.f)::BIGINT)
  JOIN cut c ON c.set = t.set AND c.p = o.p)
"""


SWEEP_KS = "SELECT i::INTEGER AS k, i::DOUBLE / 100.0::DOUBLE AS f FROM RANGE(1, 21) g(i)"
SWEEP = TOTALS + "," + AT_LEAST + "," + thresholds(SWEEP_KS) + """
SELECT set, k AS k_pct, f AS k_frac, threshold, precision, recall, tp, fp, fn, tn FROM thr"""

ROC_BODY = """
SELECT c.set, c.p AS threshold, ROUND((c.flagged - c.tp)::DOUBLE / (t.n - t.pos), 6) AS fpr,
  ROUND(c.tp::DOUBLE / t.pos, 6) AS tpr FROM cut c JOIN tot t USING (set)
UNION ALL SELECT set, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM tot"""
PR_BODY = """
SELECT c.set, c.p AS threshold, ROUND(c.tp::DOUBLE / t.pos, 6) AS recall,
  ROUND(c.tp::DOUBLE / c.flagged, 6) AS precision, ROUND(t.pos::DOUBLE / t.n, 6) AS baseline
FROM cut c JOIN tot t USING (set)
UNION ALL SELECT set, NULL, 0.0::DOUBLE, 1.0::DOUBLE, ROUND(pos::DOUBLE / n, 6) FROM tot"""

KM_NAMES = (
    "reg_km_last, reg_km_log1p, reg_km_trailing_zeros, reg_km_is_round_1000, reg_km_is_round_500, "
    "reg_km_is_round_100, reg_km_is_round_50, reg_km_is_round_10, reg_km_mod1000_norm, reg_km_mod100_norm"
)
MODEL_COUNTS = (
    "n_qleads_90d n_bookings_90d n_registers_90d n_online_schedules_90d total_signals_90d "
    "reg_km_log1p reg_km_trailing_zeros reg_km_mod1000_norm reg_km_mod100_norm reg_km_is_round_1000 "
    "reg_km_is_round_500 reg_km_is_round_100 reg_km_is_round_50 reg_km_is_round_10"
).split()
MODEL_RECENCIES = (
    "recency_last_qlead recency_last_booking recency_last_register recency_last_online_schedule"
).split()


def _filled(name: str) -> str:
    return f"COALESCE({name}::DOUBLE, {91.0 if name in MODEL_RECENCIES else 0.0})"


def _stream(table: str, km: bool = False) -> str:
    extra = ", km" if km else ""
    return f"""WITH {EVENTS}
SELECT uid::VARCHAR AS user_id, oid::VARCHAR AS opportunity_id, d AS event_date{extra} FROM {table}"""


_imputed = ", ".join(f"ROUND({_filled(c)}, 6) AS {c}" for c in [*MODEL_COUNTS, *MODEL_RECENCIES])
_scales = ", ".join(f"ROUND(STDDEV_POP({_filled(c)}), 6) AS {c}" for c in [*MODEL_COUNTS, *MODEL_RECENCIES])
_logit = " + ".join(f"({w}) * {_filled('km_log' if c == 'reg_km_log1p' else c)}" for c, w in FROZEN.items())
_metric = lambda ctes, select: TOTALS + "," + ctes + select

METRICS_BY_SET = _metric(PAIRWISE_AUC + "," + AT_LEAST + "," + AP, """
SELECT t.set, t.n AS n_rows, t.pos AS positives, ROUND(auc, 6) AS roc_auc, ROUND(ap, 6) AS pr_auc,
  (SELECT ROUND(AVG((p - y) * (p - y)), 6) FROM scored s WHERE s.set = t.set) AS brier,
  ROUND(t.pos::DOUBLE / t.n, 6) AS positive_rate
FROM tot t JOIN auc USING (set) JOIN ap USING (set)""")

_names = ", ".join(f"('{c}')" for c in [*MODEL_COUNTS, *MODEL_RECENCIES])


def _fixed_scores(dataset: str, missing: tuple[str, ...] = ()) -> str:
    """The fixed score of a dataset; features it lacks count as missing."""
    terms = " + ".join(
        f"({w}) * {0.0 if c in missing else _filled('km_log' if c == 'reg_km_log1p' else c)}" for c, w in FROZEN.items()
    )
    return f"""
SELECT user_id, ROUND(1 / (1 + EXP(-({FROZEN_INTERCEPT} + {terms}))), 6) AS y_prob
FROM (SELECT *, LOG10(reg_km_last + 1.0::DOUBLE) AS km_log FROM {dataset})"""


# Isotonic regression at x: the greatest, over starts up to x, of the least mean from the start on past x.
ISOTONIC_MAP = SCORED + """,
pts AS (SELECT p, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS pos FROM scored GROUP BY p),
run AS (SELECT p, SUM(n) OVER (ORDER BY p) AS cn, SUM(pos) OVER (ORDER BY p) AS cp, n, pos FROM pts),
mean AS (SELECT a.p AS lo, b.p AS hi, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS m FROM run a JOIN run b ON b.p >= a.p),
best AS (SELECT x.p, lo, MIN(m) AS m FROM pts x JOIN mean ON lo <= x.p AND hi >= x.p GROUP BY x.p, lo)
SELECT p AS margin, ROUND(MAX(m), 6) AS calibrated FROM best GROUP BY p"""

def newton(rows: str, keys: str, steps: int, ridge: bool) -> str:
    """CTEs ``b0`` to ``b{steps}``: Newton steps of a weighted logistic fit of (x1, x2) to y for each key.

    ``rows`` has the key, x1, x2, y and w. The penalty of half a square each is on the coefficients
    alone, against the weighted mean loss over n rows. The 3 by 3 systems are solved by determinants.
    """
    r = "1.0 / max(n)" if ridge else "0.0"
    parts = [f"b0 AS MATERIALIZED (SELECT DISTINCT {keys}, 0.0::DOUBLE AS c, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM {rows})"]
    for k in range(steps):
        parts.append(f"""
s{k} AS (
  SELECT {keys}, any_value(c) AS c, any_value(u) AS u, any_value(v) AS v,
    sum(e) / max(n) AS g0, sum(e * x1) / max(n) + any_value(u) * {r} AS g1, sum(e * x2) / max(n) + any_value(v) * {r} AS g2,
    sum(q) / max(n) AS a, sum(q * x1) / max(n) AS d1, sum(q * x2) / max(n) AS d2,
    sum(q * x1 * x1) / max(n) + {r} AS h11, sum(q * x1 * x2) / max(n) AS h12, sum(q * x2 * x2) / max(n) + {r} AS h22
  FROM (SELECT *, w * (p - y) AS e, w * p * (1 - p) AS q FROM (
    SELECT t.*, c, u, v, 1 / (1 + exp(-(c + u * x1 + v * x2))) AS p FROM {rows} t JOIN b{k} USING ({keys})))
  GROUP BY {keys}),
b{k + 1} AS MATERIALIZED (
  SELECT {keys},
    c - (g0 * (h11 * h22 - h12 * h12) - g1 * (d1 * h22 - d2 * h12) + g2 * (d1 * h12 - d2 * h11)) / det AS c,
    u - (-g0 * (d1 * h22 - h12 * d2) + g1 * (a * h22 - d2 * d2) - g2 * (a * h12 - d1 * d2)) / det AS u,
    v - (g0 * (d1 * h12 - h11 * d2) - g1 * (a * h12 - d2 * d1) + g2 * (a * h11 - d1 * d1)) / det AS v
  FROM (SELECT *, a * (h11 * h22 - h12 * h12) - d1 * (d1 * h22 - h12 * d2) + d2 * (d1 * h12 - h11 * d2) AS det FROM s{k}))""")
    return ",".join(parts)


NEWTON_STEPS = 9
LIMITS = "(VALUES (0.1::DOUBLE, 8), (0.2, 16), (0.4, 32), (0.6, 48), (0.8, 64), (1.0, 80)) l(f, limit_b)"
# Two features of the train rows over their deviation in the sample, balanced weights, and all samples' fits.
NESTED = TRAIN_TEST + f""",
raw AS (
  SELECT CAST(('0x' || SUBSTR(MD5(user_id), 1, 8))::BIGINT % 100 AS INTEGER) AS b, {_filled("n_qleads_90d")} AS r1,
    {_filled("recency_last_booking")} AS r2, target_30d::DOUBLE AS y FROM ds WHERE set = 'train'),
size AS (
  SELECT f, COUNT(*) AS n, SUM(y) AS pos, COALESCE(NULLIF(STDDEV_POP(r1), 0), 1) AS z1, COALESCE(NULLIF(STDDEV_POP(r2), 0), 1) AS z2
  FROM {LIMITS} JOIN raw ON b < limit_b GROUP BY f),
fitrows AS MATERIALIZED (
  SELECT f, r1 / z1 AS x1, r2 / z2 AS x2, y, n, CASE WHEN y = 1 THEN n / (2 * pos) ELSE n / (2 * (n - pos)) END AS w
  FROM {LIMITS} JOIN raw ON b < limit_b JOIN size USING (f)),
{newton("fitrows", "f", NEWTON_STEPS, True)},
fits AS (SELECT f, n, c, u / z1 AS u, v / z2 AS v FROM b{NEWTON_STEPS} JOIN size USING (f))
"""


def _sigmoid_steps(steps: int) -> str:
    """CTEs ``m0`` to ``m{steps}``: Newton steps of a logistic map of the margin to smoothed targets."""
    parts = ["m0 AS (SELECT 0.0::DOUBLE AS c, 0.0::DOUBLE AS u)"]
    for k in range(steps):
        parts.append(f"""m{k + 1} AS MATERIALIZED (
  SELECT any_value(c) - (sum(e) * sum(q * x * x) - sum(e * x) * sum(q * x)) / (sum(q) * sum(q * x * x) - sum(q * x) * sum(q * x)) AS c,
    any_value(u) - (sum(e * x) * sum(q) - sum(e) * sum(q * x)) / (sum(q) * sum(q * x * x) - sum(q * x) * sum(q * x)) AS u
  FROM (SELECT *, n * p - mass AS e, n * p * (1 - p) AS q FROM (
    SELECT x, n, mass, c, u, 1 / (1 + exp(-(c + u * x))) AS p FROM smoothed, m{k})))""")
    return ",\n".join(parts)


SIGMOID_MAP = SCORED + f""",
pts AS (SELECT p AS x, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS pos FROM scored GROUP BY p),
smoothed AS (
  SELECT x, n, pos * (tp + 1) / (tp + 2) + (n - pos) / (tn + 2) AS mass
  FROM pts, (SELECT SUM(pos) AS tp, SUM(n) - SUM(pos) AS tn FROM pts)),
{_sigmoid_steps(12)}
SELECT x AS margin, ROUND(1 / (1 + EXP(-(c + u * x))), 4) AS calibrated FROM pts, m12"""


ORACLE: dict[str, str] = {
    "split_counts": TRAIN_TEST + """
SELECT set AS split, COUNT(*) AS n, SUM(target_30d)::BIGINT AS positives FROM ds GROUP BY set""",
    "fit_stationarity": f"""
SELECT penalty, feature, 0.0::DOUBLE AS slope FROM (VALUES ('l2'), ('elasticnet')) p(penalty),
  (VALUES {_names}) f(feature)""",
    "sigmoid_stationarity": "SELECT 0.0::DOUBLE AS error, 0.0::DOUBLE AS error_by_margin",
    "isotonic_map": ISOTONIC_MAP,
    "isotonic_map_50_ranges": ISOTONIC_MAP,
    "score_holdout_fixed": HOLDOUT + _fixed_scores("ds"),
    "score_weekly_fixed": weekly(True) + _fixed_scores("wk", ("reg_km_log1p", "reg_km_trailing_zeros")),
    "learning_curve_sizes": TRAIN_TEST + """
SELECT f AS fraction, COUNT(*) AS train_rows
FROM (VALUES (0.1::DOUBLE, 8), (0.2, 16), (0.4, 32), (0.6, 48), (0.8, 64), (1.0, 80)) l(f, limit_b)
JOIN (SELECT CAST(('0x' || SUBSTR(MD5(user_id), 1, 8))::BIGINT % 100 AS INTEGER) AS b FROM ds WHERE set = 'train')
  ON b < limit_b GROUP BY f""",
    "sigmoid_map": SIGMOID_MAP,
    "learning_curve_coefficients": NESTED + """
SELECT f AS fraction, n AS train_rows, ROUND(c, 4) AS intercept, ROUND(u, 4) AS n_qleads, ROUND(v, 4) AS recency_booking FROM fits""",
    "fit_two_features": NESTED + """
SELECT ROUND(c, 4) AS intercept, ROUND(u, 4) AS n_qleads, ROUND(v, 4) AS recency_booking FROM fits WHERE f = 1.0""",
    "learning_curve_two_features": NESTED + """,
scored AS (
  SELECT f AS set, n AS rows_fitted, y, 1 / (1 + EXP(-(c + u * r1 + v * r2))) AS p FROM raw, fits WHERE b >= 80),
tot AS (SELECT set, COUNT(*) AS n, SUM(y)::BIGINT AS pos, MAX(rows_fitted) AS rows_fitted FROM scored GROUP BY set),
""" + PAIRWISE_AUC + "," + AT_LEAST + "," + AP + """
SELECT set AS fraction, rows_fitted AS train_rows, ROUND(auc, 6) AS roc_auc, ROUND(ap, 6) AS pr_auc
FROM tot JOIN auc USING (set) JOIN ap USING (set)""",
    "coefficient_names": f"SELECT feature, TRUE AS odds_fit, TRUE AS in_order FROM (VALUES {_names}) f(feature)",
    "sales_lead_events": _stream("lead"),
    "booking_events": _stream("booking"),
    "sales_tx_events": _stream("sales_tx"),
    "supply_tx_events": _stream("supply_tx"),
    "register_events": _stream("reg"),
    "online_schedule_events": _stream("sched"),
    "register_km_events": _stream("regkm", km=True),
    "register_km_text_events": f"""WITH {EVENTS}
SELECT DISTINCT uid::VARCHAR AS user_id, oid::VARCHAR AS opportunity_id, d AS event_date,
  CASE WHEN oid % 4 >= 2 THEN km END AS km FROM line WHERE rf = 'N'""",
    "lead_origin_events": """
SELECT DISTINCT o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS opportunity_id, CAST(o_orderdate AS DATE) AS event_date
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND c_name NOT LIKE '%99%'""",
    "universe_by_signal": f"""WITH {EVENTS}
SELECT DISTINCT set, cutoff_date, uid::VARCHAR AS user_id FROM per JOIN sig ON d >= f0 AND d < f1""",
    "rolling_cohorts": f"""WITH {EVENTS},
roll AS (SELECT 'rolling ' || s::VARCHAR AS set, s AS f0, s + 60 AS f1, s + 90 AS l1
  FROM (SELECT DATE '1992-01-01' + i::INTEGER AS s FROM RANGE(2500) r(i))),
users AS (
  SELECT set, f1, uid, COUNT(*) FILTER (k IN ('lead', 'register')) AS n, f1 - MAX(d) FILTER (k = 'register') AS r
  FROM roll JOIN sig ON d >= f0 AND d < f1 GROUP BY set, f1, uid),
hits AS (SELECT DISTINCT set, uid, 1 AS hit FROM roll JOIN deal ON d >= f1 AND d < l1)
SELECT set, f1 AS cutoff_date, COUNT(*) AS n_users, SUM(n)::BIGINT AS n_signals, SUM(r)::BIGINT AS register_days,
  SUM(COALESCE(hit, 0))::BIGINT AS positives
FROM users LEFT JOIN hits USING (set, uid) GROUP BY set, f1""",
    "universe_union_distinct": f"""WITH {EVENTS}
SELECT uid::VARCHAR AS user_id FROM lead, hold WHERE d >= f0 AND d < f1
UNION SELECT uid::VARCHAR FROM booking, hold WHERE d >= f0 AND d < f1
UNION SELECT uid::VARCHAR FROM reg, hold WHERE d >= f0 AND d < f1
UNION SELECT uid::VARCHAR FROM sched, hold WHERE d >= f0 AND d < f1""",
    "new_account_cohort": f"""WITH {EVENTS}, {COHORT}
SELECT 'test' AS set, DATE '1995-02-14' AS cutoff_date, uid::VARCHAR AS user_id FROM cohort""",
    "sales_features": TRAIN_TEST + """
SELECT set, cutoff_date, user_id, n_qleads_90d, n_bookings_90d, recency_last_qlead, recency_last_booking FROM ds""",
    "supply_features": TRAIN_TEST + """
SELECT set, cutoff_date, user_id, n_registers_90d, n_online_schedules_90d, recency_last_register,
  recency_last_online_schedule, reg_km_last FROM ds""",
    "last_km_asof": f"""WITH {EVENTS},
last AS (SELECT set, cutoff_date, f0, f1, uid, MAX(d) AS d FROM per JOIN regkm ON d >= f0 AND d < f1
  GROUP BY ALL)
SELECT set, cutoff_date, last.uid::VARCHAR AS user_id, MAX(km) AS reg_km_last
FROM last JOIN regkm ON regkm.uid = last.uid AND regkm.d = last.d GROUP BY set, cutoff_date, last.uid""",
    "last_km_row_number": f"""WITH {EVENTS}
SELECT uid::VARCHAR AS user_id, km AS reg_km_last FROM regkm, hold WHERE d >= f0 AND d < f1 AND km IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY uid ORDER BY d DESC, km DESC) = 1""",
    "km_features_circular": TRAIN_TEST + f"SELECT set, cutoff_date, user_id, {KM_NAMES} FROM ds",
    "km_features_plain": HOLDOUT + f"SELECT set, cutoff_date, user_id, {KM_NAMES} FROM ds",
    "per_kind_aggregates": f"""WITH {EVENTS}
SELECT k AS kind, uid::VARCHAR AS user_id, COUNT(*) AS n_events, MAX(d) AS last_date
FROM sigkm, hold WHERE d >= f0 AND d < f1 GROUP BY k, uid""",
    "label_exists": f"""WITH {EVENTS},
uni AS (SELECT DISTINCT set, cutoff_date, l0, l1, uid FROM per JOIN sig ON d >= f0 AND d < f1)
SELECT set, cutoff_date, uid::VARCHAR AS user_id,
  CAST(EXISTS (FROM deal WHERE deal.uid = uni.uid AND deal.d >= uni.l0 AND deal.d < uni.l1) AS INTEGER) AS target_30d
FROM uni""",
    "label_left_join": HOLDOUT + "SELECT user_id, target_30d FROM ds",
    "trailing_window_counts": weekly(False) + """
SELECT user_id, n_qleads_90d, n_qleads_7d, n_qleads_30d, n_registers_90d, n_registers_7d, n_registers_30d FROM wk""",
    "trailing_window_counts_fanout": weekly(True) + """
SELECT user_id, n_qleads_90d, n_qleads_7d, n_qleads_30d, n_registers_90d, n_registers_7d, n_registers_30d FROM wk""",
    "dataset_train_test": TRAIN_TEST + "SELECT * FROM ds",
    "dataset_holdout": HOLDOUT + "SELECT * FROM ds",
    "dataset_weekly": weekly(True) + "SELECT * FROM wk",
    "dataset_weekly_corrected": weekly(False) + "SELECT * FROM wk",
    "dataset_summary": HOLDOUT + """
SELECT COUNT(*) AS n_rows, SUM(target_30d)::BIGINT AS positives, ROUND(AVG(target_30d::DOUBLE), 6) AS positive_rate
FROM ds""",
    "user_split_80_20": TRAIN_TEST + """
SELECT user_id, b AS bucket, CAST(b < 80 AS INTEGER) AS is_fit
FROM (SELECT user_id, CAST(('0x' || SUBSTR(MD5(user_id), 1, 8))::BIGINT % 100 AS INTEGER) AS b
      FROM ds WHERE set = 'train')""",
    "balanced_class_weights": TRAIN_TEST + """
SELECT target_30d AS label, COUNT(*) AS n, ROUND(SUM(COUNT(*)) OVER () / (2.0 * COUNT(*)), 6)::DOUBLE AS weight
FROM ds WHERE set = 'train' GROUP BY target_30d""",
    "feature_scales": TRAIN_TEST + f"""
SELECT COUNT(*) AS n, SUM(target_30d)::DOUBLE AS pos, {_scales} FROM ds WHERE set = 'train'""",
    "imputed_features": TRAIN_TEST + f"SELECT set, cutoff_date, user_id, {_imputed} FROM ds",
    "score_frozen_logit": TRAIN_TEST + f"""
SELECT set, cutoff_date, user_id, ROUND(1 / (1 + EXP(-({FROZEN_INTERCEPT} + {_logit}))), 6) AS y_prob
FROM (SELECT *, LOG10(reg_km_last + 1.0::DOUBLE) AS km_log FROM ds)""",
    "predictions_topk": TOTALS + """
SELECT set, cutoff_date, user_id, y AS y_true, p AS y_prob,
  CAST(p >= (SELECT MIN(p) FROM (SELECT p FROM scored WHERE set = 'test' ORDER BY p DESC
    LIMIT (SELECT GREATEST(1, FLOOR(n * 0.1::DOUBLE))::BIGINT FROM tot WHERE set = 'test'))) AS INTEGER) AS y_pred_topk
FROM scored WHERE set = 'test'""",
    "roc_auc": _metric(PAIRWISE_AUC, "SELECT set, ROUND(auc, 6) AS roc_auc FROM auc"),
    "average_precision": _metric(AT_LEAST + "," + AP, "SELECT set, ROUND(ap, 6) AS pr_auc FROM ap"),
    "brier_score": SCORED + "SELECT set, ROUND(AVG((p - y) * (p - y)), 6) AS brier FROM scored GROUP BY set",
    "auc_by_set": _metric(PAIRWISE_AUC, "SELECT set, ROUND(auc, 6) AS auc FROM auc"),
    "metrics_by_set": METRICS_BY_SET,
    "metrics_by_null_group": "SELECT CASE WHEN set = 'test' THEN set END AS grp, n_rows, positives, roc_auc, pr_auc, "
    "brier, positive_rate FROM (" + METRICS_BY_SET + ")",
    "topk_threshold_report": _metric(
        AT_LEAST + "," + thresholds("SELECT 1 AS k, 0.1::DOUBLE AS f"),
        "SELECT set, f AS topk_fraction, threshold, precision, recall, tp, fp, fn, tn FROM thr",
    ),
    "threshold_sweep": SWEEP,
    "recommendation_table": SWEEP + " WHERE k IN (2, 5, 10, 15)",
    "lift_by_decile": TOTALS + """,
placed AS (
  SELECT s.*, t.n, t.pos,
    ROW_NUMBER() OVER (PARTITION BY s.set ORDER BY s.p DESC, MD5(s.user_id), s.user_id) - 1 AS i
  FROM scored s JOIN tot t USING (set))
SELECT set, LEAST(FLOOR(i::DOUBLE / (n::DOUBLE / 10))::INTEGER + 1, 10) AS decile, COUNT(*) AS n,
  SUM(y)::BIGINT AS positives, ROUND(AVG(p), 6) AS mean_p, ROUND(AVG(y), 6) AS response_rate,
  ROUND(AVG(y) / (MAX(pos)::DOUBLE / MAX(n)), 6) AS lift
FROM placed GROUP BY set, LEAST(FLOOR(i::DOUBLE / (n::DOUBLE / 10))::INTEGER + 1, 10)""",
    "calibration_bins": SCORED + """,
edges AS (
  SELECT set, QUANTILE_CONT(p, [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7, 0.8, 0.9]) AS e FROM scored GROUP BY set),
binned AS (
  SELECT s.set, s.p, s.y, LEN(LIST_FILTER(e, lambda x: x < s.p))::INTEGER AS bin
  FROM scored s JOIN edges USING (set))
SELECT set, bin, COUNT(*) AS n, ROUND(AVG(p), 6) AS mean_predicted, ROUND(AVG(y), 6) AS positive_fraction
FROM binned GROUP BY set, bin""",
    "roc_points": _metric(AT_LEAST, ROC_BODY),
    "pr_points": _metric(AT_LEAST, PR_BODY),
}


def _margin(coefficients: dict[str, float], intercept: float) -> str:
    terms = " + ".join(f"({w!r}) * {_filled('km_log' if c == 'reg_km_log1p' else c)}" for c, w in coefficients.items())
    return f"({intercept!r} + {terms})"


def _interpolated(x: str) -> str:
    """The value of the fixed blocks at a margin: linear between them, clipped outside."""
    knots = [(m, pos / n) for lo, hi, n, pos in FIXED_BLOCKS for m in (lo, hi)]
    cases = [f"WHEN {x} <= {knots[0][0]} THEN {knots[0][1]!r}"]
    cases += [
        f"WHEN {x} <= {b} THEN {v!r} + ({w!r} - {v!r}) * ({x} - ({a})) / ({b} - ({a}))" for (a, v), (b, w) in zip(knots, knots[1:])
    ]
    return f"CASE {' '.join(cases)} ELSE {knots[-1][1]!r} END::DOUBLE"


_LOGGED = "(SELECT *, LOG10(reg_km_last + 1.0::DOUBLE) AS km_log FROM ds)"
# Scores of a run at fixed coefficients, in place of those on the grid.
RUN_SCORED = TRAIN_TEST + f""",
scored AS (
  SELECT set, cutoff_date, user_id, target_30d AS y, 1 / (1 + EXP(-{_margin(RUN, RUN_INTERCEPT)})) AS p FROM {_LOGGED})
"""


def _of_run(name: str, only: str = "WHERE set = 'test'", numbers: tuple[str, ...] = ()) -> str:
    changed = ", ".join(f"ROUND({c}, 6) AS {c}" for c in numbers)
    replace = f" REPLACE ({changed})" if numbers else ""
    return f"SELECT set AS split, * EXCLUDE (set){replace} FROM ({ORACLE[name].replace(SCORED, RUN_SCORED)}) {only}"


_LINE = "set || ',' || cutoff_date::VARCHAR || ',' || user_id"
SAVED = HOLDOUT + f"""
SELECT user_id, ROUND({_interpolated("x")}, 6) AS y_prob FROM (SELECT user_id, {_margin(FROZEN, FROZEN_INTERCEPT)} AS x FROM {_LOGGED})"""
ORACLE |= {
    "staged_dataset": ORACLE["dataset_train_test"],
    "csv_dataset": ORACLE["dataset_train_test"],
    "csv_checked_rows": TRAIN_TEST + "SELECT set, cutoff_date, user_id, n_qleads_90d FROM ds WHERE user_id::BIGINT % 7 > 1",
    "csv_rejected_rows": TRAIN_TEST + f"""
SELECT {_LINE} || CASE WHEN user_id::BIGINT % 7 = 0 THEN ',many' ELSE '' END AS text,
  CASE WHEN user_id::BIGINT % 7 = 0 THEN 'n_qleads_90d: many' ELSE 'columns' END AS reasons
FROM ds WHERE user_id::BIGINT % 7 <= 1""",
    "sorted_export": TRAIN_TEST + """
SELECT ((i - 1) // 200)::INTEGER AS file, COUNT(*) AS n, MIN(key) AS first_key, MAX(key) AS last_key, TRUE AS in_order
FROM (SELECT set || ' ' || user_id AS key, ROW_NUMBER() OVER (ORDER BY set, user_id) AS i FROM ds) GROUP BY 1""",
    "predictions_sink": ORACLE["predictions_topk"],
    "scores_sink": ORACLE["score_holdout_fixed"],
    "scores_without_ids": f"""
SELECT COUNT(*) AS n, COUNT(*) AS ids, ROUND(SUM(y_prob), 4) AS total FROM ({ORACLE["score_holdout_fixed"]})""",
    "sweep_sink": ORACLE["threshold_sweep"],
    "metrics_document_rows": f"SELECT set AS split, roc_auc, pr_auc, brier, positive_rate FROM ({METRICS_BY_SET})",
    "threshold_document": f"""
SELECT topk_fraction, threshold, precision AS precision_at_k, recall AS recall_at_k, tn, fp, fn, tp
FROM ({ORACLE["topk_threshold_report"]}) WHERE set = 'test'""",
    "saved_model_scores": SAVED,
    "saved_table_model_scores": SAVED,
    "validation_findings": TRAIN_TEST + """,
rows AS (SELECT user_id::BIGINT AS u FROM ds WHERE set = 'train')
SELECT * FROM (
  SELECT 'empty set' AS rule, 'test' AS "column", 0::BIGINT AS rows
  UNION ALL SELECT 'missing column', c, COUNT(*) FROM rows, (VALUES ('n_bookings_90d'), ('recency_last_qlead')) m(c) GROUP BY c
  UNION ALL SELECT 'no key', 'user_id', COUNT(*) FROM rows WHERE u % 4 = 0
  UNION ALL SELECT 'no label', 'target_30d', COUNT(*) FROM rows WHERE u % 3 = 0
  UNION ALL SELECT 'bad label', 'target_30d', COUNT(*) FROM rows WHERE u % 3 = 1
  UNION ALL SELECT 'not a number', 'n_qleads_90d', COUNT(*) FROM rows WHERE u % 5 = 0
) WHERE rule = 'empty set' OR rows > 0""",
    "run_metrics": _of_run("metrics_by_set", only=""),
    "run_predictions": f"""
SELECT * REPLACE (ROUND(y_prob, 6) AS y_prob) FROM ({ORACLE["predictions_topk"].replace(SCORED, RUN_SCORED)})""",
    "run_threshold": _of_run("topk_threshold_report", numbers=("threshold",)),
    "run_sweep": _of_run("threshold_sweep", numbers=("threshold",)),
    "run_lift": _of_run("lift_by_decile"),
    "run_calibration": _of_run("calibration_bins"),
    "run_auc_by_set": f"SELECT * FROM ({ORACLE['auc_by_set'].replace(SCORED, RUN_SCORED)}) WHERE set = 'test'",
}
