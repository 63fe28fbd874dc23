"""Reference SQL (DuckDB dialect) for every exactly checkable query.

Each statement recomputes the operator's answer from the raw tables with
plain SQL: windows over whole classes, ``quantile_cont``, correlated
scalar subqueries — the straightforward formulations the Spark plans are
designed to avoid at scale. Doubles are rounded to 6 places, counts cast
to BIGINT, so results compare exactly with ``catalog.queries()``.
"""

from __future__ import annotations

from riskframe.functions.columns import hex_threshold
from riskframe.operators import search
from riskframe.plans.catalog import RISK_COEFFICIENTS

ACTIVITY = """
cut AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cutoff FROM orders),
per_customer AS (
  SELECT o.o_custkey,
         count(*) FILTER (WHERE o.o_orderdate <= cut.cutoff) AS n_orders,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderdate <= cut.cutoff) AS total_spend,
         min(o.o_orderdate) FILTER (WHERE o.o_orderdate <= cut.cutoff) AS first_order,
         count(*) FILTER (WHERE o.o_orderdate <= cut.cutoff AND o.o_orderpriority = '1-URGENT') AS n_urgent,
         count(*) FILTER (WHERE o.o_orderdate > cut.cutoff) AS n_after,
         any_value(cut.cutoff) AS cutoff
  FROM orders o CROSS JOIN cut
  GROUP BY o.o_custkey
),
activity AS (
  SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name, c.c_acctbal,
         CAST(p.n_orders AS BIGINT) AS n_orders,
         p.total_spend,
         p.total_spend / p.n_orders AS avg_spend,
         CAST(date_diff('day', CAST(p.first_order AS DATE), CAST(p.cutoff AS DATE)) AS INTEGER) AS tenure_days,
         p.n_urgent / p.n_orders AS urgent_share,
         CASE WHEN p.n_after > 0 THEN 'No' ELSE 'Yes' END AS churned
  FROM per_customer p
  JOIN customer c ON c.c_custkey = p.o_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE p.n_orders > 0
)"""

NUMERIC = ("c_acctbal", "n_orders", "total_spend", "avg_spend", "tenure_days", "urgent_share")


# the split's key text: length, colon, value
_KEY = "length(CAST(c_custkey AS VARCHAR)) || ':' || CAST(c_custkey AS VARCHAR)"


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _score_expr() -> str:
    terms = [_d(RISK_COEFFICIENTS["intercept"])]
    for name, w in RISK_COEFFICIENTS.items():
        if name != "intercept":
            terms.append(f"{_d(w)} * CAST({name} AS DOUBLE)")
    lin = terms[0]
    for t in terms[1:]:
        lin = f"({lin} + {t})"
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{lin})))"


SCORED = f"""{ACTIVITY},
scored AS (SELECT *, {_score_expr()} AS churn_proba FROM activity)"""


def _num_stats(src: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (
        f"SELECT '{col}' AS column_name, count({col}) AS count, "
        f"(round(avg({x}), 6) + 0.0) AS mean, (round(stddev_samp({x}), 6) + 0.0) AS std, (round(min({x}), 6) + 0.0) AS min, "
        f"(round(quantile_cont({x}, 0.25), 6) + 0.0) AS p25, (round(quantile_cont({x}, 0.5), 6) + 0.0) AS p50, "
        f"(round(quantile_cont({x}, 0.75), 6) + 0.0) AS p75, (round(max({x}), 6) + 0.0) AS max FROM {src}"
    )


def _mixed_num(src: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return (
        f"SELECT '{col}' AS column_name, count({col}) AS count, CAST(NULL AS BIGINT) AS unique, "
        f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, "
        f"(round(avg({x}), 6) + 0.0) AS mean, (round(stddev_samp({x}), 6) + 0.0) AS std, (round(min({x}), 6) + 0.0) AS min, "
        f"(round(quantile_cont({x}, 0.25), 6) + 0.0) AS p25, (round(quantile_cont({x}, 0.5), 6) + 0.0) AS p50, "
        f"(round(quantile_cont({x}, 0.75), 6) + 0.0) AS p75, (round(max({x}), 6) + 0.0) AS max FROM {src}"
    )


def _mixed_text(src: str, col: str) -> str:
    f = f"(SELECT CAST({col} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col})"
    nd = "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{col}' AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, "
        f"(SELECT v FROM {f} ORDER BY n DESC, v LIMIT 1) AS top, "
        f"(SELECT max(n) FROM {f}) AS freq, "
        f"{nd} AS mean, {nd} AS std, {nd} AS min, {nd} AS p25, {nd} AS p50, {nd} AS p75, {nd} AS max FROM {f}"
    )


def _metrics(pairs: str, select: str, by_model: bool = False, tail: str = "") -> str:
    """Per-class and summary metrics from a (model, label, prediction) source."""
    m = "model" if by_model else "'all'"
    return f"""
WITH pairs AS ({pairs}),
cnt AS (SELECT {m} AS model, CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction,
               CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY ALL),
cls AS (SELECT model, label AS cls FROM cnt UNION SELECT model, prediction AS cls FROM cnt),
pc AS (SELECT c.model, c.cls,
              coalesce(sum(CASE WHEN k.label = c.cls THEN k.n END), 0) AS support,
              coalesce(sum(CASE WHEN k.label = c.cls AND k.prediction = c.cls THEN k.n END), 0) AS tp,
              coalesce(sum(CASE WHEN k.prediction = c.cls THEN k.n END), 0) AS predicted
       FROM cls c JOIN cnt k ON k.model = c.model GROUP BY c.model, c.cls),
pm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
                 CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                      ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM pm),
s AS (SELECT model, sum(support) AS n,
             sum(tp) / sum(support) AS accuracy,
             coalesce(max(CASE WHEN cls = 1.0 THEN precision END), 0.0) AS precision,
             coalesce(max(CASE WHEN cls = 1.0 THEN recall END), 0.0) AS recall,
             coalesce(max(CASE WHEN cls = 1.0 THEN f1 END), 0.0) AS f1,
             avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
             sum(precision * support) / sum(support) AS weighted_precision,
             sum(recall * support) / sum(support) AS weighted_recall,
             sum(f1 * support) / sum(support) AS weighted_f1
      FROM pf GROUP BY model)
{select}
{tail}"""


LABEL_PAIRS = "SELECT 'all' AS model, quality AS label, toxic AS prediction FROM labels"
MODEL_RUNS = (
    "SELECT 'toxic_flag' AS model, quality AS label, toxic AS prediction FROM labels "
    "UNION ALL SELECT 'all_negative', quality, 0 FROM labels "
    "UNION ALL SELECT 'all_positive', quality, 1 FROM labels"
)
REPORT_COLS = (
    "model, (round(accuracy, 6) + 0.0) AS accuracy, (round(precision, 6) + 0.0) AS precision, (round(recall, 6) + 0.0) AS recall, "
    "(round(f1, 6) + 0.0) AS f1, (round(weighted_f1, 6) + 0.0) AS weighted_f1"
)


def _tidy(run_sql: str, side: str) -> str:
    parts = [
        f"SELECT 'quality' AS model, '{m}' AS metric, {m} AS value_{side} FROM ({run_sql})"
        for m in ("accuracy", "precision", "recall", "f1", "weighted_f1")
    ]
    return " UNION ALL ".join(parts)


def _compare_runs() -> str:
    a = _metrics(
        "SELECT 'quality' AS model, quality AS label, toxic AS prediction FROM labels",
        "SELECT * FROM s",
        by_model=True,
    )
    b = _metrics(
        "SELECT 'quality' AS model, quality AS label, 0 AS prediction FROM labels",
        "SELECT * FROM s",
        by_model=True,
    )
    return f"""
WITH ta AS ({_tidy(a, 'a')}), tb AS ({_tidy(b, 'b')})
SELECT coalesce(ta.model, tb.model) AS model, coalesce(ta.metric, tb.metric) AS metric,
       (round(value_a, 6) + 0.0) AS value_a, (round(value_b, 6) + 0.0) AS value_b,
       CASE WHEN value_a IS NULL OR value_b IS NULL THEN NULL
            WHEN value_a = value_b THEN 'tie'
            WHEN value_a > value_b THEN 'a' ELSE 'b' END AS better
FROM ta FULL JOIN tb ON ta.model = tb.model AND ta.metric = tb.metric"""


def _report_rows() -> str:
    return _metrics(
        LABEL_PAIRS,
        """SELECT CAST(CAST(cls AS BIGINT) AS VARCHAR) AS class, (round(precision, 6) + 0.0) AS precision,
       (round(recall, 6) + 0.0) AS recall, (round(f1, 6) + 0.0) AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, (round(accuracy, 6) + 0.0), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', (round(macro_precision, 6) + 0.0), (round(macro_recall, 6) + 0.0), (round(macro_f1, 6) + 0.0), CAST(n AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', (round(weighted_precision, 6) + 0.0), (round(weighted_recall, 6) + 0.0), (round(weighted_f1, 6) + 0.0),
          CAST(n AS BIGINT) FROM s""",
    )


def _index_categories() -> str:
    cats = ("c_mktsegment", "n_name", "r_name")
    levels = ",\n".join(
        f"lv_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS idx "
        f"FROM activity WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in cats
    )
    cols = ", ".join(
        f"coalesce(lv_{c}.idx, CAST((SELECT count(*) FROM lv_{c}) AS DOUBLE)) AS {c}_idx" for c in cats
    )
    joins = " ".join(f"LEFT JOIN lv_{c} ON a.{c} = lv_{c}.v" for c in cats)
    return f"WITH {ACTIVITY},\n{levels}\nSELECT a.c_custkey, {cols} FROM activity a {joins}"


# The TPC-H market segments and region names.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _one_hot() -> str:
    cols = [
        f"CAST(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS \"{c}_{v}\""
        for c, vals in (("c_mktsegment", SEGMENTS), ("r_name", REGIONS))
        for v in vals
    ]
    return f"WITH {ACTIVITY}\nSELECT c_custkey, {', '.join(cols)} FROM activity"


def _scaled(std_fn: str, suffix: str, zero_to_one: bool) -> str:
    cols = []
    for c in NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        s = f"{std_fn}({x}) OVER ()"
        denom = f"coalesce(nullif({s}, 0), 1.0)" if zero_to_one else s
        cols.append(f"(round(({x} - avg({x}) OVER ()) / {denom}, 6) + 0.0) AS {c}{suffix}")
    return f"WITH {ACTIVITY}\nSELECT c_custkey, {', '.join(cols)} FROM activity"


def _assembled() -> str:
    cols = ", ".join(f"(round(CAST({c} AS DOUBLE), 6) + 0.0) AS {c}_slot" for c in NUMERIC)
    return f"WITH {ACTIVITY}\nSELECT c_custkey, {cols} FROM activity"


def _pipeline_scaled() -> str:
    cats = ("c_mktsegment", "n_name", "r_name")
    levels = ",\n".join(
        f"lv_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS idx "
        f"FROM activity WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in cats
    )
    idx_cols = ", ".join(
        f"coalesce(lv_{c}.idx, CAST((SELECT count(*) FROM lv_{c}) AS DOUBLE)) AS {c}_idx" for c in cats
    )
    joins = " ".join(f"LEFT JOIN lv_{c} ON a.{c} = lv_{c}.v" for c in cats)
    slots = [f"{c}_idx" for c in cats] + list(NUMERIC)
    scaled = ", ".join(
        f"(round((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_samp(CAST({c} AS DOUBLE)) OVER (), 6) + 0.0) AS {c}_scaled"
        for c in slots
    )
    return (
        f"WITH {ACTIVITY},\n{levels},\n"
        f"x AS (SELECT a.*, {idx_cols} FROM activity a {joins})\n"
        f"SELECT c_custkey, {scaled} FROM x"
    )


def _read_metrics() -> str:
    run = _metrics(MODEL_RUNS, "SELECT * FROM s", by_model=True)
    parts = [
        f"SELECT 'labels' AS engine, model, '{m}' AS metric, (round({m}, 3) + 0.0) AS value FROM ({run})"
        for m in ("accuracy", "precision", "recall", "f1", "weighted_f1")
    ]
    return "\nUNION ALL ".join(parts)


def _write_metrics() -> str:
    run = _metrics(MODEL_RUNS, "SELECT * FROM s", by_model=True)
    tidy = " UNION ALL ".join(
        f"SELECT model, '{m}' AS metric, {m} AS value FROM ({run})"
        for m in ("accuracy", "precision", "recall", "f1", "weighted_f1")
    )
    return f"""WITH m AS ({tidy}),
per_model AS (
  SELECT model, '{{' || string_agg('"' || metric || '":"' || printf('%.3f', value) || '"', ',' ORDER BY metric) || '}}' AS j
  FROM m GROUP BY model)
SELECT '{{' || string_agg('"' || model || '":' || j, ',' ORDER BY model) || '}}' AS value FROM per_model"""


def _strat_rank() -> str:
    return (
        "SELECT c_custkey, churned, "
        f"row_number() OVER (PARTITION BY churned ORDER BY md5({_KEY} || '#42'), c_custkey) AS rk, "
        "count(*) OVER (PARTITION BY churned) AS n FROM activity"
    )


GAPS = """gaps AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 9500 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""

# the same with NaN as null
GAPS_NULL = f"""{GAPS},
filled AS (SELECT * REPLACE (CASE WHEN isnan(c_acctbal) THEN NULL ELSE c_acctbal END AS c_acctbal) FROM gaps)"""

GAP_MISSING = (
    ("c_custkey", "c_custkey IS NULL"),
    ("c_name", "c_name IS NULL"),
    ("c_nationkey", "c_nationkey IS NULL"),
    ("c_acctbal", "c_acctbal IS NULL OR isnan(c_acctbal)"),
    ("c_mktsegment", "c_mktsegment IS NULL"),
)

CUSTOMER_TYPES = (
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
)


def _describe_text() -> str:
    null_text, null_num = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
    parts = []
    for col, typ in CUSTOMER_TYPES:
        x = f"CAST({col} AS DOUBLE)"
        if typ == "string":
            stats = [
                ("count", null_text, f"CAST(count({col}) AS DOUBLE)"),
                ("mean", null_text, null_num),
                ("stddev", null_text, null_num),
                ("min", f"min({col})", null_num),
                ("max", f"max({col})", null_num),
            ]
        else:
            stats = [
                ("count", null_text, f"CAST(count({col}) AS DOUBLE)"),
                ("mean", null_text, f"(round(avg({x}), 6) + 0.0)"),
                ("stddev", null_text, f"(round(stddev_samp({x}), 6) + 0.0)"),
                ("min", null_text, f"(round(min({x}), 6) + 0.0)"),
                ("max", null_text, f"(round(max({x}), 6) + 0.0)"),
            ]
        for summary, text, num in stats:
            constant = text == null_text and num == null_num
            parts.append(
                f"SELECT '{summary}' AS summary, '{col}' AS column_name, {text} AS text_value, "
                f"{num} AS num_value" + ("" if constant else " FROM customer")
            )
    return "\nUNION ALL ".join(parts)


ACTIVITY_OUT = (
    "c_custkey, c_mktsegment, n_name, r_name, (round(c_acctbal, 6) + 0.0) AS c_acctbal, n_orders, "
    "(round(total_spend, 6) + 0.0) AS total_spend, (round(avg_spend, 6) + 0.0) AS avg_spend, tenure_days, "
    "(round(urgent_share, 6) + 0.0) AS urgent_share, churned"
)
CUSTOMER_OUT = "c_custkey, c_name, c_nationkey, (round(c_acctbal, 6) + 0.0) AS c_acctbal, c_mktsegment"
HIGH_RISK = "SELECT * FROM scored WHERE churn_proba >= 0.8 ORDER BY churn_proba DESC, c_custkey LIMIT 20"


def _test_rows(columns: str) -> str:
    return f"""WITH {ACTIVITY}, r AS ({_strat_rank()}),
t AS (SELECT *, rk > floor(n * 0.3::DOUBLE + 0.5::DOUBLE) AS is_train,
             CASE WHEN churned = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM r)
SELECT {columns} FROM t WHERE NOT is_train"""


FIT = "c_custkey, label, true AS probability_valid, true AS prediction_follows"
FIT_LOGISTIC = (
    FIT + ", (SELECT (round(avg(label), 6) + 0.0) FROM t WHERE is_train) AS train_share, true AS mean_is_share"
)


def _importance() -> str:
    numbers = " UNION ALL ".join(f"SELECT 'num__{c}' AS feature" for c in NUMERIC)
    levels = " UNION ALL ".join(
        f"SELECT DISTINCT 'cat__{c}_' || {c} FROM activity JOIN taught USING (c_custkey) WHERE {c} IS NOT NULL"
        for c in ("c_mktsegment", "n_name", "r_name")
    )
    return f"""WITH {ACTIVITY}, r AS ({_strat_rank()}),
taught AS (SELECT c_custkey FROM r WHERE rk > floor(n * 0.3::DOUBLE + 0.5::DOUBLE)),
names AS ({numbers} UNION ALL {levels})
SELECT feature, true AS is_share, 1.0::DOUBLE AS total FROM names"""


#: Steps of the SQL fit: far more than its accuracy needs at sf0.01.
FIT_STEPS = 2500


def _fit_logistic_notebook() -> str:
    """The same objective minimised in SQL: accelerated gradient steps over the
    one-hot and scaled columns of the training rows, the vector of all
    coefficients being one list (the intercept last)."""
    cats = ("c_mktsegment", "n_name", "r_name")
    numbers = ",\n".join(
        f"(CAST(a.{c} AS DOUBLE) - m.mean_{c}) / coalesce(nullif(m.std_{c}, 0), 1.0)" for c in NUMERIC
    )
    moments = ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS mean_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS std_{c}" for c in NUMERIC
    )
    levels = ", ".join(
        f"(SELECT list(DISTINCT {c} ORDER BY {c}) FROM activity JOIN taught USING (c_custkey) WHERE {c} IS NOT NULL) AS lv_{c}"
        for c in cats
    )
    hot = " || ".join(
        f"list_transform(m.lv_{c}, lambda v: CASE WHEN v = a.{c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for c in cats
    )
    return f"""WITH RECURSIVE {ACTIVITY}, r AS ({_strat_rank()}),
t AS (SELECT *, rk > floor(n * 0.3::DOUBLE + 0.5::DOUBLE) AS is_train,
             CASE WHEN churned = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM r),
taught AS (SELECT c_custkey FROM t WHERE is_train),
m AS (SELECT {moments}, {levels} FROM activity JOIN taught USING (c_custkey)),
x AS MATERIALIZED (
  SELECT a.c_custkey, t.label, t.is_train, [{numbers}] || {hot} || [1.0::DOUBLE] AS x
  FROM activity a JOIN t USING (c_custkey), m),
given AS MATERIALIZED (
  SELECT any_value(len(x)) AS p, 0.25 * sum(list_dot_product(x, x)) + 1 AS bound FROM x WHERE is_train),
train AS MATERIALIZED (SELECT x, label FROM x WHERE is_train),
fit(i, b, y) AS (
  SELECT 0, list_transform(range(p), lambda j: 0.0::DOUBLE), list_transform(range(p), lambda j: 0.0::DOUBLE) FROM given
  UNION ALL
  SELECT i + 1, list(nb ORDER BY j), list(nb + (sqrt(bound) - 1) / (sqrt(bound) + 1) * (nb - ob) ORDER BY j)
  FROM (
    SELECT any_value(i) AS i, j, any_value(b[j]) AS ob, any_value(bound) AS bound,
      any_value(y[j]) - (sum(resid * x[j]) + CASE WHEN j < any_value(p) THEN any_value(y[j]) ELSE 0.0 END) / any_value(bound) AS nb
    FROM (SELECT f.*, g.*, x, UNNEST(range(1, g.p + 1)) AS j, 1 / (1 + exp(-list_dot_product(x, y))) - label AS resid
          FROM fit f, given g, train WHERE f.i < {FIT_STEPS})
    GROUP BY j)
  GROUP BY i, bound HAVING count(*) > 0),
optimum AS (SELECT b FROM fit WHERE i = {FIT_STEPS})
SELECT c_custkey, label, true AS probability_valid, true AS prediction_follows,
  (SELECT (round(avg(label), 6) + 0.0) FROM t WHERE is_train) AS train_share, true AS mean_is_share,
  (round(1 / (1 + exp(-list_dot_product(x, b))), 4) + 0.0) AS churn_proba
FROM x, optimum WHERE NOT is_train"""


_DOC_KEY = "md5(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || '#42')"
LABEL_FOLDS = f"""SELECT i || '-' || CASE WHEN fold = i THEN 'test' ELSE 'train' END AS model, quality AS label, toxic AS prediction
FROM (SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY {_DOC_KEY}, doc_id) - 1) % 5 AS fold FROM labels)
CROSS JOIN range(5) f(i)"""
FOLD_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1")


def _cross_validate() -> str:
    known = "\nUNION ALL ".join(
        f"SELECT 'labels' AS source, split_part(model, '-', 2) AS side, '{m}' AS metric, "
        f"(round(avg({m}), 6) + 0.0) AS mean, (round(stddev_pop({m}), 6) + 0.0) AS std FROM s GROUP BY ALL"
        for m in FOLD_METRICS
    )
    fitted = "\nUNION ALL ".join(
        f"SELECT 'fitted', '{side}', '{m}', 1.0::DOUBLE, CAST(NULL AS DOUBLE)"
        for side in ("test", "train")
        for m in FOLD_METRICS
    )
    return _metrics(LABEL_FOLDS, known, by_model=True, tail=f"UNION ALL\n{fitted}")


def _grid_search() -> str:
    combos = search.combinations(search.FOREST_GRID)
    fitted = "\nUNION ALL ".join(f"SELECT 'fitted', '{search.combo_text(c)}', 1.0::DOUBLE" for c in combos)
    known = _metrics(
        LABEL_FOLDS,
        "SELECT 'labels' AS source, 'recall' AS params, (round(avg(recall), 6) + 0.0) AS value FROM s "
        "WHERE model LIKE '%-test'",
        by_model=True,
        tail=f"UNION ALL SELECT 'fitted', 'is_best', 1.0::DOUBLE\nUNION ALL {fitted}",
    )
    tuned = _test_rows("label").replace("SELECT label FROM t", "SELECT * FROM t")
    return f"""SELECT * FROM ({known})
UNION ALL SELECT 'tuned', 'support ' || CAST(CAST(label AS INTEGER) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM ({tuned}) GROUP BY label
UNION ALL SELECT 'tuned', 'support ' || line, CAST(n AS DOUBLE)
FROM (SELECT count(*) AS n FROM ({tuned})), (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(line)"""


def oracle_sql() -> dict[str, str]:
    split_cut = hex_threshold(0.7, 8)
    sql = {
        # 2.1
        "read_table": "SELECT doc_id, nullif(text, 'NA') AS text, nullif(lang, 'NA') AS lang, nullif(source, 'NA') AS source, n_chars FROM documents",
        "read_metrics": _read_metrics(),
        "write_metrics": _write_metrics(),
        "write_table": f"""WITH {SCORED}
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_mktsegment, n_name, r_name, (round(c_acctbal, 6) + 0.0) AS c_acctbal,
       CAST(n_orders AS INTEGER) AS n_orders, (round(total_spend, 6) + 0.0) AS total_spend, (round(avg_spend, 6) + 0.0) AS avg_spend,
       tenure_days, (round(urgent_share, 6) + 0.0) AS urgent_share, churned, (round(churn_proba, 6) + 0.0) AS churn_proba
FROM scored""",
        # 2.2
        "schema_report": "\nUNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, true AS nullable, "
            f"count({c}) AS non_null FROM customer"
            for i, (c, t) in enumerate(CUSTOMER_TYPES)
        ),
        "table_shape": "SELECT count(*) AS n_rows, 6 AS n_cols FROM orders",
        "preview": f"SELECT {CUSTOMER_OUT} FROM customer ORDER BY c_custkey LIMIT 5",
        "describe_numeric": "\nUNION ALL ".join(
            f"(WITH {GAPS_NULL} {_num_stats('filled', c)})" for c in ("c_custkey", "c_nationkey", "c_acctbal")
        ),
        "describe_lineitem": "\nUNION ALL ".join(
            _num_stats("lineitem", f"l_{c}")
            for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax")
        ),
        "describe_text": _describe_text(),
        "describe_mixed": "\nUNION ALL ".join(
            [_mixed_num("orders", f"o_{c}") for c in ("orderkey", "custkey", "totalprice")]
            + [_mixed_text("orders", f"o_{c}") for c in ("orderstatus", "orderdate", "orderpriority")]
        ),
        "value_counts": (
            f"WITH {GAPS_NULL} SELECT (round(c_acctbal, 6) + 0.0) AS c_acctbal, count(*) AS count FROM filled "
            "WHERE c_acctbal IS NOT NULL GROUP BY c_acctbal"
        ),
        "value_shares": (
            f"WITH {GAPS_NULL} SELECT c_mktsegment, (round(CAST(count(*) AS DOUBLE) * 100.0::DOUBLE / "
            "CAST(sum(count(*)) OVER () AS DOUBLE), 6) + 0.0) AS share_pct FROM filled "
            "WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment"
        ),
        "histogram": f"""WITH {ACTIVITY},
lab AS (SELECT CASE WHEN churned = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM activity),
b AS (SELECT CASE WHEN x >= -0.5 AND x < 0.5 THEN 0 WHEN x >= 0.5 AND x <= 1.5 THEN 1 END AS bin FROM lab),
bins AS (SELECT * FROM (VALUES (0, -0.5::DOUBLE, 0.5::DOUBLE), (1, 0.5::DOUBLE, 1.5::DOUBLE)) t(bin, lower, upper))
SELECT bins.bin, bins.lower, bins.upper, count(b.bin) AS count
FROM bins LEFT JOIN b ON b.bin = bins.bin GROUP BY bins.bin, bins.lower, bins.upper""",
        "duplicate_count": (
            "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates "
            "FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"
        ),
        "null_counts": f"WITH {GAPS}\n"
        + "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cond}) AS n_missing FROM gaps"
            for c, cond in GAP_MISSING
        ),
        "null_total": f"WITH {GAPS}, m AS ("
        + " UNION ALL ".join(f"SELECT count(*) FILTER (WHERE {cond}) AS k FROM gaps" for _, cond in GAP_MISSING)
        + ")\nSELECT CAST(sum(k) AS BIGINT) AS n_missing, CASE WHEN sum(k) = 0 THEN 'ok' ELSE 'alert' END AS status FROM m",
        # 2.3
        "map_label": f"WITH {ACTIVITY}\nSELECT c_custkey, churned, CASE churned WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn_flag FROM activity",
        "binary_label": f"WITH {ACTIVITY}\nSELECT c_custkey, churned, CASE WHEN churned = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM activity",
        "features_and_target": f"""WITH {ACTIVITY}
SELECT c_mktsegment, n_name, r_name, (round(c_acctbal, 6) + 0.0) AS c_acctbal, n_orders, (round(total_spend, 6) + 0.0) AS total_spend,
       (round(avg_spend, 6) + 0.0) AS avg_spend, tenure_days, (round(urgent_share, 6) + 0.0) AS urgent_share, churned AS target
FROM activity""",
        "select_existing": "SELECT c_custkey, c_mktsegment, (round(c_acctbal, 6) + 0.0) AS c_acctbal FROM customer",
        "filter_at_least": f"SELECT {CUSTOMER_OUT} FROM customer WHERE c_acctbal >= 8000",
        "top_k": (
            "SELECT o_orderkey, o_custkey, (round(o_totalprice, 6) + 0.0) AS o_totalprice FROM orders "
            "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"
        ),
        # 2.4
        "index_categories": _index_categories(),
        "one_hot": _one_hot(),
        "standardize": _scaled("stddev_pop", "_std", True),
        "scale_vector": _scaled("stddev_samp", "_scaled", False),
        "assemble": _assembled(),
        "preprocess_pipeline": _pipeline_scaled(),
        # 2.5
        "random_split": f"""WITH {ACTIVITY}
SELECT c_custkey,
       CASE WHEN substr(md5({_KEY} || '#42'), 1, 8) < '{split_cut}' THEN 'train' ELSE 'test' END AS split
FROM activity""",
        "stratified_split": f"""WITH {ACTIVITY}, r AS ({_strat_rank()})
SELECT c_custkey, churned, CASE WHEN rk <= floor(n * 0.3::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""",
        "stratified_folds": f"""WITH {ACTIVITY}, r AS ({_strat_rank()})
SELECT c_custkey, churned, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r""",
        # 2.6: fits, checked by what must hold of them
        "fit_logistic": _test_rows(FIT_LOGISTIC),
        "fit_logistic_notebook": _fit_logistic_notebook(),
        "fit_forest": _test_rows(FIT),
        "fit_forest_notebook": _test_rows(FIT),
        "fit_boosting": _test_rows(FIT),
        "predict": _test_rows("c_custkey, true AS is_class"),
        "feature_importance": _importance(),
        "cross_validate": _cross_validate(),
        "grid_search": _grid_search(),
        "risk_flow": f"""WITH {ACTIVITY}, r AS ({_strat_rank()})
SELECT CASE WHEN rk <= floor(n * 0.3::DOUBLE + 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split, count(*) AS n_scored,
       true AS list_follows, CAST(4 AS BIGINT) AS n_profiled FROM r GROUP BY ALL""",
        "score": f"WITH {SCORED}\nSELECT c_custkey, (round(churn_proba, 6) + 0.0) AS churn_proba FROM scored",
        "class_weights": f"""WITH {ACTIVITY},
cw AS (SELECT churned, count(*) AS nc FROM activity GROUP BY churned),
tot AS (SELECT sum(nc) AS n, count(*) AS k FROM cw)
SELECT a.c_custkey, a.churned, (round(CAST(tot.n AS DOUBLE) / CAST(tot.k * cw.nc AS DOUBLE), 6) + 0.0) AS weight
FROM activity a JOIN cw ON a.churned = cw.churned CROSS JOIN tot""",
        # 2.7
        "confusion_matrix": """WITH grid AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.0::DOUBLE, 1.0::DOUBLE),
                                      (1.0::DOUBLE, 0.0::DOUBLE), (1.0::DOUBLE, 1.0::DOUBLE)) g(label, prediction)),
cnt AS (SELECT CAST(quality AS DOUBLE) AS label, CAST(toxic AS DOUBLE) AS prediction, count(*) AS n
        FROM labels GROUP BY ALL)
SELECT g.label, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt c ON g.label = c.label AND g.prediction = c.prediction""",
        "accuracy": _metrics(LABEL_PAIRS, "SELECT (round(accuracy, 6) + 0.0) AS accuracy FROM s"),
        "precision_binary": _metrics(LABEL_PAIRS, "SELECT (round(precision, 6) + 0.0) AS precision FROM s"),
        "recall_binary": _metrics(LABEL_PAIRS, "SELECT (round(recall, 6) + 0.0) AS recall FROM s"),
        "f1_binary": _metrics(LABEL_PAIRS, "SELECT (round(f1, 6) + 0.0) AS f1 FROM s"),
        "f1_weighted": _metrics(LABEL_PAIRS, "SELECT (round(weighted_f1, 6) + 0.0) AS weighted_f1 FROM s"),
        "macro_scores": _metrics(
            LABEL_PAIRS,
            "SELECT (round(macro_precision, 6) + 0.0) AS macro_precision, (round(macro_recall, 6) + 0.0) AS macro_recall, "
            "(round(macro_f1, 6) + 0.0) AS macro_f1 FROM s",
        ),
        "classification_report": _report_rows(),
        "metrics_report": _metrics(MODEL_RUNS, f"SELECT {REPORT_COLS} FROM s", by_model=True),
        "select_best": _metrics(
            MODEL_RUNS, f"SELECT {REPORT_COLS} FROM s", by_model=True, tail="ORDER BY recall DESC, f1 DESC, model LIMIT 1"
        ),
        "compare_runs": _compare_runs(),
        # 2.8
        "high_risk": f"WITH {SCORED}, top AS ({HIGH_RISK})\nSELECT {ACTIVITY_OUT}, (round(churn_proba, 6) + 0.0) AS churn_proba FROM top",
        "risk_profile": f"WITH {SCORED}, top AS ({HIGH_RISK})\n"
        + "\nUNION ALL ".join(
            [
                _mixed_text("top", "c_mktsegment"),
                _mixed_text("top", "r_name"),
                _mixed_num("top", "tenure_days"),
                _mixed_num("top", "avg_spend"),
            ]
        ),
        "retention_roi": f"""WITH {SCORED},
n AS (SELECT count(*) AS n_targeted FROM scored WHERE churn_proba >= 0.8)
SELECT n_targeted,
       (round(CAST(n_targeted AS DOUBLE) * 150.0::DOUBLE, 6) + 0.0) AS expected_gain,
       (round(CAST(n_targeted AS DOUBLE) * 100.0::DOUBLE, 6) + 0.0) AS expected_cost,
       CASE WHEN n_targeted = 0 THEN NULL
            ELSE (round((CAST(n_targeted AS DOUBLE) * 150.0::DOUBLE - CAST(n_targeted AS DOUBLE) * 100.0::DOUBLE)
                       / (CAST(n_targeted AS DOUBLE) * 100.0::DOUBLE) * 100.0::DOUBLE, 6) + 0.0) END AS roi_pct
FROM n""",
    }
    return sql
