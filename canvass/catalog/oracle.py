"""SQL for DuckDB that states the expected result of each registered query.

Written from the definitions, not from the operators: window functions over whole
tables, brute-force split search, gamma-function tail sums.
"""

from __future__ import annotations

import re

from canvass.catalog import tree_sql

CONTACTS = """contacts AS (
SELECT o_orderkey AS contact_id, o_orderdate AS contact_ts,
 CAST(18 + (o_custkey * 7 + 3) % 70 AS INT) AS age,
 CASE o_custkey % 12 WHEN 0 THEN 'admin.' WHEN 1 THEN 'blue-collar' WHEN 2 THEN 'entrepreneur' WHEN 3 THEN 'housemaid'
  WHEN 4 THEN 'management' WHEN 5 THEN 'retired' WHEN 6 THEN 'self-employed' WHEN 7 THEN 'services' WHEN 8 THEN 'student'
  WHEN 9 THEN 'technician' WHEN 10 THEN 'unemployed' ELSE 'unknown' END AS job,
 CASE c_nationkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'married' ELSE 'divorced' END AS marital,
 CASE (o_custkey + c_nationkey) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' ELSE 'unknown' END AS education,
 CASE WHEN o_orderkey % 50 = 0 THEN 'yes' ELSE 'no' END AS "default",
 c_acctbal AS balance,
 CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS housing,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS loan,
 CASE o_orderstatus WHEN 'F' THEN 'cellular' WHEN 'O' THEN 'telephone' ELSE 'unknown' END AS contact,
 CAST(day(o_orderdate) AS INT) AS day,
 CASE month(o_orderdate) WHEN 1 THEN 'jan' WHEN 2 THEN 'feb' WHEN 3 THEN 'mar' WHEN 4 THEN 'apr' WHEN 5 THEN 'may' WHEN 6 THEN 'jun'
  WHEN 7 THEN 'jul' WHEN 8 THEN 'aug' WHEN 9 THEN 'sep' WHEN 10 THEN 'oct' WHEN 11 THEN 'nov' ELSE 'dec' END AS month,
 CAST(floor(o_totalprice / 100) AS INT) AS duration,
 CAST(1 + o_orderkey % 5 AS INT) AS campaign,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 + o_orderkey % 400 END AS INT) AS pdays,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_orderkey % 4 END AS INT) AS previous,
 CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN substr(o_orderpriority,1,1) IN ('1','2') THEN 'success'
  WHEN substr(o_orderpriority,1,1) = '3' THEN 'other' ELSE 'failure' END AS poutcome,
 CASE WHEN (CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END)
   + (CASE WHEN o_orderkey % 3 <> 0 AND substr(o_orderpriority,1,1) IN ('1','2') THEN 1 ELSE 0 END)
   + (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
   + (CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)),1,1) IN ('0','1','2','3') THEN 1 ELSE 0 END) >= 2 THEN 'yes' ELSE 'no' END AS deposit
FROM orders JOIN customer ON o_custkey = c_custkey)"""

SCORED = CONTACTS + """, scored AS (
SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT *, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS label,
 (CASE WHEN duration >= 2000 THEN 3 ELSE 0 END + CASE WHEN poutcome = 'success' THEN 2 ELSE 0 END
  + CASE WHEN contact = 'cellular' THEN 2 ELSE 0 END + CASE WHEN age < 40 THEN 1 ELSE 0 END) / CAST(8 AS DOUBLE) AS p FROM contacts) t)"""

SMOOTH = SCORED + """, smooth AS (
SELECT * REPLACE ((balance + 1e3) / 1.1e4 * CAST(0.25 AS DOUBLE) + duration / 5e3 * CAST(0.75 AS DOUBLE) AS p) FROM scored)"""

NUMERIC = ("age", "balance", "day", "duration", "campaign", "pdays", "previous")
CATEGORICAL = ("job", "marital", "education", "default", "housing", "loan", "contact", "month", "poutcome")
INPUTS = (
    "age", "job", "marital", "education", "default", "balance", "housing", "loan", "contact", "day", "month",
    "duration", "campaign", "pdays", "previous", "poutcome",
)
METRICS = ("accuracy", "precision", "recall", "f1_score", "auc_roc")


def q(name: str) -> str:
    return f'"{name}"'


def columns(names) -> str:
    return ", ".join(q(n) for n in names)


def matrix(source: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''}
 CAST(count(*) FILTER (label = 0 AND prediction = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (label = 0 AND prediction = 1) AS BIGINT) AS fp,
 CAST(count(*) FILTER (label = 1 AND prediction = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 1 AND prediction = 1) AS BIGINT) AS tp,
 CAST(count(*) FILTER (label IS NULL) AS BIGINT) AS unlabelled FROM {source}{group}"""


ACC = "(tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE)"
PREC = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END"
REC = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END"
SCALARS = f'round({ACC}, 9) AS accuracy, round({PREC}, 9) AS "precision", round({REC}, 9) AS recall, round({F1}, 9) AS f1_score'


def curve(source: str, by: str = "1") -> str:
    """CTE ``cum``: running counts of every distinct score, from the top."""
    return f"""cum AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY p DESC) AS tps, sum(neg) OVER (PARTITION BY g ORDER BY p DESC) AS fps,
  sum(pos) OVER (PARTITION BY g) AS ps, sum(neg) OVER (PARTITION BY g) AS ns, row_number() OVER (PARTITION BY g ORDER BY p DESC) AS k,
  count(*) OVER (PARTITION BY g) AS m, lead(pos) OVER (PARTITION BY g ORDER BY p DESC) AS next_pos, lead(neg) OVER (PARTITION BY g ORDER BY p DESC) AS next_neg
 FROM (SELECT {by} AS g, p, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY ALL) c)"""


AREA = "CASE WHEN max(ps) * max(ns) = 0 THEN 0.0 ELSE sum(neg * (tps - pos + pos / 2.0)) / CAST(max(ps) * max(ns) AS DOUBLE) END"
ROC = """SELECT g, 0 AS k, CAST(NULL AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr FROM cum WHERE k = 1 AND ps > 0 AND ns > 0
 UNION ALL SELECT g, k, p, fps / CAST(ns AS DOUBLE), tps / CAST(ps AS DOUBLE) FROM cum
 WHERE ps > 0 AND ns > 0 AND (k = 1 OR k = m OR pos <> next_pos OR neg <> next_neg)"""
PR = """SELECT g, k, p AS threshold, tps / CAST(tps + fps AS DOUBLE) AS "precision", tps / CAST(ps AS DOUBLE) AS recall FROM cum WHERE ps > 0 AND ns > 0
 UNION ALL SELECT g, 0, NULL, 1.0, 0.0 FROM cum WHERE k = 1 AND ps > 0 AND ns > 0"""

RUNS = SCORED + """, weeks AS (SELECT *, CAST(date_trunc('week', contact_ts) AS TIMESTAMP) AS week FROM scored), """ + curve("weeks", "week") + f""",
aucs AS (SELECT g AS week, {AREA} AS auc_roc FROM cum GROUP BY g),
runs AS (SELECT m.week AS created_at, strftime(m.week, '%Y-%m-%d %H:%M:%S') AS created, 'scorecard' AS model_name, tn, fp, fn, tp,
  {ACC} AS accuracy, {PREC} AS "precision", {REC} AS recall, {F1} AS f1_score, auc_roc
 FROM ({matrix('weeks', 'week')}) m JOIN aucs ON m.week = aucs.week)"""
ROUNDED_METRICS = ", ".join(f"round({q(m)}, 9) AS {q(m)}" for m in METRICS)
NEWEST = "runs ORDER BY created_at DESC LIMIT 1"

PREDICTIONS = SCORED + """, predictions AS (SELECT contact_id, prediction, round(p, 9) AS probability, printf('%.4f', p) AS probability_text,
 CASE WHEN prediction = 1 THEN 'yes' ELSE 'no' END AS class_name, strftime(contact_ts, '%Y-%m-%d %H:%M:%S') AS created, contact_ts, job, balance FROM scored)"""
PREDICTION_COLUMNS = "contact_id, prediction, probability, probability_text, class_name, created"

RAW_VALUES = {
    "age": "CASE WHEN contact_id % 97 = 0 THEN '200' WHEN contact_id % 89 = 0 THEN 'abc' ELSE CAST(age AS VARCHAR) END",
    "balance": "CASE WHEN contact_id % 61 = 0 THEN '12,5' ELSE CAST(balance AS VARCHAR) END",
    "marital": "CASE WHEN contact_id % 83 = 0 THEN 'widowed' ELSE marital END",
    "day": "CASE WHEN contact_id % 71 = 0 THEN '0' ELSE CAST(day AS VARCHAR) END",
    "campaign": "CASE WHEN contact_id % 79 = 0 THEN '2.5' ELSE CAST(campaign AS VARCHAR) END",
    "job": "CASE WHEN contact_id % 101 = 0 THEN NULL ELSE job END",
}
# Violations follow from how the requests were spoilt.
SPOILT = """spoilt AS (
 SELECT contact_id, 1 AS o, 'age' AS rule, CASE WHEN contact_id % 97 = 0 THEN 'range' ELSE 'type' END AS kind FROM contacts WHERE contact_id % 97 = 0 OR contact_id % 89 = 0
 UNION ALL SELECT contact_id, 2, 'job', 'missing' FROM contacts WHERE contact_id % 101 = 0
 UNION ALL SELECT contact_id, 3, 'marital', 'domain' FROM contacts WHERE contact_id % 83 = 0
 UNION ALL SELECT contact_id, 6, 'balance', 'type' FROM contacts WHERE contact_id % 61 = 0
 UNION ALL SELECT contact_id, 10, 'day', 'range' FROM contacts WHERE contact_id % 71 = 0
 UNION ALL SELECT contact_id, 13, 'campaign', 'type' FROM contacts WHERE contact_id % 79 = 0)"""
SOUND = "contact_id NOT IN (SELECT contact_id FROM spoilt)"


def raw_columns() -> str:
    return ", ".join(f"{RAW_VALUES.get(c, f'CAST({q(c)} AS VARCHAR)')} AS {q(c)}" for c in INPUTS)


def marked(c: str) -> str:
    return f"CASE WHEN {q(c)} = 'unknown' THEN 'unknown_{c}' ELSE {q(c)} END"


VOCAB = "words AS (" + " UNION ".join(
    f"SELECT '{c}' AS feature, {marked(c)} AS category FROM contacts" for c in CATEGORICAL
) + """), vocab AS (SELECT feature, category, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INT) AS "position" FROM words)"""
SCALER = "scaler AS (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS center, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS scale FROM contacts"
    for i, c in enumerate(NUMERIC)
) + ")"
PARAMS = "params AS (SELECT " + ", ".join(
    f"max(center) FILTER (feature = '{c}') AS c_{c}, max(CASE WHEN scale = 0 THEN 1 ELSE scale END) FILTER (feature = '{c}') AS s_{c}" for c in NUMERIC
) + " FROM scaler)"


def scaled(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) - c_{c}) / s_{c}"


# Categories of the campaign view, sorted, baseline first.
CATEGORIES = {
    "job": ("admin.", "blue-collar", "entrepreneur", "housemaid", "management", "retired", "self-employed", "services",
            "student", "technician", "unemployed", "unknown_job"),
    "marital": ("divorced", "married", "single"),
    "education": ("primary", "secondary", "tertiary", "unknown_education"),
    "default": ("no", "yes"), "housing": ("no", "yes"), "loan": ("no", "yes"),
    "contact": ("cellular", "telephone", "unknown_contact"),
    "month": ("apr", "aug", "dec", "feb", "jan", "jul", "jun", "mar", "may", "nov", "oct", "sep"),
    "poutcome": ("failure", "other", "success", "unknown_poutcome"),
}
INDICATORS = [(c, v) for c in CATEGORICAL for v in CATEGORIES[c][1:]]

SPLIT = """ranked AS (SELECT *, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS y,
  row_number() OVER (PARTITION BY deposit ORDER BY md5(concat('42:', CAST(contact_id AS VARCHAR))), contact_id) AS rk,
  count(*) OVER (PARTITION BY deposit) AS cn FROM contacts),
 parts AS (SELECT *, CASE WHEN rk <= round(0.2 * cn) THEN 'test' ELSE 'train' END AS part FROM ranked)"""

FIXED_P = f"""CASE WHEN {scaled('duration')} <= 0 THEN
   CASE WHEN poutcome <> 'success' THEN CAST(0.1 AS DOUBLE) ELSE CASE WHEN {scaled('age')} <= -0.4 THEN 0.6 ELSE 0.5 END END
  ELSE CASE WHEN contact <> 'telephone' THEN 0.85 ELSE CASE WHEN poutcome <> 'success' THEN 0.3 ELSE 0.95 END END END"""
FIXED = f"""fixed AS (SELECT contact_id, contact, job, age, {FIXED_P} AS p FROM contacts, params)"""
FIXED_HISTORY = f"""WITH {CONTACTS}, {SPOILT}, {SCALER}, {PARAMS}, {FIXED}
SELECT contact_id, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, p AS probability, printf('%.4f', p) AS probability_text,
 CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS class_name, job, age FROM fixed WHERE {SOUND}"""

BINOMIAL = "list_sum(list_transform(range(correct, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))"
TESTED = f"""round(correct / CAST(n AS DOUBLE), 9) AS accuracy, round({BINOMIAL}, 9) AS p_value, {BINOMIAL} < 0.05 AS reject_h0,
 CASE WHEN {BINOMIAL} < 0.05 THEN 'reject H0' ELSE 'do not reject H0' END AS decision"""


def class_entry(name: str, right: str, claimed: str, missed: str) -> str:
    return f"""SELECT '{name}' AS class, {right} / CAST(greatest({right} + {claimed}, 1) AS DOUBLE) AS pr, {right} / CAST(greatest({right} + {missed}, 1) AS DOUBLE) AS re,
 2 * {right} / CAST(greatest(2 * {right} + {claimed} + {missed}, 1) AS DOUBLE) AS f, {right} + {missed} AS s FROM m"""


REPORT = f"""classes AS ({class_entry('0', 'tn', 'fn', 'fp')} UNION ALL {class_entry('1', 'tp', 'fp', 'fn')}),
entries AS (SELECT * FROM classes UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f), sum(s) FROM classes
 UNION ALL SELECT 'weighted avg', sum(pr * s) / sum(s), sum(re * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM classes)"""

JOB_FOLDS = SCORED + """, folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(contact_id AS VARCHAR))), contact_id) - 1) % 5 AS INT) AS fold FROM scored),
 numbered AS (SELECT f.*, CASE WHEN job = 'unknown' THEN 0 ELSE j.n END AS candidate FROM folded f LEFT JOIN
  (SELECT job AS name, row_number() OVER (ORDER BY job) AS n FROM (SELECT DISTINCT job FROM scored WHERE job <> 'unknown') d) j ON f.job = j.name),
 melted AS (SELECT candidate, fold, 'test' AS part, label, p FROM numbered UNION ALL SELECT candidate, fold, 'train', label, duration / 5e3 FROM numbered), """ \
    + curve("melted", "(candidate, fold, part)") + f""",
 fold_scores AS (SELECT g[1] AS candidate, g[3] AS part, {AREA} AS auc FROM cum GROUP BY g),
 stats AS (SELECT candidate, avg(auc) FILTER (part = 'test') AS mt, stddev_pop(auc) FILTER (part = 'test') AS st,
   avg(auc) FILTER (part = 'train') AS mr, stddev_pop(auc) FILTER (part = 'train') AS sr FROM fold_scores GROUP BY candidate),
 ranks AS (SELECT CAST(candidate AS INT) AS candidate, mt, st, mr, sr, CAST(rank() OVER (ORDER BY round(mt, 12) DESC) AS INT) AS rk FROM stats)"""

# Brute-force search of the first two levels of a tree over features with few values.
TREE_NUMERIC = ("age", "day", "campaign", "previous")
TREE_FLAGS = {
    "cellular": "contact = 'cellular'", "telephone": "contact = 'telephone'", "success": "poutcome = 'success'",
    "housing": "housing = 'yes'", "loan": "loan = 'yes'", "default": '"default" = \'yes\'',
}


def _impurity(a: str, b: str) -> str:
    entropy = " + ".join(f"CASE WHEN {x} > 0 THEN -({x}) * log2(({x}) / ({a} + {b})) ELSE 0 END" for x in (a, b))
    return f"CASE WHEN criterion = 'gini' THEN {a} + {b} - (({a}) * ({a}) + ({b}) * ({b})) / ({a} + {b}) ELSE {entropy} END"


def _level(source: str, target: str) -> str:
    """Best split of every (tree, node) of ``source``: (tree, node, feature, f, threshold)."""
    l0, l1, r0, r1 = "l0 * w0", "l1 * w1", "(t0 - l0) * w0", "(t1 - l1) * w1"
    return f"""{target}_long AS (SELECT s.tree, s.node, s.label, v.f, v.value FROM {source} s JOIN long_rows v ON s.contact_id = v.contact_id),
 {target}_left AS (SELECT s.tree, s.node, c.f, c.threshold, count(*) FILTER (value <= threshold AND label = 0) AS l0, count(*) FILTER (value <= threshold AND label = 1) AS l1,
   count(*) FILTER (label = 0) AS t0, count(*) FILTER (label = 1) AS t1 FROM {target}_long s JOIN cuts c ON s.f = c.f GROUP BY ALL),
 {target} AS (SELECT tree, node, f, threshold, t0, t1 FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY round({_impurity(l0, l1)} + {_impurity(r0, r1)}, 6), f, threshold) AS rk
   FROM {target}_left JOIN trees USING (tree) WHERE l0 + l1 >= 5 AND t0 + t1 - l0 - l1 >= 5 AND t0 > 0 AND t1 > 0) WHERE rk = 1)"""


_FEATURES = list(TREE_NUMERIC) + list(TREE_FLAGS)
_TREE = f"""WITH {CONTACTS}, labelled AS (SELECT *, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS label FROM contacts),
 long_rows AS ({' UNION ALL '.join(
    [f"SELECT contact_id, {i} AS f, /*value {i}*/CAST({c} AS DOUBLE)/*end*/ AS value FROM labelled" for i, c in enumerate(TREE_NUMERIC)]
    + [f"SELECT contact_id, {i + len(TREE_NUMERIC)}, CASE WHEN {e} THEN 1.0 ELSE 0.0 END FROM labelled" for i, e in enumerate(TREE_FLAGS.values())]
)}),
 cuts AS (SELECT f, (value + next_value) / 2 AS threshold FROM (SELECT f, value, lead(value) OVER (PARTITION BY f ORDER BY value) AS next_value
   FROM (SELECT DISTINCT f, value FROM long_rows WHERE value IS NOT NULL)) WHERE next_value IS NOT NULL/*cuts*/),
 sizes AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM labelled),
 trees AS (SELECT tree, criterion, CASE WHEN balanced THEN n / (2.0 * c0) ELSE 1.0 END::DOUBLE AS w0, CASE WHEN balanced THEN n / (2.0 * c1) ELSE 1.0 END::DOUBLE AS w1
   FROM (VALUES (0, 'gini', false), (1, 'gini', true), (2, 'entropy', false), (3, 'entropy', true)) t(tree, criterion, balanced), sizes),
 level0 AS (SELECT tree, 1 AS node, contact_id, label FROM trees, labelled),
 {_level('level0', 'best0')},
 level1 AS (SELECT s.tree, CASE WHEN v.value <= b.threshold THEN 2 ELSE 3 END AS node, s.contact_id, s.label
   FROM level0 s JOIN best0 b ON s.tree = b.tree AND s.node = b.node JOIN long_rows v ON v.contact_id = s.contact_id AND v.f = b.f),
 {_level('level1', 'best1')},
 level2 AS (SELECT s.tree, s.node * 2 + CASE WHEN v.value <= b.threshold THEN 0 ELSE 1 END AS node, s.contact_id, s.label
   FROM level1 s JOIN best1 b ON s.tree = b.tree AND s.node = b.node JOIN long_rows v ON v.contact_id = s.contact_id AND v.f = b.f),
 every AS (SELECT tree, node, label FROM level0 UNION ALL SELECT tree, node, label FROM level1 UNION ALL SELECT tree, node, label FROM level2),
 names AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_FEATURES))}) t(f, feature)),
 best AS (SELECT tree, node, f, threshold FROM best0 UNION ALL SELECT tree, node, f, threshold FROM best1),
 counts AS (SELECT tree, node, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM every GROUP BY tree, node)
SELECT c.tree, CAST(c.node AS BIGINT) AS node, n0, n1, feature, threshold, round(n1 * w1 / (n0 * w0 + n1 * w1), 9) AS p1
FROM counts c JOIN trees t ON c.tree = t.tree LEFT JOIN best b ON c.tree = b.tree AND c.node = b.node LEFT JOIN names USING (f)"""
TREE = re.sub(r"/\*.*?\*/", "", _TREE)


def _tree_with_missing() -> str:
    """The same trees where each numeric feature lacks every seventh value: a missing one goes right,
    and one more threshold parts it from all others."""
    holes = re.sub(r"/\*value (\d)\*/(.*?)/\*end\*/", r"CASE WHEN contact_id % 7 <> \1 THEN \2 END", _TREE)
    holes = holes.replace("/*cuts*/", " UNION ALL SELECT DISTINCT f, CAST('infinity' AS DOUBLE) FROM long_rows WHERE value IS NULL")
    return f"SELECT tree, node, n0, n1, feature, CASE WHEN threshold = CAST('infinity' AS DOUBLE) THEN 1e300 ELSE threshold END AS threshold, p1 FROM ({holes})"



def _joined_points(points: str, expr: str, order: str) -> str:
    return f"string_agg(printf('%.4f', {expr}), ',' ORDER BY {order}) AS {points}"


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    with_scored = f"WITH {SCORED}"
    with_contacts = f"WITH {CONTACTS}"
    s["classification_report"] = f"""{with_scored}, m AS ({matrix('scored')}), {REPORT}
SELECT class, round(pr, 9) AS "precision", round(re, 9) AS recall, round(f, 9) AS f1, CAST(s AS BIGINT) AS support, round({ACC}, 9) AS accuracy FROM entries, m"""
    s["confusion_matrix"] = f"{with_scored} {matrix('scored')}"
    s["scalar_metrics"] = f"{with_scored}, m AS ({matrix('scored')}) SELECT tn, fp, fn, tp, {SCALARS} FROM m"
    s["scalar_metrics_by_job"] = f"{with_scored}, m AS ({matrix('scored', 'job')}) SELECT job, tn, fp, fn, tp, {SCALARS} FROM m"
    counts = "CAST(max(ps) AS BIGINT) AS positives, CAST(max(ns) AS BIGINT) AS negatives"
    s["auc"] = f"{with_scored}, {curve('scored')} SELECT round({AREA}, 9) AS auc_roc, {counts} FROM cum"
    s["auc_by_job"] = f"{with_scored}, {curve('scored', 'job')} SELECT g AS job, round({AREA}, 9) AS auc_roc, {counts} FROM cum GROUP BY g"
    s["auc_continuous"] = f"WITH {SMOOTH}, {curve('smooth')} SELECT round({AREA}, 9) AS auc_roc, {counts} FROM cum"
    s["auc_continuous_by_contact"] = f"WITH {SMOOTH}, {curve('smooth', 'contact')} SELECT g AS contact, round({AREA}, 9) AS auc_roc, {counts} FROM cum GROUP BY g"
    roc = f"SELECT round(threshold, 9) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM ({ROC})"
    pr = f'SELECT round(threshold, 9) AS threshold, round("precision", 9) AS "precision", round(recall, 9) AS recall FROM ({PR})'
    s["roc_points"] = f"{with_scored}, {curve('scored')} {roc}"
    s["pr_points"] = f"{with_scored}, {curve('scored')} {pr}"
    s["roc_points_continuous"] = f"WITH {SMOOTH}, {curve('smooth')} {roc}"
    s["pr_points_continuous"] = f"WITH {SMOOTH}, {curve('smooth')} {pr}"
    s["metrics_bundle"] = f"""{with_scored}, {curve('scored', 'contact')}, m AS ({matrix('scored', 'contact')}),
a AS (SELECT g, {AREA} AS auc FROM cum GROUP BY g),
r AS (SELECT g, {_joined_points('roc_fpr', 'fpr', 'k')}, {_joined_points('roc_tpr', 'tpr', 'k')} FROM ({ROC}) GROUP BY g),
p AS (SELECT g, {_joined_points('pr_precision', '"precision"', 'k DESC')}, {_joined_points('pr_recall', 'recall', 'k DESC')} FROM ({PR}) GROUP BY g)
SELECT contact, tn + fp + fn + tp AS n, 'decision-tree' AS model, '2024-01-01 00:00:00' AS timestamp, {SCALARS}, round(auc, 9) AS auc_roc, tn, fp, fn, tp,
 round(tn / CAST(tn + fn AS DOUBLE), 9) AS precision_0,
 round((2 * tn / CAST(2 * tn + fp + fn AS DOUBLE) + {F1}) / 2, 9) AS macro_f1, round({ACC}, 9) AS weighted_recall,
 roc_fpr, roc_tpr, pr_precision, pr_recall FROM m JOIN a ON contact = a.g JOIN r ON contact = r.g JOIN p ON contact = p.g"""
    s["metrics_without_scores"] = f"{with_scored}, m AS ({matrix('scored')}) SELECT {SCALARS}, CAST(0.0 AS DOUBLE) AS auc_roc, true AS no_roc, true AS no_pr FROM m"
    s["correct_count"] = f"{with_scored} SELECT count(*) FILTER (label = prediction) AS correct, count(*) AS n FROM scored"
    s["binomial_test"] = f"""{with_scored}, c AS (SELECT strftime(date_trunc('week', contact_ts), '%Y-%m-%d %H:%M:%S') AS week,
 count(*) FILTER (label = prediction) AS correct, count(*) AS n FROM scored GROUP BY 1) SELECT week, correct, n, {TESTED} FROM c"""

    names = ("contact_id", "contact_ts", *INPUTS, "deposit")
    s["table_shape"] = f"{with_contacts} SELECT count(*) AS row_count, CAST({len(names)} AS INT) AS column_count, '{','.join(names)}' AS columns FROM contacts"
    kinds = {"contact_id": "bigint", "contact_ts": "timestamp_ntz", "balance": "double", **{c: "int" for c in NUMERIC if c != "balance"}}
    s["column_info"] = f"{with_contacts} " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS position, '{c}' AS \"column\", '{kinds.get(c, 'string')}' AS type, count({q(c)}) AS non_null FROM contacts" for i, c in enumerate(names)
    )
    s["head5"] = f"{with_contacts} SELECT * EXCLUDE (contact_ts) FROM contacts ORDER BY contact_id LIMIT 5"
    s["describe"] = f"{with_contacts} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
 round(CAST(max({c}) AS DOUBLE), 6) AS max FROM contacts""" for c in NUMERIC
    )
    ends = "long AS (SELECT CASE WHEN duration > 1000 THEN CAST('infinity' AS DOUBLE) ELSE duration END AS value FROM contacts), both_ AS (SELECT CASE WHEN day < 10 THEN CAST('-infinity' AS DOUBLE) WHEN day > 20 THEN CAST('infinity' AS DOUBLE) ELSE day END AS value FROM contacts)"
    numbers = ", ".join(
        f"(SELECT CASE WHEN isinf(x) AND x > 0 THEN 1e300 WHEN isinf(x) THEN -1e300 ELSE round(x, 6) END FROM (SELECT {e} AS x)) AS {n}"
        for n, e in (("min", "v[1]"), ("p25", "{0.25}"), ("p50", "{0.5}"), ("p75", "{0.75}"), ("max", "v[len(v)]")))
    for share in (0.25, 0.5, 0.75):
        at = f"(len(v) - 1) * {share}"
        low, high = f"v[CAST(floor({at}) AS BIGINT) + 1]", f"v[CAST(ceil({at}) AS BIGINT) + 1]"
        numbers = numbers.replace("{" + str(share) + "}", f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END")
    s["describe_infinite"] = f"{with_contacts}, {ends} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, len(v) AS count, {numbers} FROM (SELECT list(value ORDER BY value) AS v FROM {t})" for f, t in (("long", "long"), ("both", "both_")))
    s["robust_fit_approximate"] = f"{with_contacts} " + " UNION ALL ".join(
        f"SELECT source, '{c}' AS feature, CAST(share AS DOUBLE) AS share, count({c}) AS n, true AS rank_within_bound, true AS bound_kept FROM contacts, (VALUES ('whole'), ('merged')) a(source), (VALUES (0.25), (0.5), (0.75)) b(share) GROUP BY source, share"
        for c in NUMERIC)
    s["class_distribution"] = f"{with_contacts} SELECT CAST(CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS INT) AS label, count(*) AS n FROM contacts GROUP BY 1"

    with_spoilt = f"{with_contacts}, {SPOILT}"
    s["validate_accept"] = f"{with_spoilt} SELECT contact_id, {columns(INPUTS)} FROM contacts WHERE {SOUND}"
    s["validate_quarantine"] = f"""{with_spoilt} SELECT c.contact_id, {RAW_VALUES['age'].replace('contact_id', 'c.contact_id')} AS age, {RAW_VALUES['job'].replace('contact_id', 'c.contact_id')} AS job, violations
FROM contacts c JOIN (SELECT contact_id, string_agg(concat(rule, ':', kind), ',' ORDER BY o) AS violations FROM spoilt GROUP BY 1) v ON c.contact_id = v.contact_id"""
    s["validate_violations"] = f"{with_spoilt} SELECT rule, kind, count(*) AS n FROM spoilt GROUP BY rule, kind"
    s["violation_details"] = f"{with_spoilt} SELECT contact_id, rule, kind FROM spoilt"
    s["validate_strict"] = f"""{with_spoilt} SELECT rule, kind, count(*) AS n FROM (SELECT rule, kind FROM spoilt
 UNION ALL SELECT 'month', 'domain' FROM contacts WHERE contact_id % 59 = 0) GROUP BY rule, kind"""
    s["coerce_types"] = f"""{with_contacts} SELECT contact_id, CASE WHEN contact_id % 97 = 0 THEN 200 WHEN contact_id % 89 = 0 THEN NULL ELSE age END AS age,
 CASE WHEN contact_id % 61 = 0 THEN NULL ELSE round(balance, 9) END AS balance, CASE WHEN contact_id % 79 = 0 THEN NULL ELSE campaign END AS campaign FROM contacts"""
    s["output_invariant"] = f"WITH {SMOOTH} SELECT count(*) FILTER (p BETWEEN 0 AND 1) AS valid, count(*) FILTER (NOT (p * 2 BETWEEN 0 AND 1)) AS doubled_invalid FROM smooth"

    s["split_target"] = f"{with_contacts} SELECT contact_id, {columns(INPUTS)} FROM contacts"
    s["label_map"] = f"""{with_contacts}, d AS (SELECT contact_id, CASE WHEN contact_id % 73 = 0 THEN 'maybe' ELSE deposit END AS deposit FROM contacts)
SELECT contact_id, deposit, CAST(CASE deposit WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS INT) AS label FROM d"""
    s["label_quality"] = f"{with_contacts} SELECT count(*) FILTER (contact_id % 73 <> 0) AS labelled, count(*) FILTER (contact_id % 73 = 0) AS unlabelled FROM contacts"
    s["keep_columns"] = f"{with_contacts} SELECT contact_id, {columns(NUMERIC)} FROM contacts"
    s["unknown_handler"] = f"{with_contacts} SELECT contact_id, age, " + ", ".join(f"{marked(c)} AS {c}" for c in ("job", "education", "contact", "poutcome")) + " FROM contacts"
    s["robust_fit"] = f"{with_contacts}, {SCALER} SELECT position, feature, round(center, 9) AS center, round(scale, 9) AS scale FROM scaler"
    s["encoder_roundtrip"] = s["robust_fit"]
    s["robust_transform"] = f"{with_contacts}, {SCALER}, {PARAMS} SELECT contact_id, " + ", ".join(f"round({scaled(c)}, 6) AS num__{c}" for c in NUMERIC) + " FROM contacts, params"
    s["onehot_fit"] = f'{with_contacts}, {VOCAB} SELECT feature, category, "position", "position" = 0 AS is_baseline FROM vocab'
    s["vocabulary_roundtrip"] = s["onehot_fit"]
    s["onehot_transform"] = f"{with_contacts} " + " UNION ALL ".join(
        f"SELECT 'cat__{c}_{v}' AS feature, count(*) FILTER ({marked(c)} = '{v}') AS rows_set FROM contacts" for c, v in INDICATORS
    )
    s["feature_names"] = f"""{with_contacts}, {VOCAB}, named AS ({' UNION ALL '.join(f"SELECT {i} AS a, 0 AS b, 'num__{c}' AS feature" for i, c in enumerate(NUMERIC))}
 UNION ALL SELECT 100 + list_position([{', '.join(f"'{c}'" for c in CATEGORICAL)}], feature), "position", concat('cat__', feature, '_', category) FROM vocab WHERE "position" > 0)
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INT) AS position, feature FROM named"""
    flags = [f"CAST(CASE WHEN {marked(c)} = '{v}' THEN 1 ELSE 0 END AS DOUBLE)" for c, v in INDICATORS]
    s["encode_features"] = f"{with_contacts}, {SCALER}, {PARAMS} SELECT contact_id, " + ", ".join(
        [f"round({scaled(c)}, 6) AS f{i}" for i, c in enumerate(NUMERIC)] + [f"{e} AS f{i + len(NUMERIC)}" for i, e in enumerate(flags)]
    ) + " FROM contacts, params"
    s["encode_sparse"] = f"{with_contacts}, {SCALER}, {PARAMS}, e AS (" + " UNION ALL ".join(
        [f"SELECT {i} AS position, contact_id, {scaled(c)} AS value FROM contacts, params" for i, c in enumerate(NUMERIC)]
        + [f"SELECT {i + len(NUMERIC)}, contact_id, {e} FROM contacts" for i, e in enumerate(flags)]
    ) + ") SELECT CAST(position AS INT) AS position, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(contact_id) AS BIGINT) AS key_sum FROM e WHERE value <> 0 GROUP BY position"
    s["unseen_categories"] = f"{with_contacts} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER ({q(c)} NOT IN (SELECT {q(c)} FROM contacts WHERE contact = 'cellular')) AS unseen FROM contacts" for c in CATEGORICAL
    )

    with_parts = f"{with_contacts}, {SPLIT}"
    s["stratified_split"] = f"{with_parts} SELECT contact_id, CAST(y AS INT) AS label, part FROM parts"
    s["stratified_folds"] = f"{with_parts} SELECT contact_id, CAST(y AS INT) AS label, CAST((rk - 1) % 10 AS INT) AS fold FROM ranked"
    s["class_weights"] = f"{with_parts} SELECT CAST(y AS INT) AS label, count(*) AS n, round((SELECT count(*) FROM contacts) / (2.0 * count(*)), 9) AS weight FROM ranked GROUP BY y"
    s["row_weights"] = f"{with_parts} SELECT contact_id, CAST(y AS INT) AS label, round((SELECT count(*) FROM contacts) / (2.0 * cn), 9) AS weight FROM ranked"

    everything = f"{with_contacts} SELECT contact_id, {columns(INPUTS)}, deposit FROM contacts"
    s["csv_scan"] = s["parquet_scan"] = s["json_scan"] = everything
    s["csv_scan_mixed_headers"] = everything.replace('"poutcome"', '''CASE WHEN contact_id % 3 <> 2 THEN poutcome END AS poutcome''')
    s["json_requests"] = f"{with_contacts} SELECT contact_id, {raw_columns()} FROM contacts"
    s["source_contract"] = f"{with_contacts} SELECT count(*) AS n, 'refused' AS missing_target, 'refused' AS missing_path FROM contacts"
    with_predictions = f"WITH {PREDICTIONS}"
    s["prediction_history"] = f"{with_predictions} SELECT {PREDICTION_COLUMNS}, job, balance FROM predictions"
    s["prediction_documents"] = f"{with_predictions} SELECT contact_id, job, balance, CAST(0.0 AS DOUBLE) AS missing FROM predictions"
    s["latest_predictions"] = f"{with_predictions} SELECT {PREDICTION_COLUMNS} FROM predictions ORDER BY contact_ts DESC, contact_id DESC LIMIT 100"
    s["last10_predictions"] = f"{with_predictions} SELECT contact_id, prediction, probability_text, class_name, created FROM predictions ORDER BY contact_ts DESC, contact_id DESC LIMIT 10"
    for name in ("latest_predictions", "last10_predictions"):
        s[f"{name}_stored"] = s[name]
    s["high_probability_stored"] = f"{with_predictions} SELECT {PREDICTION_COLUMNS} FROM predictions WHERE CAST(probability_text AS DOUBLE) > 0.8"
    s["quarantine_history"] = s["validate_quarantine"]
    s["predictions_by_class"] = f"{with_predictions} SELECT class_name, count(*) AS n FROM predictions GROUP BY class_name"
    s["high_probability"] = f"{with_predictions} SELECT {PREDICTION_COLUMNS} FROM predictions WHERE CAST(probability_text AS DOUBLE) > 0.8"

    with_runs = f"WITH {RUNS}"
    view = f"SELECT created, model_name, {ROUNDED_METRICS} FROM runs"
    s["append_metrics"] = f"{with_runs} {view}"
    s["metrics_top100"] = f"{with_runs} {view} ORDER BY created_at DESC LIMIT 100"
    s["latest_metrics"] = f"{with_runs} {view} ORDER BY created_at DESC LIMIT 1"
    s["latest_metrics_per_model"] = f"""{with_scored}, last AS (SELECT contact AS c, max(date_trunc('week', contact_ts)) AS week FROM scored GROUP BY contact),
recent AS (SELECT s.*, week FROM scored s JOIN last ON contact = c AND date_trunc('week', contact_ts) = week), {curve('recent', 'contact')},
m AS ({matrix('recent', 'contact, week')}), a AS (SELECT g, {AREA} AS auc FROM cum GROUP BY g)
SELECT contact, strftime(week, '%Y-%m-%d %H:%M:%S') AS created, {SCALARS}, round(auc, 9) AS auc_roc FROM m JOIN a ON contact = g"""
    s["metric_cards"] = f"{with_runs} SELECT created, {ROUNDED_METRICS} FROM {NEWEST}"
    labels = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1_score": "F1 Score", "auc_roc": "Auc Roc"}
    s["metric_series"] = f"{with_runs}, newest AS (SELECT * FROM runs ORDER BY created_at DESC LIMIT 100) " + " UNION ALL ".join(
        f"SELECT created, '{labels[m]}' AS metric, round({q(m)}, 9) AS value FROM newest" for m in METRICS
    )
    s["confusion_cells"] = f"{with_runs}, newest AS (SELECT * FROM {NEWEST}) " + " UNION ALL ".join(
        f"SELECT 'Actual: {a}' AS actual, 'Predicted: {b}' AS predicted, {c} AS n FROM newest"
        for a, b, c in (("No", "No", "tn"), ("No", "Yes", "fp"), ("Yes", "No", "fn"), ("Yes", "Yes", "tp"))
    )
    last_curve = f"{with_runs}, lastcum AS (SELECT * FROM cum WHERE g = (SELECT max(created_at) FROM runs))"
    s["roc_long"] = f"""{last_curve}, pts AS ({ROC.replace('FROM cum', 'FROM lastcum')}), diagonal AS (SELECT * FROM (VALUES (0, 0.0), (1, 1.0)) t(point_no, v))
SELECT 'ROC Curve' AS series, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS point_no, round(fpr, 9) AS x, round(tpr, 9) AS y FROM pts
UNION ALL SELECT 'Random', CAST(point_no AS INT), CAST(v AS DOUBLE), CAST(v AS DOUBLE) FROM diagonal WHERE EXISTS (SELECT 1 FROM pts)"""
    s["pr_long"] = f"""{last_curve}, pts AS ({PR.replace('FROM cum', 'FROM lastcum')})
SELECT 'PR Curve' AS series, CAST(row_number() OVER (ORDER BY k DESC) - 1 AS INT) AS point_no, round(recall, 9) AS x, round("precision", 9) AS y FROM pts"""
    s["metrics_table"] = f"{with_runs} SELECT created, " + ", ".join(f"printf('%.4f', {q(m)}) AS {q(m)}" for m in METRICS) + " FROM runs ORDER BY created_at DESC LIMIT 100"
    s["stream_refresh"] = s["metrics_table"]
    four = ["printf('%.4f', {})".format(q(m)) for m in METRICS]
    lines = {
        "metric_cards": ["created", *four], "metric_series": ["created", "metric", "printf('%.4f', value)"], "confusion_cells": ["actual", "predicted", "CAST(n AS VARCHAR)"],
        "roc_long": ["series", "CAST(point_no AS VARCHAR)", "printf('%.4f', x)", "printf('%.4f', y)"],
        "pr_long": ["series", "CAST(point_no AS VARCHAR)", "printf('%.4f', x)", "printf('%.4f', y)"], "metrics_table": ["created", *map(q, METRICS)],
    }
    s["stream_refresh_all"] = " UNION ALL ".join(f"SELECT '{n}' AS name, concat_ws('|', {', '.join(e)}) AS line FROM ({s[n]})" for n, e in lines.items())
    s["roc_long_continuous"] = f"""WITH pts AS ({s['roc_points_continuous']}) SELECT 'ROC Curve' AS series, threshold, fpr AS x, tpr AS y FROM pts
 UNION ALL SELECT 'Random', NULL, v, v FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(v)"""
    s["pr_long_continuous"] = f"WITH pts AS ({s['pr_points_continuous']}) SELECT 'PR Curve' AS series, threshold, recall AS x, precision AS y FROM pts"
    s["run_significance"] = f"{with_runs}, c AS (SELECT created, tn + tp AS correct, tn + fp + fn + tp AS n FROM runs) SELECT created, correct, n, {TESTED} FROM c"
    s["score_text"] = f"""{with_scored} SELECT contact_id, CASE WHEN prediction = 1 THEN 'SÍ' ELSE 'NO' END AS answer, printf('%.4f', p) AS probability_text,
 concat(printf('%.2f', p * 100), '%') AS percent_text FROM scored"""
    s["text_functions"] = f"""{with_contacts} SELECT contact_id, printf('%.4f', duration / 5e3) AS four, printf('%.2f', duration / 5e3 * 100) AS percent,
 strftime(contact_ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(contact_ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(contact_ts, '%Y-%m-%d %H:%M:%S') AS parsed,
 CASE WHEN day > 15 THEN duration + CAST(0.5 AS DOUBLE) END AS number,
 concat(upper(contact[1]), contact[2:], ' ', upper(month[1]), month[2:]) AS title FROM contacts"""

    with_fixed = f"{with_contacts}, {SCALER}, {PARAMS}, {FIXED}"
    s["score_fixed_tree"] = f"{with_fixed} SELECT contact_id, p, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS INT) AS prediction FROM fixed"
    s["score_fixed_tree_walk"] = s["score_fixed_tree"]
    s["tree_roundtrip"] = f"{with_fixed} SELECT contact, p, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS INT) AS prediction, count(*) AS n FROM fixed GROUP BY ALL"
    s["truncated_tree_scores"] = f"""{with_contacts}, {SCALER}, {PARAMS} SELECT contact_id,
 CASE WHEN {scaled('duration')} <= 0 THEN CASE WHEN poutcome <> 'success' THEN CAST(0.1 AS DOUBLE) ELSE 0.54 END ELSE CASE WHEN contact <> 'telephone' THEN 0.85 ELSE 0.4 END END AS p_depth,
 CASE WHEN {scaled('duration')} <= 0 THEN CASE WHEN poutcome <> 'success' THEN CAST(0.1 AS DOUBLE) ELSE 0.54 END ELSE CASE WHEN contact <> 'telephone' THEN 0.85 ELSE 0.4 END END AS p_size
FROM contacts, params"""
    s["scoring_job"] = FIXED_HISTORY
    s["stream_scoring"] = FIXED_HISTORY
    s["mixed_history"] = f"WITH one AS ({FIXED_HISTORY}) SELECT contact_id, prediction, probability_text, class_name, 3 * count(*) AS n FROM one GROUP BY ALL"
    s["evaluation_job"] = f"""{with_parts}, {SCALER}, {PARAMS}, held AS (SELECT y AS label, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM (SELECT y, {FIXED_P} AS p FROM parts, params WHERE part = 'test')),
{curve('held')}, m AS ({matrix('held')}), a AS (SELECT {AREA} AS auc FROM cum)
SELECT tn + fp + fn + tp AS n, {SCALARS}, round(auc, 9) AS auc_roc, '2024-01-01 00:00:00' AS timestamp FROM m, a"""
    held = f"{with_parts}, {SCALER}, {PARAMS}, held AS (SELECT y AS label, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM (SELECT y, {FIXED_P} AS p FROM parts, params WHERE part = 'test')), {curve('held')}"
    s["roc_long_stored"] = f"""{held}, pts AS ({ROC}) SELECT 'ROC Curve' AS series, round(threshold, 9) AS threshold, round(fpr, 9) AS x, round(tpr, 9) AS y FROM pts
 UNION ALL SELECT 'Random', NULL, v, v FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) t(v)"""
    s["pr_long_stored"] = f"""{held}, pts AS ({PR}) SELECT 'PR Curve' AS series, round(threshold, 9) AS threshold, round(recall, 9) AS x, round("precision", 9) AS y FROM pts"""
    s["tree_first_splits"] = TREE
    s["tree_with_missing"] = _tree_with_missing()
    flags = {f"cat__{c}_{v}": f"{marked(c)} = '{v}'" for c, v in INDICATORS}
    train = f"{with_parts}, {SCALER}, {PARAMS}, train AS (SELECT parts.*, params.*, y AS label FROM parts, params WHERE part = 'train')"
    encoded = {f"num__{c}": scaled(c) for c in NUMERIC}
    for criterion in ("gini", "entropy"):
        s[f"tree_{criterion}"] = f"{train}, {tree_sql.grown('train', encoded, flags, [(criterion, False, 1)], 5)}\nSELECT {tree_sql.NODE_COLUMNS} FROM nodes"
    leaves = (1, 2, 4, 8)
    s["tree_size_limits"] = f"{train}, {tree_sql.grown('train', encoded, flags, [('gini', False, m) for m in leaves], 8)}\n{tree_sql.cut_counts(leaves, (3, 5, 8), (2, 20))}"
    four = [(c, b, 5) for c in ("gini", "entropy") for b in (False, True)]
    labelled = f"{with_contacts}, labelled AS (SELECT *, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS label FROM contacts)"
    s["tree_all_midpoints"] = f"{labelled}, {tree_sql.grown('labelled', {c: c for c in NUMERIC}, flags, four, 4)}\nSELECT {tree_sql.SPLIT_COLUMNS} FROM nodes"
    odd = {
        "balance": "CASE WHEN contact_id % 7 <> 0 THEN balance END", "constant": "CASE WHEN duration % 5 <> 0 THEN 1.0 END",
        "duration": "CASE WHEN duration > 3000 THEN CAST('infinity' AS DOUBLE) WHEN duration < 300 THEN CAST('-infinity' AS DOUBLE) ELSE duration END",
        "sign": "CASE WHEN day > 20 THEN CAST('infinity' AS DOUBLE) ELSE CAST('-infinity' AS DOUBLE) END",
    }
    s["tree_odd_numbers"] = f"{labelled}, {tree_sql.grown('labelled', odd, {}, four, 4)}\nSELECT {tree_sql.SPLIT_COLUMNS} FROM nodes"
    many = tree_sql.grown(
        "labelled", {"num__age": f"({scaled('age')})", "num__duration": f"({scaled('duration')})"}, {}, [("gini", False, 1), ("entropy", True, 3)], 4,
        {"branch": "concat('b', CAST(contact_id % 20011 AS VARCHAR))", "job": marked("job")})
    with_params = f"{with_contacts}, {SCALER}, {PARAMS}, labelled AS (SELECT *, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS label FROM contacts, params)"
    s["encode_many_categories"] = f"{with_params}, {many}\nSELECT {tree_sql.SPLIT_COLUMNS} FROM nodes"
    s["score_many_categories"] = f"{with_params}, {many}\nSELECT {tree_sql.LEAF_COUNTS} FROM nodes WHERE tree = 1 AND feature IS NULL GROUP BY 1"
    s["grid_rank"] = f"""WITH {JOB_FOLDS} SELECT candidate, round(mt, 9) AS mean_test_score, round(st, 9) AS std_test_score, round(mr, 9) AS mean_train_score, round(sr, 9) AS std_train_score,
 rk AS rank_test_score FROM ranks"""
    s["grid_best"] = f"WITH {JOB_FOLDS} SELECT candidate, round(mt, 9) AS mean_test_score, rk AS rank_test_score FROM ranks ORDER BY rk, candidate LIMIT 1"
    return s
