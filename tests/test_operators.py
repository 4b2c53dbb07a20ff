import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.functions import text
from canvass.functions.binomial import upper_tail
from canvass.functions.ordered import exact_quantiles, order_digits, running_totals
from canvass.operators import encoding, evaluation, projection, significance, splitting, validation
from canvass.sources import tables
from canvass.spec import CAMPAIGN


@pytest.fixture(scope="module")
def ten(spark):
    # The inputs of a known example.
    y = [0, 1, 1, 0, 1, 0, 1, 1, 0, 0]
    hat = [0, 1, 1, 0, 1, 0, 1, 0, 0, 0]
    p = [0.1, 0.9, 0.8, 0.2, 0.7, 0.3, 0.9, 0.4, 0.2, 0.1]
    return spark.createDataFrame(list(zip(y, hat, p)), "label int, prediction int, p double")


def test_bundle_of_ten_rows(ten):
    row = evaluation.metrics_bundle(ten, curves="arrays").first()
    m = row["metrics"]
    assert m["confusion_matrix"] == [[5, 0], [1, 4]]
    assert [m["accuracy"], m["precision"], m["recall"], m["auc_roc"]] == [0.9, 1.0, 0.8, 1.0]
    assert m["f1_score"] == pytest.approx(8 / 9)
    assert list(zip(m["roc_curve"]["fpr"], m["roc_curve"]["tpr"])) == [(0, 0), (0, 0.4), (0, 1), (0.2, 1), (1, 1)]
    pr = list(zip(m["precision_recall_curve"]["precision"], m["precision_recall_curve"]["recall"]))
    assert pr == [(0.5, 1), (0.625, 1), (5 / 6, 1), (1, 1), (1, 0.8), (1, 0.6), (1, 0.4), (1, 0)]
    assert m["classification_report"]["0"]["f1"] == pytest.approx(10 / 11)
    assert row["curve_points"] == 7


def test_curves_as_rows_are_complete(ten):
    row = evaluation.metrics_bundle(ten).first()
    assert row["metrics"]["roc_curve"] is None and row["curve_points"] == 7
    assert row["metrics"]["auc_roc"] == 1.0
    counts = {r["curve"]: r["count"] for r in evaluation.curve_rows(ten).groupBy("curve").count().collect()}
    assert counts == {"roc": 5, "pr": 8}


def test_infinite_and_missing_scores(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [(1, 1, inf), (1, 1, 0.6), (0, 0, 0.6), (0, 0, 0.1), (0, 0, -inf), (1, 0, float("nan")), (1, 0, None)],
        "label int, prediction int, p double")
    expected = (1 + 1 + 1 + 0.5 + 1 + 1) / 6
    for few in (True, False):
        assert evaluation.roc_auc(df, few_scores=few).first()["auc_roc"] == pytest.approx(expected)
        assert evaluation.roc_points(df, few_scores=few).count() == evaluation.roc_points(df, few_scores=not few).count()


@pytest.mark.parametrize("n", [10**6, 4 * 10**6 + 2, 10**10, 10**12, 10**14])
def test_binomial_tail_of_many_trials(n):
    """Against the normal tail with the continuity and skewness-free corrections of p = 1/2."""
    import math
    sd = math.sqrt(n) / 2
    for z in (0.5, 1.0, 3.0):
        k = int(n / 2 + z * sd)
        u = (k - 0.5 - n / 2) / sd
        density = math.exp(-u * u / 2) / math.sqrt(2 * math.pi)
        # Edgeworth term of fourth order: kurtosis -2 / n, and the lattice term 1 / (24 sd^2).
        expected = 0.5 * math.erfc(u / math.sqrt(2)) + density * (-2 / n / 24 * (u**3 - 3 * u) - u / (24 * sd * sd))
        assert upper_tail(np.array([k]), np.array([n]), 0.5)[0] == pytest.approx(expected, rel=1e-9)


def test_report_from_matrix(spark):
    matrix = spark.createDataFrame([(1500, 200, 150, 800)], "tn bigint, fp bigint, fn bigint, tp bigint")
    got = {r["class"]: (round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4), r["support"])
           for r in evaluation.classification_report(matrix).collect()}
    assert got["0"] == (0.9091, 0.8824, 0.8955, 1700)
    assert got["1"] == (0.8, 0.8421, 0.8205, 950)


@pytest.mark.parametrize("rows", [[(1, 1, 0.7), (1, 0, 0.2)], []])
def test_one_class_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "label int, prediction int, p double")
    m = evaluation.metrics_bundle(df).first()["metrics"]
    assert m["auc_roc"] == 0.0 and m["roc_curve"] is None
    assert len(m["confusion_matrix"]) == 2


def test_binomial_tail():
    for k, n in [(9, 10), (0, 10), (10, 10), (5, 10), (60, 100), (40, 100)]:
        exact = float(sum(Fraction(math.comb(n, i), 2**n) for i in range(k, n + 1)))
        assert upper_tail(np.array([k]), np.array([n]), 0.5)[0] == pytest.approx(exact, rel=1e-11)


def test_significance_decision(ten):
    row = significance.binomial_test(ten).first()
    assert row["p_value"] == pytest.approx(11 / 1024) and row["reject_h0"]


def test_running_totals_equal_the_plain_window(spark):
    rng = random.Random(7)
    special = [0.0, 5e-324, 1.7976931348623157e308, -1.0, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)]
    values = sorted({*special, *(rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500))})
    df = spark.createDataFrame([(g, v, i % 5) for i, v in enumerate(values) for g in ("a", None)], "g string, v double, n bigint")
    digits = df.where("g = 'a'").select("v", *[d.alias(c) for d, c in zip(order_digits(F.col("v")), "xyz")]).collect()
    assert [r["v"] for r in sorted(digits, key=lambda r: (r["x"], r["y"], r["z"]))] == values
    for down in (False, True):
        a, b = (
            sorted(running_totals(df, ["g"], "v", ["n"], down, few).collect(), key=lambda r: (str(r["g"]), r["v"]))
            for few in (False, True)
        )
        assert a == b


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=301), rng.integers(0, 4, 301).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    got = {(r["feature"], r["share"]): r["quantile"] for r in exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75]).collect()}
    for name, values in (("x", x), ("y", y)):
        for s in (0.25, 0.5, 0.75):
            assert got[name, s] == pytest.approx(np.quantile(values, s))


def test_encoding_of_three_rows(three_rows):
    model = encoding.fit_encoder(three_rows)
    assert len(model.feature_names) == 22
    assert model.feature_names[7:9] == ["cat__job_management", "cat__job_technician"]
    assert "cat__contact_unknown_contact" in model.feature_names and "cat__job_admin." not in model.feature_names
    rows = model.transform(three_rows, keep=["contact_id"]).orderBy("contact_id").collect()
    assert [round(r["num__day"], 6) for r in rows] == [-0.965517, 0, 1.034483]
    assert [r["cat__poutcome_unknown_poutcome"] for r in rows] == [1, 0, 0]
    sparse = {r["contact_id"]: r["features"] for r in model.transform_sparse(three_rows, ["contact_id"]).collect()}
    for r in rows:
        dense = {i: v for i, v in enumerate(r[1:]) if v}
        assert sparse[r["contact_id"]] == dense


def test_edge_columns(spark, three_rows):
    odd = three_rows.withColumns({"age": F.lit(5), "balance": F.lit(None).cast("double")})
    model = encoding.fit_encoder(odd)
    row = model.transform(odd).first()
    assert row["num__age"] == 0.0 and row["num__balance"] is None
    new = three_rows.withColumn("job", F.lit("pilot"))
    first = encoding.fit_encoder(three_rows).transform(new).first()
    assert first["cat__job_management"] == 0.0 and first["cat__job_technician"] == 0.0
    unseen = {r["feature"]: r["unseen"] for r in encoding.fit_encoder(three_rows).unseen_categories(new).collect()}
    assert unseen["job"] == 3 and unseen["month"] == 0


def test_unknown_handler(spark):
    df = spark.createDataFrame([("a", "x", 1), ("unknown", "y", 2), ("b", "unknown", 3)], "col1 string, col2 string, col3 int")
    got = projection.mark_unknown(df).collect()
    assert [tuple(r) for r in got] == [("a", "x", 1), ("unknown_col1", "y", 2), ("b", "unknown_col2", 3)]


def test_validation_of_a_request(spark, three_rows):
    request = three_rows.where("contact_id = 1").drop("deposit")
    assert validation.accepted(validation.check(request)).count() == 1
    old = validation.check(request.withColumn("age", F.lit(200)))
    assert [(r["rule"], r["kind"]) for r in validation.violation_rows(old, "contact_id").collect()] == [("age", "range")]
    assert validation.accepted(old).count() == 0 and validation.quarantined(old).count() == 1


def test_labels_outside_the_pair(spark, three_rows):
    odd = three_rows.withColumn("deposit", F.when(F.col("contact_id") == 1, "maybe").otherwise(F.col("deposit")))
    assert projection.labelled(odd).count() == 2
    with pytest.raises(Exception):
        projection.labelled(odd, strict=True).collect()
    with pytest.raises(ValueError):
        tables.require_target(["age"])


def test_split_is_a_function_of_key_label_and_seed(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    a = splitting.stratified_split(df, "id").collect()
    b = splitting.stratified_split(df.repartition(7), "id").collect()
    assert sorted(a) == sorted(b) and len(a) == 3000
    assert sum(r["part"] == "test" and r["label"] == 1 for r in a) == 200
    assert sum(r["part"] == "test" and r["label"] == 0 for r in a) == 400
    folds = splitting.stratified_folds(df, "id", folds=7).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 7


def test_text(spark):
    rows = spark.createDataFrame([(0.03125,), (0.12345,), (1.0,)], "x double")
    assert [r[0] for r in rows.select(text.fixed4(F.col("x"))).collect()] == ["0.0312", "0.1235", "1.0000"]
    assert rows.select(text.to_number(F.lit("12d"))).first()[0] is None
    assert CAMPAIGN.inputs[0] == "age"


def test_prediction_history_has_its_schema(spark):
    from canvass.sources.history import prediction_records
    from canvass.spec import prediction_history_schema

    scored = tables.scorecard(tables.contacts(spark, "/root/testdata/sf0.001"))
    schema = prediction_records(scored, created_at="contact_ts").schema
    want = prediction_history_schema(key_type=schema[CAMPAIGN.key].dataType)
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [(f.name, f.dataType.simpleString()) for f in want]
