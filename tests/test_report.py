from pyspark.sql import functions as F

from lattica.plans import report


def test_texts_of_odd_numbers(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, float("inf")), (3, -0.004), (4, 1.0005), (5, 0.005)], "k int, x double")
    got = [tuple(r) for r in df.orderBy("k").select(report.decimal("x"), report.percent(F.when(F.abs("x") < 9, F.col("x"))), report.points(F.when(F.abs("x") < 9, F.col("x")))).collect()]
    assert got == [("0.000", "0%", "±0 pp"), ("0.000", "0%", "±0 pp"), ("0.000", "0%", "±0 pp"), ("-0.004", "0%", "±0 pp"), ("1.000", "100%", "+100 pp"), ("0.005", "1%", "+1 pp")]


def test_both_arms_side_by_side(spark):
    cases = spark.createDataFrame([("q", "lexical", 0.25, 0.5, None), ("q", "graph", 1.0, 0.4, 1.0), ("r", "graph", 1.0, 1.0, 1.0)], "question_id string, arm string, recall double, precision double, path_recall double")
    asked = spark.createDataFrame([("q", "what", ["a"]), ("r", "who", []), ("s", "no case", None)], "id string, query string, terms array<string>")
    got = {r["id"]: r for r in report.report_cases(cases, asked).collect()}
    assert got["q"]["baseline"]["recall"] == 0.25 and got["q"]["qam"]["precision"] == 0.4
    assert got["q"]["comparison"].asDict() == {"recall_delta": 0.75, "precision_delta": -0.1, "path_recall_delta": None, "recall_points": "+75 pp", "precision_points": "-10 pp"}
    assert got["r"]["baseline"] is None and got["r"]["comparison"]["recall_delta"] is None and got["s"]["qam"] is None
    means = spark.createDataFrame([("graph", 0.625, 1.0, None)], "arm string, mean_recall double, mean_precision double, mean_path_recall double")
    assert tuple(report.summary_texts(means).first()) == ("graph", "63%", "100%", "0.000")
