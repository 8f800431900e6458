import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph, term_match

NODE = "pos int, id string, kind string, title string, type string, path string, summary string, tags array<string>, aliases array<string>, status string"


@pytest.mark.parametrize("most", [1 << 16, 7])
def test_batch_equals_one_plan_a_list(spark, monkeypatch, most):
    monkeypatch.setattr(term_match, "MOST_TERMS", most)
    rng = random.Random(8)
    words = ["ab", "abc", "b c", "ÉTÉ", "été", "😀x", "ß", "zz", "a\0b", "ﬀ", "pump"]
    text = lambda n: rng.choice([None, "", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, n))) for _ in range(6)]])
    nodes = [(k, f"n{k}", "Concept" if k % 7 else "Tag", text(2), text(1), text(3), text(5), [t for t in (text(1), text(2)) if t is not None], [t for t in (text(1), text(2)) if t is not None], "stable") for k in range(60)]
    df = spark.createDataFrame(nodes, NODE).repartition(3)
    lists = [("q0", ["ab", "zz"]), ("q1", [" Été ", "été", "😀X"]), ("q2", ["a\0b", "b c ab"]), ("q3", ["nothing"]), ("q4", ["ff", "pump", "ab", "abc"])]
    got = term_match.resolve_batch(df, spark.createDataFrame(lists, "question_id string, terms array<string>")).collect()
    for q, terms in lists:
        want = graph.resolve_rows(df, terms).select("id", "pos", "title", "score", "n_matched", "matched_terms", "matched_fields").collect()
        assert sorted(map(repr, (tuple(r)[1:] for r in got if r["question_id"] == q))) == sorted(repr(tuple(r)) for r in want)
    best = term_match.best_matches(term_match.resolve_batch(df, spark.createDataFrame(lists, "question_id string, terms array<string>")), 3)
    assert [r["id"] for r in best.filter("question_id = 'q0'").orderBy("rank").collect()] == [r["id"] for r in graph.resolve(df, ["ab", "zz"], limit=3).collect()]


def test_bounds_and_empty(spark):
    df = spark.createDataFrame([], NODE)
    asked = lambda rows: spark.createDataFrame(rows, "question_id string, terms array<string>")
    assert term_match.resolve_batch(df, asked([])).collect() == [] and term_match.resolve_batch(df, asked([("q", ["ab"])])).collect() == []
    for bad in (None, [], ["x"], ["ok", None], ["y" * 201], ["ok"] * 21):
        with pytest.raises(ValueError):
            term_match.resolve_batch(df, asked([("q", bad)]))
