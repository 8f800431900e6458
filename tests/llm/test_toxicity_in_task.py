import random

import numpy as np

from lattica.llm import toxicity


def test_training_runs_in_a_task_and_gives_the_same_network(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(d, " ".join(rng.choice(["plain", "words", "of", "some", "text", *(["xoxyz"] if d % 3 == 0 else [])]) for _ in range(rng.randint(5, 60)))) for d in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in docs], "doc_id long, toxic int")
    rows = toxicity.sample(frame, labels)
    want = toxicity.fit([t for _, t in docs], [int(d % 3 == 0) for d, _ in docs])
    monkeypatch.setattr(toxicity, "logits", None)  # the driver's own is not called
    got = toxicity.learned(rows)
    assert rows.columns == ["doc_id", "toxic", "text"] and (got.slope, got.shift, got.empty) == (want.slope, want.shift, want.empty)
    assert got.weights.keys() == want.weights.keys() and all(np.array_equal(got.weights[k], want.weights[k]) for k in want.weights)


def test_no_labels_give_a_network_of_no_opinion(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.learned(toxicity.sample(frame, spark.createDataFrame([], "doc_id long, toxic int")))
    assert model.empty == 0.0 and toxicity.score(frame, model).first().score < 0.7
