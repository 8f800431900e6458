import random

from pyspark.sql import functions as F

from lattica.llm import linededup, queries


def test_equal_lines_of_null_ids_are_kept_once(spark, tmp_path):
    line = "one two three four five six"
    docs = spark.createDataFrame([(None, f"{line}\n{k}") for k in "abc"], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(r.n_removed for r in got) == [0, 1, 1]


def test_repeated_ids_equal_brute_force(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(40)]
    docs = []
    for n in range(40):
        lines = []
        for _ in range(rng.randint(1, 3)):
            w = list(base)
            w[rng.choice([0, 39])] = rng.choice("abcd")
            lines.append(" ".join(w) if rng.random() < 0.7 else " ".join(rng.choice("xyz") for _ in range(6)))
        docs.append((rng.choice([None, 1, 2]), "\n".join(lines) + f"\nown {n}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    sets = lambda x: set(x.split())
    lines = sorted((2**63 - 1 if d is None else d, n, hashes[t], sets(x)) for d, t in docs for n, x in enumerate(t.split("\n")))
    gone = {(h, n) for i, (_, n, h, s) in enumerate(lines) if any(100 * len(s & x) >= 80 * len(s | x) for *_, x in lines[:i])}
    want = sorted((t, "\n".join(x for n, x in enumerate(t.split("\n")) if (hashes[t], n) not in gone)) for _, t in docs)
    keyed = frame.withColumn("was", F.col("text"))
    assert sorted((r.was, r.text) for r in linededup.dedup(keyed).collect()) == want
