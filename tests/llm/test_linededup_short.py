import random
import re

import pytest

import corpus_pipeline
from lattica.llm import linededup, queries


def line_set(line):
    return {x for x in re.split(r"[\x20\x09-\x0d]+", line.lower()) if x}


def brute(docs, percent=80):
    lines = sorted((d, n, line_set(x)) for d, t in docs for n, x in enumerate(t.split("\n")))
    gone = {(d, n) for i, (d, n, s) in enumerate(lines) if s and any(100 * len(s & x) >= percent * len(s | x) for _, _, x in lines[:i])}
    return sorted((d, "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone), sum(g[0] == d for g in gone)) for d, t in docs)


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(d, "\n".join(" ".join(rng.choice("abAB") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9]))) for _ in range(rng.randint(1, 6)))) for d in range(60)]
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(docs)


def test_query_and_pipeline_remove_short_copies(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Read more\n\nx y", 12), (2, "read  MORE\n\nits own line", 22), (3, "x y", 3)], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(1, "Read more\n\nx y", 0), (2, "\nits own line", 1), (3, "", 1)]
    assert sorted(tuple(r) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()) == [(1, "Read more\n\nx y", 12), (2, "\nits own line", 13)]


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LONG", 20)
    monkeypatch.setattr(linededup, "LEADS", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(60)] = f"new{rng.randrange(2000)}"
        docs.append((d, " ".join(w)))
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(docs)


@pytest.mark.production
def test_no_exact_repeat_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = linededup.dedup(docs).collect()
    sets = [tuple(sorted(line_set(x))) for r in out for x in (r.text or "").split("\n")]
    sets = [x for x in sets if x]
    assert len(sets) == len(set(sets))
