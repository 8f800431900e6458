import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import queries, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, items):
    made = [(d, *features(t)) for d, t in docs]
    raw, target = Counter(b for _, _, f in made for b in f), Counter(b for t in items for b in features(t)[1])
    s_all, t_all = sum(raw.values()) + 10_000, sum(target.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in raw}
    rows = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter()
    ranked = [(*r, None) for r in rows if r[1] < 20] + [(*r, k + 1 if k < 5 * len(may) // 100 else None) for k, r in enumerate(may)]
    return sorted(ranked, key=repr)


def corpus(n=400):
    rng = random.Random(5)
    vocab = ["Alpha", "be7a", "日本語の文", "naïve", "ÉTÉ", "x" * 60, "y" * 49, "y" * 50, "Ω", "z"] + [f"w{k}" for k in range(300)]
    marks = [" ", "  ", ", ", "\n", "-", "\x00", "\x7f", "'"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice(marks) for _ in range(n))
    docs = [(d, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for d in range(n)]
    docs += [(1000, None), (1001, ""), (1002, "  \n.,-"), (None, text(30)), (None, text(30)), (7, text(30)), (7, docs[7][1]), (1003, "solo"), (1004, "w1 " * 5000)]
    return docs, [text(40) for _ in range(8)] + [None, ""]


def test_every_row_as_brute_force_has_it(spark):
    docs, items = corpus()
    left = spark.createDataFrame([(d, t, 0, "x", 0, "clash") for d, t in docs], "doc_id long, text string, rank int, weight string, part int, row_id string").repartition(5)
    right = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = resample.resample(left, right)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_long_texts_in_segments(spark, monkeypatch):
    docs, items = corpus(60)
    docs.append((2000, "v" * 3000 + " " + docs[3][1] * 40))
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(resample, "SEGMENT_BYTES", size)
        for _, t in docs:
            data = np.frombuffer((t or "").encode(), np.uint8)
            parts = list(resample._segments(data, 3))
            assert sum(n for _, n in parts) == features(t)[0]
            assert Counter(int(c) % 10_000 for p, _ in parts for c in p) == Counter(features(t)[1])


def test_query_over_the_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = queries.op11_importance_resampling(spark, d)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(a, c, *rest) for a, _, c, *rest in brute(docs, items)], key=repr)
    assert got.filter(F.col("rank").isNotNull()).count() == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_without_words(spark, rows):
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_features"], r["weight"], r["rank"]) for r in resample.resample(docs, items).collect()] == [(0, 0, None)] * len(rows)
