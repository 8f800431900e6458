import random
from collections import defaultdict

import numpy as np
import pytest

from lattica.llm import common, setjoin


def shingle_set(text, k=4):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, percent=85):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    least = {g: min((d for d in v if d is not None), default=None) for g, v in groups.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    common_line = [rng.choice(vocab) for _ in range(12)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(8, 120))] for _ in range(n // 8)]
    docs = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):  # edits around the threshold
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocab)]
        if rng.random() < 0.4:
            w += common_line
        docs.append((1000 - k, " ".join(w)))
    return docs


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_equals_brute_force(spark, frequent):
    docs = corpus(1, 260) + [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one"), (7, "a b c d"), (8, "a b c d"), (8, "a b c d"), (9, "É é b c"), (10, "é é b c"), (None, "a b c d"), (None, "lone text of its own kind"), (11, "x " * 4000)]
    frame = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, sid int").repartition(5)
    got = setjoin.join(frame, frequent=max(1, frequent)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)


def test_near_copies_and_a_passage_shared_by_all(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(80)]
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for k in range(150):
        w = list(base)
        w[rng.randrange(80)] = f"e{k}"
        docs.append((k, " ".join(w)))
    docs += [(200 + k, " ".join(passage + [f"u{k}x{j}" for j in range(4 + k % 30)])) for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in setjoin.join(frame).collect()), key=repr) == brute(docs)


def test_empty(spark):
    assert setjoin.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(None, 5), (500, 500)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "x long, y long")).collect()))
    root = {v: v for e in edges if None not in e for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {v: find(v) for v in root}


def test_shingles_and_hashes_do_not_depend_on_place():
    import pyarrow as pa

    data, off = common.utf8(pa.array(["a bb  ccc", None, "x a bb ccc d", "", "ccc"]))
    s, e, w = common.word_spans(data, off)
    h = common.span_hashes(data, s, e)
    assert list(np.diff(w)) == [3, 0, 5, 0, 1]
    assert list(h[:3]) == list(h[4:7]) and h[2] == h[-1]
    x, at = common.shingles(h, w, 3)
    assert list(np.diff(at)) == [1, 0, 3, 0, 1] and x[0] == x[2]
