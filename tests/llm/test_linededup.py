import random
import re

from lattica.llm import linededup


def line_set(line):
    return {x for x in re.split(r"[\x20\x09-\x0d]+", line.lower()) if x}


def brute(docs, percent=80):
    lines = sorted(((d if d is not None else 2**63 - 1, n, r, line_set(x)) for r, (d, t) in enumerate(docs) for n, x in enumerate((t or "").split("\n"))), key=lambda x: x[:3])
    gone = set()
    for i, (d, n, r, s) in enumerate(lines):
        if s and any((e, m) < (d, n) and x and 100 * len(s & x) >= percent * len(s | x) for e, m, _, x in lines[:i]):
            gone.add((r, n))
    return sorted(((d, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (r, n) not in gone), 0 if t is None else t.count("\n") + 1, sum(g[0] == r for g in gone)) for r, (d, t) in enumerate(docs)), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(50)]
    stock = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 20, 40, 70]))] for _ in range(30)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(stock)) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append((" " if rng.random() < 0.8 else "\t ").join(x.upper() if rng.random() < 0.2 else x for x in w))
        docs.append((1000 - d, "\n".join(lines)))
    long = " ".join(f"x{k}" for k in range(3000))
    docs += [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, f"{long}\nTail of it"), (None, "this is a line of its own here\nanother one"), (6, "this is a line of its own here"), (7, "a b c d e\na b c d e"), (8, "e d c b a\nx y z u v\n x\ty z u v \n\t\n\x0b \nÄ ö\nä Ö")]
    frame = spark.createDataFrame([(*r, "k", 9) for r in docs], "doc_id long, text string, key string, n_removed int").repartition(4)
    got = linededup.dedup(frame)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(2, "one two three four five six"), (2, "one two three four five six"), (3, "One two three four five six")], "doc_id long, text string")
    assert sorted(tuple(r) for r in linededup.dedup(frame).collect()) == [(2, "one two three four five six", 1, 0)] * 2 + [(3, "", 1, 1)]
    assert linededup.dedup(frame.limit(0)).collect() == []
