import random
import re
from collections import Counter

import numpy as np

from lattica.llm import decontaminate


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            best = None
            for s in range(len(w) - len(v) + 1) if v else []:
                a, b = bag(w[s : s + len(v)]), bag(v)
                likeness = sum((a & b).values()) / sum((a | b).values())
                if likeness >= threshold and (best is None or likeness > best[0]):
                    best = (likeness, s)
            if best:
                out.append((d, i, round(best[0], 9), best[1], len(v)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(60)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(prose(rng.randint(15, 60)))) for k in range(12)] + [(90, "solo"), (91, "three small words"), (92, None), (93, " ... "), (94, "a b a b a b a b a b")]
    docs = []
    for k in range(120):
        body = prose(rng.randint(0, 150))
        if k % 2:
            v = words(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = "edited"
            cut = rng.randint(0, len(body))
            body = body[:cut] + v[: rng.choice([len(v), len(v), len(v) - 1])] + body[cut:]
        docs.append((k, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in body)))
    docs += [(500, None), (501, ""), (502, "Three, small\nWORDS solo"), (503, items[0][1]), (503, items[0][1]), (None, items[1][1]), (504, "a b " * 20)]
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for block in (1 << 20, 300):
        got = decontaminate.matches(frame, bench, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.n_words) for r in got), key=repr) == brute(docs, items)
        hit = {r[0] for r in brute(docs, items)}
        kept = decontaminate.clean(frame, bench, block_bytes=block).collect()
        assert sorted((r.doc_id for r in kept), key=repr) == sorted((d for d, _ in docs if d not in hit), key=repr)
    assert decontaminate.matches(frame.limit(0), bench).collect() == []
    assert decontaminate.matches(frame, bench.limit(0)).collect() == []


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    wanted = np.concatenate([prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in (0, 3, 7, 8, 20)])
    for radius in (0, 3, 7, 20):
        at, to, d = decontaminate.HammingIndex(prints, radius).near(wanted)
        distance = np.bitwise_count(wanted[:, None] ^ prints[None])
        assert set(zip(at, to)) == set(zip(*np.nonzero(distance <= radius)))
