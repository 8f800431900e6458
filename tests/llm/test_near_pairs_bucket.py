import itertools

from lattica.llm import fingerprint


def test_ten_near_copies_give_all_pairs(spark):
    base = [f"w{k}" for k in range(300)]
    docs = [(d, " ".join(f"x{d}" if k == 25 * d else w for k, w in enumerate(base))) for d in range(1, 11)]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(296)} for d, t in docs}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    assert min(want.values()) > 0.9
    got = fingerprint.near_pairs(spark.createDataFrame([*docs, (11, docs[3][1])], "doc_id long, text string")).collect()
    assert {(r.left_id, r.right_id): r.jaccard for r in got} == want | {(4, 11): 1.0}
    assert len(got) == 46
