import random

import numpy as np

from lattica.llm.packing import Packer


def packed(lengths, tiers=(128, 256, 512), hold=8192):
    packer = Packer(1024, tiers, hold, 64, 0)
    for doc, n in enumerate(lengths):
        packer.add(doc, np.arange(n, dtype=np.uint32))
    packer.finish()
    assert packer.count == packer.tokens == 0
    return packer.rows().to_pylist()


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append(r)
    return list(out.values())


def test_each_tier_packs_its_own_size():
    got = sequences(packed([100] * 640 + [200] * 64 + [400] * 64))
    sizes = {sum(r["length"] for r in s) for s in got}
    assert 1024 not in sizes and {512, 256, 128} <= sizes
    for s in got:
        assert all(r["tier"] == next(t for t in (128, 256, 512, 1024) if t >= sum(r["length"] for r in s)) for r in s)


def test_gaps_of_longer_tiers_are_filled_from_shorter_ones():
    got = sequences(packed([900, 124, 400, 112, 100, 28]))
    assert sorted((s[0]["tier"], sorted(r["doc_id"] for r in s)) for s in got) == [(128, [4, 5]), (512, [2, 3]), (1024, [0, 1])]


def test_tiers_change_the_sequences_and_lose_nothing():
    rng = random.Random(3)
    lengths = [rng.choice([1, 5, 90, 128, 129, 300, 511, 700, 1023, 1024, 2500]) + rng.randint(0, 40) for _ in range(500)]
    by_tiers = []
    for tiers, hold in (((128, 256, 512), 8192), ((128, 256, 512), 4), ((512,), 8192), ((), 8192)):
        rows = packed(lengths, tiers, hold)
        for doc, n in enumerate(lengths):
            at = 0
            for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == n
        sums = sorted(sum(r["length"] for r in s) for s in sequences(rows))
        assert all(n & (n - 1) == 0 for n in sums)
        by_tiers.append(sums)
    assert by_tiers[0] != by_tiers[2] != by_tiers[3] and by_tiers[0].count(128) > 10
