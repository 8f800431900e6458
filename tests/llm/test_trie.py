import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lattica.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def whole(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h] + t[h:])
    return out


def brute(rows):
    convs, members, ends, children = whole(rows), defaultdict(list), defaultdict(list), defaultdict(set)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
        ends[t].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 0, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string, pos int").repartition(parts)
    got = trie.trie(df)
    assert got.columns == COLUMNS and dict(got.dtypes)["n_leaves"] == "bigint"
    out = [tuple(r) for r in got.collect()]
    assert sorted(out, key=lambda r: r[:2]) == brute(rows)
    return out


def test_small_conversations_with_every_oddity(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(0, 260), -5, -101, 1005, 2**40]:
        first = rng.randint(0, 2)
        for k in range(rng.choice([1, 1, 2, 3, 6, 7, 9])):
            rows.append((c, None if k == 3 else first + 2 * k, rng.choice([None, "", "user"]), rng.choice([None, "", "a", "é𝒳", "b"])))
    rows += [(None, 1, "user", "lost"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (7, 1, None, "other")]
    rows = [r for r in rows if r[0] != 200]  # a base that is absent
    check(spark, rows)


def test_long_shared_beginnings_and_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 8)
    rng = random.Random(2)
    base = [rng.choice("abc") * rng.randint(1, 5) for _ in range(90)]
    rows = []
    for c in range(1000, 1060):  # all equal
        rows += [(c, k, "user", t) for k, t in enumerate(base[:9])]
    for c in range(2000, 2012):  # part late, or one ends within another
        own = base[:70] + ([f"x{c % 3}"] if c % 4 else []) + base[70 : 70 + c % 5]
        rows += [(c, k, "user", t) for k, t in enumerate(own)]
    out = check(spark, rows, 9)
    assert max(r[3] for r in out) == 72 and max(r[1] for r in out) > 70


def test_one_conversation_over_many_ranges(spark):
    rows = [(300, k, "user", str(k % 7)) for k in range(2500)] + [(301, k, "user", str(k % 7)) for k in range(40)] + [(5, 0, "a", "b")]
    out = check(spark, rows)
    assert len(out) > 2500


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(1, 0, "a", "b")], [(4, 0, None, None), (104, 0, None, None)]])
def test_few(spark, rows):
    check(spark, rows, 1)


def test_texts_of_nodes(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "bot", "yes"), (3, 0, "user", "hi"), (3, 1, "bot", "no")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in trie.trie(df, texts=True).collect()}
    convs = whole(rows)
    assert got[(0, 0)] == (None, None)
    assert all(got[(c, d)] == convs[c][d - 1] for c, d in got if d)
