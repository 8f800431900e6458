import random

from lattica.llm import linededup
from tests.llm.test_linededup_short import brute


def near_copies(rng, groups, copies):
    """Texts of which each is near to the one before it, so that a group's earliest leads few of them."""
    docs = []
    for g in range(groups):
        words = [f"g{g}w{k}" for k in range(40)]
        for c in range(copies):
            words[(3 * c) % 40 : (3 * c) % 40 + 3] = [f"g{g}c{c}x{k}" for k in range(len(words[(3 * c) % 40 : (3 * c) % 40 + 3]))]
            docs.append((rng.randrange(1 << 30), " ".join(words)))
    return docs


def test_last_round_makes_each_pair_one_way_and_without_idle_rows(spark, monkeypatch):
    docs = near_copies(random.Random(8), 6, 20)
    ids, found = {}, []

    def kept(df, name, f=linededup.written):
        table = f(df, name)
        if name == "line-firsts":
            ids.update((r.sid, r.doc_id) for r in table.collect())
        if name == "line-counts":
            found.extend((ids[r.late], ids[r.early]) for r in table.collect())
        return table

    monkeypatch.setattr(linededup, "written", kept)
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(docs)
    assert found and all(early < late for late, early in found)


def test_sets_too_small_to_match_others_are_not_indexed(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(d, " ".join(rng.sample("abcdefgh", rng.choice([1, 2, 3])))) for d in range(80)]
    sizes = []

    def kept(df, name, f=linededup.written):
        table = f(df, name)
        sizes.append((name, table.count()))
        return table

    monkeypatch.setattr(linededup, "written", kept)
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(docs)
    assert {n for name, n in sizes if name in ("line-pairs", "line-counts", "line-keys")} == {0}


def test_blanks_of_all_kinds_part_words(spark):
    docs = [(1, "one two\tthree\x0bfour\x0cfive\r"), (2, "  ONE   two three four five "), (3, " \t \r"), (4, "é x É X"), (5, "é x"), (6, "one")]
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(docs)
