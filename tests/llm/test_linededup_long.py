import random

from lattica.llm import linededup
from tests.llm.test_linededup_short import brute


def test_lists_that_grow_with_the_table_get_no_leads(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LONG", 4)
    rng = random.Random(3)
    docs = [(d, " ".join(rng.sample([f"w{k}" for k in range(60)], 12))) for d in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    keys = {}

    def kept(df, name, f=linededup.written):
        table = f(df, name)
        if name == "line-keys":
            keys.setdefault(linededup.SHARE, []).append(table.count())
        return table

    monkeypatch.setattr(linededup, "written", kept)
    for share in (1 << 20, 2):
        monkeypatch.setattr(linededup, "SHARE", share)
        got = linededup.dedup(frame)
        assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute(docs)
    assert keys[1 << 20][0] > 10 and keys[2] == [0]
