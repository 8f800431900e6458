import hashlib

import pytest

from lattica.functions import text as X
from lattica.operators import project
from lattica.plans.build import build
from lattica.sources import bundle


def test_labels_and_summaries_by_utf16_units(spark, tmp_path):
    root = tmp_path / "b"
    root.mkdir()
    (root / "index.md").write_text("# All\n\n- [one](one.md)\n")
    long, astral, wide = "l" * 301, "😀" * 150, "😀" * 151
    header = f"---\ntype: T\ntitle: One\ndescription: {'s' * 3999}\ntags: ['ﬀ', '😀']\naliases: [' b  b ']\nsources:\n  - resource: ' https://x.org '\n    id: ' i '\n"
    (root / "one.md").write_text(f"{header}---\n[ {astral} ](two.md) [{wide}](two.md) [{long}](three.md) [  ](three.md) [ x ](four.md) [😀](four.md) [￮](four.md)\n")
    for name in ("two", "three", "four"):
        (root / f"{name}.md").write_text(f"---\ntype: T\ntitle: {name}\ndescription: d\ntags: [x]\n---\nText.\n")
    made, _ = build(spark, str(root), project.Options("git@host:me/repo.git", "a" * 40, "2024-01-01T00:00:00Z"))
    titles = {n["id"]: (n["kind"], n["title"]) for n in made.nodes.collect()}
    got = {(e["type"], titles[e["to"]][1]): (e["label"], e["sourcePath"]) for e in made.edges.collect() if titles[e["from"]][1] == "One"}
    assert got[("LINKS_TO", "two")] == (None, "one.md")  # the label that is too long counts as none, and none wins
    assert got[("LINKS_TO", "three")] == (None, "one.md") and got[("LINKS_TO", "four")] == ("x", "one.md")
    assert got[("HAS_TAG", "ﬀ")] == ("ﬀ", "one.md") and got[("ALIASED_AS", "b  b")] == ("b  b", "one.md")
    assert got[("DERIVED_FROM", "https://x.org")] == ("i", "one.md")
    one = next(n for n in made.nodes.collect() if n["title"] == "One")
    assert one["tags"] == ["😀", "ﬀ"] and len(one["summary"]) == 3999  # by UTF-16 units the sign comes first
    order = [(("Concept", "Tag", "Source", "Term").index(n["kind"]), n["id"]) for n in sorted(made.nodes.collect(), key=lambda n: n["pos"])]
    assert order == sorted(order)


@pytest.mark.parametrize("n", [0, 1, 7, 40])
def test_digest_over_ranges(spark, monkeypatch, n):
    monkeypatch.setattr(project, "DIGEST_LINES", 3)
    rows = [(f"{'😀' if k % 3 else chr(0xFFEE)}{k}.md", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(n)]
    want = "\n".join(f"{p}\0{h}" for p, h in sorted(rows, key=lambda r: r[0].encode("utf-16-be")))
    got = project.content_digest(spark.createDataFrame(rows, "path string, contentHash string").repartition(3)).collect()
    assert [r["digest"] for r in got] == [hashlib.sha256(want.encode()).hexdigest()]


def test_utf16_expressions(spark):
    texts = ["", "a", "😀", "a😀", "￮😀b"]
    for n in range(5):
        units = lambda s: s.encode("utf-16-be")
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.utf16_prefix("t", n).alias("p"), X.utf16_length("t").alias("n")).collect()
        assert [r["p"] for r in got] == [units(t)[: 2 * n].decode("utf-16-be", "ignore") for t in texts]
    got = spark.createDataFrame([(texts + ["é"],)], "t array<string>").select(X.utf16_sorted("t").alias("s")).first()["s"]
    assert got == sorted(texts + ["é"], key=lambda s: s.encode("utf-16-be"))


def test_rounding_by_the_exact_binary_value(spark):
    import math
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(4)
    values = [1.005, 1.255, 2.675, 0.5, 1.5, 2.5, 0.125, -0.125, 0.0, 1e-9, 5e-7, 0.0000005, 123456.7890625, 1 / 128, -1.005, 999999.9999995, 8.345, 1.0000005]
    values += [rng.randrange(2000) / 2 ** rng.randint(1, 12) for _ in range(400)] + [rng.randrange(10**7) / 10**6 + 5e-7 for _ in range(400)] + [rng.random() * 10 ** rng.randint(-8, 6) for _ in range(400)]
    for x in list(values[18:420]):
        values += [math.nextafter(x, 0), math.nextafter(x, 9e9)]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double").coalesce(1)
    for digits in (0, 2, 6):
        got = df.select("x", X.fixed("x", digits).alias("y")).collect()
        for x, y in got:
            assert y is None if x is None else y == float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)), (x, y, digits)


def test_chunks_count_utf16_units(spark):
    from lattica.operators import bm25

    rng = random_bodies()
    for body in rng:
        wide = body.replace("é", "😀")  # two units each, as "ab" has
        plain = body.replace("é", "ab")
        for most, overlap in ((300, 0), (300, 40), (1000, 160)):
            want, got = bm25.chunk_texts(plain, most, overlap), bm25.chunk_texts(wide, most, overlap)
            assert len(want) == len(got)
            for w, g in zip(want, got):
                units = len(g.encode("utf-16-le")) // 2
                assert g.replace("😀", "ab").strip("ab") == w.strip("ab") and len(w) - 2 <= units <= len(w)
    head = "# H\n\n" + "😀" * 700 + "\n\n" + " ".join(f"w{k}" for k in range(30))
    rows = [("u", "p.md", "t", "T", "stable", ["al"], None, head), ("v", "q.md", None, None, None, None, [], None), ("w", "r.md", "t", "T", "draft", [], [], "")]
    docs = spark.createDataFrame(rows, "uid string, path string, title string, type string, status string, aliases array<string>, tags array<string>, body string")
    got = bm25.chunk(docs).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == [f"u#{k:03d}" for k in range(len(got))] and len(got) >= 2
    assert got[0]["text"].startswith("t\nT\np.md\nal\nstatus:stable\n\n# H") and all(r["characters"] == len(r["text"].encode("utf-16-le")) // 2 for r in got)
    assert sum(r["text"].count("😀") for r in got) >= 700


def random_bodies():
    import random

    rng = random.Random(10)
    for _ in range(60):
        blocks = [" ".join("".join(rng.choice("xyzé") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 8))]
        yield "\n\n".join(blocks)
