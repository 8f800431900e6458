import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import queries, tokens, toxicity
from test_decontaminate import words as letters_and_digits
from test_linededup import brute as brute_lines
from test_setjoin import shingle_set

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(12)
    vocab = [f"word{k}" for k in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bad = [f"vile{k}" for k in range(12)]
    item = prose(40)
    docs, toxic = [], {}
    for d in range(150):
        lines = [prose(rng.randint(10, 60)) for _ in range(rng.randint(1, 4))]
        toxic[d] = int(d % 5 == 0)
        if toxic[d]:
            w = lines[0].split()
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
            lines[0] = " ".join(w)
        if d % 7 == 1:
            lines.append("Read more about it here")
        if d % 25 == 2:
            lines.insert(0, item.upper())
        docs.append((d, "\n".join(lines)))
    base = prose(120).split()
    twin = prose(15)
    for d in range(200, 215):
        w = list(base)
        w[rng.randrange(120)] = f"edit{d}"
        docs.append((d, "\n".join(" ".join(w[k : k + 12]) for k in range(0, 120, 12))))
    odd = [(300, None), (301, ""), (302, "\n\n"), (303, prose(20_000)), (None, prose(30)), (None, None), (304, twin), (304, twin), (305, prose(9)), (305, prose(9))]
    rows = [(d, t, "en" if d else None, "s" if d else None, None if t is None else len(t)) for d, t in docs + odd]
    return rows, [(d, x) for d, x in toxic.items()], [(1, item), (2, None), (3, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels, items = corpus()
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_equal_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]

    def stage(name, given):
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, given, tables).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        return out

    # toxicity: the rows that the network scores below 0.7, each as it was
    model = queries.toxicity_model(spark, docs, tables)
    scored = Counter((r.doc_id, r.score < 0.7) for r in toxicity.score(docs, model).collect())
    clean = stage("toxicity", docs)
    assert Counter(r.doc_id for r in clean.collect()) == Counter({d: n for (d, ok), n in scored.items() if ok})
    assert {r.doc_id for r in clean.collect()} >= {300, 301, 302, 304, 305, None} and clean.count() < docs.count()

    # line dedup: later similar lines go, and documents that thereby lose all their words
    lines = stage("line dedup", clean)
    given = [(r.doc_id, r.text) for r in clean.collect() if r.doc_id not in (304, 305)]
    want = [(d, t) for d, t, _, n in brute_lines(given) if not (n and not (t or "").split())]
    got = [(r.doc_id, r.text) for r in lines.collect() if r.doc_id not in (304, 305)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in lines.collect())

    # n-gram Jaccard join: one row of each group
    single = stage("n-gram Jaccard join", lines)
    some = [tuple(r) for r in lines.collect()]
    sets = [shingle_set(r[1]) for r in some]
    root = list(range(len(some)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(some)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(some):
        groups[find(i)].append(r)
    kept = [tuple(r) for r in single.collect()]
    wordy = [g for k, g in groups.items() if sets[k]]
    assert Counter(r[0] for r in kept if shingle_set(r[1])) == Counter(min((r[0] for r in g if r[0] is not None), default=None) for g in wordy)
    assert {r[:2] for r in kept if not shingle_set(r[1])} == {r[:2] for r, s in zip(some, sets) if not s}

    # benchmark decontamination: no window of an item's size is 0.8 like the item
    out = stage("benchmark decontamination", single)
    item = letters_and_digits(corpus()[2][0][1])
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    whole = bag(item)

    def leaks(text):
        w = letters_and_digits(text)
        return any(sum((a & whole).values()) >= 0.8 * sum((a | whole).values()) for a in (bag(w[k : k + len(item)]) for k in range(len(w) - len(item) + 1) if w[k : k + len(item)][20] in item))

    assert rows_of(out) == sorted((r for r in kept if not leaks(r[1])), key=repr) and len(kept) > out.count()

    # packing: each token of each document in one piece
    pieces = defaultdict(list)
    for r in stage("packing", out).collect():
        pieces[r.doc_id].append((r.start, r.length))
    coder = tokens.encoder(tokens.public_path())
    import pyarrow as pa

    expected = Counter()
    for d, t, *_ in out.collect():
        expected[d] += sum(len(e.ids) for _, _, e in coder.encode(pa.array([t], pa.string()))) + 1
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == dict(expected)
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == set(pieces)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_with_clashing_names(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(20).withColumns({"n_removed": F.lit(1), "label": F.lit("x"), "sid": F.lit(2), "hit": F.lit(3), "score": F.lit(0.5), "text_hash": F.lit(4), "component_id": F.lit(5)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert set(out.columns) >= {"label", "sid", "hit", "score", "component_id", "text_hash"}, name
        out.collect()
