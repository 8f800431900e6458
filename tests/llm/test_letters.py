import random
import unicodedata

import numpy as np
import pyarrow as pa

from lattica.llm import decontaminate, langid, letters
from lattica.llm.common import utf8


def brute(text, kinds):
    ok = lambda c: unicodedata.category(c)[0] in kinds
    low = lambda c: c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c
    out, run = [], ""
    for c in text + "\0":
        if ok(c):
            run += low(c)
        elif run:
            out.append(run)
            run = ""
    return out


def test_words_equal_brute_force():
    rng = random.Random(3)
    pool = "aZ9 .-×÷“”’ — éÉßẞİıŞşЖжЯяЁёΩωאبक्षไทย你好かなカナ한글́😀𠀀𝔄Ǆǆ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "х" * 5000]
    data, off = utf8(pa.array(texts, pa.string()))
    for kinds, names in ((letters.LETTER | letters.MARK, "LM"), (letters.LETTER | letters.NUMBER, "LN")):
        part, starts, ends, word_off = letters.words(data, off, kinds)
        got = [[part[a:b].tobytes().decode() for a, b in zip(starts[word_off[r] : word_off[r + 1]], ends[word_off[r] : word_off[r + 1]])] for r in range(len(texts))]
        assert got == [brute(t or "", names) for t in texts]


def test_scripts():
    cases = {"word": "latin", "слово": "cyrillic", "λόγος": "greek", "한글": "hangul", "漢字かな": "han", "かな": "kana", "ไทย": "thai", "tiếng": "latin", "עברית": "hebrew"}
    data, off = utf8(pa.array(list(cases), pa.string()))
    part, starts, ends, _ = letters.words(data, off, langid.KINDS)
    assert [letters.SCRIPTS[k] for k in langid.scripts(part, starts, ends)] == list(cases.values())


def test_texts_without_letters_and_models_without_languages(spark):
    frame = spark.createDataFrame([(1, "3 × 4 ÷ 2 = 6"), (2, "“—”"), (3, "word"), (4, None), (5, "́")], "doc_id long, text string")
    model = langid.fit(["the word is here", "das wort ist hier"], ["en", "de"])
    assert {r.doc_id: r.lang_pred for r in langid.detect(frame, model).collect()} == {1: "und", 2: "und", 3: "en", 4: "und", 5: "und"}
    assert {(r.lang_pred, r.score) for r in langid.detect(frame, langid.fit(*langid.sample(frame.withColumn("lang", frame.text.substr(0, 0)).limit(0)))).collect()} == {("und", 0.0)}
    assert langid.detect(frame.limit(0), model).collect() == []


def test_benchmark_items_in_quotes_and_other_scripts(spark):
    item = "Россия и её Города, где Живут люди; “quoted words” Stand — here"
    docs = [(1, f"intro “{item.upper()}” end"), (2, f"до {item.lower().replace(' ', chr(160))}—после"), (3, "nothing of the kind is here at all"), (4, "x " * 200_000 + item)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(1, 7, 1.0), (2, 7, 1.0), (4, 7, 1.0)]


def test_no_window_is_lost_beyond_the_radius(spark):
    rng = random.Random(8)
    items = [(k, [f"w{rng.randrange(400)}" for _ in range(60)]) for k in range(20)]
    docs = []
    for k, w in items:
        for n in range(10):
            v = list(w)
            v[rng.choice([0, 1, 58, 59])] = f"new{n}"
            docs.append((100 * k + n, " ".join(v)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    every = [{(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.matches(frame, bench, radius=radius).collect()} for radius in (0, 7, 40)]
    assert every[0] == every[1] == every[2] and len(every[0]) == 200
    assert decontaminate.clean(frame, bench, block_bytes=500).count() == 0
