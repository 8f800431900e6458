import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from lattica.llm import fingerprint, html_text, langid, toxicity
from lattica.llm.common import chunks, utf8

PROSE = "The cat and the dog were in the house with a ball that was to be found on the floor of the room, and it is not that far from the other one."


def test_main_text_keeps_the_article_only():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">{PROSE}</a></li></ul></nav><div class="cookie-notice"><p>{PROSE}</p></div>
<article><h1>Head &amp; <i>line</i></h1><p><b>First  &lt;b&gt;
part.<br><p>{PROSE} {PROSE}</p><p>Os.</p><form><p>{PROSE}</p></form><div class="comments"><p>{PROSE}</p></div><!-- <p>no</p> --></article>
<aside><p>{PROSE}</p></aside><footer>&copy; us {PROSE}</footer></body>"""
    assert html_text.main_text(page) == f"Head & line\nFirst <b> part.\n{PROSE} {PROSE}\nOs."


def test_rules_without_an_article():
    page = f"<div><a href=a>Home</a> | <a href=b>About</a></div><h2>Heading</h2><p>{PROSE} {PROSE}</p><p>Short.</p><p>{PROSE} {PROSE}</p><p>Tel 123</p><div><a href=z>{PROSE}</a></div>"
    assert html_text.main_text(page) == f"Heading\n{PROSE} {PROSE}\nShort.\n{PROSE} {PROSE}"


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain text"), (None, "u", "<article>" + "<p>x y z</p>" * 5000), (5, "u", "<article><p>a &am b &lt c"), (6, "u", '<a "' * 500), (6, "u", '<a "' * 500)]
    got = {(r.page_id, r.n_chars): r.text for r in html_text.extract(spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")).collect()}
    assert got[(1, 0)] == got[(2, 0)] == "" and got[(None, 5000 * 6 - 1)] == "\n".join(["x y z"] * 5000)
    assert got[(5, 11)] == "a &am b < c"


def brute_viterbi(scores, penalty):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        move = value[:, None] - penalty * (1 - np.eye(len(s)))
        back.append(move.argmax(0))
        value = move.max(0) + s
    return value.max()


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 31, 32, 33, 100, 0, 257]
    off = np.cumsum([0, *sizes])
    s = rng.normal(0, 2, (off[-1], 4)).astype(np.float32)
    labels = langid.viterbi(s, off, 2.0)
    for a, b in zip(off[:-1], off[1:]):
        if b > a:
            path = labels[a:b]
            got = s[np.arange(a, b), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
            assert abs(got - brute_viterbi(s[a:b].astype(float), 2.0)) < 1e-3


LANGS = {"aa": "the and of to in that was with for this have from they which".split(), "bb": "der die und das nicht mit sich auf für ist im dem ein zu".split(), "cc": "и в не на что как это по но из для от".split()}


def words(lang, n, rng):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


def test_languages_and_spans(spark):
    rng = random.Random(1)
    texts = [(words(k, 40, rng), k) for k in LANGS for _ in range(30)]
    model = langid.fit(*map(list, zip(*texts)))
    mixed = words("aa", 30, rng) + ". " + words("bb", 12, rng)
    rows = [(1, mixed), (2, words("cc", 9, rng)), (3, None), (4, ""), (5, "123 ... — !"), (6, words("bb", 3000, rng).upper()), (None, words("aa", 8, rng)), (7, "…"), (7, "…")]
    got = langid.detect(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[k].lang_pred for k in (1, 2, 3, 4, 5, 6, None, 7)] == ["aa", "cc", "und", "und", "und", "bb", "aa", "und"]
    assert [s.lang for s in by[1].spans] == ["aa", "bb"] and all(0 <= r.score <= 1 for r in got)


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity._start(rng).items()}
    words_ = toxicity.words_of(*utf8(pa.array(["a bad word here", "some other words go on and on"])))
    first, size, row = toxicity.windows(words_.off)
    index, mask = toxicity._layout(words_, first, size)
    target, weight = np.array([1.0, 0.0]), np.ones(2)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    _, g = toxicity._gradients(w, words_, index, mask, target, weight)
    for name in ("u", "A", "v", "Wf", "Ub", "bf", "c"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was = w[name][at]
        losses = []
        for d in (0.01, -0.01):
            w[name][at] = was + d
            losses.append(toxicity._gradients(w, words_, index, mask, target, weight)[0])
        w[name][at] = was
        assert abs((losses[0] - losses[1]) / 0.02 - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_toxicity_learns_stems(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    ends = [a + b for a in "klmnopqr" for b in "stuvw"]
    texts, labels = [], []
    for k in range(300):
        w = [rng.choice(plain) for _ in range(rng.randint(10, 120))]
        if k % 3 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = "xoxyz" + rng.choice(ends[:20])
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, labels, per_epoch=500)
    unseen = [(1, " ".join([*plain[:50], "xoxyz" + ends[-1], *plain[50:90]])), (2, " ".join(plain)), (3, None), (4, " ... "), (None, " ".join(plain[:5]))]
    frame = spark.createDataFrame(unseen, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    known = toxicity.score(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), model).first()
    assert known.score >= 0.7 and got[1].score > 5 * got[2].score and got[2].score < 0.7 and got[3].n_windows == 0 and got[3].score < 0.1 and got[2].n_windows == 12
    with_toxic = frame.unionByName(spark.createDataFrame([(9, texts[0])], "doc_id long, text string"))
    assert {r.doc_id for r in toxicity.keep(with_toxic.filter("doc_id is null or doc_id <> 1"), model).collect()} == {2, 3, 4, None}
    assert toxicity.score(frame.limit(0), model).collect() == []
    assert toxicity.fit([], []).empty == 0.0


def test_edited_fingerprints_equal_brute_force(spark):
    rng = random.Random(3)
    docs = [(k * 3, " ".join(rng.choice("abcdef") * 3 + str(rng.randrange(50)) for _ in range(rng.randint(0, 60))) + ("é" if k % 4 else "")) for k in range(60)] + [(None, "no id at all"), (500, None), (500, "twin"), (501, "x" * 9)]
    frame = spark.createDataFrame([(*d, "f") for d in docs], "doc_id long, text string, fingerprint string").repartition(4)
    order = sorted(((d if d is not None else -(2**63), t or "") for d, t in docs), key=lambda x: (-x[0], x[1]))
    a, b = fingerprint.coefficients(128, 1)

    def mark(t):
        data, off = utf8(pa.array([t]))
        return fingerprint.signatures(*fingerprint.shingle_sets(data, off, 5), a, b)[0]

    want = []
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append((None if d == -(2**63) else d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(float((mark(t) == mark(e)).mean()), 9), round(float((mark(t) == mark(nxt)).mean()), 9)))
    for each in (7, 1000):
        got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprint.edited_fingerprints(frame, rows_each=each).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fingerprint.edited_fingerprints(frame.limit(0)).collect() == []
    assert len(fingerprint.edited_fingerprints(frame.filter("doc_id = 3")).collect()) == 1


def test_near_pairs(spark):
    base = " ".join(f"w{k}" for k in range(100))
    docs = [(1, base), (2, base), (3, base + " more"), (4, " ".join(f"v{k}" for k in range(80))), (5, None), (6, ""), (None, base)]
    got = {(r.left_id, r.right_id): round(r.jaccard, 6) for r in fingerprint.near_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 2): 1.0, (1, 3): round(96 / 97, 6)}


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    a, b = fingerprint.coefficients(512, 9)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    both = np.concatenate((x[:200], x[100:]))
    m = fingerprint.signatures(both, np.array([0, 200, 400]), a, b)
    assert abs(fingerprint.likeness(m[:1], m[1:])[0] - 100 / 300) < 0.08
