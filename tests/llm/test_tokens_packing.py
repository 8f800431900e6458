import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import packing, tokens

PATH = tokens.public_path()
ODD = ["", "  a\n\n b", "don't 's 'st ''s x'll y're z've q'm it'd '", "\n", "\n\n", "a  \n  b\t\tc  ", None, "x<|endoftext|>y\nz", "日本語 テスト 123abc  é", "naïve — café…!!  ", " '", "a'", "'re", "a'\n's", "😀😀 x\n😀", "w " * 3000, "x" * 5000]


def texts(n=300):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(" \n\t'stredlmvaé1.,!日😀") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(rows)], "doc_id long, text string, section string, start long").repartition(3)


def test_encoder_equals_tokenizer():
    rows = texts()
    coder = tokens.Encoder(PATH, slots=64)  # most pieces push one another out
    wanted = coder.tokenizer.encode_batch([t or "" for t in rows], add_special_tokens=False)
    seen = 0
    for i, j, got in coder.encode(pa.array(rows)):
        for k in range(i, j):
            a, b = got.off[k - i], got.off[k - i + 1]
            assert list(got.ids[a:b]) == wanted[k].ids
            assert list(zip(got.first[a:b], got.end[a:b])) == wanted[k].offsets
            seen += 1
    assert seen == len(rows)


def test_encoder_equals_tokenizer_on_any_characters():
    rng = random.Random(11)
    point = lambda: rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x30000), 0x20, 0x27])
    rows = ["".join(chr(point()) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    rows += ["".join(f"a{chr(p)} {chr(p)}b" for p in range(k, k + 64) if not 0xD800 <= p < 0xE000) for k in range(0, 0x30000, 64)]
    coder = tokens.encoder(PATH)
    wanted = coder.tokenizer.encode_batch(rows, add_special_tokens=False)
    for i, j, got in coder.encode(pa.array(rows)):
        for k in range(i, j):
            a, b = got.off[k - i], got.off[k - i + 1]
            assert list(got.ids[a:b]) == wanted[k].ids, ascii(rows[k])
            assert list(zip(got.first[a:b], got.end[a:b])) == wanted[k].offsets


@pytest.mark.parametrize("rule", tokens.RULES)
def test_fields_equal_brute_force(spark, rule):
    rng = random.Random(13)
    some = ["", None, "don't", "日本 語", "a  ", " b\n", "x" * 300, "é😀"]
    rows = [(k, rng.choice(some), rng.choice(some), rng.choice(some)) for k in range(60)] + [(None, None, None, None), (3, "a", "b", "c"), (3, "a", "b", "c")]
    coder = tokens.encoder(PATH)
    want = []
    for d, *parts in rows:
        texts_ = [p or "" for p in parts]
        whole = "|".join(texts_)
        cuts = [0, len(texts_[0]) + 1, len(texts_[0]) + len(texts_[1]) + 2, len(whole)]
        n, crossed = [0, 0, 0], [0, 0, 0]
        for a, b in coder.tokenizer.encode(whole, add_special_tokens=False).offsets:
            inside = [sum(cuts[f] <= c < cuts[f + 1] for c in range(a, max(b, a + 1))) for f in range(3)]
            held = [f for f in range(3) if inside[f]]
            f = held[0] if rule == "first" else held[-1] if rule == "last" else max(held, key=lambda f: (inside[f], -f))
            n[f] += 1
            crossed[f] += len(held) > 1
        want += [(d, name, cuts[f], cuts[f + 1], n[f], crossed[f]) for f, name in enumerate(("title", "body", "n_tokens"))]
    got = tokens.attribute_fields(spark.createDataFrame(rows, "doc_id long, title string, body string, n_tokens string").repartition(3), PATH, ["title", "body", "n_tokens"], rule, "|").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def brute_sections(text, rule, lines):
    coder = tokens.encoder(PATH)
    starts, n = [0], 0
    for p, c in enumerate(text):
        if c == "\n":
            n += 1
            if n % lines == 0 and p + 1 < len(text):
                starts.append(p + 1)
    counts, crossing = [0] * len(starts), [0] * len(starts)
    for a, b in coder.tokenizer.encode(text, add_special_tokens=False).offsets:
        owners = [max(k for k, s in enumerate(starts) if s <= c) for c in range(a, max(b, a + 1))]
        owner = owners[0] if rule == "first" else owners[-1] if rule == "last" else min(set(owners), key=lambda k: (-owners.count(k), k))
        counts[owner] += 1
        crossing[owner] += len(set(owners)) > 1
    return [(k, s, e, c, x) for k, (s, e, c, x) in enumerate(zip(starts, [*starts[1:], len(text)], counts, crossing))]


@pytest.mark.parametrize("rule,lines", [("first", 1), ("last", 1), ("most", 2)])
def test_sections_equal_brute_force(spark, rule, lines):
    rows = texts(80)
    got = defaultdict(list)
    for r in tokens.attribute_tokens(frame(spark, rows), PATH, rule, lines).collect():
        got[r.doc_id].append(tuple(r)[1:])
    for i, t in enumerate(rows):
        assert sorted(got[i]) == brute_sections(t or "", rule, lines), (rule, t)


def check_pieces(rows, got, size):
    coder = tokens.encoder(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(rows):
        ids = [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size and all(r.tier >= at for r in pieces)
        padded += size - at if at & (at - 1) else 0
    assert padded == 0


@pytest.mark.parametrize("hold", [4, 8192])
def test_pieces_tile_documents_and_sequences(spark, hold):
    rows = texts(150)
    check_pieces(rows, packing.pack(frame(spark, rows), PATH, hold=hold, group=4).collect(), 1024)


def test_empty_table_and_arguments(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).collect() == []
    assert tokens.attribute_tokens(none, PATH).collect() == []
    with pytest.raises(ValueError):
        tokens.attribute_tokens(none, PATH, rule="half")
    with pytest.raises(ValueError):
        packing.pack(none, PATH, tiers=(4096,))


def test_repeated_and_null_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = packing.pack(rows, PATH).collect()
    assert sorted(((r.doc_id is None), r.doc_id or 0, r.length, r.doc_tokens) for r in got if r.doc_id != 2) == [(False, 1, 3, 3)] * 2 + [(True, 0, 3, 3)] or sum(r.length for r in got) == 10
    assert [tuple(r) for r in tokens.attribute_tokens(rows.filter("doc_id = 2"), PATH).collect()] == [(2, 0, 0, 0, 0, 0)]
