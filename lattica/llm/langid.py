"""Language ID: script ranges narrow the candidates, Viterbi labels the words.

A word's score for each language comes from hashed byte n-grams (naive Bayes).
Languages that are not written in the word's script are ruled out. Viterbi
with a penalty for each switch then labels every word of a text, so texts of
several languages come apart into spans; the prediction is the language with
most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import chunks, span_hashes, utf8
from lattica.llm.letters import KIND, LETTER, MARK, SCRIPT, SCRIPTS, spread, wide, words

ORDERS = (1, 2, 3, 4)
BITS = 16
UNKNOWN = "und"
RULED_OUT = np.float32(-50.0)

#: What words are made of: letters and the marks that go with them.
KINDS = LETTER | MARK


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # buckets by languages: log probability of an n-gram
    allowed: np.ndarray  # scripts by languages: whether the language uses the script


def scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word: that of its last-ranged letter, so that kanji decide among kana."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    kind = spread(data, wide(data), SCRIPT)
    return np.maximum.reduceat(np.append(kind, np.uint8(0)), np.stack([starts, ends], 1).ravel())[::2]


def byte_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the padded words, and the word of each."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    base = stop - size
    padded = np.empty(stop[-1], np.uint64)
    inner = np.repeat(starts - base - 1, size) + np.arange(stop[-1])
    padded[:] = data[np.clip(inner, 0, len(data) - 1)]
    padded[base], padded[stop - 1] = 1, 2
    left = np.repeat(stop, size) - np.arange(stop[-1])
    out, word = [], []
    code = np.zeros(len(padded), np.uint64)
    owner = np.repeat(np.arange(len(starts)), size)
    for n in range(1, max(orders) + 1):
        code = code * np.uint64(257)
        code[: len(code) - n + 1] += padded[n - 1 :]
        if n not in orders:
            continue
        ok = left >= n
        out.append(((code[ok] * np.uint64(2 * n + 1) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
        word.append(owner[ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(word)


def fit(texts: list[str], langs: list[str], least_script: float = 0.02, damping: float = 0.4) -> Model:
    """Train on whole labelled texts (the caller bounds their number)."""
    names = sorted(set(langs))
    counts = np.zeros((1 << BITS, len(names)))
    script_words = np.zeros((len(SCRIPTS), len(names)))
    for k, name in enumerate(names):
        data, off = utf8(pa.array([t for t, x in zip(texts, langs) if x == name], pa.string()))
        for i, j in chunks(off):
            part, starts, ends, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i], KINDS)
            if len(starts):
                buckets, _ = byte_grams(part, starts, ends)
                counts[:, k] += np.bincount(buckets, minlength=1 << BITS)
                script_words[:, k] += np.bincount(scripts(part, starts, ends), minlength=len(SCRIPTS))
    share = script_words / np.maximum(1, script_words.sum(0))
    allowed = share >= least_script
    allowed[~allowed.any(1)] = True  # a script that no language uses rules nothing out
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << BITS)))
    return Model(names, (damping * table).astype(np.float32), allowed)


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log posterior (words by languages) of each word of a lowered buffer."""
    _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    first, last = starts[one], ends[one]
    buckets, word = byte_grams(data, first, last)
    total = np.stack([np.bincount(word, model.table[buckets, k], len(one)) for k in range(len(model.langs))], 1)
    total = np.where(model.allowed[scripts(data, first, last)], total, total.max(1, keepdims=True) + RULED_OUT)
    total -= total.max(1, keepdims=True)
    total -= np.log(np.exp(total).sum(1, keepdims=True))
    return np.maximum(total, RULED_OUT)[which].astype(np.float32)


def viterbi(scores: np.ndarray, off: np.ndarray, penalty: float, size: int = 32) -> np.ndarray:
    """Best label of each word: the sum of scores less ``penalty`` for each switch within a row.

    Exact, but in blocks: all blocks of ``size`` words advance together for
    every start label, then the rows' blocks are joined one after another.
    """
    n, k = scores.shape
    counts = np.diff(off)
    m = -(-counts // size)
    first = np.cumsum(m) - m
    n_blocks = int(m.sum())
    if not n_blocks:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(m)), m)
    nth = np.arange(n_blocks) - first[row]
    at = off[row] + nth * size
    left = np.minimum(counts[row] - nth * size, size)
    p = np.float32(penalty)
    reach = np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-1e9))[None].repeat(n_blocks, 0)
    for t in range(size):
        live = left > t
        part = scores[np.minimum(at + t, n - 1)][:, None, :]
        step = np.maximum(reach, reach.max(2, keepdims=True) - p) + part
        reach = np.where(live[:, None, None], step, reach)
    begin = np.zeros((n_blocks, k), np.float32)
    came = np.zeros((n_blocks, k), np.int64)
    value = np.zeros((len(m), k), np.float32)
    order = np.argsort(-m, kind="stable")
    for r in range(int(m.max())):
        rows = order[: np.searchsorted(-m[order], -r, "left")]
        blocks = first[rows] + r
        begin[blocks] = value[rows]
        both = value[rows][:, :, None] + reach[blocks]
        came[blocks] = both.argmax(1)
        value[rows] = both.max(1)
    end = np.zeros(n_blocks, np.int64)
    state = value.argmax(1)
    for r in range(int(m.max()) - 1, -1, -1):
        rows = order[: np.searchsorted(-m[order], -r, "left")]
        blocks = first[rows] + r
        end[blocks] = state[rows]
        state[rows] = came[blocks, state[rows]]
    stays = np.empty((size, n_blocks, k), bool)
    best = np.empty((size, n_blocks), np.int64)
    value = begin
    for t in range(size):
        top = value.max(1, keepdims=True) - p
        stays[t], best[t] = value >= top, value.argmax(1)
        step = np.maximum(value, top) + scores[np.minimum(at + t, n - 1)]
        value = np.where((left > t)[:, None], step, value)
    out = np.zeros(n, np.int64)
    every = np.arange(n_blocks)
    for t in range(size - 1, -1, -1):
        live = np.flatnonzero(left > t)
        out[at[live] + t] = end[live]
        end[live] = np.where(stays[t][every[live], end[live]], end[live], best[t][live])
    return out


SPAN = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("lang", T.StringType())])
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def detect(docs: DataFrame, model: Model, penalty: float = 4.0, with_spans: bool = True) -> DataFrame:
    """Language of each whole text: (doc_id, lang_pred, score, spans).

    ``spans`` are the runs of one language in the text's UTF-8 bytes, from the
    first to the last letter of each (null unless asked for). ``lang_pred`` is
    the language with most bytes of letters, the first by name of several;
    ``score`` is the mean posterior of that language over the text's letters.
    A text that is null or has no letter is ``und`` with score 0 and no span; a
    model that has learned no language calls every text ``und``.
    Nulls of doc_id stay, repeated rows repeat, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = [*model.langs, UNKNOWN]
        k = len(model.langs)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off):
                raw, rows = data[off[i] : off[j]], off[i : j + 1] - off[i]
                part, starts, ends, word_off = words(raw, rows, KINDS)
                n = j - i
                label = np.full(n, k)
                score = np.zeros(n)
                spans: list = [[] for _ in range(n)] if with_spans else [None] * n
                if len(starts) and k:
                    s = word_scores(model, part, starts, ends)
                    labels = viterbi(s, word_off, penalty)
                    row = np.repeat(np.arange(n), np.diff(word_off))
                    weight = (ends - starts).astype(float)
                    mass = np.bincount(row * k + labels, weight, n * k).reshape(n, k)
                    label = np.where(mass.any(1), mass.argmax(1), k)
                    got = np.bincount(row, weight * np.exp(s[np.arange(len(s)), np.minimum(label, k - 1)[row]]), n)
                    score = np.clip(got / np.maximum(1, np.bincount(row, weight, n)), 0, 1)
                    letters = np.flatnonzero(spread(raw, wide(raw), KIND) & LETTER)
                    bare = np.diff(np.searchsorted(letters, rows)) == 0  # marks without a letter
                    label[bare], score[bare] = k, 0.0
                    if with_spans:
                        cut = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(labels, prepend=-1).astype(bool))
                        for a, b in zip(cut, np.append(cut[1:], len(row))):
                            if label[row[a]] < k:
                                spans[row[a]].append({"start_byte": int(starts[a] - rows[row[a]]), "end_byte": int(ends[b - 1] - rows[row[a]]), "lang": names[labels[a]]})
                kind = pa.list_(pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array([names[x] for x in label], pa.string()), pa.array(score), pa.array(spans, kind)], names=SCHEMA.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def sample(docs: DataFrame, rows_each: int = 800, longest: int = 1 << 16, most_langs: int = 1000) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts: about ``rows_each`` rows of each language, by a hash of the text.

    Rows with a null text or language are left out, and texts of more than
    ``longest`` bytes are not learned from. Each of the ``most_langs`` most
    frequent languages keeps one row at least, however rare. Without labelled
    rows the sample is empty.
    """
    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna().filter(F.octet_length("text") <= longest)
    counts = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_langs).collect()
    if not counts:
        return [], []
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows_each / r["count"]))) for r in counts])
    part = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 24)) < share * (1 << 24)
    rare = F.col("lang").isin([r["lang"] for r in counts if r["count"] <= 2 * rows_each])
    rows = labelled.filter(part | rare).groupBy("lang", "text").count().drop("count").collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]
