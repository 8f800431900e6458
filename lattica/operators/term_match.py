"""Many term lists resolved in one plan: one automaton of all terms, one pass over the concepts' texts.

All distinct terms of all questions go into one Aho-Corasick automaton, which
finds every term in a text in one reading of it. The texts of a whole batch of
concepts are read as one string; which rule a hit satisfies follows from where
it lies in its text. So the work over the texts does not grow with the number
of questions, and no question has a plan or job of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import normalize_query
from lattica.operators.graph import BOUNDS, WEIGHTS, concepts
from lattica.operators.ordinals import numbered
from lattica.sources.shared import materialized

#: Distinct terms of one automaton, of at most 200 characters each; more take further passes.
MOST_TERMS = 1 << 16
_WEIGHT = dict(WEIGHTS)
#: The rules in the order in which they count: weight and field.
RULES = (
    (_WEIGHT["title"], "title"),
    (_WEIGHT["aliases"], "aliases"),
    (_WEIGHT["tags"], "tags"),
    (_WEIGHT["type"], "type"),
    (_WEIGHT["prefix"], "title"),
    (_WEIGHT["prefix"], "aliases"),
    (_WEIGHT["substring"], "title"),
    (_WEIGHT["substring"], "aliases"),
    (_WEIGHT["path"], "path"),
    (_WEIGHT["summary"], "summary"),
)
_NEVER = len(RULES)
#: Of each field the rule of a hit that is the whole text, its beginning, and any part.
FIELDS = {"title": (0, 4, 6), "aliases": (1, 5, 7), "tags": (2, _NEVER, _NEVER), "type": (3, _NEVER, _NEVER), "path": (8, 8, 8), "summary": (9, 9, 9)}


def _hits(texts: list[str], rows: np.ndarray, automaton, sizes: np.ndarray, rules: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and rule of every place where a term occurs in one of ``texts``."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(length + 1)))
    found = np.fromiter((x for end, term in automaton.iter("\0".join(texts)) for x in (end, term)), np.int64).reshape(-1, 2)
    end, term = found[:, 0], found[:, 1]
    at = np.searchsorted(first, end, "right") - 1
    start = end - sizes[term] + 1 - first[at]
    rule = np.select([(start == 0) & (sizes[term] == length[at]), start == 0], rules[:2], rules[2])
    kept = (start >= 0) & (rule < _NEVER)  # a hit over the mark between two texts is none
    return rows[at[kept]], term[kept], rule[kept]


def term_hits(nodes: DataFrame, terms: DataFrame, nfkc: bool = True) -> DataFrame:
    """(id, term_id, rule) of the first rule that holds for each concept and each of ``terms`` (term_id, norm), where one does."""
    import ahocorasick

    spark = nodes.sparkSession
    norm = lambda c: normalize_query(F.coalesce(c, F.lit("")), nfkc)
    listed = lambda c: F.split(norm(F.concat_ws("\x1f", F.col(c))), r"\s*\x1f\s*")
    rows = concepts(nodes).select("id", norm(F.col("title")).alias("title"), listed("aliases").alias("aliases"), listed("tags").alias("tags"), norm(F.col("type")).alias("type"), norm(F.col("path")).alias("path"), norm(F.col("summary")).alias("summary"))

    def one_pass(some: list) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r["term_id"], r["norm"]) for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, words = np.array([i for i, _ in sent.value], np.int64), [w for _, w in sent.value]
            automaton = ahocorasick.Automaton()
            for k, word in enumerate(words):
                automaton.add_word(word, k)
            automaton.make_automaton()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for batch in batches:
                met = []
                for name, rules in FIELDS.items():
                    column, at = batch.column(name), np.arange(batch.num_rows)
                    if pa.types.is_list(column.type):
                        at, column = np.repeat(at, column.value_lengths().to_numpy()), column.flatten()
                    met.append(_hits(column.to_pylist(), at, automaton, sizes, rules))
                row, term, rule = (np.concatenate(c) for c in zip(*met))
                order = np.lexsort((rule, term, row))
                row, term, rule = row[order], term[order], rule[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[new])), pa.array(ids[term[new]]), pa.array(rule[new].astype(np.int32))], names=["id", "term_id", "rule"])

        return rows.mapInArrow(run, "id string, term_id long, rule int")

    count = terms.count()
    passes = [one_pass(terms.filter(F.col("term_id").between(k, k + MOST_TERMS - 1)).collect()) for k in range(0, count, MOST_TERMS)]
    if not passes:
        return rows.select("id", F.lit(0).cast("long").alias("term_id"), F.lit(0).alias("rule")).limit(0)
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def resolve_batch(nodes: DataFrame, asked: DataFrame, nfkc: bool = True) -> DataFrame:
    """Every match of every question: (question_id, id, pos, title, score, n_matched, matched_terms, matched_fields).

    ``asked`` has question_id and terms (an array of 1 to 20 texts of 2 to 200
    characters, normalised like the concepts' texts); a list beyond these bounds,
    or with a null term, is an error. For each term the first rule that holds
    counts; a term that is given twice counts twice. A question without a match
    has no row.
    """
    hits, wanted = _matched(nodes, asked, nfkc)
    info = concepts(nodes).select("id", "pos", "title")
    return _scored(hits, wanted, "id").join(info, "id").select("question_id", "id", "pos", "title", "score", "n_matched", "matched_terms", "matched_fields")


def _matched(nodes: DataFrame, asked: DataFrame, nfkc: bool) -> tuple[DataFrame, DataFrame]:
    """The hits of all terms, and (question_id, nth, term, term_id) of the lists, which lie within the bounds."""
    low, high = BOUNDS["terms"]
    short, long = BOUNDS["term_length"]
    lists = asked.select("question_id", "terms")
    each = lists.select("question_id", F.posexplode_outer("terms").alias("nth", "term")).withColumn("norm", normalize_query("term", nfkc))
    wrong = lists.filter(~F.coalesce(F.size("terms").between(low, high), F.lit(False))).select("question_id").unionByName(each.filter(~F.coalesce(F.length("norm").between(short, long), F.lit(False))).select("question_id"))
    if bad := wrong.limit(1).collect():
        raise ValueError(f"terms of question {bad[0][0]}: {low} to {high} of {short} to {long} characters")
    terms = numbered(each.select("norm").distinct(), [F.col("norm")], "term_id")
    return term_hits(nodes, terms, nfkc), each.join(terms, "norm").select("question_id", "nth", "term", "term_id")


def _scored(hits: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(question_id, key, score, n_matched, matched_terms, matched_fields) of what has ``hits`` (key, term_id, rule)."""
    weight = F.get(F.array(*[F.lit(w) for w, _ in RULES]), F.col("rule"))
    field = F.get(F.array(*[F.lit(f) for _, f in RULES]), F.col("rule"))
    met = hits.join(wanted, "term_id").groupBy("question_id", key).agg(F.sum(weight).cast("int").alias("score"), F.count(F.lit(1)).cast("int").alias("n_matched"), F.array_sort(F.collect_list(F.struct("nth", "term"))).alias("terms"), F.array_sort(F.collect_set(field)).alias("matched_fields"))
    return met.select("question_id", key, "score", "n_matched", F.transform("terms", lambda t: t.term).alias("matched_terms"), "matched_fields")


def best_matches(matches: DataFrame, limit: int, collation: str | None = None) -> DataFrame:
    """The first ``limit`` matches of each question, with their ``rank``: most terms, then score, then title."""
    title = F.collate("title", collation) if collation else F.col("title")
    order = Window.partitionBy("question_id").orderBy(F.col("n_matched").desc(), F.col("score").desc(), title, "pos")
    return matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def best_batch(nodes: DataFrame, asked: DataFrame, limit: int, collation: str | None = None, nfkc: bool = True) -> DataFrame:
    """:func:`best_matches` of :func:`resolve_batch`, without a row for every match of every question.

    Concepts with the same hits (terms and their rules) are a class: in every
    question they have the same terms and score, so only a class's first
    ``limit`` by title and pos can be among the best. Questions are matched with
    classes, and a class that ``limit`` others are better than is left out.
    """
    hits, wanted = _matched(nodes, asked, nfkc)
    title = F.collate("title", collation) if collation else F.col("title")
    info = concepts(nodes).select("id", "pos", "title")
    classes = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term_id", "rule"))).alias("class")).join(info, "id")
    first = F.row_number().over(Window.partitionBy("class").orderBy(title, "pos"))
    members = materialized(classes.withColumn("_nth", first).filter(F.col("_nth") <= limit).drop("_nth"))
    of_class = members.select("class").distinct().select("class", F.inline("class"))
    better = F.rank().over(Window.partitionBy("question_id").orderBy(F.col("n_matched").desc(), F.col("score").desc()))
    some = _scored(of_class, wanted, "class").withColumn("_rank", better).filter(F.col("_rank") <= limit).drop("_rank")
    return best_matches(some.join(members, "class").select("question_id", "id", "pos", "title", "score", "n_matched", "matched_terms", "matched_fields"), limit, collation)
