"""Evaluation: questions and gold cases, retrieval metrics, acceptance, roll-ups - all questions in one plan."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import fixed

MINIMUM_PRECISION = 0.8
#: Result types and the patterns of normalised terms that ask for them.
Rules = tuple[tuple[str, tuple[str, ...]], ...]


def normalized(text: str) -> str:
    """The question normaliser for driver-side texts."""
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower()))


def requested_types(query: str, terms: list[str], rules: Rules) -> list[str]:
    """Result types that a question's terms ask for; every term must occur in the query, and one type at least."""
    whole, parts = normalized(query), [normalized(t) for t in terms]
    for raw, t in zip(terms, parts):
        if not t or t not in whole:
            raise ValueError(f"the term {raw!r} does not occur in the query")
    found = [name for name, patterns in rules if any(re.search(p, t) for t in parts for p in patterns)]
    if not found:
        raise ValueError("no term asks for a result type")
    return found


def _share(part: Column, whole: Column, if_none: float) -> Column:
    return F.when(F.size(whole) == 0, F.lit(if_none)).otherwise(F.size(part) / F.size(whole))


def metrics(cases: DataFrame, digits: int = 6) -> DataFrame:
    """Adds the metrics of each case.

    ``cases`` has retrieved, required, excluded (arrays of ids),
    required_statuses, actual_statuses (maps) and required_paths,
    supported_paths (arrays of arrays; supported_paths is null where an arm has
    no paths, and then path_recall is null too).
    """
    got, want = F.array_distinct("retrieved"), F.array_distinct("required")
    rows = cases.withColumns({"true_positives": F.array_intersect(got, want), "missed": F.array_except(want, got), "false_positives": F.array_except(got, want), "excluded_hits": F.array_intersect(got, F.col("excluded"))})
    recall, precision = _share(F.col("true_positives"), want, 1.0), _share(F.col("true_positives"), got, 0.0)
    f1 = F.when(recall + precision == 0, F.lit(0.0)).otherwise(2 * recall * precision / (recall + precision))
    checks = F.map_entries("required_statuses")
    status = F.forall(checks, lambda e: F.coalesce(F.element_at("actual_statuses", e.key) == e.value, F.lit(False)) & F.array_contains(F.col("retrieved"), e.key))
    hit = F.filter("required_paths", lambda p: F.coalesce(F.array_contains(F.col("supported_paths"), p), F.lit(False)))
    paths = F.when(F.col("supported_paths").isNull(), F.lit(None).cast("double")).otherwise(_share(hit, F.col("required_paths"), 1.0))
    return rows.withColumns({"recall": fixed(recall, digits), "precision": fixed(precision, digits), "f1": fixed(f1, digits), "status_passed": status, "path_recall": fixed(paths, digits)})


def acceptance(cases: DataFrame, minimum_precision: float = MINIMUM_PRECISION) -> DataFrame:
    """Adds the seven checks of a case and ``accepted``; needs focus_matched and truncated beside the metrics."""
    checks = {
        "check_focus": F.col("focus_matched"),
        "check_complete": ~F.col("truncated"),
        "check_recall": F.col("recall") == 1,
        "check_scope": F.size("excluded_hits") == 0,
        "check_status": F.col("status_passed"),
        "check_paths": F.coalesce(F.col("path_recall") == 1, F.lit(False)),
        "check_precision": F.col("precision") >= minimum_precision,
    }
    all_of = F.lit(True)
    for c in checks.values():
        all_of = all_of & c
    return cases.withColumns(checks | {"accepted": all_of})


def roll_up(cases: DataFrame, commits_consistent: bool = True, commit_expected: bool = True) -> DataFrame:
    """One row: accepted cases, all cases, and whether the whole run passes."""
    return cases.agg(F.count_if("accepted").alias("accepted_cases"), F.count(F.lit(1)).alias("cases"), F.coalesce(F.bool_and("accepted"), F.lit(True)).alias("all_accepted")).withColumn("passed", F.col("all_accepted") & F.lit(commits_consistent) & F.lit(commit_expected))


def macro_averages(cases: DataFrame, digits: int = 6) -> DataFrame:
    """Mean metrics and excluded hits of each arm."""
    mean = lambda c: F.coalesce(fixed(F.avg(c), digits), F.lit(0.0)).alias(f"mean_{c}")
    return cases.groupBy("arm").agg(mean("recall"), mean("precision"), fixed(F.avg("path_recall"), digits).alias("mean_path_recall"), F.sum(F.size("excluded_hits")).alias("excluded_hits"))


def deltas(means: DataFrame, arm: str, against: str, digits: int = 6) -> DataFrame:
    """Differences of the rounded means of two arms, as one row."""
    of = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c)))
    return means.agg(*[fixed(of(arm, c) - of(against, c), digits).alias(f"delta_{c.removeprefix('mean_')}") for c in ("mean_recall", "mean_precision")])


def commit_integrity(references: DataFrame, commit: str) -> DataFrame:
    """One row (references, mismatches, consistent) of a column ``commitSha`` of all rows that cite one."""
    wrong = F.count_if(~F.col("commitSha").eqNullSafe(F.lit(commit)))
    return references.agg(F.count(F.lit(1)).alias("references"), wrong.alias("mismatches"), (wrong == 0).alias("consistent"))


def gold_problems(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, problem) of gold cases that contradict themselves or their questions."""
    both = questions.select(F.col("id").alias("question_id"), "focus_concept_uid", F.lit(True).alias("asked")).join(gold.withColumn("answered", F.lit(True)), "question_id", "full")
    required = F.coalesce("required_concept_uids", F.array().cast("array<string>"))
    paths = F.coalesce("required_paths", F.array().cast("array<array<string>>"))
    ends = F.transform(paths, lambda p: F.try_element_at(p, F.lit(-1)))
    rules = {
        "no gold case": F.col("answered").isNull(),
        "no such question": F.col("asked").isNull(),
        "required and excluded overlap": F.arrays_overlap(required, F.coalesce("excluded_concept_uids", F.array().cast("array<string>"))),
        "a path is longer than three": F.exists(paths, lambda p: F.size(p) > 3),
        "a path does not start at the focus": F.exists(paths, lambda p: ~F.try_element_at(p, F.lit(1)).eqNullSafe(F.col("focus_concept_uid"))),
        "a path does not end at a required concept": F.exists(ends, lambda e: ~F.array_contains(required, e)),
        "a required concept has no path": F.size(F.array_except(required, ends)) > 0,
        "a required concept has no status": F.size(F.array_except(required, F.coalesce(F.map_keys("required_statuses"), F.array().cast("array<string>")))) > 0,
    }
    ok = F.col("answered") & F.col("asked")
    found = F.array_compact(F.array(*[F.when(F.coalesce(c if n.startswith("no ") else ok & c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    repeats = questions.groupBy(F.col("id").alias("question_id")).count().filter("count > 1").select("question_id", F.lit("the question is repeated").alias("problem"))
    return both.select("question_id", F.explode(found).alias("problem")).unionByName(repeats)


# Fixed order of the calls of a traced session.
CALLS = ("resolve_concepts", "get_neighbors", "trace_provenance", "read_concepts")


def trace_problems(calls: DataFrame) -> DataFrame:
    """(session, problem) of sessions whose calls are not the fixed four in order, chained by concept and commit.

    ``calls``: session, pos, name, status, concept_id, result_ids (array), commit.
    """
    seq = F.array_sort(F.collect_list(F.struct("pos", "name", "status", "concept_id", "result_ids", "commit")))
    rows = calls.groupBy("session").agg(seq.alias("c"))
    names = F.transform("c", lambda x: x["name"])
    first = F.try_element_at("c", F.lit(1))
    rules = {
        "other calls or order": names != F.array(*[F.lit(n) for n in CALLS]),
        "a call failed": F.exists("c", lambda x: ~x.status.eqNullSafe(F.lit("completed"))),
        "a call takes an id that resolving did not give": F.exists(F.slice("c", F.lit(2), F.greatest(F.lit(0), F.size("c") - 1)), lambda x: ~F.coalesce(F.array_contains(first.result_ids, x.concept_id), F.lit(False))),
        "commits differ": F.size(F.array_distinct(F.transform("c", lambda x: x.commit))) != 1,
    }
    return rows.select("session", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("problem"))
