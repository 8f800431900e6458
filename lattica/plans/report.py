"""Report data of an evaluation: a row for each question with both arms side by side, and the texts that a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import fixed
from lattica.plans.evaluation import GRAPH, LEXICAL

# Fixed words of the report: parts of a uid that are abbreviations, and what a uid's namespace means.
ABBREVIATION = r"(?i)^(?:iol|pkg|pal|fat|sat|fb|cr|sb|io|m8|m8s|v\d+)$"
KINDS = (
    (":machine-variant:", "Delivered variant"),
    (":component:", "Component"),
    (":io-map:", "I/O mapping"),
    (":plc:", "PLC diagnostic"),
    (":parameter-set:", "Parameter set"),
    (":test:", "FAT / SAT evidence"),
    (":service-bulletin:", "Service bulletin"),
    (":change-request:", "Controlled change"),
)
OTHER_KIND = "Knowledge concept"
METRICS = ("recall", "precision", "f1", "path_recall")


def _hundredths(c: Column | str) -> Column:
    """The whole number of hundredths, halves upwards; a null is none."""
    value = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("double")
    return F.floor(value * 100 + 0.5).cast("bigint")


def percent(c: Column | str) -> Column:
    return F.concat(_hundredths(c).cast("string"), F.lit("%"))


def points(c: Column | str) -> Column:
    """A difference in percentage points, with its sign."""
    n = _hundredths(c)
    return F.concat(F.when(n == 0, "±").when(n > 0, "+").otherwise(""), n.cast("string"), F.lit(" pp"))


def decimal(c: Column | str) -> Column:
    """Three decimals of a number by its exact value; 0.000 of a null and of what is no finite number."""
    value = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, fixed(value, 3).cast("decimal(30,3)").cast("string")).otherwise("0.000")


def short_uid(c: Column | str) -> Column:
    """The last part of a uid, its abbreviations in capitals."""
    uid = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("unresolved"))
    words = F.split(F.element_at(F.split(uid, ":"), -1), "-")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(ABBREVIATION), F.upper(w)).otherwise(w)), "-")


def uid_kind(c: Column | str) -> Column:
    """What the first namespace that a uid holds means."""
    uid = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    held = [F.when(F.contains(uid, F.lit(part)), F.lit(name)) for part, name in KINDS]
    return F.coalesce(*held, F.lit(OTHER_KIND))


def report_cases(cases: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a question (id, query, terms, baseline, qam, comparison), from the cases of both arms and the questions (id, query, terms).

    An arm that is missing is null, and so are the differences that need it.
    """
    own = [c for c in cases.columns if c not in ("question_id", "arm")]
    side = lambda arm: F.first(F.when(F.col("arm") == arm, F.struct(*own)), ignorenulls=True)
    both = cases.groupBy("question_id").agg(side(LEXICAL).alias("baseline"), side(GRAPH).alias("qam"))
    delta = {m: F.col(f"qam.{m}") - F.col(f"baseline.{m}") for m in METRICS if m in own}
    compared = F.struct(*[fixed(d, 6).alias(f"{m}_delta") for m, d in delta.items()], *[points(d).alias(f"{m}_points") for m, d in delta.items() if m in ("recall", "precision")])
    asked = questions.select(F.col("id").alias("question_id"), "query", "terms")
    return asked.join(both, "question_id", "left").select(F.col("question_id").alias("id"), "query", "terms", "baseline", "qam", compared.alias("comparison"))


def summary_texts(means: DataFrame) -> DataFrame:
    """The means of each arm as the report shows them: (arm, recall, precision, path_recall)."""
    return means.select("arm", percent("mean_recall").alias("recall"), percent("mean_precision").alias("precision"), decimal("mean_path_recall").alias("path_recall"))
