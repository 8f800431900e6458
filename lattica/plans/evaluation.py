"""Evaluation of retrieval over a bundle: a lexical and a graph arm for a set of questions, their metrics and the report.

Questions are few, and each is resolved by itself; chunks, walks, paths and
metrics of all questions are one plan each.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import bm25, evaluate, graph, paths, term_match
from lattica.operators.adjacency import adjacency
from lattica.operators.project import Projection, concept_fields
from lattica.sources.shared import materialized

#: Questions of one run; they are held by the driver.
MOST_QUESTIONS = 1000
#: Candidates that a walk may find, and neighbours that a node passes on.
HARD_LIMIT = 100
LEXICAL, GRAPH = "lexical", "graph"


@dataclass(frozen=True)
class Evaluation:
    cases: DataFrame  # a row for each question and arm, with its metrics
    acceptance: DataFrame  # the graph arm's rows with their checks
    means: DataFrame
    deltas: DataFrame
    verdict: DataFrame

    def report(self) -> dict:
        """The run as one JSON-ready value: cases, means of the arms, differences and the verdict."""
        rows = lambda df, *order: [json.loads(r[0]) for r in (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*"))).collect()]
        return {"cases": rows(self.acceptance, "question_id"), "arms": rows(self.means, "arm"), "deltas": rows(self.deltas)[0], "verdict": rows(self.verdict)[0]}


def metadata(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Concepts with their uid: the header's, or the concept's id in the bundle (uid, id, path, title, type, status, aliases, tags, body)."""
    fields = concept_fields(documents).select(F.coalesce("uid", "conceptId", "path").alias("uid"), "path", "body")
    some = graph.concepts(nodes).select("id", "path", "title", "type", "status", "aliases", "tags")
    return some.join(fields, "path")


def unique_uids(info: DataFrame) -> None:
    """Every uid names one concept, or ``ValueError``."""
    if twice := info.groupBy("uid").count().filter("count > 1").orderBy("uid").limit(1).collect():
        raise ValueError(f"several concepts have the uid {twice[0]['uid']}")


def relevance(nodes: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The focus of each question (id, terms, statuses), and the concepts that its terms match: (question_id, id), (question_id, id, score, n_matched).

    The first term names the focus: the best match of an allowed status among
    the first 20. All questions, and both their lists, are resolved in one pass.
    """
    whole = questions.select(F.struct("id", F.lit(False).alias("focus")).alias("question_id"), "terms")
    first = questions.select(F.struct("id", F.lit(True).alias("focus")).alias("question_id"), F.slice("terms", 1, 1).alias("terms"))
    matches = materialized(term_match.best_batch(nodes, whole.unionByName(first), 100).select("question_id.*", F.col("id").alias("concept"), "score", "n_matched", "rank"))
    named = matches.filter(F.col("focus") & (F.col("rank") <= 20)).join(graph.concepts(nodes).select(F.col("id").alias("concept"), "status"), "concept")
    allowed = named.join(questions.select("id", "statuses"), "id").filter(F.array_contains("statuses", F.col("status")))
    focus = allowed.groupBy(F.col("id").alias("question_id")).agg(F.min_by("concept", "rank").alias("id"))
    return focus, matches.filter("not focus").select(F.col("id").alias("question_id"), F.col("concept").alias("id"), "score", "n_matched")


def top_of_walk(found: DataFrame, info: DataFrame, matched: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates of a walk (root, id, ...) ranked by matched terms, score, distance, title and uid, the question's top_k of them."""
    order = Window.partitionBy("root").orderBy("distance", "found_from", "nth")
    some = found.filter("candidate").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HARD_LIMIT)
    scored = some.join(info.select("id", "uid", "title"), "id").join(matched.withColumnRenamed("question_id", "root"), ["root", "id"], "left").na.fill({"score": 0, "n_matched": 0})
    rank = Window.partitionBy("root").orderBy(F.col("n_matched").desc(), F.col("score").desc(), "distance", "title", "uid")
    asked = questions.select(F.col("id").alias("root"), "top_k")
    return scored.join(F.broadcast(asked), "root").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= F.col("top_k"))


def run(documents: DataFrame, projection: Projection, questions: DataFrame, gold: DataFrame, rules: evaluate.Rules, commit: str) -> Evaluation:
    """Both arms over all questions (see ``sources.graph_files`` for questions and gold cases).

    Raises ``ValueError`` for questions whose terms are not their query's or ask
    for no result type, and for gold cases that contradict themselves.
    """
    spark = documents.sparkSession
    if problems := evaluate.gold_problems(questions, gold).limit(5).collect():
        raise ValueError("; ".join(f"{p['question_id']}: {p['problem']}" for p in problems))
    asked = questions.orderBy("pos").limit(MOST_QUESTIONS + 1).collect()
    if len(asked) > MOST_QUESTIONS:
        raise ValueError(f"at most {MOST_QUESTIONS} questions")
    types = {q["id"]: evaluate.requested_types(q["query"], list(q["terms"]), rules) for q in asked}
    wanted = spark.createDataFrame([(q["id"], "\n".join(q["terms"]), list(q["terms"]), types[q["id"]], list(q["allowed_statuses"]), q["focus_concept_uid"], q["top_k"], q["max_hops"]) for q in asked], "id string, query string, terms array<string>, types array<string>, statuses array<string>, focus_uid string, top_k int, max_hops int")
    nodes, edges = materialized(projection.nodes), materialized(projection.edges)
    info = materialized(metadata(documents, nodes))
    unique_uids(info)

    # the lexical arm: chunks by BM25, the best of each concept
    chunks = materialized(bm25.chunk(info))
    scored = bm25.search(chunks, wanted.select(F.col("id").alias("query_id"), "query", "types", "statuses"), statuses=None, query_types=True)
    ranked = bm25.top_chunks(scored, chunks, 1 << 30).join(F.broadcast(wanted.select(F.col("id").alias("query_id"), "focus_uid", "top_k")), "query_id")
    best = bm25.best_per_concept(ranked, F.col("focus_uid"), F.col("top_k"))
    lexical = best.select(F.col("query_id").alias("question_id"), "rank", "uid")

    # the graph arm: resolve the focus, walk, rank by relevance, prove each candidate by a path
    focus, matched = relevance(nodes, wanted)
    start = focus.join(wanted.select(F.col("id").alias("question_id"), "statuses", "types", "max_hops"), "question_id").withColumnRenamed("question_id", "root")
    most_hops = max((q["max_hops"] for q in asked), default=1)
    found, cut = graph.typed_walk(start.select("root", "id", "statuses", "types", "max_hops"), nodes, edges, most_hops, HARD_LIMIT)
    top = materialized(top_of_walk(found, info, matched, wanted))
    crowded = found.filter("candidate").groupBy("root").count().filter(F.col("count") > HARD_LIMIT).select("root")
    many = start.join(edges.filter("type = 'LINKS_TO'").select(F.col("to").alias("id")), "id").groupBy("root").count().filter(F.col("count") > HARD_LIMIT).select("root")
    truncated = cut.unionByName(crowded).unionByName(many).distinct().withColumn("truncated", F.lit(True))
    pairs = top.select(F.col("root").alias("question_id"), F.col("id").alias("target"), "rank").join(start.select(F.col("root").alias("question_id"), F.col("id").alias("root"), "max_hops"), "question_id")
    links = adjacency(nodes, edges, ["LINKS_TO"])
    ways = paths.find_paths(pairs, nodes, links, most_hops, "both", ["LINKS_TO"])
    uids = info.select("id", "uid")
    steps = pairs.join(ways, ["root", "target"]).filter(F.col("hop_count") <= F.col("max_hops")).select("question_id", "rank", F.posexplode("node_ids").alias("nth", "id")).join(uids, "id")
    proved = steps.groupBy("question_id", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "uid"))), lambda x: x.uid).alias("path")).groupBy("question_id").agg(F.collect_list("path").alias("supported_paths"))
    resolved = focus.join(uids, "id").select("question_id", F.col("uid").alias("resolved_uid"))

    # both arms against the gold cases
    listed = lambda rows, arm: rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "uid"))), lambda x: x.uid).alias("retrieved")).withColumn("arm", F.lit(arm))
    graph_rows = top.select(F.col("root").alias("question_id"), "rank", "uid")
    arms = listed(lexical, LEXICAL).unionByName(listed(graph_rows, GRAPH))
    each = wanted.select(F.col("id").alias("question_id"), "focus_uid").withColumn("arm", F.explode(F.array(F.lit(LEXICAL), F.lit(GRAPH))))
    checked = gold.select("question_id", F.explode(F.map_keys("required_statuses")).alias("uid")).distinct().join(info.select("uid", "status"), "uid")
    statuses = checked.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("uid", "status"))).alias("every_status"))  # of a case's own concepts
    none = F.array().cast("array<string>")
    cases = each.join(arms, ["question_id", "arm"], "left").join(gold.drop("pos", "expected_commit_sha"), "question_id").join(proved, "question_id", "left").join(resolved, "question_id", "left")
    cases = cases.join(truncated.withColumnRenamed("root", "question_id"), "question_id", "left").join(statuses, "question_id", "left")
    of_graph = F.col("arm") == GRAPH
    cases = cases.select(
        "question_id",
        "arm",
        F.coalesce("retrieved", none).alias("retrieved"),
        F.coalesce("required_concept_uids", none).alias("required"),
        F.coalesce("excluded_concept_uids", none).alias("excluded"),
        F.coalesce("required_statuses", F.create_map().cast("map<string,string>")).alias("required_statuses"),
        F.coalesce("every_status", F.create_map().cast("map<string,string>")).alias("actual_statuses"),
        F.coalesce("required_paths", F.array().cast("array<array<string>>")).alias("required_paths"),
        F.when(of_graph, F.coalesce("supported_paths", F.array().cast("array<array<string>>"))).alias("supported_paths"),
        F.col("resolved_uid").eqNullSafe(F.col("focus_uid")).alias("focus_matched"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
    measured = materialized(evaluate.metrics(cases).drop("actual_statuses"))
    accepted = evaluate.acceptance(measured.filter(F.col("arm") == GRAPH))
    means = evaluate.macro_averages(measured)
    cited = nodes.select("commitSha").unionByName(edges.select("commitSha"))
    whole = evaluate.commit_integrity(cited, commit).first()["consistent"]
    expected = {r["expected_commit_sha"] for r in gold.select("expected_commit_sha").distinct().collect()} <= {None, "CURRENT", "WORKTREE", commit}
    return Evaluation(measured, accepted, means, evaluate.deltas(means, GRAPH, LEXICAL), evaluate.roll_up(accepted, whole, expected))
