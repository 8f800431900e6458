"""The query surface: browse, resolve, neighbours, backlinks, paths, reads, provenance.

All functions take the ``nodes`` and ``edges`` of one snapshot and return
DataFrames. ``pos`` is the ordinal of a row in the snapshot; every order ends
with it, so ties are settled as the input has them. Traversals run for a batch
of roots at once: a ``root`` column is carried through, and the number of
levels is a fixed bound, so a plan has that many joins and no driver loop over
rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import normalize_query, query_text, utf16_length, utf16_prefix
from lattica.operators.adjacency import DIRECTIONS, Adjacency, steps_from
from lattica.operators.ordinals import numbered
from lattica.sources.shared import dematerialized, few, materialized

BOUNDS = {"limit": (1, 100), "offset": (0, 1_000_000), "terms": (1, 20), "term_length": (2, 200), "types": (0, 20), "tags": (0, 20), "edge_types": (0, 20), "neighbor_hops": (1, 2), "path_hops": (1, 6), "reads": (1, 10), "read_chars": (1_000, 50_000)}
READ_BUDGET = 100_000


class NotFound(LookupError):
    """A requested id is not a Concept of the snapshot."""


def check(name: str, value: int) -> int:
    low, high = BOUNDS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} lies between {low} and {high}, not {value}")
    return value


def concepts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "Concept")


def of_ids(nodes: DataFrame, level: DataFrame) -> DataFrame:
    """``nodes`` that may join ``level`` (id, ...) of a written table: where it has few rows only its own nodes, found without a shuffle."""
    return nodes.join(F.broadcast(level.select("id").distinct()), "id", "left_semi") if few(level) else nodes


def only_concepts(level: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """The rows of ``level`` (id, ...) whose id is a Concept, in a written table. An :class:`Adjacency` has no other steps."""
    level = materialized(level)
    if isinstance(edges, Adjacency):
        return level
    out = materialized(level.join(of_ids(concepts(nodes).select("id"), level), "id", "left_semi").select(level.columns))
    dematerialized(level)
    return out


def require(nodes: DataFrame, ids: Sequence[str]) -> None:
    """All ids are Concepts, or :class:`NotFound`."""
    have = {r["id"] for r in concepts(nodes).filter(F.col("id").isin(list(ids))).select("id").distinct().collect()}
    if missing := [i for i in dict.fromkeys(ids) if i not in have]:
        raise NotFound(f"not_found: {', '.join(missing)}")


# ------------------------------------------------------------------- filters


def in_directory(directory: str) -> Column:
    return F.lit(True) if directory == "." else F.startswith(F.col("path"), F.lit(directory.rstrip("/") + "/"))


def of_types(types: Sequence[str] | None, nfkc: bool = True) -> Column:
    """Any of the types; None is no filter, an empty list matches nothing."""
    if types is None:
        return F.lit(True)
    check("types", len(types))
    return normalize_query("type", nfkc).isin([query_text(t) for t in types]) if types else F.lit(False)


def with_tags(tags: Sequence[str] | None, nfkc: bool = True) -> Column:
    """All of the tags; None and an empty list are no filter."""
    if not tags:
        return F.lit(True)
    check("tags", len(tags))
    wanted = F.array(*[F.lit(query_text(t)) for t in tags])
    have = F.array_distinct(F.transform("tags", lambda t: F.trim(F.lower(t)))) if not nfkc else F.split(normalize_query(F.array_join("tags", "\x1f"), True), r"\s*\x1f\s*")
    return F.size(F.array_except(wanted, have)) == 0


def of_edge_types(types: Sequence[str] | None) -> Column:
    check("edge_types", len(types or ()))
    return F.col("type").isin(list(types)) if types else F.lit(True)


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page of the ordered rows."""
    return rows.orderBy(*order).offset(check("offset", offset)).limit(check("limit", limit))


def page_info(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """(total, count, offset, has_more, next_offset) of a page of ``rows``."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    count = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)).cast("long")
    more = F.col("total") > offset + count
    return n.select("total", count.alias("count"), F.lit(offset).cast("long").alias("offset"), (more & (count > 0)).alias("has_more"), F.when(more & (count > 0), F.lit(offset) + count).alias("next_offset"))


# ------------------------------------------------------------- browse, resolve


def browse_rows(nodes: DataFrame, directory: str = ".", types: Sequence[str] | None = None, tags: Sequence[str] | None = None, nfkc: bool = True) -> DataFrame:
    return concepts(nodes).filter(in_directory(directory) & of_types(types, nfkc) & with_tags(tags, nfkc))


def browse(nodes: DataFrame, directory: str = ".", types: Sequence[str] | None = None, tags: Sequence[str] | None = None, limit: int = 20, offset: int = 0, collation: str | None = None, nfkc: bool = True) -> DataFrame:
    """Concepts under a directory, by path and title; ``collation`` (say ``UNICODE``) for a locale's order."""
    key = lambda c: F.collate(c, collation) if collation else F.col(c)
    return page(browse_rows(nodes, directory, types, tags, nfkc), [key("path"), key("title"), F.col("pos")], limit, offset)


# Fixed weights of the rules, strongest first.
WEIGHTS = (("title", 100), ("aliases", 90), ("tags", 80), ("type", 70), ("prefix", 60), ("substring", 40), ("path", 20), ("summary", 10))


def resolve_rows(nodes: DataFrame, terms: Sequence[str], types: Sequence[str] | None = None, tags: Sequence[str] | None = None, nfkc: bool = True) -> DataFrame:
    """Concepts that match any term: adds score, matched_terms, n_matched and matched_fields.

    For each term the first rule that holds counts. The terms become columns of
    one expression, so nothing is joined or exploded.
    """
    check("terms", len(terms))
    wanted = [query_text(t) for t in terms]
    for t in wanted:
        check("term_length", len(t))
    norm = lambda c: normalize_query(F.coalesce(c, F.lit("")), nfkc)
    listed = lambda c: F.split(norm(F.concat_ws("\x1f", F.col(c))), r"\s*\x1f\s*")
    rows = concepts(nodes).filter(of_types(types, nfkc) & with_tags(tags, nfkc))
    rows = once(rows, _title=norm(F.col("title")), _type=norm(F.col("type")), _path=norm(F.col("path")), _summary=norm(F.col("summary")), _aliases=listed("aliases"), _tags=listed("tags"))
    hits = F.array(*[_rule(F.lit(x), t) for x, t in zip(wanted, terms)])
    rows = once(rows, _hits=F.filter(hits, lambda h: h.w > 0)).filter(F.size("_hits") > 0)
    rows = rows.withColumns(
        {
            "score": F.aggregate("_hits", F.lit(0), lambda a, h: a + h.w),
            "matched_terms": F.transform("_hits", lambda h: h.t),
            "n_matched": F.size("_hits"),
            "matched_fields": F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h.f))),
        }
    )
    return rows.drop("_title", "_type", "_path", "_summary", "_aliases", "_tags", "_hits")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once a row: the generator keeps filters and projections above it apart from them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _rule(x: Column, term: str) -> Column:
    """The first rule that holds for a normalised term, as (w, f, t); weight 0 if none does."""
    begins = F.startswith("_title", x), F.exists("_aliases", lambda a: F.startswith(a, x))
    holds = F.contains("_title", x), F.exists("_aliases", lambda a: F.contains(a, x))
    weight = dict(WEIGHTS)
    rules = [
        (F.col("_title") == x, "title", "title"),
        (F.array_contains("_aliases", x), "aliases", "aliases"),
        (F.array_contains("_tags", x), "tags", "tags"),
        (F.col("_type") == x, "type", "type"),
        (begins[0], "prefix", "title"),
        (begins[1], "prefix", "aliases"),
        (holds[0], "substring", "title"),
        (holds[1], "substring", "aliases"),
        (F.contains("_path", x), "path", "path"),
        (F.contains("_summary", x), "summary", "summary"),
    ]
    hit = lambda w, f: F.struct(F.lit(w).alias("w"), F.lit(f).cast("string").alias("f"), F.lit(term).alias("t"))
    first, *others = [(condition, hit(weight[name], field)) for condition, name, field in rules]
    out = F.when(*first)
    for condition, value in others:
        out = out.when(condition, value)
    return out.otherwise(hit(0, None))


def resolve(nodes: DataFrame, terms: Sequence[str], types: Sequence[str] | None = None, tags: Sequence[str] | None = None, limit: int = 20, offset: int = 0, collation: str | None = None, nfkc: bool = True) -> DataFrame:
    """Ranked matches: most terms, then score, then title."""
    title = F.collate("title", collation) if collation else F.col("title")
    return page(resolve_rows(nodes, terms, types, tags, nfkc), [F.col("n_matched").desc(), F.col("score").desc(), title, F.col("pos")], limit, offset)


# ------------------------------------------------------------------ traversal


def moves(frontier: DataFrame, edges: DataFrame | Adjacency, direction: str, edge_types: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """The steps from the rows of ``frontier`` (at, ...): with next, dir, edge_pos and edge_id.

    Only the frontier's own edges are looked up, in an :class:`Adjacency` by
    blocks, of which ``most`` reads the first steps of each node only; it has
    steps to Concepts only. In a plain edge table each direction is looked up by
    itself: a frontier of few rows goes to all tasks, so no edge is shuffled, and
    a large one is shuffled. There a step may lead to any node, see
    :func:`only_concepts`, and an edge may be repeated.
    """
    if isinstance(edges, Adjacency):
        return steps_from(frontier, edges, direction, most)
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    some = edges.filter(of_edge_types(edge_types))
    frontier = F.broadcast(frontier) if few(frontier) else frontier.hint("shuffle_hash")
    met = []
    for name, dir_, here, there in (("outgoing", 0, "from", "to"), ("incoming", 1, "to", "from")):
        if direction in (name, "both"):
            ends = some.select(F.col(here).alias("_here"), F.col(there).alias("next"), F.col("pos").alias("edge_pos"), F.col("id").alias("edge_id"))
            met.append(frontier.join(ends, F.col("at") == F.col("_here")).drop("_here").withColumn("dir", F.lit(dir_)))
    return met[0] if len(met) == 1 else met[0].unionByName(met[1])


def served(edges: DataFrame | Adjacency, edge_types: Sequence[str] | None) -> DataFrame | Adjacency:
    """The adjacency if it holds the steps of just these edge types, else the edges."""
    return edges.edges if isinstance(edges, Adjacency) and not edges.serves(edge_types) else edges


def _discovered(steps: DataFrame, seen: DataFrame, level: int) -> DataFrame:
    """First discovery of every node one step on: (root, id, distance, prev, via, order), order as a queue would have it."""
    first = steps.groupBy("root", F.col("next").alias("id")).agg(F.min(F.struct("parent", "dir", "edge_pos", F.col("at").alias("prev"), F.col("edge_id").alias("via"))).alias("order"))
    return first.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(level).alias("distance"), "order.prev", "order.via", "order")


def walk(roots: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int, direction: str = "both", edge_types: Sequence[str] | None = None, limit: int | None = None, ranked: bool = True) -> DataFrame:
    """Breadth-first walk from each root: (root, id, distance, rank, prev, via, kept).

    Rows with ``kept`` are the result, the root at rank 0 among them; with a
    ``limit`` only the first so many discoveries of a root are kept (and walked
    from), and the first one left out stays as a row with ``kept`` false. A walk
    without a limit that is not ``ranked`` leaves ``rank`` null and numbers nothing.
    """
    edges = served(edges, edge_types)
    if limit is None:
        return _whole_walk(roots, nodes, edges, max_hops, direction, edge_types, ranked)
    start = roots.select("root").distinct()
    seen = start.select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("prev"), F.lit(None).cast("string").alias("via"), F.lit(True).alias("kept"))
    frontier = seen
    for level in range(1, max_hops + 1):
        steps = moves(frontier.select("root", F.col("id").alias("at"), F.col("rank").alias("parent")), edges, direction, edge_types)
        found = only_concepts(_discovered(steps, seen, level), nodes, edges)
        before = seen.groupBy("root").agg(F.max("rank").alias("before"), F.bool_or(~F.col("kept")).alias("full"))
        placed = _placed(found.select("*", "order.parent", "order.dir", "order.edge_pos").drop("order"), ["parent", "dir", "edge_pos"])
        new = placed.join(before, "root").withColumn("rank", F.col("before") + F.col("nth")).filter((F.col("rank") <= limit + 1) & ~F.col("full"))
        new = new.select("root", "id", "distance", "rank", "prev", "via", (F.col("rank") <= limit).alias("kept"))
        new = materialized(new)  # later levels read it three times; plans would grow with every one
        seen = seen.unionByName(new)
        frontier = new.filter("kept")
    return seen


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``nth``, 1, 2, ... for each root: ordinals over all roots less that of the root's first, so no task holds a whole root."""
    numbers = numbered(rows, [F.col("root"), *[F.col(c) for c in order]], "nth")
    first = numbers.groupBy("root").agg(F.min("nth").alias("_first"))
    return numbers.join(first, "root").withColumn("nth", (F.col("nth") - F.col("_first") + 1).cast("int")).drop("_first")


def _whole_walk(roots: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int, direction: str, edge_types: Sequence[str] | None, ranked: bool) -> DataFrame:
    """A walk without a limit: each row carries its way as a list of steps, whose order is that of a queue, and ranks are given at the end."""
    pos = (edges.edges if isinstance(edges, Adjacency) else edges).schema["pos"].dataType.simpleString()
    none = F.array().cast(f"array<struct<dir:int,edge_pos:{pos},prev:string,via:string>>")
    seen = roots.select("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), none.alias("way"))
    frontier = seen
    for level in range(1, max_hops + 1):
        steps = moves(frontier.select("root", F.col("id").alias("at"), "way"), edges, direction, edge_types)
        way = F.concat("way", F.array(F.struct("dir", "edge_pos", F.col("at").alias("prev"), F.col("edge_id").alias("via"))))
        best = steps.select("root", F.col("next").alias("id"), way.alias("way")).groupBy("root", "id").agg(F.min("way").alias("way"))
        frontier = only_concepts(best.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(level).alias("distance"), "way"), nodes, edges)
        seen = seen.unionByName(frontier)
    rank = F.lit(None).cast("int")
    if ranked:
        seen, rank = _placed(seen, ["distance", "way"]), F.col("nth") - 1
    last = F.try_element_at("way", F.lit(-1))
    return seen.select("root", "id", "distance", rank.alias("rank"), last["prev"].alias("prev"), last["via"].alias("via"), F.lit(True).alias("kept"))


def walked_edges(kept: DataFrame, edges: DataFrame | Adjacency, max_hops: int, direction: str = "both", edge_types: Sequence[str] | None = None) -> DataFrame:
    """(root, edge_id, edge_pos) of the edges walked over from an expanded node (distance below ``max_hops``) with both ends in ``kept``."""
    if isinstance(edges, Adjacency):
        edges = edges.edges  # parallel edges count
    expanded = kept.filter(F.col("distance") < max_hops).select("root", F.col("id").alias("at"))
    ends = kept.select("root", F.col("id").alias("next"))
    return moves(expanded, edges, direction, edge_types).join(ends, ["root", "next"], "left_semi").select("root", "edge_id", "edge_pos").distinct()


def neighbors(roots: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int = 1, direction: str = "both", edge_types: Sequence[str] | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (see :func:`walked_edges`) and truncation flag of each root's neighbourhood.

    ``truncated`` is true where a Concept within reach was left out for the limit.
    """
    check("neighbor_hops", max_hops), check("limit", limit)
    reached = walk(roots, nodes, edges, max_hops, direction, edge_types, limit)
    kept = reached.filter("kept")
    flags = reached.groupBy("root").agg(F.bool_or(~F.col("kept")).alias("truncated"))
    return kept, walked_edges(kept, edges, max_hops, direction, edge_types), flags


def backlinks_rows(target: str, nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str] | None = None) -> DataFrame:
    """One row for each edge into ``target`` from a Concept."""
    into = edges.filter((F.col("to") == target) & of_edge_types(edge_types)).select(F.col("id").alias("edge_id"), F.col("from"), F.col("type").alias("edge_type"), F.col("label"), F.col("pos").alias("edge_pos"))
    into = materialized(into)
    source = of_ids(concepts(nodes), into.select(F.col("from").alias("id")))
    return into.join(source.select(F.col("id").alias("from"), F.col("title").alias("source_title"), F.col("path").alias("source_path")), "from")


def backlink_counts(nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str] | None = None) -> DataFrame:
    """(id, n_backlinks) of every node that an edge from a Concept leads to."""
    into = edges.filter(of_edge_types(edge_types)).select("from", F.col("to").alias("id"))
    return into.join(concepts(nodes).select(F.col("id").alias("from")), "from", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_backlinks"))


def backlinks(target: str, nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str] | None = None, limit: int = 20, offset: int = 0, collation: str | None = None) -> DataFrame:
    title = F.collate("source_title", collation) if collation else F.col("source_title")
    return page(backlinks_rows(target, nodes, edges, edge_types), [title, F.col("edge_pos")], limit, offset)


def provenance(ids: Sequence[str] | DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DERIVED_FROM edges of the concepts with their Source nodes: (concept_id, edge_id, source_id, title, resource)."""
    derived = edges.filter(F.col("type") == "DERIVED_FROM")
    derived = derived.filter(F.col("from").isin(list(ids))) if not isinstance(ids, DataFrame) else derived.join(ids.select(F.col("id").alias("from")), "from", "left_semi")
    source = nodes.filter(F.col("kind") == "Source").select(F.col("id").alias("source_id"), "title", "resource")
    return derived.select(F.col("from").alias("concept_id"), F.col("id").alias("edge_id"), F.col("to").alias("source_id"), F.col("pos").alias("edge_pos")).join(source, "source_id")


# ---------------------------------------------------------------------- reads


def budgeted(rows: DataFrame, text: str = "text", pos: str = "pos", per_document: int = 20_000, budget: int = READ_BUDGET, group: str | None = None) -> DataFrame:
    """Cut each text to what is left of the shared budget, in order: adds content, truncated, total_characters.

    Characters are UTF-16 units. A cut within a surrogate pair leaves out its
    first half too, which still counts as spent.
    """
    n = utf16_length(text)
    own = F.least(n, F.lit(per_document))
    window = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.least(own, F.lit(budget) - F.coalesce(F.sum(own).over(window), F.lit(0)))).cast("int")
    return rows.withColumn("_room", room).withColumns({"content": utf16_prefix(text, F.col("_room")), "truncated": F.col("_room") < n, "total_characters": n}).drop("_room")


def verified_documents(nodes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts joined to their documents by path, and those whose content hash disagrees or whose document is missing."""
    docs = documents.select(F.col("path").alias("doc_path"), F.col("raw"))
    joined = concepts(nodes).join(docs, F.col("path") == F.col("doc_path"), "left").drop("doc_path")
    bad = joined.filter(F.col("raw").isNull() | (F.sha2("raw", 256) != F.col("contentHash")))
    return joined, bad


def read_concepts(ids: Sequence[str], nodes: DataFrame, documents: DataFrame, max_chars: int = 20_000, commit: str | None = None, budget: int = READ_BUDGET) -> DataFrame:
    """Documents of up to ten concepts in the order asked for, hash-verified whole and then cut to the budget."""
    wanted = list(dict.fromkeys(ids))
    check("reads", len(wanted)), check("read_chars", max_chars)
    require(nodes, wanted)
    order = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col("id"))
    joined, bad = verified_documents(nodes.filter(F.col("id").isin(wanted)), documents)
    if commit is not None and (other := nodes.filter(F.col("id").isin(wanted) & (F.col("commitSha") != commit)).limit(1).count()):
        raise ValueError(f"commit_mismatch: {other}")
    if (first := bad.select("id").limit(1).collect()):
        raise ValueError(f"content_hash_mismatch: {first[0]['id']}")
    return budgeted(joined.withColumn("order", order), "raw", "order", max_chars, budget).orderBy("order")


def typed_walk(focus: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, most_hops: int = 2, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """Evaluation walk for a batch: rows (root, id, distance, candidate, found_from, nth) and the roots it was cut for.

    ``focus`` has root (a label), id (where it starts), statuses, types (arrays;
    null types are any) and max_hops (at most ``most_hops``). A node of another
    status is visited but neither a candidate nor expanded; a node of another
    type is expanded but no candidate. Each node passes on its first ``cap``
    neighbours, outgoing ones first: they are among its first 2 * (``cap`` + 1)
    steps, since a neighbour is met in each direction once, and no more are read
    of an :class:`Adjacency`. A level's nodes are found in the order of
    ``found_from`` and ``nth``.
    """
    edges = served(edges, ["LINKS_TO"])
    rules = focus.select("root", "statuses", "types", "max_hops")
    here = Window.partitionBy("root", "at")
    seen = focus.select("root", "id", F.lit(0).alias("distance"), F.lit(False).alias("candidate"), F.lit(None).cast("string").alias("found_from"), F.lit(0).alias("nth"))
    frontier, cut = focus.select("root", "id", "statuses", "types", "max_hops"), []
    info = concepts(nodes).select("id", "status", "type")
    for level in range(1, most_hops + 1):
        steps = moves(frontier.filter(F.col("max_hops") >= level).select("root", F.col("id").alias("at")), edges, "both", ["LINKS_TO"], 2 * (cap + 1))
        met = steps.groupBy("root", "at", F.col("next").alias("id")).agg(F.min(F.struct("dir", "edge_pos")).alias("o"))
        placed = only_concepts(met, nodes, edges).withColumn("nth", F.row_number().over(here.orderBy("o.dir", "o.edge_pos")))
        met = materialized(placed.filter(F.col("nth") <= cap + 1).select("root", "at", "id", "nth"))
        cut.append(met.filter(F.col("nth") > cap).select("root"))
        first = met.filter(F.col("nth") <= cap).groupBy("root", "id").agg(F.min(F.struct(F.col("at").alias("found_from"), "nth")).alias("o"))
        new = first.join(seen.select("root", "id"), ["root", "id"], "left_anti").join(of_ids(info, met), "id").join(rules, "root")
        allowed = F.array_contains("statuses", F.col("status"))
        typed = F.col("types").isNull() | F.coalesce(F.array_contains("types", F.col("type")), F.lit(False))
        new = new.select("root", "id", F.lit(level).alias("distance"), (allowed & typed).alias("candidate"), "o.found_from", "o.nth", allowed.alias("allowed"), "statuses", "types", "max_hops")
        new = materialized(new)
        seen = seen.unionByName(new.select(seen.columns))
        frontier = new.filter("allowed")
    return seen, reduce(DataFrame.unionByName, cut).distinct()


def expand_typed(focus: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, max_hops: int = 2, statuses: Sequence[str] = ("stable",), types: Sequence[str] | None = None, cap: int = 100) -> DataFrame:
    """:func:`typed_walk` from each root with one set of rules: (root, id, distance, candidate)."""
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    start = focus.select("root", F.col("root").alias("id"), texts(statuses).alias("statuses"), (texts(types) if types is not None else F.lit(None).cast("array<string>")).alias("types"), F.lit(max_hops).alias("max_hops"))
    return typed_walk(start.distinct(), nodes, edges, max_hops, cap)[0].select("root", "id", "distance", "candidate")
