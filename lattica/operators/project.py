"""Projection of parsed documents to nodes, edges and a manifest, and their flat rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import ID_PREFIX, NUL, concept_identity, derived_title, encoded_path, is_external, is_fragment, is_iso_datetime, iso_datetime_text, nfkc_of, normalize_term, posix_normalized, repository_web_url, sanitized_repository, strip_query_and_fragment, trimmed, uri_decoded, utf16_key, utf16_length, utf16_min, utf16_sorted
from lattica.operators.ordinals import numbered, ranged
from lattica.schema import EDGE, FLAT_EDGE_COLUMNS, FLAT_NODE_COLUMNS, NODE

# Fixed keys of a document's header, in the order in which they count.
UID_KEYS = ('$["x-qam"].uid', '$["x-kg"].uid', "$.uid")
ALIAS_KEYS = ("$.aliases", '$["x-qam"].aliases', '$["x-kg"].aliases')


@dataclass(frozen=True)
class Options:
    """Where the documents come from: repository, commit, time, and their folder in the repository."""

    repository: str
    commit_sha: str
    generated_at: str
    path_in_repository: str = "."
    source_base_url: str | None = None
    prefix: str = ID_PREFIX
    schema_version: str = "1.0"
    okf_version: str = "0.2"

    def __post_init__(self):
        import re

        if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", self.commit_sha):
            raise ValueError("commit_sha is 40 or 64 lower-case hex digits")
        if not iso_datetime_text(self.generated_at):
            raise ValueError("generated_at is an ISO datetime with offset")
        if self.path_in_repository.startswith("/") or ".." in self.path_in_repository.split("/"):
            raise ValueError("path_in_repository stays inside the repository")
        if re.match(r"[a-z+]+://[^/]*@", self.source_base_url or ""):
            raise ValueError("source_base_url carries no credentials")


def _text(*paths: str) -> Column:
    """The first non-empty text at the paths of the header."""
    return F.coalesce(*[F.nullif(trimmed(F.when(F.schema_of_variant(F.try_variant_get("frontmatter", p, "variant")) == "STRING", F.try_variant_get("frontmatter", p, "string"))), F.lit("")) for p in paths])


def _texts(*paths: str) -> Column:
    """Texts of the lists at the paths, in order; anything else is passed over."""
    one = lambda p: F.filter(F.transform(F.coalesce(F.try_variant_get("frontmatter", p, "array<variant>"), F.array().cast("array<variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", trimmed(F.try_variant_get(v, "$", "string")))), lambda s: s.isNotNull() & (s != ""))
    return F.concat(*[one(p) for p in paths])


def concept_fields(documents: DataFrame) -> DataFrame:
    """Concept documents with the header's fields: uid, title, type, summary, resource, status, tags, aliases, sources."""
    status = _text("$.status")
    return documents.filter("kind = 'concept'").select(
        "path",
        "conceptId",
        "contentHash",
        "raw",
        "body",
        "bodyLineOffset",
        "links",
        _text(*UID_KEYS).alias("uid"),
        F.coalesce(_text("$.title"), derived_title("path")).alias("title"),
        F.coalesce(_text("$.type"), F.lit("Concept")).alias("type"),
        _text("$.description").alias("summary"),
        _text("$.resource").alias("resource"),
        F.when(status.isin("draft", "deprecated"), status).otherwise("stable").alias("status"),
        _texts("$.tags").alias("tags"),
        _texts(*ALIAS_KEYS).alias("aliases"),
        F.coalesce(F.try_variant_get("frontmatter", "$.sources", "array<variant>"), F.array().cast("array<variant>")).alias("sources"),
    )


def distinct_values(rows: DataFrame, key: str, column: str, nfkc: bool = True) -> DataFrame:
    """(key, value, norm) one row for each normalised value of a list column: the smallest spelling, by UTF-16 units."""
    each = rows.select(key, F.explode(column).alias("value")).withColumn("norm", normalize_term("value", nfkc)).filter("norm <> ''")
    return each.groupBy(key, "norm").agg(utf16_min("value").alias("value"))


def group_nodes(values: DataFrame, kind: str, prefix: str = ID_PREFIX) -> DataFrame:
    """Tag or Term nodes of (norm, value): title is the smallest spelling, aliases all of them."""
    return values.groupBy("norm").agg(utf16_min("value").alias("title"), utf16_sorted(F.collect_set("value")).alias("aliases")).select(F.concat(F.lit(f"{prefix}:{kind.lower()}:"), F.sha2("norm", 256)).alias("id"), F.lit(kind).alias("kind"), "title", F.lit(kind).alias("type"), "aliases", F.col("norm").alias("normalizedValue"))


def source_nodes(values: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Source nodes of (canon, title, source_id, author, usage_count, last_modified), grouped by canonical resource."""
    title = F.coalesce(utf16_min("title"), F.when(utf16_length("canon") > 1024, F.lit("Source")).otherwise(F.col("canon")))
    return values.groupBy("canon").agg(
        title.alias("title"),
        utf16_sorted(F.collect_set("title")).alias("aliases"),
        utf16_sorted(F.collect_set("source_id")).alias("sourceIds"),
        utf16_sorted(F.collect_set("author")).alias("authors"),
        F.array_sort(F.collect_set("usage_count")).alias("usageCounts"),
        F.max("last_modified").alias("lastModified"),
    ).select(F.concat(F.lit(f"{prefix}:source:"), F.sha2("canon", 256)).alias("id"), F.lit("Source").alias("kind"), "title", F.lit("Source").alias("type"), F.col("canon").alias("resource"), "aliases", "sourceIds", "authors", "usageCounts", "lastModified")


def deduped_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (type, from, to), that of the smallest label by UTF-16 units; a missing label counts as the empty text, so it wins."""
    order = F.struct(utf16_key(F.coalesce("label", F.lit(""))), utf16_key(F.coalesce("sourcePath", F.lit(""))))
    return edges.groupBy("type", "from", "to").agg(F.min_by(F.struct("label", "sourcePath"), order).alias("e")).select("type", "from", "to", "e.label", "e.sourcePath")


def edge_label(c: Column | str) -> Column:
    """A label without white space around it; none if it is empty or longer than 300 UTF-16 units."""
    text = trimmed(F.col(c) if isinstance(c, str) else c)
    return F.when(utf16_length(text).between(1, 300), text)


def edge_id(prefix: str = ID_PREFIX) -> Column:
    return F.concat(F.lit(f"{prefix}:edge:"), F.sha2(F.concat_ws(NUL, "type", "from", "to"), 256))


#: Documents of a piece of the digest's text.
DIGEST_LINES = 4096


def content_digest(documents: DataFrame) -> DataFrame:
    """One row ``digest``: SHA-256 over the lines path NUL hash, by UTF-16 order of the paths.

    The lines are sorted by ranges and joined to pieces range by range; the one
    hash over all of them then reads the pieces as a stream. Without documents
    it is the hash of the empty text.
    """
    rows = ranged(documents.select("path", "contentHash"), [utf16_key("path"), F.col("contentHash")])
    line = F.concat("path", F.lit(NUL), "contentHash")
    pieces = rows.groupBy("part", F.expr(f"row div {DIGEST_LINES}").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x.line), "\n").alias("text"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = hashlib.sha256(), False
        for batch in batches:
            for text in batch.column(0).to_pylist():
                state.update((b"\n" if begun else b"") + text.encode())
                begun = True
        if begun:
            yield pa.RecordBatch.from_pydict({"digest": [state.hexdigest()]})

    whole = pieces.repartition(1).sortWithinPartitions("part", "piece").select("text").mapInArrow(streamed, "digest string")
    return whole.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))


def resolve_links(documents: DataFrame) -> DataFrame:
    """Links with their fate: (path, target, label, line, column, result, target_path).

    Fates: fragment, external, outside, concept, reserved, broken. A path that
    ends in / means its index, one without extension may lack ``.md``; the
    first existing candidate counts.
    """
    links = documents.select("path", "bodyLineOffset", F.posexplode("links").alias("n", "l")).select("path", "bodyLineOffset", "n", "l.label", "l.target", "l.line", "l.column")
    plain = strip_query_and_fragment(trimmed(F.col("target")))
    decoded = uri_decoded(plain)
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "/")).otherwise("")
    joined = F.when(F.startswith(decoded, F.lit("/")), F.regexp_replace(decoded, r"^/+", "")).otherwise(F.concat(folder, decoded))
    place = posix_normalized(joined)
    early = F.when(is_fragment("target") | (plain == ""), "fragment").when(is_external("target"), "external").when((place == "..") | F.startswith(place, F.lit("../")), "outside")
    rows = links.select("*", early.alias("early"), place.alias("place"), F.endswith(decoded, F.lit("/")).alias("dir"))
    has_extension = F.element_at(F.split("place", "/"), -1).rlike(r"^.+\.[^.]*$")
    options = F.when(F.col("dir") | (F.col("place") == "."), F.array(F.when(F.col("place") == ".", F.lit("index.md")).otherwise(F.concat("place", F.lit("/index.md"))))).when(has_extension, F.array("place")).otherwise(F.array(F.col("place"), F.concat("place", F.lit(".md"))))
    tried = rows.withColumn("key", F.xxhash64("path", "n")).select("*", F.posexplode(F.when(F.col("early").isNull(), options).otherwise(F.array(F.lit(None).cast("string")))).alias("nth", "option"))
    known = documents.select(F.col("path").alias("known"), F.col("kind").alias("known_kind"))
    hit = tried.join(known, F.col("option") == F.col("known"), "left").groupBy("path", "n").agg(
        *[F.first(c).alias(c) for c in ("bodyLineOffset", "label", "target", "line", "column", "early")], F.min_by(F.struct("known", "known_kind"), F.when(F.col("known").isNotNull(), F.col("nth"))).alias("found")
    )
    result = F.coalesce("early", F.when(F.col("found.known").isNull(), "broken").when(F.col("found.known_kind") == "concept", "concept").otherwise("reserved"))
    return hit.select("path", "n", "bodyLineOffset", "label", "target", "line", "column", result.alias("result"), F.when(result == "concept", F.col("found.known")).alias("target_path"))


@dataclass(frozen=True)
class Projection:
    nodes: DataFrame
    edges: DataFrame
    manifest: DataFrame


def project(documents: DataFrame, options: Options, nfkc: bool = True) -> Projection:
    """Nodes and edges of a bundle in their fixed order (``pos``), and its one-row manifest."""
    p = options.prefix
    fields = concept_fields(documents)
    uses = fields.filter("uid is not null").groupBy(F.col("uid").alias("u")).agg(F.count(F.lit(1)).alias("uid_count"))
    keyed = fields.join(uses, F.col("uid") == F.col("u"), "left").drop("u")
    concepts = keyed.withColumn("id", F.concat(F.lit(f"{p}:concept:"), F.sha2(concept_identity(F.col("conceptId"), F.col("uid"), F.coalesce("uid_count", F.lit(0))), 256)))
    tags, terms = distinct_values(concepts, "id", "tags", nfkc), distinct_values(concepts, "id", "aliases", nfkc)
    listed = lambda values, name: values.groupBy(F.col("id").alias(f"{name}_id")).agg(utf16_sorted(F.collect_list("value")).alias(name))
    value = lambda name: F.nullif(trimmed(F.when(F.schema_of_variant(F.try_variant_get("s", f"$.{name}", "variant")) == "STRING", F.try_variant_get("s", f"$.{name}", "string"))), F.lit(""))
    each = concepts.select("id", "path", F.explode("sources").alias("s")).select(
        "id",
        "path",
        value("resource").alias("resource"),
        trimmed(nfkc_of(value("resource"), nfkc)).alias("canon"),
        value("title").alias("title"),
        value("id").alias("source_id"),
        value("author").alias("author"),
        F.try_variant_get("s", "$.usage_count", "bigint").alias("usage_count"),
        value("last_modified").alias("last_modified"),
    )
    each = each.filter(F.coalesce(F.col("canon"), F.lit("")) != "").withColumns({"usage_count": F.when(F.col("usage_count") >= 0, F.col("usage_count")), "last_modified": F.when(is_iso_datetime("last_modified"), F.col("last_modified"))})
    by_path = concepts.select(F.col("path").alias("target_path"), F.col("id").alias("to"))
    linked = resolve_links(documents).filter("result = 'concept'").join(by_path, "target_path").join(concepts.select("path", F.col("id").alias("from")), "path")
    to_id = lambda kind, c: F.concat(F.lit(f"{p}:{kind}:"), F.sha2(c, 256))
    placed = lambda values: values.join(concepts.select("id", "path"), "id")
    of = lambda rows, kind, name, c, label: rows.select(F.lit(name).alias("type"), F.col("id").alias("from"), to_id(kind, c).alias("to"), edge_label(label).alias("label"), F.col("path").alias("sourcePath"))
    raw_edges = (
        linked.select(F.lit("LINKS_TO").alias("type"), "from", "to", edge_label("label").alias("label"), F.col("path").alias("sourcePath"))
        .unionByName(of(placed(tags), "tag", "HAS_TAG", F.col("norm"), "value"))
        .unionByName(of(placed(terms), "term", "ALIASED_AS", F.col("norm"), "value"))
        .unionByName(of(each, "source", "DERIVED_FROM", F.col("canon"), F.coalesce("title", "source_id", "resource")))
    )
    digest = content_digest(documents)
    where = options.path_in_repository.strip("/") or "."
    repo = sanitized_repository(F.lit(options.repository))
    projection = digest.select("digest", F.concat(F.lit(f"{p}:projection:"), F.sha2(F.concat_ws(NUL, repo, F.lit(options.commit_sha), F.lit(where), F.col("digest")), 256)).alias("projectionId"))
    base = F.coalesce(F.lit(options.source_base_url).cast("string"), F.concat(repository_web_url(F.lit(options.repository)), F.lit(f"/blob/{options.commit_sha}")))
    in_repo = F.col("path") if where == "." else F.concat(F.lit(where + "/"), F.col("path"))
    concept_nodes = concepts.join(listed(tags, "tag_list"), F.col("id") == F.col("tag_list_id"), "left").join(listed(terms, "term_list"), F.col("id") == F.col("term_list_id"), "left")
    empty = F.array().cast("array<string>")
    concept_nodes = concept_nodes.select("id", F.lit("Concept").alias("kind"), "title", "type", F.coalesce("tag_list", empty).alias("tags"), F.coalesce("term_list", empty).alias("aliases"), "path", in_repo.alias("repositoryPath"), "conceptId", "summary", "resource", "status", "contentHash", F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), encoded_path(in_repo)).alias("sourceUrl"))
    families = concept_nodes.unionByName(group_nodes(tags, "Tag", p), allowMissingColumns=True).unionByName(source_nodes(each, p), allowMissingColumns=True).unionByName(group_nodes(terms, "Term", p), allowMissingColumns=True)
    # ordinals: the fixed kind order and ids
    order = F.array_position(F.array(*[F.lit(k) for k in ("Concept", "Tag", "Source", "Term")]), F.col("kind"))
    one = projection.select("projectionId", F.lit(options.commit_sha).alias("commitSha"))
    nodes = numbered(families.withColumn("tags", F.coalesce("tags", empty)).crossJoin(F.broadcast(one)), [order, utf16_key("id")]).select("pos", *[F.col(c) if c in {*families.columns, "projectionId", "commitSha"} else F.lit(None).cast(NODE[c].dataType).alias(c) for c in NODE.names])
    edges = numbered(deduped_edges(raw_edges).withColumn("id", edge_id(p)).crossJoin(F.broadcast(one)), [utf16_key("type"), utf16_key("from"), utf16_key("to")]).select("pos", *[F.col(c) for c in EDGE.names])
    counts = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("kind") == "concept").alias("concepts"))
    manifest = projection.crossJoin(counts).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    manifest = manifest.withColumns({"repository": repo, "commitSha": F.lit(options.commit_sha), "generatedAt": F.lit(options.generated_at), "pathInRepository": F.lit(where), "schemaVersion": F.lit(options.schema_version), "okfVersion": F.lit(options.okf_version)})
    return Projection(nodes, edges, manifest)


def flat_nodes(nodes: DataFrame, source: DataFrame, ordered: bool = False) -> DataFrame:
    """The 24 scalar columns of nodes, by ``pos`` if ``ordered``; ``source`` is one row (repository, generatedAt, okfVersion)."""
    text = lambda c: F.to_json(F.coalesce(F.col(c), F.array().cast(nodes.schema[c].dataType)))
    one = source.select("repository", F.col("generatedAt").alias("projectionGeneratedAt"), "okfVersion").limit(1)
    wide = nodes.crossJoin(F.broadcast(one)).withColumns({"tagsJson": text("tags"), "aliasesJson": text("aliases"), "sourceIdsJson": text("sourceIds"), "authorsJson": text("authors"), "usageCountsJson": text("usageCounts")})
    return (wide.orderBy("pos") if ordered else wide).select(*[F.col(c).cast("string").alias(c) for c in FLAT_NODE_COLUMNS])


def flat_edges(edges: DataFrame, ordered: bool = False) -> DataFrame:
    return (edges.orderBy("pos") if ordered else edges).select(*[F.col(c).cast("string").alias(c) for c in FLAT_EDGE_COLUMNS])
