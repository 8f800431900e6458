"""Rows of a graph store's answer, decoded within bounds.

A row is one JSON object of scalar fields, each either plain or wrapped as
``{gqlType, value}``. A table says what every field must be; it becomes
expressions over the row's VARIANT, so rows are decoded in one pass and each
carries the names of its wrong fields instead of stopping the scan. The row, its
fields and their lists are parsed once each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import trimmed, utf16_length
from lattica.operators.contract import ContractError, within_limit
from lattica.operators.graph import once
from lattica.schema import EDGE, KINDS, LIST_LIMITS, MAX_SAFE_INTEGER, NODE

#: Rows of one scan; as many may have been cut off by the store.
NODE_LIMIT, EDGE_LIMIT = 10_000, 50_000
MOST_COUNTS = 100

#: The value of a field and whether it is wrong, from the field's VARIANT and the items of the JSON array that it holds as text.
Decoder = Callable[[Column, Column], tuple[Column, Column]]


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _is(value: Column, kind: str) -> Column:
    return _holds(F.startswith(F.schema_of_variant(value), F.lit(kind)))


def _text(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def unwrapped(row: Column, field: str) -> Column:
    """The field's value, out of its wrapper if it has one."""
    value = F.try_variant_get(row, f'$["{field}"]', "variant")
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    wrapper = _is(value, "OBJECT") & _holds(F.array_contains(keys, "gqlType") & F.array_contains(keys, "value"))
    return F.when(wrapper, F.try_variant_get(value, "$.value", "variant")).otherwise(value)


def required(value: Column, items: Column | None = None) -> tuple[Column, Column]:
    """A text that is not blank."""
    text = _text(value)
    return text, ~_holds(trimmed(text) != "")


def optional(value: Column, items: Column | None = None) -> tuple[Column, Column]:
    """A text; an empty one, a JSON null or no field at all is none."""
    return F.nullif(_text(value), F.lit("")), value.isNotNull() & ~_is(value, "STRING") & ~_is(value, "VOID")


def one_of(*names: str) -> Decoder:
    def decode(value: Column, items: Column | None = None) -> tuple[Column, Column]:
        text, wrong = required(value)
        return text, wrong | ~_holds(text.isin(*names))

    return decode


def listed(most: int, longest: int) -> Decoder:
    """A JSON array of at most ``most`` texts of 1 to ``longest`` UTF-16 units, as text; none is the empty list."""

    def decode(value: Column, items: Column) -> tuple[Column, Column]:
        encoded, wrong = optional(value)
        good = _holds((F.size(items) <= most) & F.forall(items, lambda x: _holds(utf16_length(_text(x)).between(1, longest))))
        return F.when(encoded.isNotNull() & good, F.transform(items, _text)).otherwise(F.array().cast("array<string>")), wrong | (encoded.isNotNull() & ~good)

    return decode


def counts(value: Column, items: Column) -> tuple[Column, Column]:
    """A JSON array of at most ``MOST_COUNTS`` whole numbers from 0, as text; none is the empty list."""
    encoded, wrong = optional(value)
    number = lambda x: F.when(F.schema_of_variant(x).rlike("INT$|^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double"))
    good = _holds((F.size(items) <= MOST_COUNTS) & F.forall(items, lambda x: _holds((number(x) == F.floor(number(x))) & number(x).between(0, MAX_SAFE_INTEGER))))
    return F.when(encoded.isNotNull() & good, F.transform(items, lambda x: number(x).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), wrong | (encoded.isNotNull() & ~good)


def _list(name: str) -> Decoder:
    return listed(*LIST_LIMITS[name])


# Fields of a node row: its column, the field of the row, what it must be, and the kinds that have it (all if none are named).
NODE_FIELDS: tuple[tuple[str, str, Decoder, tuple[str, ...]], ...] = (
    ("kind", "kind", one_of(*KINDS), ()),
    ("id", "id", required, ()),
    ("title", "title", required, ()),
    ("type", "type", required, ()),
    ("tags", "tagsJson", _list("tags"), ()),
    ("aliases", "aliasesJson", _list("aliases"), ()),
    ("commitSha", "commitSha", required, ()),
    ("projectionId", "projectionId", required, ()),
    ("path", "path", required, ("Concept",)),
    ("repositoryPath", "repositoryPath", required, ("Concept",)),
    ("conceptId", "conceptId", required, ("Concept",)),
    ("status", "status", required, ("Concept",)),
    ("contentHash", "contentHash", required, ("Concept",)),
    ("summary", "summary", optional, ("Concept",)),
    ("resource", "resource", optional, ("Concept",)),
    ("resource", "resource", required, ("Source",)),
    ("sourceUrl", "sourceUrl", optional, ("Concept",)),
    ("sourceIds", "sourceIdsJson", _list("sourceIds"), ("Source",)),
    ("authors", "authorsJson", _list("authors"), ("Source",)),
    ("usageCounts", "usageCountsJson", counts, ("Source",)),
    ("lastModified", "lastModified", optional, ("Source",)),
    ("normalizedValue", "normalizedValue", required, ("Tag", "Term")),
)
EDGE_FIELDS: tuple[tuple[str, str, Decoder, tuple[str, ...]], ...] = (
    ("id", "id", required, ()),
    ("from", "from", required, ()),
    ("to", "to", required, ()),
    ("type", "type", required, ()),
    ("projectionId", "projectionId", required, ()),
    ("commitSha", "commitSha", required, ()),
    ("label", "label", optional, ()),
    ("sourcePath", "sourcePath", optional, ()),
)


def _decoded(rows: DataFrame, fields: tuple, columns: list[str]) -> DataFrame:
    names = list(dict.fromkeys(field for _, field, _, _ in fields) | {"kind": None})
    lists = [n for n in names if n.endswith("Json")]
    parsed = once(rows, _any=F.try_parse_json("value"))
    parsed = once(parsed, _row=F.when(_is(F.col("_any"), "OBJECT"), F.col("_any")))
    parsed = once(parsed, **{f"_{n}": unwrapped(F.col("_row"), n) for n in names})
    if lists:
        parsed = once(parsed, **{f"_parsed_{n}": F.try_parse_json(optional(F.col(f"_{n}"))[0]) for n in lists})
        parsed = once(parsed, **{f"_items_{n}": F.when(_is(F.col(f"_parsed_{n}"), "ARRAY"), F.try_variant_get(F.col(f"_parsed_{n}"), "$", "array<variant>")) for n in lists})
    kind = _text(F.col("_kind"))
    values, wrong = {}, [F.when(F.col("_row").isNull(), F.lit("row"))]
    for column, field, decode, kinds in fields:
        value, bad = decode(F.col(f"_{field}"), F.col(f"_items_{field}") if field in lists else None)
        here = _holds(kind.isin(*kinds)) if kinds else F.lit(True)
        values[column] = F.coalesce(values[column], F.when(here, value)) if column in values else F.when(here, value)
        wrong.append(F.when(F.col("_row").isNotNull() & here & bad, F.lit(field)))
    return parsed.select(*[c for c in rows.columns if c not in (*columns, "value", "errors")], *[values[c].alias(c) for c in columns], F.array_compact(F.array(*wrong)).alias("errors"))


def decode_nodes(rows: DataFrame) -> DataFrame:
    """Node rows (``value``, one JSON object) as typed columns, with ``errors``: the wrong fields, empty for a good row.

    A field of another kind of node is not looked at and stays null. A value
    that is no JSON object has the one error ``row``. Other columns stay, but
    for those whose names the typed columns take.
    """
    return _decoded(rows, NODE_FIELDS, NODE.names)


def decode_edges(rows: DataFrame) -> DataFrame:
    """Edge rows like :func:`decode_nodes`."""
    return _decoded(rows, EDGE_FIELDS, EDGE.names)


def scanned(rows: DataFrame, decode: Callable[[DataFrame], DataFrame], limit: int, name: str) -> DataFrame:
    """The decoded rows of one scan. As many rows as the limit, or a wrong field, is an error."""
    within_limit(rows, limit, name)
    out = decode(rows)
    if bad := out.filter(F.size("errors") > 0).select("errors").limit(1).collect():
        raise ContractError(f"{name}: wrong field {bad[0]['errors'][0]}")
    return out.drop("errors")


def scan_nodes(rows: DataFrame, limit: int = NODE_LIMIT) -> DataFrame:
    return scanned(rows, decode_nodes, limit, "nodes")


def scan_edges(rows: DataFrame, limit: int = EDGE_LIMIT) -> DataFrame:
    return scanned(rows, decode_edges, limit, "edges")
