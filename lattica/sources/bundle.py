"""Markdown bundles: a directory tree of documents to a DataFrame of parsed rows.

Files are found and read by Spark; splitting off the YAML header and finding
links are the only parts that need Python, in one Arrow-batched pass.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.schema import DIAGNOSTIC, LINK
from lattica.sources.data_sources import local_path, read_tree

PROBLEM = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
PARSED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("frontmatterJson", T.StringType()),
        T.StructField("hasFrontmatter", T.BooleanType()),
        T.StructField("bodyLineOffset", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("problems", T.ArrayType(PROBLEM)),
    ]
)
MAX_ALIASES = 100


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the Markdown files under ``root``, without ``.git`` and ``node_modules``."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(base)
    plain = re.sub(r"^file:/*", "/", base) if base.startswith("file:") else base
    relative = F.regexp_replace(F.col("path"), "^(?:[a-z0-9]+:/*)?/?" + re.escape(plain.lstrip("/")) + "/", "")
    rows = files.select(F.try_url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content")
    return rows.filter(~F.col("path").rlike(r"(?:^|/)(?:\.git|node_modules)/"))


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, raw) of files in UTF-8, a leading byte-order mark dropped; diagnostics of the others."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    good = files.filter(valid).select("path", raw.alias("raw"))
    bad = files.filter(~valid).select(F.lit("error").alias("severity"), F.lit("INVALID_UTF8").alias("code"), F.lit("The file is not valid UTF-8.").alias("message"), "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"))
    return good, bad


class HeaderError(ValueError):
    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.line, self.column = line, column


@functools.cache
def _loader() -> type:
    """The loader of the YAML 1.2 core schema, made once a process."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    number = r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$"
    real = r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"
    for tag, pattern, first in (("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]), ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")), ("int", number, list("-+0123456789")), ("float", real, list("-+.0123456789"))):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)

    def mapping(loader, node):
        seen = {}
        for key_node, value_node in node.value:
            key = loader.construct_object(key_node, deep=True)
            key = key if isinstance(key, str) else json.dumps(key)
            if key in seen:
                raise HeaderError(f"Map keys must be unique: {key}", key_node.start_mark.line + 2, key_node.start_mark.column + 1)
            seen[key] = loader.construct_object(value_node, deep=True)
        return seen

    def integer(loader, node):
        v = loader.construct_scalar(node)
        return int(v[2:], 8) if v.startswith("0o") else int(v, 16) if v.startswith("0x") else int(v)

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    Loader.add_constructor("tag:yaml.org,2002:int", integer)
    Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(loader.construct_scalar(node).replace(".inf", "inf").replace(".nan", "nan")))
    return Loader


def load_yaml(source: str):
    """YAML by the 1.2 core schema: only true/false are booleans, dates stay text, keys are unique."""
    import yaml

    def aliases() -> int:
        return sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(source))

    try:
        if source.count("*") > MAX_ALIASES and aliases() > MAX_ALIASES:
            raise HeaderError("Excessive alias count indicates a resource exhaustion attack.")
        try:
            return yaml.load(source, _loader())  # noqa: S506
        except yaml.YAMLError:
            aliases()  # what is wrong with the grammar anywhere comes first
            raise
    except yaml.MarkedYAMLError as e:
        mark = e.problem_mark
        raise HeaderError(str(e.problem), mark.line + 2 if mark else None, mark.column + 1 if mark else None) from None
    except yaml.YAMLError as e:
        raise HeaderError(str(e)) from None


def split_header(raw: str) -> tuple[dict, bool, int, str, HeaderError | None]:
    """Header, whether there is one, its lines, the body, and what is wrong with it."""
    lines = raw.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines[0] != "---":
        return {}, False, 0, "\n".join(lines), None
    end = next((k for k, x in enumerate(lines) if k and x == "---"), None)
    if end is None:
        return {}, True, len(lines), "", HeaderError("Frontmatter is opened by '---' and never closed.", 1, 1)
    source, body = "\n".join(lines[1:end]), "\n".join(lines[end + 1 :])
    try:
        header = load_yaml(source)
    except HeaderError as e:
        return {}, True, end + 1, body, e
    if header is None and not source.strip():
        header = {}
    if not isinstance(header, dict):
        return {}, True, end + 1, body, HeaderError("Frontmatter must be a mapping.", 2, 1)
    return header, True, end + 1, body, None


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<([^<>\n]*)>|(\S+))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*$")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_MARKS = re.compile(r"[*_]+(?=\S)|(?<=\S)[*_]+|`+")


def _visible(body: str) -> list[str]:
    """The lines with fenced and indented code blanked, at their full length."""
    out, fence, blank = [], "", True
    for line in body.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            out.append(" " * len(line))
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(" " * len(line))
        elif blank and re.match(r"^(?: {4}|\t)\s*\S", line):
            out.append(" " * len(line))
            continue
        else:
            out.append(line)
        blank = not line.strip()
    return out


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """Destination and end of ``(destination "title")`` from its bracket on."""
    m = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)").match(text, at)
    return (_ESCAPE.sub(r"\1", m[1] if m[1] is not None else m[2]), m.end()) if m else None


def extract_links(body: str) -> list[dict]:
    """Inline and reference links with label, target, line and column (from 1); no images, no code.

    Of several definitions of one label the last counts.
    """
    lines = _visible(body)
    definitions: dict[str, str] = {}
    for k, line in enumerate(lines):
        if m := _DEFINITION.match(line):
            definitions[" ".join(m[1].lower().split())] = m[2] if m[2] is not None else m[3]
            lines[k] = " " * len(line)
    text = "\n".join(lines)
    # code spans hide what they hold
    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: re.sub(r"[\[\]\\()]", "\x00", m[0]), text, flags=re.S)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out, opened, k = [], [], 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        if c == "[":
            opened.append(k)
        elif c == "]" and opened:
            begin = opened.pop()
            label = text[begin + 1 : k]
            found = _destination(text, k + 1) if text[k + 1 : k + 2] == "(" else None
            target, end = found if found else (None, k + 1)
            if not found:
                m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, k + 1)
                key = m[1] if m and m[1].strip() else label
                target = definitions.get(" ".join(key.lower().split()))
                end = m.end() if m and target is not None else k + 1
            if target is not None:
                if begin and text[begin - 1] == "!" and (begin < 2 or text[begin - 2] != "\\"):
                    k = end
                    continue
                line = next(i for i in range(len(starts) - 1, -1, -1) if starts[i] <= begin)
                original = body[begin + 1 : begin + 1 + len(label)] if len(body) == len(text) else label
                shown = _ESCAPE.sub(r"\1", _MARKS.sub("", re.sub(r"!\[([^\[\]]*)\]\([^()]*\)", "", original)))
                out.append({"label": shown, "target": target, "line": line + 1, "column": begin - starts[line] + 1})
                opened.clear()  # links do not nest
                k = end
                continue
        elif c == "\n" and text[k + 1 : k + 2] == "\n":
            opened.clear()
        k += 1
    return sorted(out, key=lambda x: (x["line"], x["column"]))


def _plain(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    raise TypeError(type(value).__name__)


def parse(documents: DataFrame) -> DataFrame:
    """Documents (path, raw) with header, body, links, kind, conceptId and contentHash.

    ``frontmatter`` is a VARIANT. Null texts are empty documents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["raw"]):
                header, has, offset, body, error = split_header(raw or "")
                problems = [{"code": "INVALID_FRONTMATTER", "message": str(error), "line": error.line, "column": error.column}] if error else []
                rows.append((path, raw or "", json.dumps(header, default=_plain, ensure_ascii=False), has, offset, body, extract_links(body), problems))
            yield pd.DataFrame(rows, columns=PARSED.names)

    parsed = documents.select("path", "raw").mapInPandas(run, PARSED)
    return parsed.select(
        "path",
        document_kind("path").alias("kind"),
        F.when(document_kind("path") == "concept", F.expr("left(path, length(path) - 3)")).alias("conceptId"),
        F.parse_json("frontmatterJson").alias("frontmatter"),
        "hasFrontmatter",
        "bodyLineOffset",
        "body",
        "raw",
        F.sha2("raw", 256).alias("contentHash"),
        "links",
        "problems",
    )


def document_kind(path: Column | str) -> Column:
    name = F.lower(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1))
    return F.when(name == "index.md", "index").when(name == "log.md", "log").otherwise("concept")


def read_bundle(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Parsed documents of a directory, and the diagnostics of reading it.

    A local folder's symbolic links are not followed but reported; other stores have none.
    """
    none = spark.createDataFrame([], DIAGNOSTIC)
    if (local := local_path(root)) is None:
        files, links = read_files(spark, root), none
    else:
        tree = read_tree(spark, local)
        files = tree.filter("not is_link").select("path", "content")
        links = tree.filter("is_link").select(F.lit("info").alias("severity"), F.lit("SYMLINK_SKIPPED").alias("code"), F.lit("Symbolic links are not followed.").alias("message"), "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"))
    good, bad = decode_files(files)
    return parse(good), none.unionByName(bad).unionByName(links)
