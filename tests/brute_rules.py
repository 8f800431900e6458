"""The document rules said once more, one document at a time: what the expressions are held against."""

import datetime
import re
from collections.abc import Callable, Iterator
from itertools import takewhile

from lattica.schema import MAX_SAFE_INTEGER

FORMAT_VERSION = "0.2"
ERRORS = frozenset("INVALID_FRONTMATTER INVALID_UTF8 MISSING_FRONTMATTER TYPE_REQUIRED INDEX_FRONTMATTER_NOT_ALLOWED INVALID_INDEX_FRONTMATTER INDEX_SECTION_REQUIRED LOG_FRONTMATTER_NOT_ALLOWED LOG_TITLE_REQUIRED LOG_DATE_REQUIRED INVALID_LOG_DATE".split())
_ACTOR = re.compile(r"human:\S+|process:\S+|\S+/\S+")
_DATETIME = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)")

Finding = tuple[str, str]


def filled(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def actor(x) -> bool:
    return isinstance(x, str) and bool(_ACTOR.fullmatch(x))


def day(text: str) -> bool:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) or text < "0100":
        return False
    try:
        return bool(datetime.date.fromisoformat(text))
    except ValueError:
        return False


def moment(x) -> bool:
    m = _DATETIME.fullmatch(x) if isinstance(x, str) else None
    return bool(m) and day("-".join(m.groups()))


def count(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer() and 0 <= x <= MAX_SAFE_INTEGER


def times(name: str, x) -> Iterator[Finding]:
    if not moment(x):
        yield "INVALID_TIMESTAMP", f"{name}: an ISO datetime with an offset is expected"


def window(name: str, x) -> Iterator[Finding]:
    if isinstance(x, dict):
        for end in ("from", "to"):
            yield from times(f"{name}.{end}", x.get(end))
    else:
        yield "INVALID_USAGE_WINDOW", f"{name}: a mapping of from and to is expected"


def optional(of: dict, name: str, test: Callable, code: str, prefix: str = "") -> Iterator[Finding]:
    if name in of and not test(of[name]):
        yield code, f"{prefix}{name}: {of[name]!r} is not allowed"


def source_rules(sources) -> Iterator[Finding]:
    if not isinstance(sources, list):
        yield "INVALID_SOURCES", "sources: a list is expected"
        return
    seen = set()
    for k, s in enumerate(sources):
        at = f"sources[{k}]."
        if not isinstance(s, dict):
            yield "INVALID_SOURCE", f"sources[{k}]: a mapping is expected"
            continue
        if not filled(s.get("resource")):
            yield "SOURCE_RESOURCE_REQUIRED", f"{at}resource: a text is expected"
        yield from optional(s, "id", filled, "INVALID_SOURCE_ID", at)
        if filled(s.get("id")):
            if (name := s["id"].strip()) in seen:
                yield "DUPLICATE_SOURCE_ID", f"{at}id: {name} is taken"
            seen.add(name)
        for field in ("title", "author"):
            yield from optional(s, field, filled, "INVALID_SOURCE_FIELD", at)
        yield from optional(s, "usage_count", count, "INVALID_USAGE_COUNT", at)
        if "last_modified" in s:
            yield from times(f"{at}last_modified", s["last_modified"])
        if "usage_window" in s:
            yield from window(f"{at}usage_window", s["usage_window"])


def trust_rules(h: dict) -> Iterator[Finding]:
    if "generated" in h:
        g = h["generated"]
        if isinstance(g, dict):
            if not actor(g.get("by")):
                yield "INVALID_ACTOR", "generated.by: an actor is expected"
            if "at" in g:
                yield from times("generated.at", g["at"])
        else:
            yield "INVALID_GENERATED", "generated: a mapping is expected"
    if "verified" in h:
        v = h["verified"]
        events = v if isinstance(v, list) else [v] if isinstance(v, dict) else []
        if not events:
            yield "INVALID_VERIFIED", "verified: a mapping or a list of mappings is expected"
        for k, e in enumerate(events):
            if not isinstance(e, dict):
                yield "INVALID_VERIFICATION_EVENT", f"verified[{k}]: a mapping is expected"
                continue
            if not actor(e.get("by")):
                yield "INVALID_ACTOR", f"verified[{k}].by: an actor is expected"
            yield from times(f"verified[{k}].at", e.get("at"))
    yield from optional(h, "status", lambda s: s in ("draft", "stable", "deprecated"), "INVALID_STATUS")
    if "stale_after" in h:
        yield from times("stale_after", h["stale_after"])


_COMPUTATION_HEADING = re.compile(r"#\s+computation\s*", re.I)
_TOP_HEADING = re.compile(r"#\s")
_FENCE = re.compile(r" {0,3}(```|~~~)")


def computation_blocks(body: str) -> int:
    """Fenced blocks between the heading "# Computation" and the next level-one heading."""
    lines = iter(body.split("\n"))
    if not any(_COMPUTATION_HEADING.fullmatch(x) for x in lines):  # leaves the iterator behind the heading
        return 0
    section = takewhile(lambda x: not _TOP_HEADING.match(x + "\n"), lines)
    return sum(1 for x in section if _FENCE.match(x)) // 2


def parameter(p) -> bool:
    return isinstance(p, dict) and filled(p.get("name")) and filled(p.get("type")) and isinstance(p.get("required"), bool)


def resource_mapping(v) -> bool:
    return isinstance(v, dict) and filled(v.get("resource"))


def computation_rules(h: dict, body: str) -> Iterator[Finding]:
    """Rules of an attested computation: its fields by a table of tests, then where the computation itself stands."""
    if h.get("type") != "Attested Computation":
        return
    if not filled(h.get("runtime")):
        yield "ATTESTED_RUNTIME_REQUIRED", "runtime: a text is expected"
    for name, test in (("computation", filled), ("executor", resource_mapping), ("attester", resource_mapping)):
        yield from optional(h, name, test, "INVALID_COMPUTATION_FIELD")
    listed = h.get("parameters", [])
    yield from (("INVALID_PARAMETER", f"parameters[{k}]: name, type and required are expected") for k, p in enumerate(listed if isinstance(listed, list) else ()) if not parameter(p))
    if not isinstance(listed, list):
        yield "INVALID_PARAMETERS", "parameters: a list is expected"
    places = {
        (False, 0): ("COMPUTATION_REQUIRED", "a computation path or one fenced block under # Computation is expected"),
        (False, 2): ("MULTIPLE_COMPUTATIONS", "one fenced block is expected"),
        (True, 1): ("AMBIGUOUS_COMPUTATION", "a computation path and a fenced block exclude each other"),
        (True, 2): ("AMBIGUOUS_COMPUTATION", "a computation path and a fenced block exclude each other"),
    }
    if found := places.get((filled(h.get("computation")), min(2, computation_blocks(body)))):
        yield found


def concept_rules(h: dict, has_header: bool, body: str) -> Iterator[Finding]:
    if not has_header:
        yield "MISSING_FRONTMATTER", "a concept opens with a YAML header"
        return
    if not filled(h.get("type")):
        yield "TYPE_REQUIRED", "type: a text is expected"
    for field in ("title", "description", "resource"):
        yield from optional(h, field, filled, "INVALID_RECOMMENDED_FIELD")
    yield from optional(h, "tags", lambda t: isinstance(t, list) and all(map(filled, t)), "INVALID_TAGS")
    if "sources" in h:
        yield from source_rules(h["sources"])
    if "usage_window" in h:
        yield from window("usage_window", h["usage_window"])
    yield from trust_rules(h)
    yield from computation_rules(h, body)


def index_rules(path: str, h: dict, has_header: bool, body: str) -> Iterator[Finding]:
    if has_header and path != "index.md":
        yield "INDEX_FRONTMATTER_NOT_ALLOWED", "only the root index.md has a header"
    elif has_header and set(h) != {"okf_version"}:
        yield "INVALID_INDEX_FRONTMATTER", "the root index.md declares okf_version only"
    if path == "index.md" and "okf_version" in h:
        v = h["okf_version"]
        if not isinstance(v, str):
            yield "INVALID_OKF_VERSION", "okf_version: a text is expected"
        elif v != FORMAT_VERSION:
            yield "UNSUPPORTED_OKF_VERSION", f"okf_version {v} is read as {FORMAT_VERSION}"
    if not re.search(r"(?m)^#\s+\S.*$", body):
        yield "INDEX_SECTION_REQUIRED", "a level-one heading is expected"
    if not re.search(r"(?m)^\s*[-*+]\s+\[[^\]]+\]\([^)]+\)", body):
        yield "INDEX_HAS_NO_ENTRIES", "list items with links are expected"


def log_rules(has_header: bool, body: str) -> Iterator[Finding]:
    if has_header:
        yield "LOG_FRONTMATTER_NOT_ALLOWED", "log.md has no header"
    if not re.search(r"(?m)^#\s+\S.*$", body):
        yield "LOG_TITLE_REQUIRED", "a level-one heading is expected"
    days = re.findall(r"(?m)^##\s+(.+?)\s*$", body)
    if not days:
        yield "LOG_DATE_REQUIRED", "entries stand under headings of their day"
    for d in days:
        if not day(d):
            yield "INVALID_LOG_DATE", f"{d} is no day"
    good = list(filter(day, days))
    if any(a < b for a, b in zip(good, good[1:])):
        yield "LOG_NOT_NEWEST_FIRST", "the newest day stands first"


def document_rules(path: str, kind: str, header: dict, has_header: bool, body: str) -> list[Finding]:
    if kind == "index":
        return list(index_rules(path, header, has_header, body))
    if kind == "log":
        return list(log_rules(has_header, body))
    return list(concept_rules(header, has_header, body))
