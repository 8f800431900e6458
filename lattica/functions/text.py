"""Scalar functions on text: identifiers, normalisers, paths, dates, tokens.

All but Unicode NFKC and YAML are built-in expressions, so they stay inside
code generation; ``nfkc=False`` keeps a normaliser JVM-side where the input is
known to be in normal form.
"""

from __future__ import annotations

import datetime
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_PREFIX = "urn:lattica"
NUL = "\0"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc_of(c: Column | str, nfkc: bool = True) -> Column:
    return _nfkc(_col(c)) if nfkc else _col(c)


def sha256(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_term(c: Column | str, nfkc: bool = True) -> Column:
    """Identity of tags and aliases: NFKC, trim, inner white space to one space, lower case."""
    return F.lower(F.regexp_replace(trimmed(nfkc_of(c, nfkc)), r"(?U)\s+", " "))


def normalize_query(c: Column | str, nfkc: bool = True) -> Column:
    """For comparing with requested terms: NFKC, lower case, trim; inner white space stays."""
    return trimmed(F.lower(nfkc_of(c, nfkc)))


def query_text(value: str) -> str:
    """:func:`normalize_query` of a driver-side argument."""
    return unicodedata.normalize("NFKC", value).lower().strip()


def utf16_key(c: Column | str) -> Column:
    """Sort key of the order by UTF-16 code units."""
    return F.encode(_col(c), "UTF-16BE")


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def utf16_sorted(c: Column | str) -> Column:
    """A list of texts in the order of UTF-16 code units."""
    keyed = F.transform(_col(c), lambda x: F.struct(utf16_key(x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x.v)


def utf16_min(c: Column | str) -> Column:
    """Aggregate: the smallest text by UTF-16 code units."""
    return F.min_by(_col(c), utf16_key(c))


def utf16_prefix(c: Column | str, n: Column | int) -> Column:
    """The first ``n`` UTF-16 code units; half of a surrogate pair at the cut is left out."""
    c, n = _col(c), n if isinstance(n, Column) else F.lit(n)
    raw = F.encode(c, "UTF-16BE")
    top = F.hex(F.substring(raw, 2 * n - 1, F.lit(1)))
    whole = F.when((n > 0) & top.between("D8", "DB"), n - 1).otherwise(n)
    return F.when(utf16_length(c) <= n, c).otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(2 * whole, F.lit(0))), "UTF-16BE"))


def iso_datetime_text(value: str) -> bool:
    """:func:`is_iso_datetime` of a driver-side text."""
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)", value)
    try:
        return bool(m) and m[1] >= "0100" and bool(datetime.date.fromisoformat(m[1]))
    except ValueError:
        return False


def is_iso_datetime(c: Column | str) -> Column:
    """An ISO datetime with offset: a real calendar day, times to 23:59:59, offset to 23:59; seconds may be missing."""
    c = _col(c)
    shape = r"^(\d{4})-(\d{2})-(\d{2})T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
    return F.coalesce(c.rlike(shape) & is_calendar_day(F.substring(c, 1, 10)), F.lit(False))


def is_calendar_day(c: Column | str) -> Column:
    """A strict ``YYYY-MM-DD`` of the proleptic calendar, years from 100."""
    c = _col(c)
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (F.substring(c, 1, 4) >= "0100") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def derived_title(path: Column | str) -> Column:
    """Title from a path: base name without ``.md``, runs of - and _ to a space, word starts in upper case."""
    base = F.regexp_replace(F.element_at(F.split(_col(path), "/"), -1), r"(?i)\.md$", "")
    words = F.split(F.regexp_replace(base, r"[-_]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def strip_query_and_fragment(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"^[^?#]*", 0)


def uri_decoded(c: Column | str) -> Column:
    """Percent-decoding; the text itself where it is malformed. A plus stays a plus."""
    c = _col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def encoded_path(c: Column | str) -> Column:
    """Percent-encoding segment by segment; empty segments go."""
    parts = F.filter(F.split(_col(c), "/"), lambda s: s != "")
    keep = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))

    def one(s: Column) -> Column:
        s = F.url_encode(s)
        for a, b in keep:
            s = F.replace(s, F.lit(a), F.lit(b))
        return s

    return F.array_join(F.transform(parts, one), "/")


def posix_normalized(c: Column | str) -> Column:
    """Fold ``.`` and ``..`` of a relative path; ``..`` beyond the top stays in front. Nothing left is ``.``."""
    parts = F.filter(F.split(_col(c), "/"), lambda s: (s != "") & (s != "."))
    climb = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.lit(""))), F.greatest(F.size(acc), F.lit(1))) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), climb), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def is_external(c: Column | str) -> Column:
    return _col(c).rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//)")


def is_fragment(c: Column | str) -> Column:
    return F.startswith(_col(c), F.lit("#"))


def is_actor(c: Column | str) -> Column:
    """``human:name``, ``process:name``, or two names parted by a slash, without white space."""
    return _col(c).rlike(r"(?U)^(?:human:\S+|process:\S+|\S+/\S+)\z")


TOKEN = r"[\p{L}\p{N}]+(?:[-_.:/][\p{L}\p{N}]+)*"


def tokens(c: Column | str, nfkc: bool = True) -> Column:
    """Search tokens: words joined by ``- _ . : /``, lower case, of two characters or more."""
    found = F.regexp_extract_all(F.lower(nfkc_of(c, nfkc)), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) > 1)


def fixed(c: Column | str, digits: int) -> Column:
    """A double rounded to ``digits`` (at most 9) decimals by its exact binary value; an exact half goes away from zero.

    Of the decimals next to the value, each half between two is compared with it
    exactly: as doubles where they differ, else by the exact product of the half
    (a double) and the scale, as a rounded product and its error. The value is
    bound to a variable, so it is computed once.
    """
    return F.get(F.transform(F.array(_col(c).cast("double")), lambda x: _fixed(x, digits)), F.lit(0))


def _fixed(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    a, q = F.abs(x), 2 * scale
    split = lambda v: F.lit(134217729.0) * v - (F.lit(134217729.0) * v - v)
    q_high = 134217729.0 * q - (134217729.0 * q - q)

    def reaches(n: Column) -> Column:
        """Whether the value is at least (n + 1/2) / scale."""
        odd = 2 * n + 1
        half = odd / F.lit(q)
        high, product = split(half), half * q
        low = half - high
        error = ((high * q_high - product) + high * (q - q_high) + low * q_high) + low * (q - q_high)
        return F.when(a != half, a > half).otherwise((product - odd) + error >= 0)

    least = F.floor(a * scale).cast("double") - 1
    n = least + sum((reaches(least + k).cast("double") for k in range(3)), F.lit(0.0))
    return F.when(a * scale < F.lit(float(1 << 50)), F.signum(x) * n / F.lit(scale)).otherwise(x)


def concept_identity(path: Column, uid: Column, uid_count: Column) -> Column:
    """The identity text of a concept: its uid, or its path; both where the uid is not unique."""
    return F.when(uid.isNull(), F.concat(F.lit(f"path{NUL}"), path)).when(uid_count > 1, F.concat(F.lit(f"duplicate-uid{NUL}"), uid, F.lit(NUL), path)).otherwise(F.concat(F.lit(f"uid{NUL}"), uid))


def sanitized_repository(c: Column | str) -> Column:
    """A repository address without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1"), r"[?#].*$", "")


def repository_web_url(c: Column | str) -> Column:
    """https address of a repository given in scp, ssh, git or http form; null for others."""
    c = F.regexp_replace(sanitized_repository(c), r"(?:\.git)?/*$", "")
    scp, url = r"^[^/@:\s]+@([^:/\s]+):(.+)$", r"^(?:https?|ssh|git)://([^/]+)/(.+)$"
    return F.when(c.rlike(scp), F.regexp_replace(c, scp, "https://$1/$2")).when(c.rlike(url), F.regexp_replace(c, url, "https://$1/$2"))
