"""Scalar functions as column expressions, and their counterparts for single values on the driver."""

from __future__ import annotations

import re
from urllib.parse import parse_qs

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO_ID = r"[A-Za-z0-9_-]{11}"
#: Hosts and path kinds that carry a video id (fixed values).
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com")
SHORT_HOST = "youtu.be"
PATH_KINDS = ("embed", "live", "shorts")
#: By host, the paths that hold an id as their group; and the path whose query has it as v.
SITES = dict.fromkeys(VIDEO_HOSTS, rf"^/*(?:{'|'.join(PATH_KINDS)})/([^/]+)") | {SHORT_HOST: "^/*([^/]+)"}
WATCHED = "^/watch/*$"
_URL = re.compile(r"https?://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(?:\?([^#]*))?", re.IGNORECASE)

#: A day, a time and an offset, however these are set apart.
_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d.*(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def parse_instant(text: Column) -> Column:
    """ISO-8601 text with an offset as an instant; null for anything else, also for text without an offset."""
    return F.when(text.rlike(_OFFSET), text.try_cast("timestamp"))


def in_utc(instant: Column) -> Column:
    """An instant as a timestamp without zone that shows UTC, in any session zone. A timestamp without zone is in UTC already."""
    shown = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL '0.000001' SECOND") * F.unix_micros(instant.cast("timestamp"))
    return F.when(F.typeof(instant) == "timestamp_ntz", instant.cast("timestamp_ntz")).otherwise(shown)


def utc_date(instant: Column) -> Column:
    return F.to_date(in_utc(instant))


def _parts(instant: Column) -> tuple[Column, Column, Column]:
    """Day, time and microseconds as texts, in UTC."""
    shown = in_utc(instant).cast("string")
    return F.substring(shown, 1, 10), F.substring(shown, 12, 8), F.rpad(F.substring(shown, 21, 6), 6, "0")


def iso_text(instant: Column) -> Column:
    day, time, micros = _parts(instant)
    return F.concat(day, F.lit("T"), time, F.lit("."), micros, F.lit("+00:00"))


def compact_instant(instant: Column) -> Column:
    """For paths and run ids, to the microsecond."""
    day, time, micros = _parts(instant)
    return F.concat(F.translate(day, "-", ""), F.lit("T"), F.translate(time, ":", ""), micros, F.lit("Z"))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to share."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def is_close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def is_filled(text: Column) -> Column:
    """Has a character that isn't white space."""
    return text.isNotNull() & text.rlike(r"(?U)[^\s\x1c-\x1f]")


def is_integer(value: Column) -> Column:
    """For VARIANT: a JSON integer, which 5.0, "5" and true are not."""
    return F.schema_of_variant(value) == "BIGINT"


def is_share(value: Column) -> Column:
    return value.between(0.0, 1.0) & ~F.isnan(value)


def encode_counts(counts: Column) -> Column:
    """A map of counts as JSON with sorted keys."""
    sorted_keys = F.array_sort(F.map_keys(counts))
    pairs = F.transform(sorted_keys, lambda k: F.format_string('"%s": %d', F.regexp_replace(k, r'(["\\\\])', r"\\$1"), F.element_at(counts, k)))
    return F.when(counts.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def decode_counts(text: Column) -> Column:
    return F.from_json(text, "map<string,bigint>")


def video_id_of(text: Column) -> Column:
    """The video id that an id or URL names, else null."""
    value = F.trim(text)
    # percent escapes of the id's alphabet only occur in the query; the host is compared in lower case
    host = F.lower(F.try_parse_url(value, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(value, F.lit("PATH")), F.lit(""))
    forms = [F.when(host == site, F.regexp_extract(path, pattern, 1)) for site, pattern in SITES.items()]
    watched = F.when(host.isin(*VIDEO_HOSTS) & path.rlike(WATCHED), F.try_url_decode(F.try_parse_url(value, F.lit("QUERY"), F.lit("v"))))
    found = F.coalesce(watched, *forms)
    return F.when(value.rlike(f"^{VIDEO_ID}$"), value).when(value.rlike("(?i)^https?://") & found.rlike(f"^{VIDEO_ID}$"), found)


def video_id(text: str) -> str:
    """As video_id_of, for one value; ValueError where there is none."""
    value = text.strip()
    url = _URL.match(value)
    host, path, query = (part or "" for part in url.groups()) if url else ("", "", "")
    pattern = SITES.get(host.lower())
    found = [value, *parse_qs(query).get("v", [])[:1]] if pattern and host.lower() != SHORT_HOST and re.search(WATCHED, path) else [value]
    if pattern and (named := re.search(pattern, path)):
        found.append(named[1])
    for candidate in found:
        if re.fullmatch(VIDEO_ID, candidate):
            return candidate
    raise ValueError(
        "Video must be an 11-character ID or YouTube URL" if not url else "URL host must be youtube.com or youtu.be" if not pattern else "YouTube URL does not contain a valid video ID"
    )


def identifier(name: str) -> str:
    """A name that may stand in SQL, quoted."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"Invalid SQL identifier: {name}")
    return f"`{name}`"


def literal(text: str) -> str:
    """Text that may stand in Spark SQL, where a backslash escapes and a quote is written twice."""
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def filled(value: object, what: str) -> str:
    """A stripped string that isn't empty; ValueError for anything else."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must be a non-empty string")
    return value.strip()
