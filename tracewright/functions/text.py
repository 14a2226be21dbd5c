"""Text, URL and token normalisers: every one is a Column expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright import vocab
from tracewright.functions.columns import col, contains_any, first_match

# Volatile identifier shapes.
ID_SHAPES = (r"(?i)\bE\d{3,8}\b", r"(?i)\b[A-Z]{1,6}-\d{4,12}(?:-\d{1,6})?\b", r"\b\d{6,}\b")
TOKEN_SHAPES = ((r"\be\d{3,8}\b", "{id}"), (r"\b[a-z]{1,8}-\d{4,12}(?:-\d{1,6})?\b", "{id}"),
                (r"\b\d{6,}\b", "{n}"))
TITLE_SUFFIXES = (r"\s*-\s*google chrome.*$", r"\s*-\s*microsoft edge.*$", r"\s*-\s*notepad.*$",
                  r"\s*-\s*microsoft word.*$", r"\s*-\s*microsoft excel.*$", r"\s*-\s*word.*$",
                  r"\s*-\s*excel.*$")
SCRIPT_WORD = r"[a-z0-9_]+|[ぁ-んァ-ン一-龥]{2,}"
CONCRETE_SHAPES = (r"(?i)\b20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b",
                   r"(?i)\b\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?\b",
                   r"(?i)\b\d+(?:\.\d{1,2})?\b",
                   r"(?i)\b(?:INV|ID|EMP|P|E)[-_]?[A-Z0-9-]{2,}\b")


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def squeeze(c) -> Column:
    return F.trim(_sub(col(c), r"\s+", " "))


def mask_ids(c) -> Column:
    """Mask ids, dates, times and long numbers, squeeze spaces, lower."""
    out = F.coalesce(col(c), F.lit(""))
    for shape in ID_SHAPES:
        out = _sub(out, shape, "{ID}")
    out = _sub(out, r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", "{DATE}")
    out = _sub(out, r"\b\d{1,2}:\d{2}(?::\d{2})?\b", "{TIME}")
    out = _sub(out, r"\b\d{3,}\b", "{N}")
    return F.lower(squeeze(out))


def norm_token(c) -> Column:
    """Lower-cased token with volatile ids replaced."""
    out = F.lower(F.trim(col(c)))
    for shape, to in TOKEN_SHAPES:
        out = _sub(out, shape, to)
    return squeeze(out)


def coarsen_title(c) -> Column:
    """Window title without application chrome; agent and set-up windows become '' (F03)."""
    base = norm_token(c)
    for suffix in TITLE_SUFFIXES:
        base = _sub(base, suffix, "")
    noise = F.contains(base, F.lit("procmine-desktop-agent")) | base.isin("settings", "setup")
    return F.when(noise, F.lit("")).otherwise(squeeze(_sub(base, r"[_\-]+", " ")))


def norm_url_path(c) -> Column:
    """URL path with id-like segments replaced by ``{id}``."""
    url = col(c)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    for shape in ID_SHAPES:
        path = _sub(path, shape, "{id}")
    path = _sub(path, r"/\d{3,}(?=/|$)", "/{id}")
    path = _sub(path, r"/[A-Fa-f0-9]{8,}(?=/|$)", "/{id}")
    path = F.trim(_sub(path, r"/+", "/"))
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(F.lower(path))


def hash_route(c) -> Column:
    """Part after ``#/`` (else the URL itself) without query and fragment."""
    url = F.coalesce(col(c), F.lit(""))
    tail = F.when(F.contains(url, F.lit("#/")), _sub(url, r"^.*?#/", "")).otherwise(url)
    return F.btrim(_sub(tail, r"[?#].*$", ""), F.lit("/"))


def route(c, known: Sequence[str] = vocab.KNOWN_ROUTES) -> Column:
    """Known application route, else the first short path; noise is UNKNOWN_ROUTE."""
    value = F.trim(F.coalesce(col(c), F.lit("")))
    low = F.lower(value)
    found = F.regexp_extract(value, r"(?:https?://[^\s/#]+)?(?:#)?(/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*)", 1)
    usable = (found != "") & (F.length(found) <= 80) & ~contains_any(
        F.lower(found), ("scr_", "screenshot", "monitor_"))
    cases = [(F.contains(low, F.lit(r)), r) for r in known]
    cases += [(contains_any(low, vocab.ROUTE_NOISE), "UNKNOWN_ROUTE"), (usable, found)]
    return first_match(cases, "UNKNOWN_ROUTE")


def url_domain(c) -> Column:
    """Host without scheme, port and ``www.``."""
    host = F.regexp_extract(F.lower(F.trim(col(c))), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1)
    return _sub(host, r"^www\.", "")


def field_token(c) -> Column:
    """``field:key:val`` structural token."""
    t = norm_token(c)
    name = F.trim(F.substring_index(t, "=", 1))
    val = _sub(F.trim(_sub(t, r"^[^=]*=", "")), r"\s+", "_")
    return F.when(t == "", F.lit("")).when(
        F.contains(t, F.lit("=")), F.concat(F.lit("field:"), name, F.lit(":"), val)).otherwise(
        F.concat(F.lit("field:"), t))


def prefix_hits(key, value, prefixes: Sequence[str] = vocab.PREFIXES, buttons: bool = False) -> Column:
    """Process prefixes named by a DOM key/value pair, once per matching form.

    ``key=value`` and the bare value are tested; ``buttons`` also accepts ``btn-xx-ok``.
    """
    names = "|".join(prefixes)
    shapes = [rf"(?:^|=)({names})-(?:note|ok)$"]
    if buttons:
        shapes += [rf"(?:^|=)btn-({names})[-_]ok$", rf"(?:^|=)({names})_note$"]
    k, v = F.trim(col(key)), F.lower(F.trim(col(value)))
    both = F.lower(F.trim(F.concat(k, F.lit("="), v)))
    hits = [F.regexp_extract(text, s, 1) for s in shapes for text in (both, v)]
    return F.filter(F.array(*hits), lambda x: x != "")


def signature_hash(*parts) -> Column:
    """First 16 hex digits of the SHA-1 of ordered components."""
    packed = F.to_json(F.struct(*[col(p).alias(f"c{i}") for i, p in enumerate(parts)]),
                       {"ignoreNullFields": "false"})
    return F.substring(F.sha1(packed), 1, 16)


def redact(c) -> Column:
    """SHA-1 of typed text, so content never leaves the log."""
    return F.sha1(col(c))


def parse_list(c, fmt: str = "pipe") -> Column:
    """Parse serialised collections.

    ``pipe`` splits on ``|``; ``literal`` reads a list or tuple of quoted strings; ``keys``
    gives the keys of a JSON object; ``counter`` reads ``name=3 | other=1`` into a map.
    """
    text = F.trim(F.coalesce(col(c), F.lit("")))
    if fmt == "pipe":
        return F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    if fmt == "literal":
        items = F.regexp_extract_all(text, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))
        inner = F.transform(items, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2)))
        return F.filter(inner, lambda x: x != "")
    if fmt == "keys":
        return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    if fmt == "counter":
        items = F.filter(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)),
                         lambda x: F.rlike(x, F.lit(r"^.+?=\d+$")))
        pairs = F.transform(items, lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^(.+?)=(\d+)$", 1)).alias("k"),
            F.regexp_extract(x, r"^(.+?)=(\d+)$", 2).cast("long").alias("v")))
        names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        last = F.transform(names, lambda n: F.struct(n.alias("k"), F.element_at(
            F.filter(pairs, lambda p: p["k"] == n), -1)["v"].alias("v")))
        return F.map_from_entries(last)
    raise ValueError(f"unknown format {fmt!r}")


def has_script(c, ranges: str = vocab.JAPANESE) -> Column:
    """Whether the text holds a character of the given ranges."""
    return F.coalesce(F.rlike(col(c), F.lit(ranges)), F.lit(False))


def script_lines(c, ranges: str = vocab.JAPANESE) -> Column:
    """Trimmed lines holding a character of the given ranges, in order."""
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: F.rlike(x, F.lit(ranges)))


def script_chars(c, ranges: str = vocab.JAPANESE) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.length(text) - F.length(_sub(text, ranges, ""))


def vocab_hits(c, words: Sequence[str]) -> Column:
    """Vocabulary words found as substrings, in vocabulary order."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w))


def regex_labels(c, rules: Sequence[tuple[str, str]]) -> Column:
    """Distinct labels of all matching rules, in rule order."""
    text = F.coalesce(col(c), F.lit(""))
    return F.array_distinct(F.array_compact(F.array(
        *[F.when(F.rlike(text, F.lit("(?i)" + p)), F.lit(label)) for p, label in rules])))


def first_label(c, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first matching rule."""
    text = F.coalesce(col(c), F.lit(""))
    return first_match([(F.rlike(text, F.lit("(?i)" + p)), label) for p, label in rules], default)


def canonical_field(c, aliases: Mapping[str, Sequence[str]] = vocab.FIELD_ALIASES) -> Column:
    """Canonical field name of the first alias group found in the text, else '' (F24)."""
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return first_match([(contains_any(text, words), name) for name, words in aliases.items()], "")


def token_set(c) -> Column:
    """Distinct Latin and Japanese word tokens."""
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SCRIPT_WORD), F.lit(0)))


def concrete_tokens(c) -> Column:
    """Distinct dates, amounts and case identifiers, lower-cased."""
    text = F.trim(F.coalesce(col(c), F.lit("")))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(s), F.lit(0)) for s in CONCRETE_SHAPES])
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def set_jaccard(a, b) -> Column:
    """Set similarity; two empty sets are identical, one empty set matches nothing."""
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def map_json(c) -> Column:
    """Map as a JSON text with sorted keys (F32)."""
    m = col(c)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
