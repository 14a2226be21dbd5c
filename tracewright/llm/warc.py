"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A response keeps its record id, date, target, HTTP head and payload.  For each, one ``metadata`` record
(HTTP status and content type of the source, its payload digest, title, outgoing links) and one
``conversion`` record (the page as plain text) are made.  Both refer to the response by
WARC-Refers-To, carry its date and target, and have a digest of their own block.  Record ids derive
from what the record refers to, so runs agree.  Only DataFrame functions; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
# Tags that end a line of text, and the named characters that are resolved (& last).
BLOCK_TAGS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|"
              "ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
DROPPED = (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>")
LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
TITLE = r"(?is)<title[^>]*>(.*?)</title"


def base32_sha1(value: Column) -> Column:
    """``sha1:`` and the base 32 digest (RFC 4648), ten hex digits at a time."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_uuid(value: Column) -> Column:
    h = F.md5(value)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def resolved(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """The readable text of a page: without comments, scripts and styles; block tags end lines."""
    text = html
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    text = resolved(F.regexp_replace(text, r"<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def as_responses(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
                 date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: (id, record_id, target_uri, date, http_head, payload).

    A null page is an empty payload.  A record id derives from the id, the url and the payload.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    named = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.sha1(payload))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(F.col(id).alias("id"), record_uuid(named).alias("record_id"), F.col(url).alias("target_uri"),
                        F.lit(date).alias("date"), head.alias("http_head"), payload.alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and conversion records of every response, two rows each.

    Returns id, record_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_status, source_type, source_digest, block.  A response whose head has no status
    or type has null there; one without a target keeps null; repeated responses give repeated records.
    """
    head = F.coalesce("http_head", F.lit(""))
    status = F.nullif(F.regexp_extract(head, r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit(""))
    kind = F.nullif(F.regexp_extract(head, r"(?i)\r\ncontent-type: *([^\r\n]*)", 1), F.lit(""))
    payload = F.coalesce("payload", F.lit(""))
    told = responses.select(
        "id", F.col("record_id").alias("refers_to"), "target_uri", "date", status.alias("source_status"), kind.alias("source_type"),
        base32_sha1(payload).alias("source_digest"), payload.alias("payload"))
    title = resolved(F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n\f]+", " ")))
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), resolved(x)))
    fields = F.concat(
        F.array(F.concat(F.lit("source-status: "), F.coalesce("source_status", F.lit(""))), F.concat(F.lit("source-content-type: "), F.coalesce("source_type", F.lit(""))),
                F.concat(F.lit("source-payload-digest: "), F.col("source_digest")), F.concat(F.lit("title: "), title)), links)
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"),
                 F.concat(F.array_join(fields, CRLF), F.lit(CRLF)).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")))
    each = told.select("*", F.explode(made).alias("m")).drop("payload").select("*", "m.*").drop("m")
    return each.select(
        "id", "record_type", record_uuid(F.concat_ws("|", "record_type", "refers_to")).alias("record_id"), "refers_to", "target_uri", "date",
        "content_type", F.octet_length("block").cast("long").alias("content_length"), base32_sha1(F.col("block")).alias("block_digest"),
        "source_status", "source_type", "source_digest", "block")


def serialised(records: DataFrame) -> Column:
    """One record as WARC/1.1 text, without the line feed that ends it."""
    def line(name, column):
        return F.when(column.isNotNull(), F.concat(F.lit(f"{name}: "), column, F.lit(CRLF))).otherwise(F.lit(""))

    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("block"), F.lit("\r\n\r"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files under ``path``, one per task, through Spark's own text writer."""
    records.select(serialised(records).alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def derive_sql() -> str:
    """The same over the table ``pages``."""
    def b32(x):
        parts = " || ".join(f"lpad(to_base(CAST('0x' || substring(sha1({x}), {1 + 10 * k}, 10) AS BIGINT), 32), 8, '0')" for k in range(4))
        return f"'sha1:' || translate({parts}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

    def uuid(x):
        return "'urn:uuid:' || " + " || '-' || ".join(f"substring(md5({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    def plain(x):
        for name, char in ENTITIES:
            x = f"replace({x}, {quoted(name)}, {quoted(char)})"
        return x

    text = "payload"
    for pattern in DROPPED:
        text = f"regexp_replace({text}, {quoted(pattern)}, ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)</?({BLOCK_TAGS})\\b[^>]*>', chr(10), 'g')"
    text = plain(f"regexp_replace({text}, '<[^>]*>', '', 'g')")
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = plain(f"trim(regexp_replace(regexp_extract(payload, {quoted(TITLE)}, 1), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')")
    links = f"list_transform(regexp_extract_all(payload, {quoted(LINK)}, 1), lambda x: 'outlink: ' || {plain('x')})"
    nl = "chr(13) || chr(10)"
    meta = f"""array_to_string(list_concat(['source-status: 200', 'source-content-type: text/html; charset=utf-8',
      'source-payload-digest: ' || source_digest, 'title: ' || {title}], {links}), {nl}) || {nl}"""
    named = "'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha1(payload)"
    return f"""WITH r AS (SELECT page_id, url, {uuid(named)} AS refers_to, {b32('payload')} AS source_digest, payload
   FROM (SELECT page_id, url, coalesce(html, '') AS payload FROM pages)),
 m AS (SELECT page_id, url, refers_to, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {meta} AS block FROM r
  UNION ALL SELECT page_id, url, refers_to, source_digest, 'conversion', 'text/plain', {text} FROM r)
 SELECT page_id, record_type, {uuid("record_type || '|' || refers_to")} AS record_id, refers_to, url AS target_uri,
  '2024-01-01T00:00:00Z' AS warc_date, content_type, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, {b32('block')} AS block_digest,
  '200' AS source_status, 'text/html; charset=utf-8' AS source_type, source_digest, block FROM m"""
