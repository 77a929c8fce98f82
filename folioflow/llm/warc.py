"""Derivatives of archived web pages: linked metadata and plain-text conversion records of WARC responses.

Records are rows: the named fields of a WARC header and the block.  All steps are Column expressions, one row at a time.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: What the SQL takes from a page: (pattern, replacement), in order.  It holds for pages that close their head.
TAGS = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<head\b.*?(?:</head\s*>|\z)", ""),
    (r"(?is)<script\b.*?(?:</script\s*>|\z)", ""),
    (r"(?is)<style\b.*?(?:</style\s*>|\z)", ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|blockquote|pre)\b[^<>]*>", "\n"),
    (r"<[^<>]*>", ""),
)
#: Named characters of the SQL, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
SPACES = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))


#: A head that is closed before the body begins, and the head's own tags where it is not closed.
HEADS = (
    r"(?is)<head(?=[\s/>])(?:[^<]|<(?!/head\b|/?body\b))*+</head\s*>",
    r"(?is)<head(?=[\s/>])[^<>]*+>(?:\s*+(?:<title\b[^<>]*+>.*?(?:</title\s*>|\z)|</?(?:meta|link|base|basefont|bgsound|noscript|noframes|template)\b[^<>]*+>))*+",
)
REFERENCE = r"&(?:#[0-9]++|#[xX](?=[0-9A-Fa-f])0*+[0-9A-Fa-f]{0,8}|[A-Za-z][A-Za-z0-9]{1,31});"


def _names() -> str:
    """All standard references by name, and the numeric ones that stand for signs of Windows-1252, as text for ``str_to_map``."""
    signs = {name[:-1]: sign for name, sign in html.entities.html5.items() if name.endswith(";")} | {"nbsp": " "}
    signs |= {f"#{n}": sign for n in range(128, 160) if (sign := bytes([n]).decode("cp1252", "ignore"))}
    return "\x01".join(f"{name}\x02{sign}" for name, sign in sorted(signs.items()))


#: A reference other than the common ones.
UNCOMMON = r"&(?!(?:" + "|".join(name[1:-1] for name, _ in ENTITIES) + r");)(?:#[0-9]|#[xX][0-9A-Fa-f]|[A-Za-z])[A-Za-z0-9]*;"


def decoded(text: Column) -> Column:
    """``text`` with numeric and standard named references replaced, once; a no-break space is a space, unknown names stay.

    Names are looked up only in texts that hold an uncommon reference.  ``text`` is used several times: give a column, not a chain.
    """
    named = F.str_to_map(F.lit(_names()), F.lit("\x01"), F.lit("\x02"))

    def sign(reference: Column) -> Column:
        name = F.substring_index(reference.substr(F.lit(2), F.length(reference)), ";", 1)
        hexed = name.rlike("^#[xX]")
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        number = F.when(name.startswith("#"), F.coalesce(F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int"), F.lit(0)))
        bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
        numeric = F.when(number == 160, " ").otherwise(F.coalesce(F.try_element_at(named, F.concat(F.lit("#"), number.cast("string"))), point))
        return F.when(name.startswith("#"), numeric).otherwise(F.coalesce(F.try_element_at(named, name), reference))

    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    signs = F.concat(F.transform(found, sign), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), signs, lambda gap, s: F.concat(gap, s)), "")
    common = text
    for name, to in ENTITIES:
        common = F.replace(common, F.lit(name), F.lit(to))
    return F.when(F.instr(text, "&") == 0, text).when(text.rlike(UNCOMMON), whole).otherwise(common)


def _replaced(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def bare(html: Column) -> Column:
    """A page without comments, scripts and styles; unclosed ones reach to the end."""
    return _replaced(html, (TAGS[0], *TAGS[2:4]))


def untagged(page: Column) -> Column:
    """What is left of a bare page without heads and tags, one line for each of its blocks.

    A head that is not closed ends at the first text or tag that cannot stand in it.
    """
    return _replaced(page, (*((head, "") for head in HEADS), *TAGS[4:]))


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(_replaced(text, SPACES), r"^\n|\n$", ""))


def with_text(pages: DataFrame, html: str, text: str) -> DataFrame:
    """``pages`` with ``__bare`` (see ``bare``) and the plain ``text`` of their html.

    Each step is a column that the next ones use more than once, so Spark computes it once.
    """
    given = pages.withColumn("__bare", bare(F.col(html)))
    given = given.withColumn("__flat", untagged(F.col("__bare")))
    given = given.withColumn("__flat", decoded(F.col("__flat")))
    return given.withColumn(text, tidy(F.col("__flat"))).drop("__flat")


def _from(text: Column, mark: str) -> Column:
    """What begins with the first ``mark``."""
    return text.substr(F.instr(text, mark), F.length(text))


def urn(*parts: Column) -> Column:
    """Record identifier made from what identifies the record, so that a repeated run gives the same."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages`` (``page_id``, ``url``, ``html``): what a crawl that got them would have stored.

    NULL html is an empty page, a NULL url has no target.  Repeated pages give records with the same identifier.
    """
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "]
    http = F.concat(F.lit(CRLF.join(head)), F.octet_length(html).cast("string"), F.lit(CRLF * 2), html)
    return pages.select(
        F.col("page_id"),
        F.lit("response").alias("record_type"),
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        digest(html).alias("payload_digest"),
        http.alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record of every response record of ``records``; other record types give none.

    Both refer to the response, keep its target, date and payload digest; the metadata record names the conversion as made
    with it and lists the HTTP status and headers, the title with its references decoded, the language and the number of links;
    what stands in comments, scripts and styles counts for none of them.  A NULL block counts as empty, a block without an empty line has no body.
    Columns beside those of ``responses`` are left behind, ``page_id`` stays.  No shuffle.
    """
    given = records.where("record_type = 'response'").withColumn("__block", F.coalesce("block", F.lit("")))
    cut = F.instr("__block", CRLF * 2)
    given = given.withColumn("__head", F.when(cut > 0, F.left("__block", cut - 1)).otherwise(F.col("__block")))
    given = given.withColumn("__html", F.when(cut > 0, F.col("__block").substr(cut + 4, F.length("__block"))).otherwise(F.lit("")))
    given = with_text(given, "__html", "__text")
    converted, described = urn(F.lit("conversion"), F.col("record_id")), urn(F.lit("metadata"), F.col("record_id"))
    given = given.withColumn("__title", F.regexp_extract("__bare", r"(?is)<title\b[^<>]*>([^<]*)", 1))
    title = F.trim(F.regexp_replace(decoded(F.col("__title")), r"\s+", " "))
    language = F.regexp_extract("__bare", r"(?i)<html\b[^<>]*?\blang=[\x22']?([A-Za-z-]+)", 1)
    fields = F.concat(
        *[F.lit("source-payload-digest: "), F.coalesce("payload_digest", F.lit("")), F.lit(CRLF)],
        *[F.lit("http-status-line: "), F.substring_index("__head", CRLF, 1)],
        F.when(F.instr("__head", CRLF) > 0, F.replace(_from(F.col("__head"), CRLF), F.lit(CRLF), F.lit(CRLF + "http-header: "))).otherwise(F.lit(CRLF)),
        *[F.lit(CRLF + "title: "), title, F.lit(CRLF + "language: "), language],
        *[F.lit(CRLF + "outlinks: "), F.regexp_count("__bare", F.lit(r"(?i)<a\b[^<>]*\bhref=")).cast("string"), F.lit(CRLF)],
        *[F.lit("text-length: "), F.octet_length("__text").cast("string"), F.lit(CRLF)],
    )
    own = F.array(
        F.struct(F.lit("metadata").alias("record_type"), described.alias("record_id"), converted.alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), converted.alias("record_id"), F.lit(None).cast("string").alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("__text").alias("block")),
    )
    rows = given.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_digest"), F.explode(own).alias("r"))
    return rows.select(
        "page_id", "r.record_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type", "source_digest",
        digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


FIELDS = (
    ("WARC-Type", "record_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Concurrent-To", "concurrent_to"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "date"),
    ("WARC-Block-Digest", "block_digest"),
    ("Content-Type", "content_type"),
    ("Content-Length", "content_length"),
)


def serialised(records: DataFrame) -> DataFrame:
    """``records`` of ``derivatives`` with ``warc``: the whole record in WARC 1.1 form, without the fields that are NULL."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) for name, c in FIELDS]
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines)
    return records.withColumn("warc", F.concat(head, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)))


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files below ``path``, one for each task.  A lost task's file is never committed twice."""
    last = F.left("warc", F.length("warc") - len(CRLF))  # the writer ends each row with the last line end
    serialised(records).select(last.alias("warc")).write.option("lineSep", CRLF).option("compression", compression).text(path)
