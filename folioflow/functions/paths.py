"""Object keys and path components, as Catalyst expressions.

A key is treated like a POSIX path: empty and ``.`` components do not count, a leading dot starts
a name rather than a suffix, and a trailing dot is part of the name.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats the extractor accepts.
SUPPORTED_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff")

#: Longest bundle folder name.
FOLDER_LENGTH = 80


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _text(value: Column | str) -> Column:
    """A parameter that is either a constant or a per-row column."""
    return F.lit(value) if isinstance(value, str) else value


def file_name(key: Column | str) -> Column:
    """Last component of the path."""
    last = F.regexp_extract(_col(key), r"([^/]+)(?:/\.?)*\z", 1)
    return F.when(last == ".", F.lit("")).otherwise(last)


def _raw_suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def suffix(key: Column | str) -> Column:
    """Lower-cased last suffix of the last component, ``''`` if there is none."""
    return F.lower(_raw_suffix(file_name(key)))


def stem(key: Column | str) -> Column:
    """Last component without its last suffix."""
    return F.regexp_replace(file_name(key), r"(?s)(?<=.)\.[^.]+\z", "")


def is_supported(key: Column | str) -> Column:
    return suffix(key).isin(*SUPPORTED_EXTENSIONS)


def target_key(key: Column | str, source_prefix: Column | str = "", target_prefix: Column | str = "") -> Column:
    """Key of the Markdown result: drop the source prefix, swap the last suffix for ``.md``.

    A key without any component left has no target and gives NULL.
    """
    key, source, target = _col(key), _text(source_prefix), _text(target_prefix)
    relative = F.when(key.startswith(source), F.substring(key, F.length(source) + 1, F.length(key))).otherwise(key)
    root = F.regexp_extract(relative, r"^(//(?!/)|/)?", 1)
    parts = F.filter(F.split(relative, "/"), lambda p: ~p.isin("", "."))
    joined = F.array_join(parts, "/")
    # Only the last component may lose a suffix, and only if something precedes the dot.
    without_suffix = F.regexp_replace(joined, r"(?s)(?<=[^/])\.[^./]+\z", "")
    return F.when(joined != "", F.concat(target, root, without_suffix, F.lit(".md")))


def artifact_prefix(target: Column | str) -> Column:
    """Result key without its three-character ``.md`` ending."""
    target = _col(target)
    return F.left(target, F.length(target) - 3)


def safe_dir(key: Column | str) -> Column:
    """Fixed-length directory name for any file name."""
    return F.md5(stem(key))


def image_key(prefix: Column | str, name: Column | str) -> Column:
    return F.concat(_col(prefix), F.lit("/images/"), _col(name))


def content_type(name: Column | str, default: str = "image/png") -> Column:
    """MIME type by suffix, from the standard library's own default table."""
    table = mimetypes.MimeTypes().types_map[1]
    lookup = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    # A compression ending does not hide the type below it.
    bare = F.regexp_replace(_col(name), r"\.(?:gz|Z|bz2|xz|br)\z", "")
    return F.coalesce(lookup[suffix(bare)], F.lit(default))


def bundle_folder(key: Column | str) -> Column:
    return F.left(stem(key), F.lit(FOLDER_LENGTH))


def bundle_name(at: Column | str) -> Column:
    return F.concat(F.lit("ocr_results_"), F.date_format(_col(at), "yyyyMMdd_HHmmss"))


def ingest_key(name: Column | str, source_prefix: Column | str = "") -> Column:
    return F.concat(_text(source_prefix), _col(name))


def job_id(*parts: Column | str) -> Column:
    """Job id derived from its inputs: a retried task gives the same id, a random one would not."""
    return F.sha2(F.to_json(F.struct(*[_col(p).alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def image_roots(key: Column | str) -> Column:
    """Every leading part of ``key`` that ends in ``/images/``, as an array.

    Listing by the prefix ``P/images/`` finds exactly the keys whose array holds that prefix, so a
    prefix search becomes an equality join.
    """
    pieces = F.split(_col(key), "/images/")
    heads = F.sequence(F.lit(1), F.size(pieces) - 1)
    found = F.transform(heads, lambda n: F.concat(F.array_join(F.slice(pieces, 1, n), "/images/"), F.lit("/images/")))
    return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast("array<string>"))
