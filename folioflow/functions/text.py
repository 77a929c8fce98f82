"""Extracted-text clean-up and Markdown expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import bounded

# Character classes and the ligature table.
ZERO_WIDTH = "\u200b-\u200d\ufeff"
CONTROL = "\u0000-\u0008\u000b-\u000c\u000e-\u001f\u007f-\u009f"
ARABIC = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
LAM_ALEF = "\u0644\u0627"  # what each of the eight ligatures becomes
LIGATURES = ("\ufef5", "\ufef6", "\ufef7", "\ufef8", "\ufef9", "\ufefa", "\ufefb", "\ufefc")
IMAGE_REF = r"!\[([^\]]*)\]\(([^)]+)\)"
DIRECTION_MODES = ("auto", "always")

# Java tests the ranges of a class one after the other for every character.  Meeting the class with
# a range that common characters fail lets nearly all of them leave after one test.
_NOT_PRINTABLE = "[^ -~]"
_CLEAN_CLASS = f"[{_NOT_PRINTABLE}&&[{ZERO_WIDTH}{CONTROL}]]"
_CONTROL_CLASS = f"[{_NOT_PRINTABLE}&&[{CONTROL}]]"
_ARABIC_CLASS = f"[\u0600-\ufeff&&[{ARABIC}]]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- clean-up ------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text: Column | str, where: Column | None = None) -> Column:
    """NFKC form of ``text`` (of the rows meeting ``where``).

    Spark has no such built-in.  ASCII text is its own NFKC form, so only other rows carry a
    payload to Python; the rest travel as NULL and keep the JVM-side value.
    """
    bounded(SparkSession.getActiveSession())
    text = _col(text)
    needed = F.octet_length(text) != F.length(text)
    if where is not None:
        needed = where & needed
    return F.coalesce(_nfkc(F.when(needed, text)), text)


def expand_ligatures(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"[{LIGATURES[0]}-{LIGATURES[-1]}]", LAM_ALEF)


def drop_zero_width(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"[{ZERO_WIDTH}]", "")


def drop_control(text: Column | str) -> Column:
    """Remove control characters, keeping tab, line feed, carriage return and all spaces."""
    return F.regexp_replace(_col(text), _CONTROL_CLASS, "")


def clean(text: Column | str) -> Column:
    """Zero-width and control characters in one pass; the two classes are disjoint."""
    return F.regexp_replace(_col(text), _CLEAN_CLASS, "")


def post_process(
    text: Column | str, normalize: bool = True, clean_up: bool = True, where: Column | None = None
) -> Column:
    """Normalise, then clean.  The ligature step after NFKC can find nothing and is left out."""
    text = _col(text)
    out = nfkc(text, where) if normalize else text
    if clean_up:
        out = F.when(where, clean(out)).otherwise(out) if where is not None else clean(out)
    return out


# ---- Arabic script and direction -----------------------------------------------------------


def has_arabic(text: Column | str) -> Column:
    return _col(text).rlike(_ARABIC_CLASS)


def map_arabic_lines(text: Column | str, fix: Callable[[Column], Column]) -> Column:
    """Apply a Column function to each line that holds Arabic script; other lines stay as they are."""
    text = _col(text)
    lines = F.transform(F.split(text, "\n"), lambda line: F.when(has_arabic(line), fix(line)).otherwise(line))
    return F.when(has_arabic(text), F.array_join(lines, "\n")).otherwise(text)


def map_arabic_lines_python(reorder: Callable[[str], str]) -> Callable[[Column], Column]:
    """The same for a Python ``str -> str`` function.  A line on which it raises stays as it is."""
    import re

    arabic = re.compile(f"[{ARABIC}]")

    def one_line(line: str) -> str:
        if not arabic.search(line):
            return line
        try:
            return reorder(line)
        except Exception:
            return line

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: "\n".join(one_line(x) for x in s.split("\n")), na_action="ignore")

    return apply


def fix_direction(
    text: Column | str,
    mode: Column | str = "auto",
    reorder: Callable[[str], str] | None = None,
    where: Column | None = None,
) -> Column:
    """Line-wise direction fix.  ``never`` and unknown modes, or no ``reorder``, change nothing."""
    text = _col(text)
    if reorder is None or (isinstance(mode, str) and mode not in DIRECTION_MODES):
        return text
    bounded(SparkSession.getActiveSession())
    needed = has_arabic(text)
    if not isinstance(mode, str):
        needed = mode.isin(*DIRECTION_MODES) & needed
    if where is not None:
        needed = where & needed
    return F.coalesce(map_arabic_lines_python(reorder)(F.when(needed, text)), text)


def arabic_chain(
    text: Column | str,
    lang: Column | str,
    mode: Column | str = "auto",
    reorder: Callable[[str], str] | None = None,
    enabled: bool = True,
) -> Column:
    """Clean-up and direction fix for rows whose language is ``arabic``; others pass unchanged."""
    text = _col(text)
    gate = F.coalesce(_col(lang) == "arabic", F.lit(False))
    if enabled:
        text = post_process(text, where=gate)
    return fix_direction(text, mode, reorder, where=gate)


def changed_lines(before: Column | str, after: Column | str) -> Column:
    """How many lines differ between two texts with the same line structure."""
    before, after = _col(before), _col(after)
    pairs = F.arrays_zip(F.split(before, "\n").alias("b"), F.split(after, "\n").alias("a"))
    differing = F.size(F.filter(pairs, lambda p: ~p["b"].eqNullSafe(p["a"])))
    return F.when(before == after, F.lit(0)).otherwise(differing)


# ---- Markdown ------------------------------------------------------------------------------


def image_refs(md: Column | str) -> Column:
    """``array<struct<alt, path>>`` of the image references, in text order."""
    md, pattern = _col(md), F.lit(IMAGE_REF)
    return F.arrays_zip(
        F.regexp_extract_all(md, pattern, 1).alias("alt"), F.regexp_extract_all(md, pattern, 2).alias("path")
    )


def strip_dot_slash(path: Column | str) -> Column:
    """Drop any leading run of the characters ``.`` and ``/``."""
    return F.ltrim(_col(path), F.lit("./"))


def rewrite_image_links(md: Column | str, prefix: Column | str) -> Column:
    """Point relative image references at ``prefix``; ``http(s)`` references stay as they are.

    The text is cut at the references and put together again around the rewritten ones, so every
    reference is judged exactly once and the prefix needs no escaping.
    """
    md, prefix = _col(md), _col(prefix)

    def rewritten(ref: Column) -> Column:
        path = F.regexp_extract(ref, IMAGE_REF, 2)
        moved = F.concat(
            F.lit("!["), F.regexp_extract(ref, IMAGE_REF, 1), F.lit("]("), prefix, F.lit("/"), strip_dot_slash(path), F.lit(")")
        )
        return F.when(path.startswith("http://") | path.startswith("https://"), ref).otherwise(moved)

    refs = F.regexp_extract_all(md, F.lit(IMAGE_REF), 0)
    pieces = F.zip_with(
        F.split(md, IMAGE_REF), refs, lambda piece, ref: F.concat(piece, F.coalesce(rewritten(ref), F.lit("")))
    )
    return F.when(md.contains("]("), F.array_join(pieces, "")).otherwise(md)


# ---- markup and encoding -------------------------------------------------------------------

# HTML entities, the ampersand first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def _escape(text: Column, entities: tuple[tuple[str, str], ...]) -> Column:
    for plain, entity in entities:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.coalesce(text, F.lit(""))


def escape_html(text: Column | str) -> Column:
    return _escape(_col(text), ENTITIES)


def escape_attribute(text: Column | str) -> Column:
    return _escape(_col(text), ENTITIES[3:])


def plain_html(text: Column | str) -> Column:
    return F.replace(escape_html(text), F.lit("\n"), F.lit("<br>"))


def encode_utf8(text: Column | str) -> Column:
    return F.encode(_col(text), "UTF-8")


def decode_utf8(content: Column | str) -> Column:
    """Strict decoding: NULL for bytes that are not UTF-8."""
    return F.try_validate_utf8(_col(content).cast("string"))


def decode_utf8_lossy(content: Column | str) -> Column:
    """Decoding with U+FFFD in place of bad bytes."""
    return F.make_valid_utf8(_col(content).cast("string"))
