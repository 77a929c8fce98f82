"""Display formats for sizes, durations, dates, report lines, and the page count."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "—"
ELLIPSIS = "…"
ERROR_LENGTH = 300

# Display labels of the job states.
STATUS_LABELS = {"pending": "待处理", "running": "处理中", "success": "成功", "failed": "失败", "skipped": "已跳过"}


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- numbers -------------------------------------------------------------------------------


def fixed(value: Column | str, digits: int, half: str = "even") -> Column:
    """Decimal text of a double, its absolute value rounded on its exact binary value.

    ``half`` says what happens on an exact tie: ``even`` as in C and Python formatting, ``up`` as
    in ECMAScript ``toFixed``.  Spark's own rounding works on the shortest decimal form of a
    double and differs on values such as 1.005.  The tie test here is exact: the product with
    ``2 * 10**digits`` is kept as a double plus its rounding error (a two-product).
    """
    x = F.abs(_col(value).cast("double"))
    scale = float(2 * 10**digits)
    product = x * F.lit(scale)
    split = x * F.lit(134217729.0)  # 2**27 + 1 cuts a double into two 26-bit halves
    high = split - (split - x)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    units = F.floor(x * F.lit(float(10**digits)))
    beyond_tie = F.signum((product - (units * 2 + 1)) + error)
    # -1, 0 and 1 stand for below, on and above the tie.
    needed = F.when(units % 2 == 1, -0.5).otherwise(0.5) if half == "even" else F.lit(-0.5)
    rounded = units + (beyond_tie > needed).cast("long")
    unit = F.lit(Decimal(1).scaleb(-digits))
    sign = F.when(_col(value) < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, (rounded.cast("decimal(18,0)") * unit).cast(f"decimal(20,{digits})").cast("string"))


# Units of the report size and their divisors.
SIZE_UNITS = (("B", 1), ("KB", 1024), ("MB", 1024**2), ("GB", 1024**3), ("TB", 1024**4))


def report_size(size: Column | str) -> Column:
    """One decimal, half to even, unit chosen so that the number is below 1024, up to TB.

    Divisors are powers of two, so the quotient is exact and ``bround`` sees every tie as one.
    """
    size = _col(size)
    divisor, unit = F, F
    for name, value in SIZE_UNITS[:-1]:
        divisor = divisor.when(size < value * 1024, float(value))
        unit = unit.when(size < value * 1024, name)
    name, value = SIZE_UNITS[-1]
    number = F.bround(size / divisor.otherwise(float(value)), 1)
    return F.when(size.isNotNull(), F.format_string("%.1f %s", number, unit.otherwise(name)))


def listing_size(size: Column | str) -> Column:
    """Whole bytes, KB with one decimal, MB with two, half up; nothing for zero or unknown."""
    size = _col(size)
    return (
        F.when(size.isNull() | (size == 0), F.lit(PLACEHOLDER))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.format_string("%.1f KB", F.round(size / F.lit(1024.0), 1)))
        .otherwise(F.format_string("%.2f MB", F.round(size / F.lit(1024.0**2), 2)))
    )


# ---- time ----------------------------------------------------------------------------------


def micros(at: Column | str) -> Column:
    """Microseconds on the time line, for either timestamp flavour."""
    return F.unix_micros(_col(at).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def listing_duration(start: Column | str, end: Column | str) -> Column:
    """Seconds with one decimal, computed on whole milliseconds; unknown or negative gives a dash.

    A negative span becomes NULL before it is formatted: inside a condition, Spark would not share
    the repeated parts of the format and generate several times the code.
    """
    millis = F.unix_millis(_col(end).cast("timestamp")) - F.unix_millis(_col(start).cast("timestamp"))
    known = F.when(millis >= 0, millis)
    return F.coalesce(F.concat(fixed(known / F.lit(1000.0), 1, "up"), F.lit("s")), F.lit(PLACEHOLDER))


def report_duration(duration_us: Column | str) -> Column:
    """Seconds with two decimals from whole microseconds."""
    return F.concat(fixed(_col(duration_us) / F.lit(1e6), 2), F.lit("s"))


def elapsed_hours(start: Column | str, now: Column | str) -> Column:
    return seconds_between(start, now) / F.lit(3600.0)


def elapsed_hours_text(start: Column | str, now: Column | str) -> Column:
    return fixed(elapsed_hours(start, now), 1)


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text to timestamp; text that is none gives NULL."""
    return F.try_to_timestamp(_col(text))


def iso_utc(at: Column | str) -> Column:
    """Fixed-width ISO text ending in ``Z``, so that text order is time order.

    Takes timestamps without zone holding UTC; cast other ones under a UTC session first.
    """
    return F.date_format(_col(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def listing_date(at: Column | str, zone: str = "UTC") -> Column:
    """Local date and 24-hour time of a UTC timestamp; nothing gives a dash."""
    local = F.from_utc_timestamp(_col(at), zone)
    return F.coalesce(F.date_format(local, "yyyy/M/d HH:mm:ss"), F.lit(PLACEHOLDER))


# ---- report lines --------------------------------------------------------------------------


def pad_right(text: Column | str, width: int) -> Column:
    """Pad to ``width`` characters; longer text stays whole (``rpad`` would cut it)."""
    text = _col(text)
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))))


def pad_left(text: Column | str, width: int) -> Column:
    text = _col(text)
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))), text)


def short_key(key: Column | str) -> Column:
    """Keys over 28 characters show their last 25."""
    key = _col(key)
    return F.when(F.length(key) > 28, F.concat(F.lit("..."), F.right(key, F.lit(25)))).otherwise(key)


def report_line(key: Column, size: Column, pages: Column, duration: Column, status: Column) -> Column:
    """Five columns: 30 left, 8, 6 and 10 right, status as is."""
    return F.concat_ws(
        " ", pad_right(key, 30), pad_left(size, 8), pad_left(pages.cast("string"), 6), pad_left(duration, 10), status
    )


def error_line(error: Column | str) -> Column:
    """Sub-line for a non-empty error, else NULL."""
    error = _col(error)
    return F.when(error != "", F.concat(F.lit("  Error: "), error))


# ---- listing columns -----------------------------------------------------------------------


def status_label(status: Column | str) -> Column:
    status = _col(status)
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(labels[status], status)


def short_error(error: Column | str) -> Column:
    error = _col(error)
    return F.when(
        F.length(error) > ERROR_LENGTH, F.concat(F.left(error, F.lit(ERROR_LENGTH)), F.lit(ELLIPSIS))
    ).otherwise(error)


def or_dash(value: Column | str) -> Column:
    """Text of a value, a dash for NULL and for the empty text."""
    return F.coalesce(F.nullif(_col(value).cast("string"), F.lit("")), F.lit(PLACEHOLDER))


def or_default(value: Column | str, default: Column | str | None) -> Column:
    """Option value, else the default; the empty text counts as absent."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_col(value), F.lit("")), default)


def source_kind(url: Column | str) -> Column:
    return F.when(F.lower(_col(url)).contains(".pdf"), F.lit("pdf")).otherwise(F.lit("image"))


# ---- layout --------------------------------------------------------------------------------


def page_count(layout_json: Column | str) -> Column:
    """Length of the ``pdf_info`` array; absent key, bad JSON and NULL give 0."""
    return F.coalesce(F.json_array_length(F.get_json_object(_col(layout_json), "$.pdf_info")), F.lit(0))
