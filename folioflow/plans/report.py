"""Status summary and the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import fmt

# The rules of the report; its header lines and labels below are fixed, too.
RULE, THIN_RULE = "=" * 60, "-" * 60


def summary(results: DataFrame) -> DataFrame:
    """One row, also for no results at all."""
    return results.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")],
    )


def tally(outcomes: DataFrame, ok: Column) -> DataFrame:
    return outcomes.agg(F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))


def in_order(results: DataFrame, *order: str) -> DataFrame:
    """Results in finishing order, sorted by range over all tasks rather than gathered in one."""
    return results.orderBy(*order)


def _lines(rows: DataFrame, section: int, lines: list[Column], order: list[str]) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), *order, F.posexplode(F.array(*lines)).alias("line_no", "line"))


def report_lines(results: DataFrame, *order: str) -> DataFrame:
    """The report as lines ``(section, <order>, line_no, line)``, sorted.

    ``results`` has ``file_key, file_size, page_count, duration_us, status, error`` and the columns
    of ``order``, which say how the job lines follow one another.
    """
    keys = list(order)
    kinds = {f.name: f.dataType for f in results.schema.fields}
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in keys]
    total = summary(results).select("*", *nothing)
    titles = fmt.report_line(F.lit("File"), F.lit("Size"), F.lit("Pages"), F.lit("Duration"), F.lit("Status"))

    def count(label: str, name: str) -> Column:
        return F.concat(fmt.pad_right(F.lit(f"{label}:"), 9), F.col(name).cast("string"))

    head = _lines(
        total,
        0,
        [
            F.lit(RULE),
            F.lit("OCR Processing Summary"),
            F.lit(RULE),
            count("Total", "total"),
            count("Success", "success"),
            count("Failed", "failed"),
            count("Skipped", "skipped"),
            F.lit(""),
            F.lit(THIN_RULE),
            titles,
            F.lit(THIN_RULE),
        ],
        keys,
    )
    line = fmt.report_line(
        fmt.short_key("file_key"),
        fmt.report_size("file_size"),
        F.coalesce("page_count", F.lit(0)),
        fmt.report_duration("duration_us"),
        F.col("status"),
    )
    body = _lines(results, 1, [line, fmt.error_line("error")], keys).where(F.col("line").isNotNull())
    foot = _lines(total, 2, [F.lit(RULE)], keys)
    return head.unionByName(body).unionByName(foot).orderBy("section", *keys, "line_no")


def write_report(lines: DataFrame, path: str) -> None:
    """Text files whose names sort in report order."""
    lines.select("line").write.mode("overwrite").text(path)
