import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folioflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "folioflow-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.sources.parallelPartitionDiscovery.parallelism": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a Column function over Python values."""

    def evaluate(function, values, kind="string"):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        rows = frame.select("i", function("v").alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]

    return evaluate


JOBS = (
    "job_id string, file_key string, file_size bigint, status string, submitted_at timestamp, started_at timestamp, "
    "completed_at timestamp, page_count int, error string, target_key string, lang string, arabic_bidi_fix string, backend string"
)


@pytest.fixture(scope="session")
def make_jobs(spark):
    """Job table from dictionaries; absent fields are NULL, times are ISO text."""
    from datetime import datetime

    names = [part.split()[0] for part in JOBS.split(", ")]

    def make(*rows):
        defaults = {"file_size": 0, "status": "pending", "submitted_at": "2024-01-01T00:00:00+00:00"}
        full = []
        for row in rows:
            row = {**defaults, **row}
            for name in ("submitted_at", "started_at", "completed_at"):
                if row.get(name):
                    row[name] = datetime.fromisoformat(row[name])
            full.append(tuple(row.get(n) for n in names))
        return spark.createDataFrame(full, JOBS)

    return make
