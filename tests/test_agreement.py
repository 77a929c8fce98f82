"""Common lines of two versions against the textbook table."""

import random

from folioflow.operators.agreement import common_lines, line_agreement


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_common_lines_against_the_table():
    rng = random.Random(4)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randrange(0, 90)) for _ in range(2))
        assert common_lines(a, b) == brute(a, b)


def test_agreement_of_texts(spark):
    rows = [(1, "a\nb\nc\n", "b\nc\nd", 5), (2, None, "", 5), (3, "", "x", 5), (3, "x", "x", 5), (None, "\n", "\n\n", 5), (4, "l\n" * 5000, "l\n" * 4000, 5)]
    frame = spark.createDataFrame(rows, "doc_id int, a string, b string, common int")
    got = sorted((str(r.doc_id), r.lines_a, r.lines_b, r.common, r.agreement) for r in line_agreement(frame, "a", "b").collect())
    assert got == sorted([("1", 3, 3, 2, 2 / 3), ("2", 0, 0, 0, 1.0), ("3", 0, 1, 0, 0.0), ("3", 1, 1, 1, 1.0), ("None", 1, 2, 1, 2 / 3), ("4", 5000, 4000, 4000, 8 / 9)])
    assert line_agreement(frame.limit(0), "a", "b").count() == 0
