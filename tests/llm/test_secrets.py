"""Long logs of keys: every span where it stands, in time that follows their number."""

import re
import time

import pytest
from pyspark.sql import functions as F

from adjudica.llm import secret_scan

ASSIGN = re.compile(secret_scan.BASE[0][1])


def spans(text):
    return ",".join(f"assign:{m.start()}:{m.end()}" for m in ASSIGN.finditer(text) if len(m[2]) >= 6)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 513, 3000])
def test_spans_of_many_matches(spark, n):
    text = "ü start " + "".join(f"token = v{i}x{'y' * (i % 9)} \n" for i in range(n)) + " end"
    got = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.spans == spans(text) and got.n_assign == (spans(text).count("assign") if spans(text) else 0)


def test_forty_thousand_assignments(spark):
    """10,000 and 40,000 matches: four times the matches in less than twice four times the time."""
    took = []
    for n in (10_000, 40_000):
        text = "".join(f"password={i:08d}\n" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = secret_scan.secret_scan(df).agg(F.sum("n_assign")).first()[0]
        took.append(time.time() - began)
        assert got == n
    assert took[1] < 8 * took[0] + 5, took
