import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "local[8]",
        "newsloom-tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows(ddl, [tuples])`` makes a frame."""
    return lambda ddl, data: spark.createDataFrame(data, ddl)


@pytest.fixture
def values(rows):
    """Evaluate a column expression over one text column ``x``, in order."""

    def run(expression, texts, kind="string"):
        df = rows(f"i int, x {kind}", list(enumerate(texts)))
        out = df.select("i", expression.alias("y")).collect()
        return [r["y"] for r in sorted(out, key=lambda r: r["i"])]

    return run
