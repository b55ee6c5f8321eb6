"""The driver contract holds without the optional subpackage, or with one that cannot be imported."""

import os
import subprocess
import sys

import pytest

from presswork.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["presswork.llm", "ahocorasick", "corpus_pipeline"])
def test_other_queries_stay(blocked):
    code = f"import sys; sys.modules['{blocked}'] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    names, sql = (set(x.split()) for x in said.stdout.strip().split("\n")[-2:])
    assert set(catalog.queries()) <= names and set(catalog.oracle_sql()) <= sql
    assert "pipeline" not in names


def test_batches_and_written_tables(spark):
    from presswork import session

    session.bound_batches(spark, 1 << 20)
    session.bound_batches(spark)  # a smaller bound stays
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(1 << 20)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    paths = []

    @session.tidy("outer")
    def made():
        a = session.settle(spark.range(5), "a")
        paths.append(a.inputFiles()[0].rsplit("/", 1)[0])
        return a.where("id > 1")

    assert made().count() == 3
    assert not os.path.exists(paths[0].removeprefix("file://").removeprefix("file:"))
