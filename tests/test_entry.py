import os
import subprocess
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first().vec_id == 7
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_from_another_folder(tmp_path):
    """Python workers find the package wherever the session was started."""
    code = f"""
import sys
sys.path.insert(0, {HOME!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.createDataFrame([(0, "abc"), (1, "abd")], "doc_id long, text string").write.parquet({str(tmp_path)!r} + "/documents.parquet")
print(sorted(tuple(r) for r in e.queries()["document_sad"](spark, {str(tmp_path)!r}).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[(0, 0), (1, 1)]" in out.stdout, out.stderr[-2000:]
