from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a registered query with its SQL over the smallest tables: column names and rows, in any order."""
    import duckdb

    def check(name: str, sf_dir: str = SMALL) -> int:
        import __spark_entry__ as entry

        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got, want = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        ours = sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
        theirs = sorted(map(repr, want.project(", ".join(f'"{c}"' for c in names)).fetchall()))
        assert ours == theirs
        return len(ours)

    return check
