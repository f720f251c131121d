"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_module  # noqa: E402
from tools.check import TABLES, digest  # noqa: E402

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def test_entry(spark, data):
    assert entry_module.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    mine = QUERIES[name](spark, data).toArrow()
    if name not in ORACLES:
        assert mine.num_columns > 0
        return
    theirs = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert digest(mine)[1] == digest(theirs)[1]


def test_entry_from_another_folder(data, tmp_path):
    """Executors that cannot import the package still run its batch functions."""
    script = tmp_path / "run.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('entry', {str(Path(entry_module.__file__).resolve())!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', m.queries()['i07_preset'](spark, {data!r}).count(), m.queries()['f02_outside_tokeniser'](spark, {data!r}).count())\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "rows 500 200" in done.stdout, done.stderr[-2000:]
