import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quarryloom.plans import queries

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("left_out", ["corpus_pipeline.py", "llm", "both"])
def test_imports_without_session_and_without_llm(tmp_path, left_out):
    os.symlink(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    shutil.copytree(ROOT / "quarryloom", tmp_path / "quarryloom", ignore=shutil.ignore_patterns("__pycache__", *([] if left_out == "corpus_pipeline.py" else ["llm"])))
    if left_out == "llm" and (ROOT / "corpus_pipeline.py").exists():
        os.symlink(ROOT / "corpus_pipeline.py", tmp_path / "corpus_pipeline.py")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda folder: subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    assert [int(x) for x in run(tmp_path).stdout.split()] == [len(queries.QUERIES), len(queries.SQL)]


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    bad = []
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, str(DATA))
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        columns = sorted(df.columns)
        mine = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
        other = sorted(repr([norm(r[names.index(c)]) for c in columns]) for r in found.fetchall()) if sorted(names) == columns else names
        if mine != other:
            bad.append(name)
    assert not bad


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry_and_rows_only_queries(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    for name in queries.QUERIES.keys() - queries.SQL.keys():
        assert queries.QUERIES[name](spark, str(DATA)).count() > 0


