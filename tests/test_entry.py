import os
import shutil
import subprocess
import sys
import textwrap

import duckdb

from .conftest import HERE


def _norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "" if v is None else str(v)


def compare(spark, sf, name, f, sql):
    df = f(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in ("documents", "events", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns, name
    assert got == sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in cur.fetchall()), name


def test_queries_and_sql(spark, sf):
    from siftlake.plans import queries as Q

    for name, sql in Q.ORACLE_SQL.items():
        compare(spark, sf, name, Q.QUERIES[name], sql)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())


def test_without_the_training_data_operators(tmp_path):
    """The rest of a copy without them works, and a fault within them is not hidden."""
    away = shutil.ignore_patterns(".git", "__pycache__")
    shutil.copytree(HERE, tmp_path / "repo", ignore=away)
    repo = tmp_path / "repo"
    run = lambda code: subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=repo, env=os.environ | {"PYTHONPATH": str(repo)}, capture_output=True, text=True, timeout=120)
    assert run("import __spark_entry__ as E; assert len([q for q in E.queries() if q.startswith('op')]) == 10 and 'pipeline' in E.queries()").returncode == 0
    (repo / "siftlake/llm/warc.py").write_text("import no_such_module")
    assert "no_such_module" in run("import __spark_entry__").stderr
    for gone in ("siftlake/llm", "tests/llm"):
        shutil.rmtree(repo / gone)
    done = run("import __spark_entry__ as E; assert 'scan_findings' in E.queries() and not [q for q in E.queries() if q.startswith('op') or q == 'pipeline']")
    assert done.returncode == 0, done.stderr
    (repo / "corpus_pipeline.py").unlink()
    assert run("import __spark_entry__ as E; E.oracle_sql()").returncode == 0
