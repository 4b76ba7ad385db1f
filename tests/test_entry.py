import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 45
    assert e.entry(spark).count() == 23


def test_the_rest_works_without_the_optional_operators(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 40; print('fine')"
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", ".git", "treeloom", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "treeloom").mkdir()
    for p in (ROOT / "treeloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "treeloom" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr[-2000:]


def test_nothing_else_imports_them():
    for p in (ROOT / "treeloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "treeloom.llm" not in p.read_text()


def test_flagship_plan_prunes_and_pushes_down(spark):
    plan = e.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan
    assert "LeftSemi" in plan and "LeftAnti" in plan
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_planned_query_stays_in_the_jvm(spark):
    for name, make in e.queries().items():
        if name.startswith("dsl_") and name not in ("dsl_validation", "dsl_validity_rate", "dsl_one_shot"):  # these parse texts
            plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name
