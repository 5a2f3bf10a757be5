import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_agree():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40 and all(callable(q) for q in queries.values())


def test_without_the_corpus_operators(tmp_path):
    """The rest imports and registers its queries when the subpackage and the pipeline are gone."""
    shutil.copytree(os.path.join(ROOT, "lociq"), tmp_path / "lociq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1], any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[0]) > 40


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "lociq")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "lociq.llm" not in text.read(), f


def test_flagship(spark):
    from lociq.plans.registry import flagship

    if os.path.isdir("/root/testdata/sf0.001"):
        assert flagship(spark, "/root/testdata/sf0.001").count() == 3
