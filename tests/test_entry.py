import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1


def test_the_rest_stands_without_the_llm_package(tmp_path):
    """A copy without the llm folder and the pipeline still imports and names its queries."""
    for p in REPO.iterdir():
        if p.name in ("__spark_entry__.py", "paperloom"):
            subprocess.run(["cp", "-r", str(p), str(tmp_path)], check=True)
    subprocess.run(["mv", str(tmp_path / "paperloom/llm"), str(tmp_path / "gone")], check=False)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'vector_search' in e.oracle_sql())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "True" and int(out.stdout.split()[0]) > 70


def test_a_broken_module_is_an_error(tmp_path):
    """Only the package's absence is accepted, not a module of it that can't be imported."""
    for p in REPO.iterdir():
        if p.name in ("__spark_entry__.py", "paperloom"):
            subprocess.run(["cp", "-r", str(p), str(tmp_path)], check=True)
    llm = tmp_path / "paperloom/llm"
    llm.mkdir(exist_ok=True)
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode and "no_such_module" in out.stderr
