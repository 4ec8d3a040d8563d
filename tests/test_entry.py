import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("corpus_pipeline.py", "corvane/llm", "tests/llm"), ("corvane/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_works_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, ops, pipeline = said.stdout.split()[-3:]
    assert int(n) > 50 and ops == str((copy / "corvane/llm").exists()) and pipeline == "False"


def test_other_import_errors_are_raised(tmp_path):
    (tmp_path / "broken_module_of_this_test.py").write_text("import a_module_that_nobody_has")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; e._optional('broken_module_of_this_test')"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode != 0 and "a_module_that_nobody_has" in said.stderr
