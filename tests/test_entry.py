"""The entry points with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = {"llm": ["turnloom/llm", "tests/llm"], "pipeline": ["corpus_pipeline.py"]}


def output(command, folder, env):
    """What a command prints; all of it, if it fails."""
    done = subprocess.run(command, cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, f"{command}: {done.returncode}\n{done.stdout}\n{done.stderr}"
    return done.stdout


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["llm"], ["pipeline"], ["llm", "pipeline"]])
def test_entry_works_without_optional_parts(tmp_path, gone):
    """In a copy without them the rest imports, lists its queries, and every test module is collected."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in [p for part in gone for p in OPTIONAL[part]]:
        at = copy / path
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(' '.join(sorted(q)))"
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), *filter(None, [os.environ.get("PYTHONPATH")])])}
    names = output([sys.executable, "-c", code], copy, env).split()
    assert "corpus_describe" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op")] or "llm" not in gone
    tests = [str(p.relative_to(copy)) for p in (copy / "tests").glob("test_*.py")]
    output([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "--rootdir", str(copy), *tests], copy, env)
