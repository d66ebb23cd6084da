"""The library and its queries work without the optional package."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'), set(o) <= set(q))"


@pytest.mark.parametrize("left_out", [["tallyhouse/llm"], ["tallyhouse/llm", "corpus_pipeline.py"], []])
def test_entry_imports_without_optional_files(tmp_path, left_out):
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy)
    skip = shutil.ignore_patterns("__pycache__", *(["llm"] if "tallyhouse/llm" in left_out else []))
    shutil.copytree(f"{ROOT}/tallyhouse", copy / "tallyhouse", ignore=skip)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    count, names = said.stdout.split(" ", 1)
    assert int(count) >= 239 and names.strip().endswith("True")
    if "tallyhouse/llm" in left_out:
        assert "pipeline" not in names and "op1" not in names


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(f"{ROOT}/tallyhouse"):
        if folder.startswith(f"{ROOT}/tallyhouse/llm"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", text.read(), re.M), f
