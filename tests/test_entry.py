"""The entry module with and without the training-data operators."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder, block: str = "") -> tuple[set, set]:
    code = f"import sys; sys.modules[{block!r}] = None\n{LOOK}" if block else LOOK
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    found, sql = json.loads(said.stdout.splitlines()[-1])
    return set(found), set(sql)


def copy(tmp_path, *without):
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=lambda folder, items: [i for i in items if i in (".git", "__pycache__", "tests") or os.path.join(os.path.relpath(folder, ROOT), i).removeprefix("./") in without])
    return target


def core() -> tuple[set, set]:
    from docloom.plans import catalog

    return set(catalog.QUERIES), set(catalog.ORACLE_SQL)


def test_core_queries_are_there_without_the_operators(tmp_path):
    assert names(copy(tmp_path, "docloom/llm", "corpus_pipeline.py")) == core()


@pytest.mark.skipif(not os.path.exists(os.path.join(ROOT, "docloom/llm")), reason="needs the operators")
@pytest.mark.parametrize("package", ["xxhash", "zstandard"])
def test_a_missing_package_takes_only_the_operators(package):
    assert names(ROOT, package) == core()


@pytest.mark.skipif(not os.path.exists(os.path.join(ROOT, "docloom/llm")), reason="needs the operators")
def test_every_operator_is_registered():
    found, sql = names(ROOT)
    assert {n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()} >= {f"op{n}" for n in range(1, 14)}
    assert sql <= found and core()[0] < found


def test_nothing_in_the_core_imports_the_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "docloom")):
        if os.path.relpath(folder, ROOT).startswith(os.path.join("docloom", "llm")):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "docloom.llm" not in open(os.path.join(folder, f)).read(), f
