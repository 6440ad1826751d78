"""The driver contract: bench.py prints one JSON line; __spark_entry__ is consistent."""

import json
import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracle_keys_are_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(sql, str) and sql.strip().upper().startswith(("WITH", "SELECT")) for sql in entry.oracle_sql().values())


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_QUERIES="global_top_k,truth_long")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=600, check=True
    )
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    doc = json.loads(lines[0])
    assert doc["unit"] == "sec" and doc["sf"] == 0.001 and set(doc["queries"]) == {"global_top_k", "truth_long"}
    assert doc["value"] == sum(doc["queries"].values()) or abs(doc["value"] - sum(doc["queries"].values())) < 0.01
    assert "errors" not in doc


def test_entry_module_loads_from_another_directory():
    code = (
        "import importlib.util;"
        "spec = importlib.util.spec_from_file_location('e', %r);"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m);"
        "print(len(m.queries()), len(m.oracle_sql()))"
    ) % os.path.join(ROOT, "__spark_entry__.py")
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split() == [str(len(entry.queries())), str(len(entry.oracle_sql()))]
