"""bench.py prints one JSON line in the shape the driver records."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_QUERIES="power_source,node_context", BENCH_REPEAT="1", BENCH_WARMUP_DIR="")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600, check=True).stdout
    lines = [line for line in out.splitlines() if line.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["metric"] == "total_sec" and rec["unit"] == "sec" and rec["sf"] == 0.001
    assert set(rec["queries"]) == {"power_source", "node_context"}
    assert abs(rec["value"] - sum(rec["queries"].values())) < 0.01
