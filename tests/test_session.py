"""The session keeps a master that is given."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "from tillroll.session import build_session; s = build_session(); print('MASTER', s.sparkContext.master); s.stop()"


def master(**env):
    out = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=300,
                         env={k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"} | {"PYTHONPATH": ROOT} | env)
    return out.stdout.split("MASTER ")[-1].strip()


def test_submitted_master_is_kept():
    assert master(PYSPARK_SUBMIT_ARGS="--master local[2] pyspark-shell", BENCH_CPUS="3") == "local[2]"


def test_configured_master_is_kept(tmp_path):
    (tmp_path / "spark-defaults.conf").write_text("# defaults\nspark.master   local[2]\n")
    assert master(SPARK_CONF_DIR=str(tmp_path), BENCH_CPUS="3") == "local[2]"


def test_without_a_master_it_is_local():
    assert master(BENCH_CPUS="3") == "local[3]"


def test_shuffle_partitions_stay_small_on_any_cluster():
    from tillroll.session import cluster_sizing

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    assert cluster_sizing("yarn", 8000, set())[key] == "16m"  # of what a task reads, its sorts and tables take some 30 times
    assert cluster_sizing("local-cluster[3,4,10240]", 12, set()) == {key: "16m"}
    assert cluster_sizing("local-cluster[3,4,10240]", 12, {key}) == {}
