"""Driver contract and the end-to-end pipeline on the smallest data set."""

import os

import __spark_entry__ as entry_mod
from tillroll.plans.catalog import QUERIES
from tillroll.plans.pipeline import run_pipeline
from tillroll.sources.transactions import transactions_from_star

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["Country", "TotalRevenue", "NumberOfCustomers", "NumberOfOrders"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    q, o = set(entry_mod.queries()), set(entry_mod.oracle_sql())
    assert o <= q
    assert {"kmeans_segments", "k_selection"} == (q - o) & set(QUERIES)


def test_pipeline_end_to_end(spark, scratch_dir):
    out = os.path.join(scratch_dir, "export")
    res = run_pipeline(transactions_from_star(spark, SMOKE), out_dir=out, ks=range(2, 4), n_init=2,
                       max_iter=50, fmt="csv")
    n = res["final"].count()
    assert n > 0
    assert res["segment_insights"].agg({"CustomerCount": "sum"}).first()[0] == n
    assert res["customer_actions"].select("CustomerID").distinct().count() == n
    names = {"customers": "final", "segment_profiles": "segment_insights", "date_dimension": "date_dimension",
             "segment_summary": "segment_summary", "segment_interpretations": "interpretations",
             "segment_recommendations": "recommendations", "segment_kpis": "kpis"}
    for name, frame in names.items():
        df = res[frame]
        back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(df.schema)
                .csv(os.path.join(out, "retail_analysis_" + name)))
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())), name
    from tillroll.session import release_tables

    assert release_tables(spark) > 0


def test_cluster_sizing_only_fills_unset_keys():
    from tillroll.session import cluster_sizing

    assert cluster_sizing("local[8]", 8, set()) == {}
    sized = cluster_sizing("yarn", 8000, set())
    assert sized["spark.sql.shuffle.partitions"] == "32000"
    assert sized["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "32000"
    assert sized["spark.sql.files.maxPartitionBytes"] == "256m"
    assert cluster_sizing("yarn", 16, set())["spark.sql.shuffle.partitions"] == "2000"
    # a user's own shuffle partition count is kept, and AQE starts from it
    mine = cluster_sizing("yarn", 8000, {"spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"})
    assert "spark.sql.shuffle.partitions" not in mine
    assert "spark.sql.adaptive.coalescePartitions.initialPartitionNum" not in mine
    assert "spark.sql.files.maxPartitionBytes" not in mine


def test_release_tables_deletes_materialized_tables(spark):
    import os

    from tillroll.session import materialize, release_tables

    release_tables(spark)  # tables of earlier tests
    df = materialize(spark.range(10), "release-check")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and df.count() == 10
    assert release_tables(spark) == 1
    assert not os.path.exists(path)
    assert release_tables(spark) == 0


def test_queries_load_without_a_library_of_the_training_operators():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_mod.__file__))
    code = ("import sys; sys.modules['xxhash'] = None\n"
            "import __spark_entry__ as e; from tillroll.plans.catalog import QUERIES\n"
            "assert set(e.queries()) == set(QUERIES), set(e.queries()) ^ set(QUERIES)")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_empty_partitioned_tables_can_be_read(spark):
    from tillroll.session import materialize

    df = spark.range(3).selectExpr("id", "id % 2 AS part")
    assert materialize(df.where("id < 0"), "none", partition_by=["part"]).count() == 0
    assert sorted(map(tuple, materialize(df, "some", partition_by=["part"]).select("id", "part").collect())) == [(0, 0), (1, 1), (2, 0)]
