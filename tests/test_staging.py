"""Staging of derived tables (trestle.sources.staging / model.stage_model)."""

import os
import shutil
import tempfile
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from trestle.config import PRESETS
from trestle.sources import model as M
from trestle.sources import staging
from trestle.sources.tpch_sql import ADAPTER_CTES

SF = "/root/testdata/sf0.001"


def test_signature_tracks_file_metadata(spark):
    d = tempfile.mkdtemp(prefix="trestle-sig-")
    shutil.copy(f"{SF}/region.parquet", f"{d}/region.parquet")
    a = staging.input_signature(spark, [f"{d}/region.parquet"], ttl=0)
    assert a == staging.input_signature(spark, [f"{d}/region.parquet"], ttl=0)
    os.utime(f"{d}/region.parquet", (1, 1))
    assert staging.input_signature(spark, [f"{d}/region.parquet"], ttl=3600) == a  # cached listing
    assert a != staging.input_signature(spark, [f"{d}/region.parquet"], ttl=0)
    assert staging.input_signature(spark, [f"{d}/absent.parquet"], ttl=0) != a


def test_stage_table_writes_once(spark):
    root = tempfile.mkdtemp(prefix="trestle-stage-")
    df = spark.range(10).withColumnRenamed("id", "projectId")
    first = staging.stage_table(spark, df, f"{root}/t", sort_by="projectId")
    assert first.count() == 10
    # a second call with different content reads the complete table as is
    again = staging.stage_table(spark, spark.range(3).withColumnRenamed("id", "projectId"), f"{root}/t")
    assert again.count() == 10


def test_staged_model_matches_unstaged(spark):
    staged = M.from_tpch(spark, SF)
    raw = M.from_tpch(spark, SF, staged=False)
    assert staged is M.from_tpch(spark, SF)  # one staged model per session and input
    assert staged.kpis.count() == raw.kpis.count()
    assert staged.scorecard.count() == raw.scorecard.count()
    data = raw.data_columns(raw.kpis)
    expected = raw.kpis.select(*data).dropDuplicates().count()
    assert staged.kpis_unique.count() == expected
    assert set(staged.kpis_unique.columns) <= set(M.UNIQUE_KPI_COLUMNS)
    plan = staged.kpis.where("phase = 'closeout'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(phase" in plan


def test_profiles_carry_the_unique_rows(spark):
    staged = M.from_tpch(spark, SF)
    cloud = M.for_profile(M.cloud_layout(staged), PRESETS["mixed"])
    assert cloud.kpis_unique is not None
    phases = {r.phase for r in cloud.kpis_unique.select("phase").distinct().collect()}
    assert "estimating" in phases and "bidding" not in phases
    assert cloud.kpis_unique.where("name_flag <> 0").count() == 0


def test_a_table_shows_only_when_it_is_complete(spark):
    root = tempfile.mkdtemp(prefix="trestle-publish-")
    df = spark.range(5).withColumnRenamed("id", "projectId")
    # data without a marker (an interrupted run, or a run that is still writing) is never read
    spark.range(99).write.parquet(f"{root}/t/data-unfinished")
    assert staging.staged_path(spark, f"{root}/t") is None
    assert staging.stage_table(spark, df, f"{root}/t").count() == 5
    done = staging.staged_path(spark, f"{root}/t")
    assert done and os.path.exists(f"{done}/_SUCCESS") and not done.endswith("unfinished")
    # an empty marker (its writer died) hides the table, and the own copy is read
    open(f"{root}/{staging.MARKER}", "w").close()
    assert staging.staged_path(spark, root) is None
    assert staging.stage_table(spark, df, root).count() == 5


def test_readers_while_tables_are_published(spark):
    root = tempfile.mkdtemp(prefix="trestle-race-")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            if done := staging.staged_path(spark, f"{root}/t"):
                seen.append(spark.read.parquet(done).count())

    def write(n):
        staging.stage_table(spark, spark.range(n).withColumnRenamed("id", "projectId"), f"{root}/t")

    reader = threading.Thread(target=read)
    reader.start()
    writers = [threading.Thread(target=write, args=(n,)) for n in (1000, 2000)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    time.sleep(0.5)
    stop.set()
    reader.join()
    assert seen and len(set(seen)) == 1 and seen[0] in (1000, 2000)


def test_old_stages_are_removed_on_demand(spark):
    root = staging.staging_root(spark)
    os.makedirs(f"{root}/tpch-old/kpis")
    os.utime(f"{root}/tpch-old", (1, 1))
    staging.stage_table(spark, spark.range(2), f"{root}/tpch-new/kpis")
    removed = staging.clean_stages(spark, older_than_hours=1)
    assert [p for p in removed if p.endswith("tpch-old")] and not os.path.exists(f"{root}/tpch-old")
    assert os.path.exists(f"{root}/tpch-new")


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())


def test_project_ids_are_never_cut(spark):
    from trestle.sources.tpch import _project_id

    keys = [7, 12345678, 123456789, 123456780, 10**15 + 1]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(_project_id(F.col("k"))).collect()]
    assert got == ["P-00000007", "P-12345678", "P-123456789", "P-123456780", "P-1000000000000001"]
    sql = "concat('P-', repeat('0', greatest(0, 8 - length(CAST(o.o_custkey AS string)))), CAST(o.o_custkey AS string))"
    assert sql in ADAPTER_CTES
    values = ", ".join(f"({k})" for k in keys)
    assert [r[0] for r in duckdb.sql(f"SELECT {sql} FROM (VALUES {values}) o(o_custkey)").fetchall()] == got
