"""The driver contract and the shape of important plans."""

import os
import re
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

import __spark_entry__ as entry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["product_id", "open_time", "close", "ret_1"] and out.count() == 10


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(entry.queries()["log_loss"](spark, sf))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "ts:" not in schema


def test_the_book_reads_the_whole_table(spark, sf):
    lineitem = plan(entry.queries()["parse_level2"](spark, sf))
    assert "FileScan" in lineitem and "GreaterThan" not in lineitem and "LessThan" not in lineitem


def test_a_message_is_parsed_once(spark, sf):
    for name in ("parse_level2", "parse_feed_messages"):
        made = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert made.count("from_json(") == 1, name


def test_every_message_stays_one_row(spark):
    from tapeflow.sources.feed import parse_messages

    raw = spark.createDataFrame([(1, '{"channel": "l2_data"}'), (2, "no json"), (3, None), (3, None)], "id int, value string")
    rows = sorted((r.id, r.m and r.m.channel) for r in parse_messages(raw).collect())
    assert [i for i, _ in rows] == [1, 2, 3, 3] and [c for _, c in rows] == ["l2_data", None, None, None]


def test_library_never_uses_local_checkpoints_or_cross_products():
    for path in Path(entry.__file__).parent.joinpath("tapeflow").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text
        for line in text.splitlines():
            if "crossJoin(" in line:
                assert "one row" in line, f"{path}: {line}"


class Session:
    """The settings of a session that is not local."""

    def __init__(self, **conf):
        self.conf = self
        self.all = {"spark.master": "spark://host:7077"} | conf

    def get(self, key, default=None):
        return self.all.get(key, default)


def test_a_cluster_needs_a_shared_folder():
    from tapeflow.session import checkpoint_dir

    for conf in ({}, {"spark.checkpoint.dir": "/tmp/mine"}):
        with pytest.raises(ValueError, match="share"):
            checkpoint_dir(Session(**conf))


@pytest.mark.parametrize("conf", [{"spark.master": "local-cluster[3,4,10240]"}, {"spark.driver.host": "127.0.0.1"}, {"spark.driver.host": "localhost"}])
def test_a_cluster_of_one_machine_shares_its_folders(conf):
    from tapeflow.session import checkpoint_dir

    session = Session(**conf, **{"spark.checkpoint.dir": "/tmp/checkpoints"})
    session.sparkContext, told = session, []
    session.setCheckpointDir = told.append
    assert checkpoint_dir(session) == "/tmp/checkpoints" and told == ["/tmp/checkpoints"]


@pytest.mark.parametrize("host", ["10.0.0.7", "localhost.example.org", "host"])
def test_a_driver_that_others_reach_needs_a_shared_folder(host):
    from tapeflow.session import checkpoint_dir

    with pytest.raises(ValueError, match="share"):
        checkpoint_dir(Session(**{"spark.driver.host": host, "spark.checkpoint.dir": "/tmp/checkpoints"}))


STAGED_ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

out, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.checkpoint.dir": f"{out}/kept", "spark.local.dir": f"{out}/local", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    entry.queries()[name](spark, f"{out}/in").write.parquet(f"{out}/{name}")
"""


def test_queries_that_stage_give_the_same_rows_on_a_local_cluster(spark, tmp_path):
    names, start = ["asof_last_close", "calibrate"], datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i * 37 % 101, "ab"[i % 2], float(i * 29 % 97), f'{{"k": {i % 50}}}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/in/events.parquet")
    # another process, as a process has one session's master
    subprocess.run([sys.executable, "-c", STAGED_ON_A_CLUSTER, str(tmp_path), *names], check=True, timeout=300, cwd=Path(entry.__file__).parent, env=os.environ | {"PYTHONPATH": str(Path(entry.__file__).parent)})
    assert [*(tmp_path / "kept").glob("stage-*")]
    for name in names:
        here, there = entry.queries()[name](spark, f"{tmp_path}/in"), spark.read.parquet(f"{tmp_path}/{name}")
        assert here.count() and sorted(map(str, here.collect())) == sorted(map(str, there.collect())), name


def test_release_deletes_what_was_staged(spark):
    from tapeflow import session

    out = session.staged(spark.range(3))
    (path,) = {f.rpartition("/")[0] for f in out.inputFiles()}
    path = Path(path.removeprefix("file://"))
    kept, session._STAGED[spark.sparkContext.applicationId] = session._STAGED[spark.sparkContext.applicationId][:-1], [str(path)]
    assert path.exists() and session.release(spark) == 1 and not path.exists()
    session._STAGED[spark.sparkContext.applicationId] = kept


def test_per_product_facts_are_attached_without_a_shuffle_of_the_rows(spark, sf):
    for name in ("holdout_split", "rows_to_folds"):
        text = plan(entry.queries()[name](spark, sf))
        assert "SortMergeJoin [product_id" not in text, name
