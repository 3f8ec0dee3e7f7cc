"""Staged tables, with and without a configured folder."""

import os
import subprocess
import sys
import time
from pathlib import Path

from clientele.session import SHUFFLES_GO, release, stage

ROOT = Path(__file__).resolve().parent.parent

WITHOUT_FOLDER = """
from clientele.session import local_session, shared_folder, stage
spark = local_session(2, 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert stage(spark.range(5), "x").count() == 5
print("staged")
"""


def test_stage_and_release(spark):
    staged = stage(spark.range(10).selectExpr("id", "id % 3 AS k"), "numbers")
    assert staged.count() == 10 and staged.columns == ["id", "k"]
    paths = staged.inputFiles()
    release(spark)
    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_was_shuffled_for_a_staged_table_is_dropped(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
    staged = stage(spark.range(1000).selectExpr("id % 7 AS k").repartition(4, "k").groupBy("k").count(), "counted")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    assert staged.count() == 7


def test_empty_frames_keep_their_schema(spark):
    staged = stage(spark.range(0).selectExpr("id", "'x' AS name"), "empty")
    assert staged.count() == 0 and dict(staged.dtypes) == {"id": "bigint", "name": "string"}


def test_a_local_session_without_the_setting_gets_its_own_folder(tmp_path):
    environment = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", WITHOUT_FOLDER], env=environment, capture_output=True, text=True, timeout=180)
    assert "staged" in done.stdout, done.stderr[-2000:]
