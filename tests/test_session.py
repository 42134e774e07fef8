import os
import subprocess
import sys
import tempfile

from tagrack.session import ensure_checkpoint_dir, scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_checkpoint_dir_is_stable_and_scratch_lies_inside(spark):
    d = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == d
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(d) and len(a) == len(b)


def start(code):
    """Standard output of a fresh application."""
    head = ("from pyspark.sql import SparkSession\nimport sys\nfrom tagrack.session import *\n"
            "b = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\n")
    with tempfile.TemporaryDirectory() as none:  # no defaults of this machine
        out = subprocess.run([sys.executable, "-c", head + code], cwd=ROOT, capture_output=True, text=True, timeout=120,
                             env=os.environ | {"SPARK_CONF_DIR": none})
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip().splitlines()


def test_empty_configuration():
    a, b, n = start("s = b.getOrCreate()\nprint(ensure_checkpoint_dir(s))\ns.range(3).checkpoint()\n"
                    "print(ensure_checkpoint_dir(s))\nprint(s.range(3).checkpoint().count())")
    assert a == b and n == "3"


def test_folder_of_the_launcher_is_kept(tmp_path):
    for code in (f"s = b.getOrCreate()\ns.sparkContext.setCheckpointDir('{tmp_path}')\n",
                 f"s = b.config('spark.checkpoint.dir', '{tmp_path}').getOrCreate()\n"):
        a, b = start(code + "print(ensure_checkpoint_dir(s))\nprint(scratch_path(s, 'x'))")
        assert a.removeprefix("file:") == str(tmp_path) and b.startswith(a)


def test_scratch_of_finished_queries_goes(spark):
    from pathlib import Path

    from tagrack.plans.materialize import written
    from tagrack.session import drop_scratch, scratch_path
    df = written(spark.range(3), "some")
    assert df.count() == 3
    folder = Path(scratch_path(spark, "x").replace("file://", "")).parent
    assert any(folder.iterdir())
    drop_scratch(spark)
    assert not folder.exists()
    assert written(spark.range(2), "next").count() == 2  # goes on as before
