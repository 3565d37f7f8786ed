"""What only executors in processes of their own show."""

import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JDBC = """
from pyspark.sql import SparkSession, functions as F
from heddle.sources import readers
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://{tmp}/shared").config("spark.ui.enabled", "false").getOrCreate()
readers.DATABASE_ROWS = 40
rows = spark.createDataFrame([(i, None if i % 7 == 0 else "" if i % 7 == 1 else 'a "b", c' + chr(10) + str(i), i / 7) for i in range(100)], "k long, s string, d double")
back = readers.round_trip(rows, "jdbc", "file://{tmp}/shared/db")
for _ in range(2):
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
assert back.where("k >= 50").count() == 50 and readers.round_trip(rows.limit(0), "jdbc", "file://{tmp}/shared/none").count() == 0
print("same")
"""


def test_jdbc_on_a_cluster(tmp_path):
    there, home = os.path.dirname(pyspark.__file__), tmp_path / "home"
    home.mkdir()
    for x in os.listdir(there):
        (home / x).symlink_to(os.path.join(there, x))
    env = os.environ | {"SPARK_HOME": str(home), "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", JDBC.replace("{tmp}", str(tmp_path))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("same"), done.stderr[-2000:]
