"""JDBC where executors are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

RUN = """
import sys
from pyspark.sql import SparkSession
from cellgrain import queries
shared, data = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{shared}/checkpoints", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print(sorted(map(tuple, queries.QUERIES["jdbc_scan"](spark, data).collect())))
frame = spark.createDataFrame([(None, None, 3), (1, "it's", None), (1, "", 4)], "R int, N string, K int")
read = spark.read.jdbc(queries._derby(spark, frame), "NATION", column="K", lowerBound=0, upperBound=8, numPartitions=4)
print(sorted(map(repr, map(tuple, read.collect()))))
spark.stop()
"""


def test_executors_of_a_cluster_read_the_database(sf_dir, tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).parents[1])}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), sf_dir], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    counts, rows = ran.stdout.strip().splitlines()[-2:]
    assert counts == "[(0, 5, 50.0), (1, 5, 55.0), (2, 5, 60.0), (3, 5, 65.0), (4, 5, 70.0)]"
    assert rows == str(sorted(map(repr, [(None, None, 3), (1, "it's", None), (1, "", 4)])))
