import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
JOB = """
import os, sys
from pyspark.sql import SparkSession
from tallyworks.llm.common import cut, drop
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
own = lambda: [x for x in os.listdir(sys.argv[1]) if x.startswith("tallyworks")]
one, two = cut(spark.range(5)), cut(spark.range(7))
assert one.count() == 5 and two.count() == 7 and len(own()) == 2
drop(one)
assert len(own()) == 1
spark.stop()
"""


def test_what_is_written_goes_with_the_session(tmp_path):
    subprocess.run([sys.executable, "-c", JOB, str(tmp_path)], check=True, env=os.environ | {"PYTHONPATH": HERE}, capture_output=True, timeout=300)
    assert [x for x in os.listdir(tmp_path) if x.startswith("tallyworks")] == []
