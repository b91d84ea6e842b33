"""Every operator where workers have no copy of the package: started from another folder, without it on their path."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from strandex.llm import op03_language, op04_decontaminate, op05_pii, op07_secrets, op08_ngram_join, op09_packing, op11_alignment, op12_sharding, op13_prefix_trie

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
docs = spark.createDataFrame([(i, f"some words of text number {i} and more of them " * 9, "en", "a") for i in range(60)], "doc_id long, text string, lang string, source string")
turns = spark.createDataFrame([(i, k, "user", f"hello {k * (i % 3)}") for i in range(9) for k in range(3)], "conv_id long, turn long, role string, text string")
items = spark.createDataFrame([(1, "some words of text number 7 and more of them some words of text")], "item_id long, text string")
runs = [
    lambda: op03_language.identify(docs), lambda: op04_decontaminate.contamination(docs, items), lambda: op05_pii.personal_data(docs), lambda: op07_secrets.secret_scan(docs), lambda: op08_ngram_join.near_duplicates(docs),
    lambda: op09_packing.packed(docs), lambda: op11_alignment.alignment(docs), lambda: op12_sharding.sharded(docs), lambda: op13_prefix_trie.prefix_trie(turns),
]
print("rows", [run().count() for run in runs])
"""


def test_foreign_workers(tmp_path):
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": path}
    got = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500, check=False)
    line = [x for x in got.stdout.splitlines() if x.startswith("rows")]
    if not line:
        pytest.fail(got.stderr[-2000:])
    counts = eval(line[0].removeprefix("rows"))  # noqa: S307
    assert counts[0] == counts[2] == counts[3] == counts[4] == counts[5] == counts[6] == counts[7] == 60 and counts[1] > 0 and counts[8] > 3
