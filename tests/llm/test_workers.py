"""Workers that don't find this package run its functions."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.sql.warehouse.dir", {folder!r}).getOrCreate()
from pyspark.sql import functions as F
from tillsight.llm import chat, decontamination, hard_negatives, language_id, ngram_join, sketch, vector_search
docs = spark.createDataFrame([(i, "some words of document " + str(i % 3), "en", "s", 1) for i in range(6)],
                             "doc_id long, text string, lang string, source string, n_chars long")
print(ngram_join.keep_one(docs).count(), sketch.with_edits(docs).count())
print(decontamination.leaks(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count())
print(language_id.identify(docs, language_id.fit(docs)).count())
points = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(8)], "vec_id long, embedding array<float>, label int")
print(vector_search.top_k(points, F.col("vec_id") == 0).count(), hard_negatives.mine(points, F.col("vec_id") == 0, F.col("label")).count())
turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), chat.text_parts(F.col("text")).alias("parts"))
print(chat.digest(chat.format_turns(turns)).count())
"""


def test_functions_travel_with_their_tasks(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "script.py"
    script.write_text(SCRIPT.format(root=root, folder=str(tmp_path / "warehouse")))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split()[:2] == ["3", "6"]
