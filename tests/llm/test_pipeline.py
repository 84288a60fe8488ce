"""The pipeline's stages one by one, against what each says it does."""

import os
import re
import subprocess
import sys

import corpus_pipeline

from corvane.llm import minhash, pii, quality
from corvane.llm.store import Scratch


def test_stages(spark, sf):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.put(stage(spark, tables[-1], sf), name))
    assert all(t.columns == names for t in tables[:-1])
    ids = [sorted(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    assert ids[1] == sorted(kept)
    first = {r["doc_id"] for r in minhash.near_duplicates(tables[1]).where("kept").collect()}
    assert ids[2] == sorted(first)
    assert ids[3] == ids[2] and set(ids[4]) == set(ids[3]) and ids[5] == ids[4]
    assert pii.pii_report(tables[3]).where("spans <> ''").count() == 0
    before = {r["doc_id"]: r["text"] for r in tables[2].collect()}
    for r in tables[3].collect():
        if r["text"] != before[r["doc_id"]]:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE|IBAN|SSN|KEY)\]", r["text"])
    assert tables[5].where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, tables[5].select("doc_id", "n_tokens").collect()))


GROWN = """
import gc, time
from pyspark.sql import SparkSession
from corvane.llm.store import Scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
heap = spark._jvm.java.lang.Runtime.getRuntime()
scratch = Scratch(spark, "grown")
held = [spark.sparkContext._gateway.new_array(spark._jvm.byte, 100 << 20) for _ in range(4)]
assert heap.totalMemory() > 400 << 20
del held
gc.collect()
time.sleep(1)
scratch.put(spark.range(3), "some")
print("HEAP", heap.totalMemory() >> 20)
"""


def test_the_drivers_heap_is_given_back():
    """What jobs have left behind doesn't keep the driver's heap grown for the jobs that follow."""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    said = subprocess.run([sys.executable, "-c", GROWN], env=env, capture_output=True, text=True, timeout=300)
    assert "HEAP" in said.stdout, said.stderr[-800:]
    assert int(said.stdout.split("HEAP")[1]) < 400
