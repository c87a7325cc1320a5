"""Work that grows faster than the input, or that one process did for all: spread by what it really takes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarryline.operators import lexical, temporal, vector
from quarryline.sources import datasource


def test_overlap_join_has_tasks_by_pairs(spark, monkeypatch):
    """800 short rows a side make 16,000 pairs: by their bytes they were one task of each half."""
    monkeypatch.setattr(temporal, "PAIRS", 500, raising=False)
    left = spark.range(800).select(F.col("id").alias("a"), (F.col("id") % 40 * 10).alias("s"), (F.col("id") % 40 * 10 + 1).alias("e"))
    right = left.toDF("b", "s2", "e2")
    pairs = temporal.overlap_join(left, right, ("s", "e"), ("s2", "e2"))
    each = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in each) == 40 * 20 * 20
    assert len(each) > 8 and max(r["count"] for r in each) <= 6 * 400


def test_bm25_packs_its_index_and_sends_no_query_apart(spark, monkeypatch):
    """The index takes a row for each range, not for each word and range; more jobs give the same hits."""
    docs = spark.range(1, 601).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 30)), F.when(F.col("id") % 50 == 0, "ÄÖ rare")).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 111 != 0, F.col("text"))).unionByName(spark.createDataFrame([(601, "")], docs.schema))
    asked = docs.filter("doc_id % 20 = 0").toDF("query_id", "text")
    index = lexical.build_index(docs)
    assert index.packed.count() == 3 and {r["n"] for r in index.blocks.filter("term = 'rare'").select(F.size("postings").alias("n")).collect()} == {5, 2}
    one = sorted(map(tuple, lexical.bm25_search(index, asked, 7).collect()))
    monkeypatch.setattr(lexical, "SENT", 1)
    monkeypatch.setattr(lexical, "BLOCK", 9)
    assert one == sorted(map(tuple, lexical.bm25_search(index, asked, 7).collect())) and len(one) > 200
    loaded = lexical.Index(index.docs, index.blocks, index.terms, index.n_docs, index.mean_words)
    assert one == sorted(map(tuple, lexical.bm25_search(loaded, asked, 7).collect()))
    files = [f.rsplit("/", 1)[0] for f in index.packed.inputFiles()]
    index.release()
    assert files and not any(os.path.exists(f.removeprefix("file:")) for f in files)


def test_vector_search_in_jobs_sends_one_block_at_a_time(spark, monkeypatch):
    emb = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in range(1, 9))).alias("embedding"))
    asked = emb.filter("vec_id % 5 = 0").toDF("query_id", "query_vec")
    want = sorted(map(tuple, vector.batched_search(emb, asked, 6, digits=6).collect()))
    monkeypatch.setattr(vector, "BLOCK", 40)
    kept = []
    got = vector.search_in_jobs(emb, asked, 6, digits=6, keep=lambda df: kept.append(df) or df)
    assert len(kept) == 2 and sorted(map(tuple, got.collect())) == want and len(want) == 354  # the zero vector has no hits


def test_batch_reader_deals_folders_and_holds_no_file(tmp_path, monkeypatch):
    """The planner lists levels of few folders only; tasks list the rest, each file once, at any depth."""
    monkeypatch.setattr(datasource, "DEALT", 6)
    monkeypatch.setattr(datasource, "TASK_BYTES", 4 * datasource.OPEN_BYTES + 1000)
    paths = [f"{tmp_path}/{t}/10-K/{i:04d}/full-submission.txt" for t in "AB" for i in range(20)]
    paths += [f"{tmp_path}/full-submission.txt", f"{tmp_path}/A/full-submission.txt", f"{tmp_path}/B/10-K/0003/more/full-submission.txt"]
    for p in paths:
        datasource._put(*datasource.open_path(p), p.encode())
    datasource._put(*datasource.open_path(p), p.encode())
    (tmp_path / "A" / "10-K" / "0000" / "other.txt").write_text("no submission")
    reader = datasource._BatchReader(str(tmp_path))
    monkeypatch.setattr(datasource, "_listed", lambda root: pytest.fail("the planner lists every file"))
    parts = reader.partitions()
    assert len(parts) > 8 and sum(p.folders for p in parts) == 10 and all(len(p.part().paths) <= 4 for p in parts)
    got = [x.as_py() for p in parts for b in reader.read(p) for x in b.column("path")]
    assert sorted(got) == sorted(paths)
    assert not list(reader.read(datasource._BatchReader(f"{tmp_path}/none").partitions()[0]))
