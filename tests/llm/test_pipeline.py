import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        frames[name] = docs
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: [r["doc_id"] for r in f.select("doc_id").collect()] for n, f in frames.items()}
    assert set(ids["language_id"]) == {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i in sorted(ids["language_id"]):
        first.setdefault(normal(texts[i]), i)
    assert sorted(ids["exact_dedup"]) == sorted(first.values())
    from tests.llm.test_near_dedup import components

    rows = [(i, texts[i]) for i in sorted(ids["exact_dedup"])]
    _, groups = components(rows)
    heads = {}
    for (i, _), g in zip(rows, groups, strict=True):
        heads[g] = min(i, heads.get(g, i))
    assert sorted(ids["near_dedup"]) == sorted(heads.values())
    copies = Counter(ids["mix_sources"])
    assert set(copies) <= set(ids["near_dedup"]) and max(copies.values()) <= 3
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(n * (len(whole.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())
    assert frames["pack"].agg({"length": "sum"}).first()[0] == total


def test_run_and_registration(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_columns_of_any_names(spark, tmp_path):
    """Names with dots, quotes and spaces go through every stage, and so does shard_documents."""
    from weftlink.llm.sharding import shard_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    names = ["meta.k", "a`b", "a b", "row", "c0", "doc_id.x"]
    wide = docs.toDF(*docs.columns)
    for n in names:
        wide = wide.withColumn("new", F.concat(F.lit(n), F.col("doc_id").cast("string"))).toDF(*wide.columns, n)
    order, frames = ["doc_id", "text", "lang", "source", "n_chars", *names], {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        wide = spark.read.parquet(f"{tmp_path}/{name}")
        frames[name] = wide
        if name != "pack":
            assert wide.columns == order
            rows = wide.collect()
            assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    sharded = shard_documents(frames["exact_dedup"])
    assert set(order) < set(sharded.columns) and all(r["meta.k"] == f"meta.k{r['doc_id']}" for r in sharded.collect())
