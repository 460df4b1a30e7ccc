"""The pipeline against a plain version of itself over a small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from wayline.llm import bpe
from wayline.llm.queries import vocabulary


def corpus():
    random.seed(11)
    vocab = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    items = [text(25) for _ in range(5)]
    shared = text(60)
    rows = [text(120) for _ in range(20)]
    rows += [rows[0], rows[1] + " end", f"{text(80)}\n{shared}", f"{text(80)}\n{shared}", f"{text(60)} {items[2]} {text(40)}", "spam " * 200, "too short", None]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{i}.parquet")
            docs = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        kept.append(sorted(r["doc_id"] for r in out.select("doc_id").collect()))
    clean = set(range(20))
    assert set(kept[0]) == set(range(25)) and clean <= set(kept[-1])
    assert 20 not in kept[1] and 24 in kept[2] and 24 not in kept[3] and 23 in kept[3]
    want = {}
    codec = bpe.load(open(vocabulary(), encoding="utf-8").read())
    for r in docs.collect():
        want[r["doc_id"]] = len(codec.encode(r["text"])) // 4
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    lines = docs.select(F.explode(F.split("text", "\n")).alias("l")).where("length(l) >= 25").groupBy("l").count().where("count > 1")
    assert lines.count() == 0


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    """Every stage passes columns that its own tables have too, nulls and repeated rows, and makes nothing of nothing."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, key long, `class` string, h long, line string, bpe string, id long"
    texts, items = corpus()
    rows = [(i, texts[i], None, "s", None, "n", 1, "c", 2, "l", "b", 3) for i in range(3)]
    rows += [rows[0], (None, texts[3], "en", None, 1, None, None, None, None, None, None, None), (9, None, "en", "s", 0, "n", 1, "c", 2, "l", "b", 3)]
    full = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, items[0]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full, str(tmp_path))
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
        assert {(False, 0), (False, 1), (False, 2), (True, 0)} <= set(ids), name
        if name != "bpe":
            assert out.columns == full.columns
        assert stage(spark, full.limit(0), str(tmp_path)).count() == 0
