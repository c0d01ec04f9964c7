"""The pipeline's stages one after the other against what brute force says about each stage's own input."""

import random
import tracemalloc
from pathlib import Path

import corpus_pipeline
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_operators import DOCS, classes_by_force, lines_by_force, sentence

from boxtally import session
from boxtally.llm import decontaminate, language
from boxtally.llm.text import blocks
from boxtally.session import cut_lineage, fresh_path, settled


def test_stages_one_by_one(spark):
    rng = random.Random(11)
    item = sentence(rng, 30)
    rows = []
    for d in range(40):
        rows.append((d, "\n".join(sentence(rng, 15) for _ in range(4)), "en", "a"))
    rows += [(40, rows[3][1], "en", "b"), (41, rows[4][1].replace(" ", "  "), None, "b"), (42, "12 %", None, "b"), (43, None, "en", "b"), (44, "", "en", "b")]
    rows += [(45, f"{sentence(rng, 20)} {item} {sentence(rng, 20)}", "en", None), (None, sentence(rng, 25), "en", None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    folder = fresh_path(spark)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        got = after.collect()
        kept[name] = {r.doc_id for r in got}
        if name == "language_id":
            assert kept[name] == {d for d, t in before if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            gone = set(lines_by_force(before))
            want = {d: "\n".join(x for no, x in enumerate(t.split("\n")) if d is None or (d, no) not in gone) for d, t in before}
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        elif name == "near_dedup":
            classes = classes_by_force([r for r in before if r[0] is not None])
            assert kept[name] == {d for d, c in classes.items() if d == c} | {None}
        elif name == "decontaminate":
            w = decontaminate.word_shingles(item)
            assert kept[name] == {d for d, t in before if len(w & decontaminate.word_shingles(t)) < 0.8 * len(w)}
        else:
            assert kept[name] == {d for d, _ in before} and all(r.exact for r in got)
        docs = after
    assert 45 in kept["near_dedup"] and 45 not in kept["decontaminate"]


def test_run_over_the_smallest_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 200 and out.filter("not exact").count() == 0


def test_rows_with_equal_or_missing_ids_are_judged_apart(spark):
    rng = random.Random(12)
    first, other, third, item = sentence(rng, 60), sentence(rng, 60), sentence(rng, 60), sentence(rng, 30)
    rows = [(1, first), (2, first), (2, other), (3, third), (3, third), (None, third), (None, other), (4, f"{sentence(rng, 60)} {item}"), (4, sentence(rng, 60)), (None, item)]
    docs = spark.createDataFrame([(d, t, "en", "a") for d, t in rows], DOCS).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, first), (2, other), (3, third), *rows[7:]], key=str)
    folder = fresh_path(spark)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_benchmarks(spark, docs, folder).collect()]
    assert sorted(kept, key=str) == sorted([*rows[:7], rows[8]], key=str)
    lines = [(1, "a line that comes twice"), (2, "a line that comes twice\nits own line"), (2, "another text\nwith its lines"), (None, "its own line"), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(d, t, "en", "a") for d, t in lines], DOCS).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.distinct_lines(spark, docs, "").collect()]
    want = [lines[0], (2, "its own line"), lines[2], (None, ""), (5, "x"), (5, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_task_holds_a_block_of_texts_and_not_a_whole_batch(spark, monkeypatch):
    docs = spark.createDataFrame([("some words of a text", "en")], "text string, lang string")
    held, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, *rest: held.append(run) or plain(df, run, *rest))
    assert language.fit(docs).languages == ["en"]
    text = "some words of a text " * 100
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 5000, "text": [text] * 10_000})
    tracemalloc.start()
    got = pd.concat(b.to_pandas() for b in held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and got["lang"].value_counts().nunique() == 1
    assert got[got["bucket"] >= language.BUCKETS]["n"].tolist() == [500 * 5000] * 2
    assert list(blocks(pa.array(["a" * 5, None, "b" * 30, "c", ""]), 10)) == [(0, 2), (2, 3), (3, 5)]


def test_only_rows_that_may_go_are_shuffled_with_their_texts(spark):
    rows = spark.range(500).select(F.col("id").alias("__row"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    left = corpus_pipeline.without(rows, rows.filter("__row % 50 = 3").select("__row"))
    assert sorted(r.text for r in left.collect()) == sorted(f"text {i}" for i in range(500) if i % 50 != 3)
    assert left.columns == rows.columns and corpus_pipeline.without(rows, rows.limit(0).select("__row")).count() == 500
    stays, may_go = left._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")
    assert "Union" in stays and "pythonUDF" in stays and "pythonUDF" in may_go


def test_searching_and_verifying_share_no_task(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "a text of other words altogether")], "doc_id long, text string")
    found = decontaminate.find_items(docs, spark.createDataFrame([(7, "one two three four five")], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 7)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_tables_of_a_step_go_once_its_result_is_written(spark, monkeypatch):
    paths, plain = [], session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda spark: paths.append(plain(spark)) or paths[-1])
    left = lambda: sum(Path(p.removeprefix("file:")).exists() for p in paths)
    got = settled(lambda: cut_lineage(settled(lambda: cut_lineage(spark.range(9))).filter("id > 3")))
    assert sorted(r.id for r in got.collect()) == [4, 5, 6, 7, 8] and len(paths) == 4 and left() == 1
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3 and left() == 2
    docs = spark.createDataFrame([(d, f"a line of its own {d * 977}\na line that all have", "en", "a") for d in range(9)], DOCS).selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    paths.clear()
    cleaned = corpus_pipeline.distinct_lines(spark, docs, "")
    assert len(paths) > 8 and left() == 2  # the numbered rows and the lines that go
    assert sum("all have" in r.text for r in cleaned.collect()) == 1 and cleaned.count() == 9
    assert "BroadcastHashJoin" not in cleaned._jdf.queryExecution().executedPlan().toString()
