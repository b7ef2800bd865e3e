"""Columns of any name and ids of any type stay as they are; DataFrames that nobody prepared work; empty tables give empty results."""

import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm import bpe, chosen_path, decontam, license_scan, line_dedup, lm_scoring, substring_dedup
from assaykit.llm.queries import vocabulary

from .data import documents, empty, prose
from .test_corpus_operators import labels

ODD = ["_id", "_k", "_g", "_gone", "_gone_lines", "_text", "_row", "_hit", "_m", "_set_digest", "gone_id", "items", "n_words", "n_hit", "label_id", "id", "v", "k", "gone", "first"]


@pytest.fixture(scope="module")
def odd(spark):
    import random

    r = random.Random(3)
    block = "\n".join(" ".join(prose(r, 9).split()) for _ in range(4))
    texts = [prose(r, 60) + "\n" + block, prose(r, 50) + "\n" + block, prose(r, 80), "!!!", None, ""]
    rows = [(i, t, None if t is None else len(t), *(f"{c} {i}" for c in ODD)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in ODD))


def same(found, docs, but=()):
    """found has the schema of docs, and its rows the values of docs' rows of that id outside of the columns in but."""
    assert found.schema == docs.schema
    known = {x.doc_id: x.asDict() for x in docs.collect()}
    rows = found.collect()
    assert all({k: v for k, v in x.asDict().items() if k not in but} == {k: v for k, v in known[x.doc_id].items() if k not in but} for x in rows)
    return {x.doc_id: x for x in rows}


def test_columns_of_any_name_stay(spark, odd):
    bench = spark.createDataFrame([(1, odd.where("doc_id = 2").first().text)], "item_id long, text string")
    assert same(decontam.remove_documents(odd, bench), odd).keys() == {0, 1, 3, 4, 5}
    for most in (500_000, 1):
        assert same(decontam.remove_spans(odd, bench, max_windows=most), odd, {"text"}).keys() == {0, 1, 2, 3, 4, 5}
        got = decontam.scan(odd, bench, keep=odd.columns, max_windows=most)
        assert got.where("doc_id = 2").first().n_hit > 0 and got.where("_row = '_row 2' and _text = '_text 2'").count() == 1
    found = same(line_dedup.remove_repeats(odd), odd, {"text", "n_chars"})
    assert len(found[1].text) < len(found[0].text) and found[1].n_chars == len(found[1].text)
    assert same(chosen_path.keep_one(odd), odd).keys() == {0, 1, 2, 3, 4, 5}
    assert same(chosen_path.keep_one(odd.union(odd)), odd).keys() == {0, 1, 2, 3, 4, 5}
    assert same(substring_dedup.remove_copies(odd), odd, {"text"}).keys() == {0, 1, 2, 3, 4, 5}
    marked = lm_scoring.flagged(odd, labels(spark, [(2, 1, 0)]))
    assert marked.columns == [*odd.columns, "_target"] and [x.doc_id for x in marked.where("_target").collect()] == [2]
    assert same(marked.drop("_target"), odd).keys() == {0, 1, 2, 3, 4, 5}


def test_stages_keep_whole_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(0, 1, 0), (3, 0, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, odd.where("doc_id = 2").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        same(stage(spark, docs, str(tmp_path)), docs, {"text", "n_chars"})


def test_a_unique_text_stays(spark):
    r = __import__("random").Random(5)
    long = prose(r, 60)
    rows = [(5, "!!!"), (5, "???"), (5, None), (5, ""), (6, long), (6, long.upper()), (6, long), (7, long + " more"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        got = [tuple(x) for x in chosen_path.keep_one(docs.repartition(parts)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, [(5, "!!!"), (5, "???"), (5, None), (5, ""), (None, long), next(x for x in got if x[0] == 6)]))
        first = [x for x in got if x[0] == 6] if parts == 1 else first
        assert [x for x in got if x[0] == 6] == first  # whatever the partitions


def test_ids_of_any_type(spark):
    r = __import__("random").Random(6)
    texts = [prose(r, 60) for _ in range(6)]
    rows = [(f"id-{i}", t) for i, t in enumerate([*texts, texts[0], texts[1] + " more"])] + [(None, texts[2]), ("zz", None)]
    named = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    assert {x.id: (x.class_id, x.n_links) for x in chosen_path.classes(named).where("id is not null").collect()} == {
        **{f"id-{i}": (f"id-{i}", int(i < 3)) for i in range(6)}, "id-6": ("id-0", 1), "id-7": ("id-1", 1), "zz": ("zz", 0)}
    assert {x.doc_id for x in chosen_path.keep_one(named).collect()} == {*(f"id-{i}" for i in range(6)), None, "zz"}
    found = {x.doc_id: x for x in substring_dedup.summary(named).collect()}
    assert found["id-6"].first_ids == ["id-0"] and found["id-6"].has_copy and not found["id-0"].has_copy and found["id-0"].has_repeat and found["zz"].first_ids == []
    left = {x.doc_id: x.text for x in substring_dedup.remove_copies(named).collect()}
    assert left["id-6"] == "" and left["id-0"] == texts[0] and left[None] == texts[2]
    assert line_dedup.remove_repeats(named).where("doc_id = 'id-0'").count() == 1
    short = spark.createDataFrame([(1, texts[0]), (2, texts[0])], "doc_id smallint, text string")
    assert [x.doc_id for x in chosen_path.keep_one(short).collect()] == [1] and substring_dedup.summary(short).where("has_copy").first().doc_id == 2


def test_empty_tables(spark):
    none = empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert chosen_path.classes(none).count() == chosen_path.keep_one(none).count() == 0
    assert substring_dedup.summary(none).count() == substring_dedup.remove_copies(none).count() == 0
    assert license_scan.scan(none).count() == decontam.scan(none, bench).count() == decontam.remove_documents(none, bench).count() == 0
    assert bpe.encode(none, vocabulary()).count() == line_dedup.remove_repeats(none).count() == 0
    assert decontam.remove_documents(documents(spark), bench).count() == documents(spark).count()


def test_a_frame_that_nobody_prepared(tmp_path):
    """In a fresh process outside of the repository: workers don't find the package by their path."""
    code = """
        import sys
        sys.path.insert(0, sys.argv[1])
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from assaykit.llm import chosen_path, decontam
        docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
        print(chosen_path.keep_one(docs).count(), decontam.remove_documents(docs, docs.selectExpr("doc_id as item_id", "text")).count())
    """
    import pathlib

    root = str(pathlib.Path(__file__).resolve().parents[2])
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code), root, f"file://{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["1", "0"], done.stderr[-2000:]
