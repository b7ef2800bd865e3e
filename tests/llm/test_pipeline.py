"""The pipeline over a small folder of tables, each stage held against a brute-force version on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm import bpe, decision_list, line_dedup, pii, quality_fm
from assaykit.llm.queries import vocabulary

from .data import SCHEMA, empty, prose
from .test_corpus_operators import brute_classes, labels
from .test_words_and_spans import brute_hits, words


def junk(r, n):
    return " ".join(w + r.choice(["$$$", "###", "!!"]) for w in prose(r, n).split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(31)
    items = [(i, " ".join(prose(r, 30).split())) for i in range(5)]
    block = "\n".join(prose(r, 9).replace("\n", " ") for _ in range(4))
    long_line = " ".join(prose(r, 60).split())
    texts = [prose(r, r.randint(60, 150)) for _ in range(120)] + [junk(r, r.randint(60, 150)) for _ in range(60)]
    good, base = list(range(120)), " ".join(prose(r, 120).split())
    texts += [base, base + " changed", "new " + base]  # near copies, no line of which is the same
    texts += [prose(r, 70) + "\n" + block + "\n" + prose(r, 20) for _ in range(3)]  # a run of lines that repeats
    texts += [prose(r, 70) + "\n" + long_line for _ in range(2)] + [long_line]  # a long line that repeats
    texts += [prose(r, 70) + " " + items[2][1] + " " + prose(r, 20), items[4][1].upper()]  # passages of the benchmark
    texts += [None, "", "one"]
    rows = [(i, t, "en", "src", None if t is None else len(t), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose(r, 80), None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    labels(spark, [(i, int(i in good), 0) for i in range(180)]).write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def brute_lines(rows, long=line_dedup.LONG):
    """Texts without later copies of three lines, or of fewer with more than `long` words; None for texts of which nothing is left."""
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        if t is None or (i, t) in out:
            continue
        own = [(k, x.strip(line_dedup.BLANKS)) for k, x in enumerate(t.split("\n"))]
        own = [x for x in own if x[1]]
        gone = set()
        for n in (1, 2, 3):
            for s in range(len(own) - n + 1):
                g = tuple(x for _, x in own[s : s + n])
                if n < 3 and sum(len(re.findall(f"[^{line_dedup.BLANKS}]+", x)) for x in g) <= long:
                    continue
                if g in seen:
                    gone |= set(range(own[s][0], own[s + n - 1][0] + 1))
                seen.add(g)
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out[i, t] = left if not gone or re.search(r"[^\x20\x09-\x0D]", left) else None
    return out


def test_stages_equal_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, docs
    key = lambda rows: sorted(((x.doc_id, x.text) for x in rows), key=repr)
    before = now.collect()
    machine = quality_fm.fit(now, spark.read.parquet(f"{folder}/labels.parquet"))
    cache = quality_fm.Cache(quality_fm._marks)
    want = [x for x in before if machine.score([quality_fm.slots((x.text or "").encode(), x.n_chars, cache)])[0] >= 0.5]
    stages = dict(corpus_pipeline.STAGES)
    now = stages["quality"](spark, now, folder)
    assert now.columns == columns and key(now.collect()) == key(want)
    kept = {x.doc_id for x in want}
    assert len(kept & set(range(120))) >= 118 and len(kept & set(range(120, 180))) <= 2

    before = now.collect()
    cleaned = brute_lines([(x.doc_id, x.text) for x in before])
    want = sorted(((x.doc_id, cleaned.get((x.doc_id, x.text), x.text)) for x in before if x.doc_id is None or x.text is None or cleaned[x.doc_id, x.text] is not None), key=repr)
    now = stages["lines"](spark, now, folder).cache()
    assert now.columns == columns and key(now.collect()) == want and now.where("n_chars <> length(text)").count() == 0

    before = sorted({(x.doc_id, x.text) for x in now.collect()}, key=repr)
    classes = brute_classes(before)
    keep = sorted((i for i, c, _ in classes if i is None or c is None or c == i), key=repr)
    now = stages["near_duplicates"](spark, now, folder).cache()
    assert now.columns == columns and sorted((x.doc_id for x in now.collect()), key=repr) == keep and 181 not in keep and 182 not in keep and 180 in keep

    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [x for x in now.collect() if not brute_hits(x.text, items)[1]]
    now = stages["decontaminate"](spark, now, folder).cache()
    assert now.columns == columns and key(now.collect()) == key(want)

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    want = sorted(((x.doc_id, library.encode(x.text or "", add_special_tokens=False).ids) for x in now.collect()), key=repr)
    got = stages["encode"](spark, now, folder).collect()
    assert sorted(((x.doc_id, x.token_ids) for x in got), key=repr) == want and all(x.n_tokens == len(x.token_ids) for x in got)
    assert sorted(((x.doc_id, x.token_ids) for x in corpus_pipeline.run(spark, folder).collect()), key=repr) == want


def test_empty_tables_and_clashing_columns(spark):
    none = labels(spark)
    assert quality_fm.keep_good(empty(spark), none).count() == 0 and pii.find(empty(spark)).count() == 0
    rules = decision_list.fit(empty(spark), none)
    assert rules == [] and decision_list.judge(empty(spark), rules).count() == 0
    odd = spark.createDataFrame([(1, "some words of a text", "a", "b", "c", 5)], "doc_id long, text string, _text string, _score string, c0 string, slots int").withColumn("_y", F.lit(1))
    kept = quality_fm.keep_good(odd, none, 0.0)
    assert kept.columns == odd.columns and kept.first() == odd.first()
    assert line_dedup.remove_repeats(odd).first() == odd.first()
    done = bpe.encode(odd, vocabulary()).first()
    assert done.n_tokens == len(done.token_ids) > 0
    assert decision_list.judge(odd, rules, keep=("doc_id", "_y")).first().base_failed and words("A b") == ["a", "b"]
