"""Costly rows in many tasks; resamples beyond a period of the generator; searches by blocks of products."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_cases_are_dealt_to_several_tasks(spark):
    from assaykit.sources import reports

    for rows in (reports.cases(spark, SF), reports.reports(spark, SF)):
        held = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(held) >= 4 and sum(r["count"] for r in held) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_cases_without_gold_have_no_matches(spark):
    from assaykit.operators import evaluators
    from assaykit.plans import report_queries
    from assaykit.sources import reports

    every = evaluators.quality(reports.cases(spark, SF)).select("case_id", F.posexplode("matches").alias("n", "m")).select("case_id", "n", "m.finding", "m.match")
    got = report_queries.greedy_match(spark, SF).select("case_id", "n", "finding", "match")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))


def test_a_period_gives_the_same_resamples(spark, monkeypatch):
    """The join's totals and the period's, where both can be had; draws beyond the period repeat it."""
    import random

    from assaykit.operators import agreement

    r = random.Random(4)
    scores = spark.createDataFrame([(i, r.randint(-1000, 1000)) for i in range(1237)], "pos long, tenths long")
    want = {x.r: x.total for x in agreement.resampled_sums(scores, 1237, 50, 42).collect()}
    assert {x.r: x.total for x in agreement.period_sums(scores, 1237, 50, 42).collect()} == want and len(want) == 50


def test_numbers_of_places_and_draws_backwards(spark):
    import numpy as np

    from assaykit.operators import agreement

    got = spark.range(2000).select("id", (agreement.draw(7, F.col("id") + 1) * 4294967296.0).cast("long").alias("x")).toPandas()
    assert (agreement.drawn_by(got["x"].to_numpy().astype(np.uint32), 7) == got["id"].to_numpy()).all()
    for n in (1, 7, 1000, 7_200_003, 50_000_017):
        pos = np.unique(np.clip(np.array([0, 1, n // 3, n // 2, n - 2, n - 1]), 0, n - 1)).astype(np.int64)
        first, after = agreement.first_number(pos, n), agreement.first_number(pos + 1, n)
        place = lambda x: np.floor(x.astype(np.float64) / 4294967296.0 * float(n))  # noqa: E731, B023
        assert (place(first) == pos).all() and (place(after - 1) == pos).all() and ((first == 0) | (place(first - 1) < pos)).all()


def test_searches_by_products_equal_brute_force(spark, monkeypatch):
    """Copies, repeated ids, null and zero vectors, slices and blocks of a few rows; the old pairwise join is gone from the plan."""
    import math
    import random

    from assaykit.operators import retrieval

    r = random.Random(3)
    kinds = [[r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)] for _ in range(30)]
    rows = [(i, r.choice(kinds)) for i in range(300)] + [(7, kinds[0]), (7, kinds[0]), (301, None), (302, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "SLICE", 200)
    queries = [x for x in rows if x[0] % 15 == 0 and x[1] and any(x[1])]
    found = retrieval.nearest(spark.createDataFrame(queries, "id long, v array<float>"), df, 5)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    sim = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 9) if b and any(b) else -9
    want = {(q, d, k + 1) for q, a in queries for k, (_, d) in enumerate(sorted((-sim(a, b), d) for d, b in rows if d != q)[:5])}
    assert {(x["query"], x["doc"], x["pos"]) for x in found.collect()} == want


def test_measurements_end_before_other_letters_too(spark, tmp_path):
    import duckdb

    from assaykit.plans import text_queries

    texts = ["231.87 enßielich", "ß12 mm", "12 mm, 3cm and 4 mm\u00e9", "5 mmx 6 mm_ 7,5 cmß", "no", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(text_queries.registry.sql["measurements"]).fetchall()
    assert sorted(map(tuple, text_queries.measurements(spark, str(tmp_path)).collect())) == sorted(want) and dict((i, n) for i, n, _ in want)[0] == 1


def test_checks_of_one_dimension_are_those_of_all(spark):
    from assaykit.operators import catalogue
    from assaykit.sources import reports

    rows = reports.cases(spark, SF)
    own = catalogue.with_checks(rows, dims=("GUIDE",)).select("case_id", F.inline("structural")).where("id is not null")
    every = catalogue.structural_checks(rows).where("dim = 'GUIDE'")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, every.select(own.columns).collect())) and own.count() > 0


def test_tokens_match_as_pair_by_pair(spark):
    """Matching tokens counted by words and beginnings, against each pair in a loop; what gold is told against isn't made without gold."""
    import random

    from assaykit.functions import clinical, text
    from assaykit.operators import evaluators

    r = random.Random(5)
    words = ["fracture", "fractional", "fractured", "fraction", "hemorrhage", "hemorrhoid", "hemorrhoids", "hemor", "frac", "nodule", "nodular", "node", "left", "mass", "masses", "mas", "acute"]
    rows = [(i, r.choices(words, k=r.randint(0, 6)), r.choices(words, k=r.randint(0, 6))) for i in range(300)]

    def alike(a, b):
        return a == b or (min(len(a), len(b)) >= 5 and a[:5] == b[:5] and "|".join(sorted((a, b))) not in text.CONFUSABLE)

    got = spark.createDataFrame(rows, "id long, a array<string>, b array<string>").select("id", clinical.hits(F.col("a"), F.col("b")).alias("n"))
    assert {x.id: x.n for x in got.collect()} == {i: sum(any(alike(x, y) for y in b) for x in a) for i, a, b in rows}
    gold = "array<struct<finding:string,severity:string,location:string,laterality:string,measurements:array<string>,negated:boolean>>"
    cases = spark.createDataFrame([(1, "<b>Findings</b><br>Large hepatic metastasis.", "a mass")], "case_id int, html string, findings string").withColumn("gold", F.expr(f"cast(array() as {gold})"))
    one = evaluators.quality(cases).first()
    assert one.matches == [] and one.invented == [] and one.synthesis is None and one.quality_mode == "structural-fallback"


def test_a_submission_is_dealt_out_and_evaluated_by_the_locales_it_has(spark, monkeypatch):
    from assaykit.operators import catalogue, submission
    from assaykit.sources import reports

    packs, parts, own = [], [], catalogue.with_checks

    def with_checks(rows, pack):
        packs.append(pack.words.key)
        parts.append(rows.groupBy(F.input_file_name().alias("f")).count().count())
        return own(rows, pack)

    monkeypatch.setattr(catalogue, "with_checks", with_checks)
    cases = reports.cases(spark, SF).coalesce(1)
    assert submission.checked(cases).count() == cases.count()
    assert packs == ["en-US"] and parts[0] >= 4


def test_scores_to_resample_come_from_their_run_alone(spark, monkeypatch):
    """The resampled scores are counted from the checks of their run; nothing is stored but case, score and position's part."""
    from assaykit.plans import pairing_queries
    from assaykit.sources import scratch

    kept, own = [], scratch.stored
    for place in (scratch, pairing_queries.adapters):
        monkeypatch.setattr(place, "stored", lambda df: kept.append(df.columns) or own(df))
    plan = pairing_queries.bootstrap_ci(spark, SF)
    assert plan.first()["n"] == pairing_queries.adapters.results(spark, SF).where("run = 0").count()
    assert kept == [["case_id", "tenths", "_part"]]


def test_measurements_end_at_blanks_that_the_sql_has_not(spark, tmp_path):
    """Blanks beyond ASCII and the vertical tab aren't white space of the SQL."""
    from assaykit.plans import text_queries

    texts = {"5 mm": 1, "5\tmm": 1, "5\r\n mm": 1, "5\u00a0mm": 0, "5\u000bmm": 0, "5\u2003cm 7 cm": 1, "5\ufeffmm": 0, "5\u2028mm": 0}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n, x.n_metric) for x in text_queries.measurements(spark, str(tmp_path)).collect()}
    assert got == {i: (n, n) for i, n in enumerate(texts.values())}


def test_measurements_have_no_marks_of_any_script(spark, tmp_path):
    """The SQL's strip_accents takes all of them, those newer than the JVM's own class too."""
    from assaykit.plans import text_queries

    texts = {"5\u05b0mm": 1, "5\u0651 m\u0902m": 1, "1\U0001e8d02 cm": 1, "5 mm\u1ac1 \u089c": 1, "5 \u212bm": 0, "\u3042 5\u20dd mm": 1, "5 \u3042mm": 0}
    spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n, x.n_metric) for x in text_queries.measurements(spark, str(tmp_path)).collect()}
    assert got == {i: (n + (i == 4), n) for i, n in enumerate(texts.values())} | {9: (None, None)}


def test_perturbed_reports_are_looked_at_by_what_should_notice_them(spark, monkeypatch):
    """The same counts as over all dimensions, without the guidelines; changes are made once, not again to see whether there are any."""
    from assaykit.operators import evaluators, robustness, scoring
    from assaykit.plans import run_queries
    from assaykit.sources import reports

    assert set(robustness.NOTICING) == {d for _, dims, _ in robustness.KINDS for d in dims} and "GUIDE" not in robustness.NOTICING
    with monkeypatch.context() as m:
        m.setattr(robustness, "NOTICING", scoring.DIMS)
        want = sorted(map(tuple, run_queries.perturbation_run(spark, SF).collect()))
    monkeypatch.setattr(evaluators, "guidelines", lambda *_: pytest.fail("guidelines are evaluated"))
    assert sorted(map(tuple, run_queries.perturbation_run(spark, SF).collect())) == want and len(want) == 8
    plan = robustness.matrix(reports.cases(spark, SF), applicable_only=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(filter(" not in plan
