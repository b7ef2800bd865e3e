"""Changed reports: alike ones are evaluated once, and no more of them than decides."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plain(cases, dims):
    """Every changed report of every case evaluated on its own."""
    from assaykit.operators import robustness, submission
    from assaykit.sources.scratch import stored

    cases = stored(cases)
    links = stored(robustness.matrix(cases, applicable_only=True).withColumn("prediction_id", F.concat_ws("__", "prediction_id", "kind")))
    texts = links.select(F.col("case_id").alias("_case"), F.col("prediction_id").alias("_id"), F.col("text").alias("html"))
    changed = cases.drop("html").join(texts, F.col("case_id") == F.col("_case")).drop("case_id", "_case").withColumnRenamed("_id", "case_id")
    return sorted(map(tuple, robustness.summarize_links(submission.results(changed, dims=dims), links).collect()))


def _odd(spark):
    """Cases with nulls, without findings, in both languages, with expectations or documents alone, and one without an id."""
    from assaykit.sources import reports

    some = reports.cases(spark, SF).where("case_id < 24")
    null = lambda *names: {n: F.lit(None).cast(some.schema[n].dataType) for n in names}
    moved = lambda by, **new: some.withColumns({"case_id": F.col("case_id") + by, **new})
    parts = [
        some, moved(1000, **null("gold", "urgent", "relevance", "retrieved", "expectations", "locale")), moved(2000, **null("findings")), moved(3000, reference=F.lit("")),
        moved(4000, locale=F.lit("pt-BR"), findings=F.lit("Nódulo de 6 mm e 12 mm no lobo direito. Sem derrame pleural.")), moved(5000, findings=F.lit("No mass of 5 mm, 7 mm or 2 cm. Left effusion."), reference=F.lit(None).cast("string")),
        moved(0, case_id=F.lit(None).cast("bigint")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def test_changes_are_noticed_as_if_each_report_were_evaluated_on_its_own(spark):
    from assaykit.operators import noticing, robustness

    cases = _odd(spark)
    got = sorted(map(tuple, noticing.rates(cases).collect()))
    assert got == _plain(cases, robustness.NOTICING) and len(got) == 8


def test_alike_reports_are_evaluated_once(spark, monkeypatch):
    """Copies of cases count, but nothing is evaluated again for them; what a first look notices isn't looked at again."""
    from assaykit.operators import catalogue, evaluators, robustness
    from assaykit.plans import run_queries
    from assaykit.sources import reports

    base = reports.cases(spark, SF).where("case_id < 60")
    copies = base.select(*(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("_i") if c == "_i" else c for c in [*base.columns, "_i"])).withColumn("case_id", F.col("case_id") + F.col("_i") * 1000).drop("_i")
    seen, checks, quality = {}, catalogue.with_checks, evaluators.quality

    def counted(name, own):
        def of(rows, *more, **named):
            seen[name] = seen.get(name, 0) + rows.count()
            return own(rows, *more, **named)

        return of

    monkeypatch.setattr(catalogue, "with_checks", counted("checks", checks))
    monkeypatch.setattr(evaluators, "quality", counted("quality", quality))
    monkeypatch.setattr(reports, "cases", lambda *_: copies)
    rows = run_queries.perturbation_run(spark, SF).collect()
    total = sum(r.n for r in rows)
    assert next(r.n for r in rows if r.kind == "critical_invent") == 1200 and total > 3000
    assert seen["checks"] < total / 5 and 0 < seen["quality"] < seen["checks"]
    monkeypatch.undo()
    assert sorted((r.kind, r.n, r.caught, r.rate) for r in rows) == _plain(copies, robustness.NOTICING)
