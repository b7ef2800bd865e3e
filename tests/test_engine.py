import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from assaykit.functions import clinical, text
from assaykit.functions.lexicon import ENGLISH, PORTUGUESE
from assaykit.functions.rounding import to_fixed
from assaykit.operators import adjudication, agreement, board, calibration, contamination, evaluators, extraction, pairing, release, retrieval, robustness, scoring, submission, summary
from assaykit.sources import artifacts
from assaykit.sources.scratch import with_position
from assaykit.streaming import submissions

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_to_fixed_rounds_the_exact_value(spark):
    values = [(0.15, 1, 0.1), (0.35, 1, 0.3), (1.005, 2, 1.0), (6.25, 1, 6.3), (18.75, 1, 18.8), (-6.25, 1, -6.3), (83.95, 1, 84.0), (2.5, 0, 3.0), (0.0, 1, 0.0), (1e-7, 6, 0.0)]
    from decimal import ROUND_HALF_UP, Decimal

    for x, d, want in values:
        exact = float(Decimal(abs(x)).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP)) * (-1 if x < 0 else 1)
        got = one(spark, to_fixed(F.lit(x), d).alias("x")).x
        assert got == exact, (x, d)
        if x != 83.95:
            assert got == want
    assert one(spark, to_fixed(F.lit(None), 1).alias("x")).x is None


def case(spark, checks):
    rows = [(0, 1, d, s, p) for d, s, p in checks]
    return scoring.score_dimensions(scoring.case_counts(spark.createDataFrame(rows, "run int, case_id int, dim string, severity string, passed boolean")))


def test_gates_in_order(spark):
    fine = [(d, "minor", True) for d in scoring.DIMS]
    r = scoring.combine(case(spark, fine)).first()
    assert (r.overall, r.verdict, r.confidence, r.phase, r.gate_reasons) == (100.0, "PASS", "medium", "degraded", [])
    r = scoring.combine(case(spark, [*fine, ("CRIT", "critical", False)])).first()
    assert (r.score_CRIT, r.overall, r.verdict) == (50.0, 59.9, "FAIL") and r.gate_reasons[0] == "cap: critical failure"
    r = scoring.combine(case(spark, [*fine, ("TERM", "major", False)])).first()
    assert (r.score_TERM, r.verdict_TERM, r.verdict) == (50.0, "FAIL", "PARTIAL") and "cap: failed dimension" in r.gate_reasons
    r = scoring.combine(case(spark, [("TERM", "minor", True)])).first()
    assert (r.score_CRIT, r.overall, r.verdict, r.gate_reasons) == (None, 83.9, "PARTIAL", ["no clinical dimension scored"])
    many = [("QUAL", "minor", True)] * 30 + [("QUAL", "major", False)] * 3
    r = case(spark, many).first()
    assert (r.score_QUAL, r.verdict_QUAL) == (70.0, "FAIL")
    assert case(spark, [("CRIT", "critical", False)] * 4 + [("CRIT", "minor", True)] * 96).first().score_CRIT == 20.0


def test_judge_scale_is_read_over_the_whole_result(spark):
    base = case(spark, [(d, "minor", True) for d in scoring.DIMS])

    def judged(scores, overall, mode=False):
        new = {f"judge_{d}": F.lit(s).cast("double") for d, s in zip(scoring.DIMS, scores, strict=True)}
        new |= {"judge_overall": F.lit(overall).cast("double"), "has_judge": F.lit(True), "judge_critical": F.lit(0), "judge_missing": F.lit(0), "judge_hallucinated": F.lit(0)}
        return scoring.combine(base.withColumns(new), True, judge_primary=mode).first()

    assert judged([4, 5, 4, 5, 5], 4.5).combined_CRIT == 80.0
    assert judged([3, 88, 90, 90, 90], 80).combined_CRIT == 3.0
    r = judged([5, 5, 5, 5, 5], 5)
    assert (r.overall, r.verdict, r.confidence, r.phase) == (100.0, "PASS", "high", "complete")


def test_ranks_go_to_eligible_entries_only(spark):
    cols = [c for c, _ in summary.ORDER]
    rows = [(k, "g", *v) for k, v in {"a": (True, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 1.0), "b": (False, 9.0, 9.0, 9.0, 9.0, 9.0, 0.0, 0.0), "c": (True, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)}.items()]
    got = {r.run: r["rank"] for r in summary.rank_entries(spark.createDataFrame(rows, ["run", "comparable_key", *cols])).collect()}
    assert got == {"c": 1, "a": 2, "b": None}


@pytest.mark.parametrize("units, alpha", [([[10, 20], [30, 40]], 0.70), ([[0, 100], [0, 100]], -0.50), ([[20, 30, 40]], 0.0), ([[5, 5], [5, 5]], 1.0), ([[1, None], [None, None]], 0.0)])
def test_interval_alpha(spark, units, alpha):
    rows = [(u, None if v is None else float(v)) for u, own in enumerate(units) for v in own]
    assert agreement.krippendorff_alpha(spark.createDataFrame(rows, "unit int, value double")).first().alpha == pytest.approx(alpha)


def test_kappas(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "a string, b string")
    assert agreement.cohens_kappa(pairs).first().kappa == 0.5
    assert agreement.cohens_kappa(spark.createDataFrame([("a", "a")], "a string, b string")).first().kappa == 1.0
    assert agreement.cohens_kappa(pairs.limit(0)).first().kappa == 0.0
    same = spark.createDataFrame([(i, c) for i, c in ((1, "x"), (1, "x"), (2, "y"), (2, "y"))], "item int, category string")
    assert agreement.fleiss_kappa(same, 2).first().kappa == 1.0


def sequential(seed):
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x9E3779B9) & 0xFFFFFFFF
        t = state ^ (state >> 16)
        t = (t * 0x21F0AAAD) & 0xFFFFFFFF
        t ^= t >> 15
        t = (t * 0x735A2D97) & 0xFFFFFFFF
        yield (t ^ (t >> 15)) / 4294967296


def test_bootstrap_follows_the_stream(spark):
    scores, draws = [10, 250, 700, 655, 431, 90, 1000], sequential(42)
    means = sorted(sum(scores[math.floor(next(draws) * 7)] for _ in range(7)) for _ in range(200))
    df = with_position(spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "case_id int, tenths long").repartition(3), "case_id")
    for parts in (1, 5):
        r = agreement.bootstrap_interval(df.repartition(parts), 200).first()
        assert (r.lower, r.upper) == (pytest.approx(means[5] / 70, abs=1e-6), pytest.approx(means[194] / 70, abs=1e-6))
    r = agreement.paired_bootstrap(df, 200).first()
    assert r.n == 7 and 0 < r.p_value <= 1 and r.mean_diff == pytest.approx(sum(scores) / 70, abs=1e-6)


def test_tests_of_shares(spark):
    rows = [(True, False)] * 5 + [(False, True)] * 2 + [(True, True)] * 9
    r = agreement.mcnemar(spark.createDataFrame(rows, "a boolean, b boolean")).first()
    assert r.p_value == pytest.approx(2 * sum(math.comb(7, i) for i in range(3)) / 2**7) and r.chi2 == pytest.approx(4 / 7, abs=1e-6)
    assert agreement.chi2_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6) and agreement.chi2_cdf(7.814728, 3) == pytest.approx(0.95, abs=1e-6)
    assert one(spark, agreement.cohens_h(F.lit(1.0), F.lit(0.0)).alias("h")).h == pytest.approx(math.pi, abs=1e-6)
    assert one(spark, agreement.erf(F.lit(1.0)).alias("e")).e == pytest.approx(math.erf(1), abs=2e-7)
    ranks = agreement.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 9.0)], "x double, y double")).first()
    assert ranks.rho == pytest.approx(0.866025, abs=1e-6)


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "query string, doc string, pos int")
    qrels = spark.createDataFrame([("q", "b", 3), ("q", "z", 1)], "query string, doc string, rel int")
    r = retrieval.metrics(retrieval.judged(retrieval.distinct_ranks(ranked), qrels), qrels).first()
    assert (r.n, r.mrr, r.precision_1, r.recall_3, r.precision_3, r.ndcg_5) == (3, 0.5, 0.0, 0.5, pytest.approx(1 / 3, abs=1e-6), None)
    assert r.ndcg_3 == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)), abs=1e-6)


def test_submissions(spark):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    got = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("d", 2, "z"), ("b", 3, "  ")], "instance_id string, pos int, model_output string")
    r = pairing.validation(want, got).first()
    assert (r.missing, r.extra, r.duplicates, r.empty_outputs, r.valid) == (1, 1, 1, 1, False)
    assert [(x.case_id, x.model_output) for x in pairing.latest_predictions(want, got).orderBy("case_id").collect()] == [("a", "y"), ("b", "  ")]


def test_text_functions(spark):
    assert one(spark, text.fold(F.lit(" Pneumotórax\n À  DIREITA ")).alias("x")).x == "pneumotorax a direita"
    assert one(spark, text.fold(F.lit("\u1ea4 \u00a0\u0391\u0301 x")).alias("x")).x == "a \u03b1 x"
    m = one(spark, text.measurements(F.lit("18x12x15 mm and 5 mm, 5 mm"), True).alias("m")).m
    assert m == ["18x12x15 mm", "5 mm"]
    assert one(spark, text.measurement_present(F.lit("nodule of 0,5 cm"), F.lit("0.5 cm")).alias("x")).x
    assert not one(spark, text.measurement_present(F.lit("nodule of 10.5 cm"), F.lit("0.5 cm")).alias("x")).x
    toks = [F.array(*map(F.lit, t.split())) for t in ("fracture left rib", "fractures rib", "fraction")]
    r = one(spark, clinical.coverage(toks[0], toks[1]).alias("c"), clinical.similarity(toks[2], toks[0]).alias("s"))
    assert r.c == pytest.approx(2 / 3) and r.s == 0
    assert one(spark, text.sanitize(F.lit("<script>x</script><b>a</b><i>")).alias("x")).x == "<b>a</b>&lt;i&gt;"
    assert one(spark, text.normalize_generated(F.lit("```html\na\r\n\r\n\r\nb```")).alias("x")).x == "<br>a<br><br>b"


def test_perturbations(spark):
    r = one(spark, robustness.flip_laterality(F.lit("Left and right")).alias("a"), robustness.flip_laterality(F.lit("à esquerda, lado direito"), "pt-BR").alias("e"), robustness.insert_negation(F.lit("One. Two.")).alias("b"), robustness.insert_negation(F.lit("mass")).alias("c"), robustness.drop_negation(F.lit("no fracture, without edema")).alias("d"))
    assert (r.a, r.b, r.c, r.d, r.e) == ("right and left", "One. no evidence of Two.", "no evidence of mass", "fracture, edema", "à direita, lado esquerdo")
    labels = F.array(F.lit("Subdural hematoma"))
    text_ = F.lit("Chest clear.<br>Large subdural hematoma on the left.<br><br><b>Impression</b><br>Hematoma. Cyst of 5 mm and 10,5 cm")
    r = one(spark, robustness.deny_target(text_, labels).alias("a"), robustness.drop_critical(text_, labels).alias("b"), robustness.corrupt_terms(text_).alias("c"), robustness.break_structure(text_).alias("d"), robustness.invent_critical(text_, F.lit(0.5)).alias("e"))
    assert "<br>no evidence of Large subdural hematoma" in r.a and "hematoma" not in r.b.lower() and "Chest clear." in r.b and r.c.endswith("blister of 5 mm and 10,5 cm")
    assert "<" not in r.d and "  " not in r.d and "left.New hepatic metastasis identified in segment VII measuring 32 mm. <br><br><b>Impression" in r.e
    draws = sequential(robustness.seed("7::measurement_scramble"))
    numbers = [(5.0, next(draws)), (10.5, next(draws))]
    want = [f"{n * (0.3 if d < 0.5 else 4.0) + 7:.1f}".replace(".", ",") for n, d in numbers]
    gold = [("Subdural hematoma", "critical", None, "left", [], False), ("pneumothorax", "minor", None, None, [], True)]
    cases = spark.createDataFrame([(7, "Subdural hematoma on the left. No pneumothorax. Cyst of 5 mm and 10,5 cm", gold, ["Subdural hematoma"], "en-US"), (8, "plain", [], [], "pt-BR"), (9, None, None, None, "en-US")], f"case_id int, findings string, gold {GOLD}, urgent array<string>, locale string")
    got = {(x.case_id, x.kind): x.text for x in robustness.matrix(cases).collect()}
    assert len(got) == 24 and f"Cyst of {want[0]} mm and {want[1]} cm" in got[7, "measurement_scramble"]
    some = {(x.case_id, x.kind) for x in robustness.matrix(cases, applicable_only=True).collect()}
    assert {k for i, k in some if i == 7} == {k for k, _, _ in robustness.KINDS} - {"structure_break", "terminology_corrupt"} | {"terminology_corrupt"} and {k for i, k in some if i == 8} == {"critical_invent"}
    assert robustness.seed("é") != robustness.seed("e")


def test_a_submission_from_predictions_to_results(spark):
    found = [("Acute subdural hematoma", "critical", None, "left", [], False)]
    rows = [(k, "CT of the head", "acute subdural hematoma on the left", found if k < 3 else [], "en-US") for k in range(4)]
    cases = spark.createDataFrame(rows, f"case_id int, exam string, findings string, gold {GOLD}, locale string")
    good, bad = report("Acute subdural hematoma on the left.", "Acute left subdural hematoma of the convexity."), report("No subdural hematoma.", "Normal head without subdural hematoma.")
    given = spark.createDataFrame([("0", 1, bad), ("0", 2, good), ("1", 1, bad), ("3", 1, good), ("9", 1, good)], "instance_id string, pos int, model_output string")
    got = {r.case_id: r for r in submission.evaluate_submission(cases, given).collect()}
    assert set(got) == {0, 1, 3} and got[1].verdict == "FAIL" and got[0].overall > got[1].overall and got[1].crit_CRIT > 0 and got[0].crit_CRIT == 0
    failed = submission.results(cases.withColumns({"html": F.lit(good), "failed": F.col("case_id") == 0})).collect()
    zero = next(r for r in failed if r.case_id == 0)
    assert zero.overall < 60 and zero.verdict == "FAIL" and zero.criteria_total == 5 and zero.criteria_passed == 0
    r = one(spark, submission.trusted_latency(F.lit(-1.0), F.lit(7.0)).alias("a"), submission.trusted_latency(F.lit(float("nan")), F.lit(7.0)).alias("b"), submission.trusted_latency(F.lit(0.0), F.lit(7.0)).alias("c"))
    assert (r.a, r.b, r.c) == (7, 7, 0)


def test_adjudication_records(spark):
    reviewed = {f: True for f in adjudication.REVIEWED}
    label = lambda who, ok=True, notes="fine": (who, ok, {d: "PASS" for d in scoring.DIMS}, notes, "2025-01-02T03:04:05Z")
    whole = ("1.0", "s", "h", "2025-01-02T03:04:05Z", ["a", "b"], ["x", "y"], [("a", reviewed, [label("x"), label("y")]), ("b", reviewed, [label("x"), label("y")])])
    worse = ("1.0", "s", "h", "yesterday", ["a", "c"], ["x"], [("a", {**reviewed, "polarityReviewed": False}, [label("x"), label("z", False, "mail a.b@c.de")])])
    got = adjudication.validated(spark.createDataFrame([whole, worse, (None,) * 7], adjudication.SCHEMA)).collect()
    assert got[0].valid and got[0].errors == [] and (got[0].clinical_agreement, got[0].dimension_agreement, got[0].reviewer_count) == (100.0, 100.0, 2)
    assert not got[1].valid and set(got[1].errors) == {
        "lockedAt must be an ISO timestamp", "at least two adjudicators are required", "cases length must match caseIds length", "a: polarityReviewed must be true", "a: unknown reviewerId z",
        "a/z: reviewer notes contain PHI/PII-like text", "missing adjudication case: c", "clinical acceptability agreement 0.0% is below 80%",
    }
    assert not got[2].valid and "caseIds must not be empty" in got[2].errors
    other = adjudication.validated(spark.createDataFrame([whole], adjudication.SCHEMA), suite_hash="k").first()
    assert other.errors == ["suiteHash mismatch: expected k, got h"]


def test_graduated_controls(spark):
    ref = "<b>Findings</b><br>Left subdural hematoma of 12 mm.<br>Renal cyst of 2,5 cm.<br><br><b>Impression</b><br>Subdural hematoma. Cyst."
    gold = [("Left subdural hematoma of 12 mm", "critical", None, "left", [], False), ("Renal cyst of 2,5 cm", "minor", None, None, [], False)]
    cases = spark.createDataFrame([(1, "CT <head>. x", gold, ref), (2, "CT <head>. x", gold, None), (3, None, [], None)], f"case_id int, exam string, gold {GOLD}, reference string")
    got = {(x.case_id, x.level): x.text for x in robustness.controls(cases).collect()}
    assert len(got) == 15 and got[1, "l1"] == ref.replace("12 mm", "17.0 mm") and got[1, "l2"] == got[1, "l1"].replace("Left", "right")
    assert "cyst of" not in got[1, "l3"] and "hematoma of" in got[1, "l3"] and "hematoma" not in got[1, "l4"] and "Renal cyst of 2,5 cm" in got[1, "l4"]
    assert got[2, "l4"].endswith("<b>Conclusao</b><br>Renal cyst of 2,5 cm") and got[2, "l1"].startswith("<center><b>CT &lt;head&gt;</b></center>") and got[2, "l1"].count("17.0 mm") == 2
    assert got[3, "l3"].count("Sem achado principal descrito.") == 2 and got[3, "l5"] == got[1, "l5"]


def test_prompts_and_hashes(spark):
    from hashlib import sha256

    from assaykit.operators import prompts

    gold = [("mass", "major", None, None, [], k == 0) for k in range(20)]
    row = evaluators.with_defaults(spark.createDataFrame([(1, "CT", "a mass", gold, "r" * 5000)], f"case_id int, exam string, findings string, gold {GOLD}, reference string"))
    said = row.select(prompts.judge_prompt(F.lit("<b>x</b>"), F.lit("tok")).alias("p"), prompts.system_prompt(F.lit("US"), F.lit(False)).alias("s")).first()
    assert said.p.count("- major: mass") == 11 and "- NEGATED major: mass" in said.p and "r" * 3000 in said.p and "r" * 3001 not in said.p
    assert said.p.count("===REPORT-BOUNDARY-tok===") == 3 and "EXAM: CT" in said.p and "Do not include a Technique section" in said.s and "Non-contrast exam" in said.s
    assert row.select(pairing.detection_counts(F.lit("exact=1 partial=0 missed=2 total=3")).alias("x")).first().x.asDict() == {"exact": 1, "partial": 0, "missed": 2, "total": 3}
    run = {c: "v" for c in release.RUN_FIELDS.values()} | {"score_mode": None, "judge_temperature": None}
    df = spark.createDataFrame([run], ", ".join(f"{c} string" for c in run))
    canon = json.dumps({k: {"scoreMode": "conservative-min", "judgeTemperature": None}.get(k, "v") for k in release.RUN_FIELDS}, sort_keys=True, separators=(",", ":"))
    assert df.select(release.run_hash(F.lit("s"), F.lit("c")).alias("h")).first().h == sha256(f"s|{canon}|c".encode()).hexdigest()


def test_board(spark):
    shown = [("Model X (@org/model)", "Model X"), ("@org/model now", "private configuration now"), ("see https://a.b/c", "see private target"), ("via openrouter /api/run", "via private product reporting flow")]
    for raw, want in shown:
        assert one(spark, board.public_label(F.lit(raw)).alias("x")).x == want
    row = dict(run="r", benchmark_version="2", suite_id="s", locale="en-US", track="model", comparison_class=None, scaffold_id="my-pipeline", judge_model="secret", score_mode=None, model_label="M", entity_name=None, system_type=None, entity_type=None)
    got = board.public_entries(spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))).first()
    assert got.public_key == "2::s::en-US::model::model::product-agent::judged-frozen-conservative-min" and (got.entity_name, got.entity_type, got.system_type, got.judge_model) == ("M", "model", "raw-model", "hidden")
    v = spark.createDataFrame([(False, ["a", "b"], ["a"], ["b"], [], [], [], ["missing cases: b", "odd"])], "valid boolean, expected_ids array<string>, received_ids array<string>, missing_ids array<string>, duplicate_ids array<string>, extra_ids array<string>, empty_outputs array<string>, errors array<string>")
    got = board.public_validation(v).first()
    assert got.errors == ["missing cases: 1", "invalid submission details withheld"] and (got.expected_count, got.missing_count) == (2, 1)
    runs = spark.createDataFrame([("r1", "s", "h", "public", "local", "en-US", "2", 5), ("r2", "s", "k", "public", "local", "pt-BR", "2", 5), ("r3", "t", "h", "public", "local", "en-US", "2", 5)], "run string, suite_id string, suite_hash string, visibility string, evaluation_mode string, locale string, benchmark_version string, case_count int")
    errors = sorted(map(tuple, board.run_mismatches(runs, runs.where("run = 'r1'")).collect()))
    assert errors == [("r2", "locale mismatch: expected en-US, got pt-BR"), ("r2", "suiteHash mismatch: expected h, got k"), ("r3", "unknown suite t")]


def test_calibration(spark):
    rows = [(f"r{j}{k}", f"judge{j}", c, float(60 + c * 3 + j), "PASS" if c > 4 else "FAIL", float(50 + c * 4), float(c % 6)) for j in range(2) for k in range(2) for c in range(10)]
    got = calibration.calibrate(spark.createDataFrame(rows, "run string, judge string, case_id int, overall double, verdict string, det_overall double, judge_overall double")).first()
    assert got.judges == ["judge0", "judge1"] and got.case_count == 10 and got.test_retest_alpha == 1 and got.cross_judge_kappa == 1 and got.n == 40 and 0.9 < got.cross_judge_alpha < 1
    one_run = calibration.calibrate(spark.createDataFrame(rows[:10], "run string, judge string, case_id int, overall double, verdict string, det_overall double, judge_overall double")).first()
    assert one_run.test_retest_alpha is None and one_run.cross_judge_kappa is None and one_run.verdict in ("calibrated", "weak", "uncalibrated")
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    assert calibration.pearson(pairs).first().r == pytest.approx(0.993399, abs=1e-6)


def test_release_rules(spark):
    files = [
        ("data\\raw\\x.csv", "on 12/05/2024"), ("a.md", "ok"), ("site/data.js", 'It was clinically validated. "suiteHash": "0123456789abcdef"'), ("src/x.md", "This was clinically validated."),
        ("leaderboard/b.md", "This was not clinically validated."), ("cases/public/1.json", '"goldFindings": [], seen 2024-01-02'), ("x.py", "supabase_service_role_abcdefghijklm"),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    found = lambda **k: {(r.path, r.rule) for r in release.issues(df, **k).collect()}
    always = {("data/raw/x.csv", "raw-data-extension"), ("x.py", "secret-pattern")}
    public = {("data/raw/x.csv", "private-path-public-release"), ("cases/public/1.json", "public-answer-key"), ("cases/public/1.json", "calendar-date-public-artifact")}
    claim = {("site/data.js", "unsubstantiated-clinical-validation-claim")}
    assert found() == always | public | claim and found(substantiated=True) == always | public
    assert found(mode="private") == always | {("data/raw/x.csv", "private-path-tracked")}
    assert [r.suite_hash for r in release.published_suites(df).collect()] == ["0123456789abcdef"]
    claims = [("It was clinically validated.", True), ("It was not clinically validated.", False), ("No harm was seen, and all of it was clinically validated.", True), ("não é uma validação independente", False)]
    for s, want in claims:
        assert one(spark, release.asserts_validation(F.lit(s)).alias("x")).x is want, s


def test_positions_hold_when_partitions_are_coalesced(spark):
    """The optimizer may read an exchange in other parts each time; positions must not depend on it."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(30_000).selectExpr("id", "(id * 7919) % 30000 AS k", "repeat(cast(id as string), 20) AS wide").repartition(17)
        got = with_position(rows, "k")
        assert got.count() == 30_000 and got.where("pos <> k").count() == 0
        assert with_position(rows.where("id < 0"), "k").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_passages_of_any_length_are_found(spark, block):
    texts = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz0123456789"), (2, "xyzshort"), (3, ""), (4, None)], "doc_id long, c string")
    items = [(10, "short"), (11, "ghijklmnopqrstuvwxyz01234567"), (12, "z"), (13, "absent"), (14, "z"), (15, ""), (16, None)]
    got = contamination.passages_in(texts, spark.createDataFrame(items, "item_id long, c string"), block)
    assert sorted(map(tuple, got.collect())) == [(1, 11), (1, 12), (1, 14), (2, 10), (2, 12), (2, 14)]


def test_frontier_and_board_equal_one_window(spark):
    rows = [(i, float((i * 37) % 50), float((i * 61) % 97), ("production", "model", "calibration")[i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "run int, cost double, average_overall double, board_group string").withColumns({"criterion_pass_rate": F.lit(1.0), "all_pass_rate": F.lit(0.5)}).repartition(9)
    best, want = -1.0, set()
    for i, _, score, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if score > best:
            best = score
            want.add(i)
    assert {r.run for r in summary.pareto_frontier(df, "cost", "average_overall", "run").collect()} == want
    order = sorted(rows, key=lambda r: (("production", "model", "calibration").index(r[3]), -r[2], r[0]))
    assert [r.run for r in summary.board_order(df).orderBy("position").collect()] == [r[0] for r in order]


def test_sources_and_sinks(spark, tmp_path):
    good, bad = tmp_path / "p.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"instance_id": "a", "model_output": "x", "metadata": {"retrieval": {"docIds": ["d1"]}}}\n\n{"instance_id": "b", "model_output": "y", "score": 1}\n')
    bad.write_text('{"instance_id": "a"\n')
    rows = {r.instance_id: r for r in artifacts.read_predictions(spark, str(good)).withColumn("ids", artifacts.retrieved_ids("metadata")).collect()}
    assert rows["a"].ids == ["d1"] and rows["b"].unknown_keys == ["score"]
    with pytest.raises(ValueError, match="malformed"):
        artifacts.read_predictions(spark, str(bad))
    run = {"manifest": {"runName": "r"}, "summary": {}, "results": [{"case": {"id": "1"}, "checks": [{"dim": "CRIT", "id": "C01", "severity": "critical", "passed": False}]}]}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text(json.dumps(run))
    (tmp_path / "runs" / "b.json").write_text("{}")
    assert [(r.run, r.case_id, r.id, r.passed) for r in artifacts.run_checks(artifacts.read_runs(spark, str(tmp_path / "runs"))).collect()] == [("r", "1", "C01", False)]
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert artifacts.append_new(new, str(tmp_path / "out"), "k") == 2 and artifacts.append_new(new.union(spark.createDataFrame([("c", 3)], "k string, v int")), str(tmp_path / "out"), "k") == 1
    assert artifacts.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int"), ["x", "y"]).first().value == "| a/b | - |"
    made = artifacts.generate(spark.createDataFrame([("1", "hi"), ("2", "no")], "id string, prompt string"), artifacts.command(["grep", "hi"])).collect()
    assert {r.instance_id: (r.model_output.strip(), r.error is None) for r in made} == {"1": ("hi", True), "2": ("", False)}
    reply = 'Sure: ```json\n{"verdict": "PASS", "scores": {"CRIT": 90, "RAG": 900,}, "overall": 88}``` done }'
    j = artifacts.parse_judge(spark.createDataFrame([(reply,), ("nothing",)], "reply string")).collect()
    assert j[0].judge.scores == {"CRIT": 90.0} and j[0].judge.overall == 88 and j[1].judge.verdict is None


def test_stream_of_predictions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"instance_id": "a", "model_output": "x", "pos": 1}\n{"instance_id": "a", "model_output": "y", "pos": 2}\n')
    q = submissions.score_each_batch(submissions.prediction_stream(spark, str(folder)), lambda b: b.groupBy("instance_id").agg(F.max("pos").alias("pos")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert [(r.instance_id, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]


LIGHT = ["criterion_stats", "all_pass_rate", "dim_scores", "severity_cap", "submission_validation", "latest_prediction", "strata_excess", "audit_totals", "failure_taxonomy", "retrieval_metrics", "text_fold", "sanitize_html", "language_signal", "token_coverage", "contamination_scan", "case_hash", "suite_hash", "release_scan", "phi_scan", "telemetry_clean", "negation_scope", "report_classifications", "report_recommendations", "report_critical_mentions", "report_findings", "mention_denial", "copy_ratio", "section_tokens", "recall_precision_f1", "finding_score", "weighted_check_score", "catalogue_core", "perturb_reports", "calibration_matrix", "verdict_pairs", "pearson_det_judge", "adjudication_records", "public_board", "run_suite_check", "limit_cases", "suite_hash", "pareto_frontier", "site_order", "bootstrap_ci", "paired_bootstrap", "run_integrity", "verified_runs", "provenance_tree", "provenance_changes", "audit_cube", "score_cube", "groups_in_order", "calibration_report"]


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if glob.os.path.isdir(p) else ''}')")
    got = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 4


REPORT = (
    "<center><b>COMPUTED TOMOGRAPHY OF THE CHEST</b></center><br><br><b>Technique:</b><br>Helical.<br><br><b>Findings:</b><br>Pulmonary nodule of 5 mm in the left lung, trachea, mediastinum, "
    "lymph nodes, pleural spaces, heart, pericardium, aorta and esophagus are seen within expected limits today.<br><br><b>Impression:</b><br>Left pulmonary nodule of the lung."
)


def test_structural_checks(spark):
    from assaykit.operators import catalogue

    wrong = REPORT.replace("left lung", "right lung").replace("Left pulmonary nodule", "Right pulmonary nodule, 5 mm, enhancement [TODO_X]")
    rows = [(1, REPORT, "left nodule of 5 mm. second finding here"), (2, wrong, "left nodule of 5 mm"), (3, "# plain", "nothing of note"), (4, None, None)]
    df = spark.createDataFrame(rows, "case_id int, html string, findings string").withColumns({"modality": F.lit("CT"), "region": F.lit("chest"), "contrast": F.lit(False), "abnormal": F.lit(True)})
    got = catalogue.structural_checks(df).collect()
    failed = {k: {r.id for r in got if r.case_id == k and not r.passed} for k in (1, 2, 3)}
    assert failed[1] == set() and failed[2] == {"C01", "C05", "Q07", "R02"}
    assert {"C04", "Q01", "Q08", "Q11", "R01", "R06"} <= failed[3]
    assert not {r.id for r in got if r.case_id == 1} & {"TM1", "TM2", "Q09", "R03", "R05"}
    m = spark.range(1).select(*(v.alias(k) for k, v in catalogue.exam_meta(F.lit("MRI of the lumbar spine with contrast"), F.lit("normal")).items())).first()
    assert tuple(m) == ("MRI", "spine", True, False)
    pt = spark.createDataFrame([(1, "<center><b>TOMOGRAFIA DO CRÂNIO</b></center><br><br><b>Análise:</b><br>Presença de hematoma subdural à direita.<br><br><b>Conclusão:</b><br>Hematoma subdural.", "hematoma subdural à esquerda", "TC de crânio")], "case_id int, html string, findings string, exam string")
    failed = {r.id for r in catalogue.structural_checks(pt, catalogue.PORTUGUESE).collect() if not r.passed}
    assert {"TO0", "R02", "Q12"} <= failed and not failed & {"R01", "Q08", "Q11", "C07", "T-LANG", "R06"}


GOLD = "array<struct<finding:string,severity:string,location:string,laterality:string,measurements:array<string>,negated:boolean>>"


def report(analysis: str, conclusion: str) -> str:
    return f"<center><b>CT OF THE HEAD</b></center><br><br><b>Findings</b><br>{analysis}<br><br><b>Impression</b><br>{conclusion}"


def test_denials_hold_in_their_clause(spark):
    asked = [
        ("Without fluid but with an acute bleed in the spleen", "acute bleed", False), ("No bleed or swelling", "swelling", True), ("Torn ligament, without fluid", "torn ligament", False), ("Bleed not seen", "bleed", True),
        ("Nothing but air", "bleed", False), ("no air", "bleed", True), (None, "x", None),
    ]
    df = spark.createDataFrame([(i, s, m) for i, (s, m, _) in enumerate(asked)], "i int, s string, m string")
    got = [r.x for r in df.orderBy("i").select(clinical.mention_denied(F.col("s"), F.col("m"), ENGLISH).alias("x")).collect()]
    assert got == [w for _, _, w in asked]
    pt = one(spark, clinical.mention_denied(F.lit("Sem líquido, mas com fratura"), F.lit("fratura"), PORTUGUESE).alias("a"), clinical.mention_denied(F.lit("Não há fratura"), F.lit("fratura"), PORTUGUESE).alias("b"))
    assert (pt.a, pt.b) == (False, True)


def test_evaluators(spark):
    found = [("Acute subdural hematoma", "critical", None, "left", ["12 mm"], False), ("Mild sinus thickening", "minor", None, None, [], False), ("pneumothorax", "major", None, None, [], True)]
    good = report("Acute subdural hematoma along the left convexity of 12 mm.<br>Mild thickening of the sinus.<br>No pneumothorax.", "Acute left subdural hematoma with sinus thickening.")
    denied = report("No subdural hematoma.<br>Mild sinus thickening.<br>No pneumothorax.", "No acute subdural hematoma is seen here.")
    invented = report("Acute subdural hematoma on the left, 12 mm.<br>Mild sinus thickening. No pneumothorax.<br>Large hepatic metastasis.", "Acute left subdural hematoma and hepatic metastasis.")
    rows = [(k, h, "CT of the head", "acute subdural hematoma left 12 mm, mild sinus thickening", found, ["Acute subdural hematoma"], "CT", "en-US") for k, h in enumerate((good, denied, invented))]
    rows.append((3, report("Breast nodule, BI-RADS 9.", "Nodule of the breast."), "US of the breast", "nodule in the breast", [], [], "US", "en-US"))
    rows += [(4, None, None, None, None, None, None, None), (5, "", "", "", [], [], "CT", "pt-BR")]
    cases = spark.createDataFrame(rows, f"case_id int, html string, exam string, findings string, gold {GOLD}, urgent array<string>, modality string, locale string")
    got = {r.case_id: r for r in evaluators.evaluate(cases).collect()}
    assert len(got) == len(rows)
    kinds = lambda k: [m.match for m in got[k].matches]
    failed = lambda k: {c.id for c in [*got[k].quality_checks, *got[k].critical_checks] if not c.passed}
    assert kinds(0) == ["exact", "exact", "exact"] and not failed(0) & {"QG01", "QG02", "QG05", "CG01", "CG03"} and (got[0].recall, got[0].precision) == (1, 1)
    assert kinds(1)[0] == "missed" and {"QG01", "QG02", "CG01"} <= failed(1) and got[1].recall == 0 and got[1].critical_score == 30
    assert "QG03" in failed(2) and any("metastasis" in h.text and h.confidence == "high" for h in got[2].invented) and got[2].quality_score < got[0].quality_score
    assert {c.id: c.passed for c in got[3].guide_checks} == {"GE-birads-presence": True, "GE-birads-valid-range": False} and got[3].guide_mode == "expected-guidelines"
    assert got[5].retrieval_score == -1 and got[5].quality_score == 100 and got[4].quality_mode == "structural-fallback"


def test_further_guidelines_and_detectors(spark):
    from assaykit.functions import lexicon

    more = lexicon.Guideline("orads", "O-RADS (Ovarian Imaging)", ("US",), (r"ovar",), "(?i)o-?rads", "O-RADS not mentioned")
    cases = spark.createDataFrame([(1, "O-RADS 3", "US of the ovary", "cyst of the ovary", "US", ["rupture"])], "case_id int, html string, exam string, findings string, modality string, urgent array<string>")
    got = evaluators.guidelines(cases, (*lexicon.GUIDELINES, more)).first()
    assert [(c.id, c.passed) for c in got.guide_checks] == [("GE-orads-presence", True)]
    sure = lambda _: F.struct(F.expr("cast(array() as array<int>)").alias("used"), F.transform("_labels", lambda x: F.struct(x.alias("label"), F.lit(True).alias("hit"))).alias("out"))
    assert evaluators.critical(cases, sure).first().recall == 1 and evaluators.critical(cases).first().recall == 0


def test_retrieval_evaluator(spark):
    rows = [(1, {"a": 2, "b": 1, "c": 1}, ["x", "a", "a", "b"], "axial T1 images"), (2, {"a": 1}, [], "none"), (3, None, [], "axial images")]
    cases = spark.createDataFrame(rows, "case_id int, relevance map<string,int>, retrieved array<string>, html string").withColumn("exam", F.lit("MRI T1"))
    got = {r.case_id: r for r in evaluators.retrieval(cases).collect()}
    p, r, m = 2 / 3, 2 / 3, 0.5
    gain = (3 / math.log2(3) + 1 / 2) / (3 + 1 / math.log2(3) + 1 / 2)
    assert got[1].retrieval_score == math.floor(r * 40 + p * 20 + gain * 25 + m * 15 + 0.5) and [c.passed for c in got[1].retrieval_checks] == [True, True, gain >= 0.5, True]
    assert (got[2].retrieval_mode, got[2].retrieval_score) == ("retrieval-gold-present-no-pipeline", -1)
    assert [c.evidence for c in got[3].retrieval_checks] == ["axial acquisition"] and got[3].retrieval_score == 0


def test_classification_values(spark):
    html = "BI-RADS 4a, ACR TI-RADS: TR5, LR-TNC, Bosniak 3, Lung-RADS 4x; PI-RADS 2. BI-RADS 4A"
    df = spark.createDataFrame([(1, html)], "case_id int, html string")
    got = {(r.system, r.normal) for r in extraction.extract(df, "classifications").collect()}
    assert got == {("birads", "4A"), ("tirads", "5"), ("lirads", "TNC"), ("bosniak", "III"), ("lungrads", "4X"), ("pirads", "2")}
    values = {"BI-RADS 4a": "4A", "TI-RADS TR5": "5", "Bosniak 2F": "IIF", "LR-5": "5", "Lung-RADS 4X": "4X"}
    r = one(spark, *(extraction.normal_value(F.lit(k)).alias(f"x{i}") for i, k in enumerate(values)))
    assert list(r) == list(values.values())
