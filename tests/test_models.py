"""Models that are asked over HTTP, against a service in this process."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from assaykit.operators import prompts, submission
from assaykit.sources import models


class Service:
    """Answers prompts by rules: counts calls, throttles the first call of what says "busy", refuses "bad", is down for "down" while told so."""

    def __init__(self):
        self.calls, self.now, self.most, self.down, self.bodies, self.lock = Counter(), 0, 0, True, [], threading.Lock()
        own = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["content-length"])))
                text = body["messages"][-1]["content"]
                with own.lock:
                    own.calls[text] += 1
                    own.now += 1
                    own.most = max(own.most, own.now)
                    own.bodies.append((self.path, {k.lower(): v for k, v in self.headers.items()}, body))
                    n = own.calls[text]
                time.sleep(0.05)
                code, reply, head = own.answer(text, n)
                with own.lock:
                    own.now -= 1
                data = json.dumps(reply).encode()
                self.send_response(code)
                for k, v in head.items():
                    self.send_header(k, v)
                self.send_header("content-length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, text, n):
        if "busy" in text and n == 1:
            return 429, {"error": "slow down"}, {"retry-after": "0.01"}
        if "bad" in text:
            return 400, {"error": {"message": "no such thing"}}, {}
        if "down" in text and self.down:
            return 503, {"error": "down"}, {"retry-after": "0.01"}
        content = [{"type": "text", "text": "parts of "}, {"content": text}] if "parts" in text else f"re: {text}"
        if "QA judge" in text:
            content = '```json\n{"verdict": "fail", "scores": {"CRIT": 40, "QUAL": 140, "TERM": 80.04}, "overall": 55, "critical_failures": [{"issue": "missed"}], "missing": ["a", 3], "fix": "x",}\n```' if "second" in text else "I can't say."
        if "Which of the findings" in text:
            content = 'Here: {"found": ["Acute hematoma", "made up"]}' if "clear" not in text else "none of them"
        return 200, {"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 1000, "completion_tokens": 500}}, {}


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def quick(service, **more):
    return models.Model(service.url, "m", "secret", waits=(0.01, 0.01, 0.01), price_in=1.0, price_out=2.0, **more)


def test_prompts_are_asked_once(spark, service, tmp_path):
    rows = [(k, f"prompt {k % 20}") for k in range(60)] + [(60, "busy one"), (61, "bad one"), (62, "parts"), (63, None)]
    table = spark.createDataFrame(rows, "id long, prompt string").withColumn("reply", F.lit("clash"))
    folder = f"file://{tmp_path}/answers"
    got = {x.id: x for x in models.ask(table, quick(service), folder, in_flight=3, tasks=2).collect()}
    assert len(got) == 64 and got[3].reply == "re: prompt 3" == got[23].reply and got[3].cost_usd == 0.002 and got[3].attempts == 1
    assert got[60].reply == "re: busy one" and got[60].attempts == 2 and got[61].reply is None and got[61].error == "m 400: no such thing" and got[62].reply == "parts of parts" and got[63].reply == "re: "
    assert service.most <= 6 and all(service.calls[f"prompt {k}"] == 1 for k in range(20)) and service.calls["bad one"] == 1
    path, head, body = service.bodies[0]
    assert path == "/v1/chat/completions" and head["authorization"] == "Bearer secret" and body["max_tokens"] == 4096 and body["temperature"] == 0.2
    before = service.calls.copy()
    again = {x.id: x for x in models.ask(table, quick(service), folder, tasks=3).collect()}
    assert again[3].reply == got[3].reply and service.calls - before == Counter({"bad one": 1})  # errors aren't answers
    assert models.answers(spark, folder).count() == 23
    other = models.ask(table.limit(1), quick(service, temperature=0.9), folder).collect()
    assert other[0].reply and sum(service.calls.values()) == sum(before.values()) + 2  # other settings, another answer
    assert models.ask(table.limit(0), quick(service), folder).count() == 0


def test_a_run_that_stops_goes_on_where_it_stopped(spark, service, tmp_path):
    rows = [(k, f"prompt {k}") for k in range(10)] + [(10, "down now")]
    table, folder = spark.createDataFrame(rows, "id long, prompt string"), f"file://{tmp_path}/answers"
    failed = models.ask(table, quick(service), folder, tasks=1).withColumn("reply", F.when(F.col("error").isNull(), F.col("reply")).otherwise(F.raise_error("error")))
    with pytest.raises(Exception):  # noqa: B017  the job dies
        failed.select("reply").collect()
    assert service.calls["down now"] == 4
    service.down = False
    assert models.ask(table, quick(service), folder, tasks=1).where("error is null").count() == 11
    assert all(service.calls[f"prompt {k}"] == 1 for k in range(10)) and service.calls["down now"] == 5


def test_waits():
    half = lambda: 0.5
    assert models.wait_for("2", 1, half) == 2 and models.wait_for("900", 1, half) == 30 and models.wait_for("Wed, 21 Oct 2015 07:28:00 GMT", 3, half) == 3 and models.wait_for(None, 8, half) == 8 and models.wait_for("-1", 8, half) == 8
    assert models.wait_for("4", 1, lambda: 0.0) == 3 and models.wait_for("4", 1, lambda: 1.0) == 5
    dead = models.Model("http://127.0.0.1:9/v1", "m", waits=(0.0,))
    with pytest.raises(RuntimeError, match="no answer after 2 tries"):
        models.call(dead, "x")
    assert dict(models.routed("m", "t").body)["provider"]["data_collection"] == "deny" and models.completions("http://x/chat/completions/") == "http://x/chat/completions"


def test_verdicts():
    assert models.verdict_of("nothing") is None and models.verdict_of(None) is None and models.verdict_of('{"a": ') is None
    x = models.verdict_of('So: {"verdict": "maybe", "scores": {"CRIT": 0, "QUAL": true, "X": 5, "RAG": -1}, "overall": 101, "critical_failures": [{"dim": "ZZ"}, 4], "spot_checks": [{"claim": "c", "ok": 1}, {}]} bye }')
    assert x == {"verdict": "PARTIAL", "scores": {"CRIT": 0.0}, "overall": None, "critical_failures": [{"dim": "CRIT", "issue": "unspecified", "evidence": ""}], "missing": [], "hallucinated": [], "spot_checks": [{"claim": "c", "ok": True, "by": ""}], "fix": ""}


def test_a_model_detects_urgent_findings(spark, service, tmp_path):
    from assaykit.operators import evaluators

    rows = [("1", "en-US", "x", "words that no rule knows", ["Acute hematoma", "Pneumothorax"]), ("2", "en-US", "x", "all clear", ["Acute hematoma"]), ("3", "en-US", "x", "y", [])]
    cases = spark.createDataFrame(rows, "case_id string, locale string, findings string, html string, urgent array<string>")
    told = models.detected(cases, quick(service), f"file://{tmp_path}/detect")
    assert {x.case_id: x.affirmed for x in told.collect()} == {"1": ["Acute hematoma"], "2": None, "3": []} and len(service.calls) == 2
    got = {x.case_id: x for x in evaluators.critical(told, evaluators.told_by("affirmed")).collect()}
    assert got["1"].true_positives == ["Acute hematoma"] and got["1"].false_negatives == ["Pneumothorax"] and got["2"].false_negatives == ["Acute hematoma"]
    plain = {x.case_id: x for x in evaluators.critical(cases).collect()}
    assert plain["1"].true_positives == []
    with pytest.raises(ValueError, match="needs the column"):
        evaluators.told_by(None)


def test_a_judge_counts_in_the_results(spark, service, tmp_path):
    html = "<center><b>CT OF THE HEAD</b></center><br><br><b>Findings</b><br>Mass in the right lobe.<br><br><b>Impression</b><br>Mass in the right lobe."
    rows = [("1", "en-US", "first", html), ("2", "en-US", "second", html)]
    cases = spark.createDataFrame(rows, "case_id string, locale string, findings string, html string").withColumns({"exam": F.lit("CT of the head"), "gold": F.expr("cast(array() as array<struct<finding:string,severity:string,location:string,laterality:string,measurements:array<string>,negated:boolean>>)"), "urgent": F.array().cast("array<string>"), "expectations": F.expr("cast(array() as array<struct<guideline:string,classification:string,recommendation:string,required:boolean>>)"), "reference": F.lit(None).cast("string")})
    told = models.judged(cases, quick(service), f"file://{tmp_path}/judge", prompts.judge_prompt(F.col("html"))).cache()
    by = {x.case_id: x for x in told.collect()}
    assert by["1"].judge is None and by["1"].judge_error == "no verdict in the reply" and by["2"].judge_error is None and by["2"].judge_cost_usd == 0.002
    assert by["2"].judge.verdict == "FAIL" and by["2"].judge.scores == {"CRIT": 40.0, "TERM": 80.0} and by["2"].judge.missing == ["a"] and service.bodies[0][2]["temperature"] == 0 and service.bodies[0][2]["max_tokens"] == 2048
    plain = {x.case_id: x for x in submission.results(cases).collect()}
    got = {x.case_id: x for x in submission.results(cases, judgements=told).collect()}
    assert got["1"].overall == plain["1"].overall and got["1"].phase == "degraded" and got["2"].phase == "complete" and got["2"].verdict == "FAIL" and "judge found critical failure" in got["2"].gate_reasons
