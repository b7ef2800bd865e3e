"""Runs that stop and go on, and events posted to a service in this process."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from assaykit.streaming import ledger, webhook


def cases(folder, files=5, each=4):
    folder.mkdir()
    for f in range(files):
        rows = [{"case_id": f"c{f}{k}", "prompt": f"p{f}{k}"} for k in range(each)]
        if f == 2:
            rows += [rows[0], {"case_id": None, "prompt": "nobody's"}, {"case_id": "c00", "prompt": "again"}, {"case_id": "null", "prompt": None}]
        (folder / f"{f}.json").write_text("\n".join(map(json.dumps, rows)))
    return str(folder)


def maker(log):
    """Notes each call; fails always for p11, once for p20."""
    log.mkdir()

    def make(prompt):
        import os
        import uuid

        before = sum(n.startswith(f"{prompt}-") for n in os.listdir(log))
        (log / f"{prompt}-{uuid.uuid4().hex}").write_text("")
        if prompt == "p11" or prompt == "p20" and not before:
            raise ValueError(f"can't do {prompt}")
        return f"made {prompt}"

    return make, lambda: Counter(p.name.rsplit("-", 1)[0] for p in log.iterdir())


def test_a_stopped_run_ends_like_one_run(spark, tmp_path):
    folder = cases(tmp_path / "in")
    make, calls = maker(tmp_path / "log")
    whole = ledger.run(spark, folder, make, str(tmp_path / "whole"), str(tmp_path / "check-whole"), 1)
    want = sorted(map(tuple, ledger.results(spark, str(tmp_path / "whole")).collect()))
    assert whole and len(want) == 21 and ("c11", "failed", 2, None, "ValueError: can't do p11") in want and ("c20", "done", 2, "made p20", None) in want and ("c00", "done", 1, "made p00", None) in want and ("null", "done", 1, "made ", None) in want

    make, calls = maker(tmp_path / "log2")
    stop, seen = threading.Event(), []
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def watch():  # stop in mid-run: once the second batch is written
        while len(list((tmp_path / "out").glob("batch=*/_SUCCESS"))) < 2:
            seen.append(stop.wait(0.01))
        stop.set()

    threading.Thread(target=watch, daemon=True).start()
    assert not ledger.run(spark, folder, make, out, check, 1, stop=stop)
    all_cases = spark.read.schema("case_id string, prompt string").json(folder)
    part = ledger.results(spark, out)
    told = ledger.progress(all_cases, part).first()
    assert 8 <= told.done + told.failed < 21 and told.open == 21 - told.done - told.failed and told.partial
    assert set(map(tuple, part.collect())) <= set(want)
    before = calls()
    assert ledger.run(spark, folder, make, out, check, 1)
    assert sorted(map(tuple, ledger.results(spark, out).collect())) == want and not ledger.progress(all_cases, ledger.results(spark, out)).first().partial
    # What was written before the stop isn't done again, but for the batch that the stop came in.
    again = {k for k, n in calls().items() if n > {"p11": 2, "p20": 2}.get(k, 1)}
    assert len({k[1] for k in again}) <= 1 and before


def test_an_empty_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ledger.run(spark, str(tmp_path / "in"), str, str(tmp_path / "out"), str(tmp_path / "check"))


@pytest.fixture
def service():
    class Service:
        posts, down = [], set()

    own = Service()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            own.posts.append((self.headers["idempotency-key"], body))
            self.send_response(500 if body["id"] in own.down else 204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own.url = f"http://127.0.0.1:{server.server_port}/hook"
    yield own
    server.shutdown()


def test_events_are_posted_once(spark, service, tmp_path):
    webhook.register(spark)
    (tmp_path / "in").mkdir()

    def put(name, ids):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i, "event": "seen", "value": i / 2}) for i in ids))

    def post():
        rows = spark.readStream.schema("id long, event string, value double").json(str(tmp_path / "in"))
        out = rows.writeStream.format("webhook").option("url", service.url).option("sent", f"file://{tmp_path}/sent").option("waits", "0.01").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        out.awaitTermination()

    put("a.json", range(5))
    post()
    assert sorted(service.posts) == [(str(i), {"id": i, "event": "seen", "value": i / 2}) for i in range(5)]
    service.down = {7}
    put("b.json", range(4, 10))
    with pytest.raises(Exception, match="webhook answered 500"):
        post()
    service.down = set()
    post()  # the batch again: what was taken before isn't posted anew
    n = Counter(k for k, _ in service.posts)
    assert set(n) == {str(i) for i in range(10)} and all(n[str(i)] == 1 for i in range(10) if i != 7) and n["7"] == 3


def test_events_of_a_table(spark, service, tmp_path):
    webhook.register(spark)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, event string")
    service.down = {2}
    rows.write.format("webhook").option("url", service.url).option("strict", "false").option("waits", "").mode("append").save()
    assert sorted(k for k, _ in service.posts) == ["1", "2"]
    with pytest.raises(Exception, match="needs the option url"):
        rows.write.format("webhook").mode("append").save()
