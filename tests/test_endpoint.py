"""The endpoint scorer and the replay against a server of this machine."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from mailloom.operators import endpoint, scoring
from mailloom.operators import prompts as P

ANSWER = '{"is_schedule_change_announcement": true, "evidence_quote": "q"}'


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((asked, self.headers.get("X-Key")))
        user = asked["messages"][1]["content"]
        if user == "busy":
            return self.say(503, b"try later")
        if user == "odd":
            return self.say(200, b"{}")
        if user == "slow":
            self.send_response(200)
            self.end_headers()
            for _ in range(40):  # a byte at a time, so no single read ever times out
                self.wfile.write(b" ")
                self.wfile.flush()
                time.sleep(0.1)
            return None
        token = {"token": "true", "logprob": -0.1, "top_logprobs": [{"token": "true", "logprob": -0.1}, {"token": "false", "logprob": -2.4}]}
        more = {"logprobs": {"content": [token]}} if asked.get("logprobs") else {}
        return self.say(200, json.dumps({"choices": [{"message": {"content": ANSWER}, **more}], "usage": {"prompt_tokens": 5, "completion_tokens": 3}}).encode())

    def say(self, status, body):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.seen = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def test_scorer(spark, server):
    there = endpoint.Endpoint(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", timeout=1.0, headers=(("X-Key", "k"),))
    prompts = spark.createDataFrame([(u, "S", u) for u in ("fine", "busy", "odd", "slow")], "id string, system string, user string")
    began = time.monotonic()
    got = {r.id: r for r in scoring.run_scorer(prompts, None, there.scorer("m"), concurrency=2).collect()}
    assert time.monotonic() - began < 20
    assert got["fine"].content == ANSWER and got["fine"].error is None and (got["fine"].prompt_tokens, got["fine"].completion_tokens) == (5, 3)
    assert got["fine"].tokens[0].token == "true" and [t.logprob for t in got["fine"].tokens[0].top_logprobs] == [-0.1, -2.4]
    assert got["busy"].error == "HTTP 503" and "choices" in got["odd"].error and "no whole answer in 1 s" in got["slow"].error
    rows = prompts.where("id = 'fine'").withColumns({"prompt_hash": prompts["id"], "prompt_variant": prompts["id"]})
    read = scoring.predictions(spark.createDataFrame([got["fine"]], f"id string, {scoring.RESPONSE}"), rows, "m").first()
    assert read.prediction and read.p_source == "logprob" and 0.9 < read.p_positive < 0.92
    asked, key = server.seen[0]
    assert key == "k" and set(asked) == {"model", "messages", "temperature", "max_tokens", "logprobs", "top_logprobs", "guided_json"}
    away = endpoint.Endpoint("http://127.0.0.1:1/", timeout=1.0)
    assert scoring.run_scorer(prompts.limit(1), None, away.scorer("m"), concurrency=1).first().error


def test_request_equals_the_payload_column(spark):
    row = spark.createDataFrame([('sys "x"\n', "né \\ user")], "system string, user string")
    for logprobs in (10, None):
        column = row.select(P.payload("m", logprobs).alias("p")).first().p
        assert json.loads(column) == json.loads(endpoint.request('sys "x"\n', "né \\ user", "m", logprobs))


def test_replayed_report(spark, server, tmp_path):
    there = endpoint.Endpoint(f"http://127.0.0.1:{server.server_port}/", timeout=5.0)
    payloads = [(str(i), endpoint.request("s", "busy" if i == 3 else "fine", "m", None)) for i in range(10)]
    calls, report = scoring.replayed(spark.createDataFrame(payloads, "id string, payload string"), there.post, str(tmp_path / "calls"), concurrency=3)
    rows = {r.id: r for r in calls.collect()}
    assert len(rows) == len(server.seen) == 10 and rows["3"].error == "HTTP 503" and rows["3"].status == 503 and rows["0"].prompt_tokens == 5
    r = report.first()
    assert r.n == 9 and 0 < r.p50 <= r.p99 <= r.longest and r.per_second > 0
    assert len(server.seen) == 10, "the report reads what was written, and posts nothing again"
