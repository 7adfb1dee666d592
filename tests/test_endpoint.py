import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webgauge.operators import enrich as E
from webgauge.sources import endpoint

NOW, MOST, SEEN, LOCK = [0], [0], [], threading.Lock()


class Scripted(BaseHTTPRequestHandler):
    """Answers by the last message; counts how many requests are open at once."""

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with LOCK:
            NOW[0] += 1
            MOST[0] = max(MOST[0], NOW[0])
            SEEN.append((self.headers["Authorization"], asked))
        time.sleep(0.05)
        with LOCK:
            NOW[0] -= 1
        text = asked["messages"][-1]["content"]
        status = {"slow down": 429, "key": 401, "broken": 500}.get(text, 200)
        said = {"choices": [{"message": {"content": None if text == "refuse" else f"to {text}"}}], "usage": {"prompt_tokens": len(text), "completion_tokens": 7}}
        body = b"<html>" if text == "page" else json.dumps(said).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Scripted)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    server.shutdown()


def test_answers_and_failures(url):
    ask = lambda text: endpoint.Endpoint(url, "secret", "gpt-4o")([{"role": "user", "content": text}])
    assert ask("hello") == E.Completion("to hello", 5, 7) and ask("refuse").content is None
    key, sent = SEEN[-1]
    assert key == "Bearer secret" and sent["model"] == "gpt-4o" and sent["max_tokens"] == 300 and sent["temperature"] == 0.3
    for text, error, why in (("slow down", E.RateLimited, "often"), ("key", E.Unavailable, "refused"), ("broken", E.Unavailable, "status 500"), ("page", E.Unavailable, "not a chat")):
        with pytest.raises(error, match=why):
            ask(text)
    with pytest.raises(E.Unavailable, match="no connection"):
        endpoint.Endpoint("http://127.0.0.1:9/", "secret", "m")([])

    def late(*_):
        raise TimeoutError("30 s")

    with pytest.raises(E.Unavailable, match="in time"):
        endpoint.Endpoint(url, "secret", "m", late)([])
    assert "secret" not in repr(endpoint.completer(url, "secret", "m"))


def test_waits_when_told_to(url):
    waits, n = [], len(SEEN)
    with pytest.raises(E.Unavailable):
        E.Patient(endpoint.Endpoint(url, "k", "m"), waits.append)([{"role": "user", "content": "slow down"}])
    assert waits == [1.0, 2.0] and len(SEEN) == n + 3


@pytest.mark.parametrize("at_once", [1, 3, 20])
def test_never_more_at_once(spark, url, at_once):
    MOST[0] = 0
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content")))
    asked = spark.range(60).select("id", message.alias("messages"))
    rows = E.ask(asked, endpoint.Endpoint(url, "k", "m"), at_once).collect()
    assert {(x.id, x.answer) for x in rows} == {(i, f"to {i}") for i in range(60)}
    assert 1 <= MOST[0] <= at_once
