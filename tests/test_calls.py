import http.server
import random
import threading
import time

import pytest

from tessera.operators import extraction, linking
from tessera.operators.calls import BusyError, ConfigurationError, TokenBucket, in_flight
from tessera.operators.hosted import Hosted
from tessera.streaming.store import Store

TEXT = "We looked at it for long. flask uses werkzeug. That was all there is to say."


def test_bounded_in_flight_and_in_order():
    now, most, lock = [0], [0], threading.Lock()

    def call(n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(random.Random(n).random() / 50)
        with lock:
            now[0] -= 1
        if n % 10 == 3:
            raise OSError(n)
        return n * n

    out = list(in_flight(range(60), call, TokenBucket(None), 5))
    assert [item for item, _, _ in out] == list(range(60))
    assert [a for _, a, _ in out] == [None if n % 10 == 3 else n * n for n in range(60)]
    assert [isinstance(f, OSError) for _, _, f in out] == [n % 10 == 3 for n in range(60)]
    assert 2 <= most[0] <= 5


def test_rate():
    turns, began, at = TokenBucket(50), time.monotonic(), []

    def call(n):
        turns.take()
        at.append(time.monotonic() - began)

    list(in_flight(range(25), call, turns, 8))
    assert 0.45 <= max(at) < 2
    assert all(sum(1 for x in at if a <= x < a + 0.2) <= 13 for a in at)


def test_a_busy_service_holds_all_back():
    turns, met = TokenBucket(None), []

    def call(n):
        turns.take()
        met.append((n, time.monotonic()))
        if n == 0 and len(met) == 1:
            raise BusyError(0.3)

    list(in_flight([0, 1], call, turns, 1))
    assert met[1][1] - met[0][1] >= 0.29


def test_a_wrong_setting_ends_the_job():
    def call(n):
        raise ConfigurationError("wrong key")

    with pytest.raises(ConfigurationError):
        list(in_flight(range(3), call, TokenBucket(None), 2))


@pytest.fixture
def service():
    """Replies with the statuses that are left in the list, then with an answer."""
    statuses = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            status = statuses.pop(0) if statuses else 200
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0.1")
            self.end_headers()
            if status == 200:
                self.wfile.write(b'{"response": "[]"}')

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Hosted("ollama", "m", "", f"http://127.0.0.1:{server.server_port}"), statuses
    server.shutdown()


@pytest.mark.parametrize(("replies", "answer"), [([], "[]"), ([429], "[]"), ([500, 500], "[]"), ([500, 500, 500], None)])
def test_failures_that_pass(service, replies, answer):
    provider, statuses = service
    statuses += replies
    assert extraction.ask(provider, TEXT)[0] == answer


@pytest.mark.parametrize("status", [401, 404])
def test_refusals_are_not_repeated(service, status):
    provider, statuses = service
    statuses += [status] * 5
    with pytest.raises(ConfigurationError):
        extraction.ask(provider, TEXT)
    assert len(statuses) == 4 and "secret" not in repr(Hosted("openai", "m", "secret"))


def test_a_failure_is_not_an_answer(spark, tmp_path):
    """While the provider fails nothing is known; once it answers, only then it is asked no more."""

    class Down:
        def generate(self, prompt):
            raise TimeoutError

    store = Store(spark, str(tmp_path))
    m = spark.createDataFrame([("m0", "s0", TEXT)], "message_id string, session string, content string")
    assert [r.facts for r in extraction.extract_into(store, m, 0, Down).collect()] == [None]
    assert [len(r.facts) for r in extraction.extract_into(store, m, 1).collect()] == [1]
    assert [len(r.facts) for r in extraction.extract_into(store, m, 2, Down).collect()] == [1]
    refusing = lambda: Hosted("ollama", "m", "", "http://127.0.0.1:9")  # noqa: E731  nobody listens: a failure, no refusal
    other = m.withColumn("message_id", m.session)
    assert extraction.extract_into(store, other, 3, refusing).first().facts is None


def test_a_failed_search_is_not_an_empty_one(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("python", "uses", "golang", f"m{i}", f"s{i}") for i in range(3)]
    facts = spark.createDataFrame(rows, "subj_name string, predicate string, obj_name string, message_id string, session string")

    def flaky():
        def find(label):
            if label == "golang":
                raise TimeoutError
            return []

        return find

    def working():
        return lambda label: [{"id": "Q1", "label": label, "description": "software", "aliases": []}]

    links, counts = linking.link_into(store, facts, flaky, 0)
    assert links.count() == 0 and {r.label: r.qid for r in store.current("link_cache").collect()} == {"python": None}
    links, _ = linking.link_into(store, facts, working, 1, rate=100.0, in_flight=2)
    assert [(r.label, r.qid) for r in links.collect()] == [("golang", "Q1")]
