"""Calls of outside services from tasks: several at a time, at a bounded rate, in order.

A task keeps at most so many requests in flight and hands their answers on in the order
of its rows, so results don't depend on which answer came first. Requests of all kinds
of one worker draw from one token bucket per service. An answer that says to wait (429,
503) holds the bucket back for all of them. A refusal that no repetition mends, such as
a wrong key, is a ``ConfigurationError`` and ends the job; anything else that is raised
is handed on as that row's failure.
"""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

#: Requests that a task keeps in flight.
IN_FLIGHT = 8
#: Seconds to wait where a service says that it is busy but not for how long.
BUSY_SECONDS = 5.0
#: Replies that a repetition cannot mend.
REFUSED = (400, 401, 403, 404, 405, 422)
#: Replies that ask to wait.
BUSY = (429, 503)


class ConfigurationError(ValueError):
    """A setting is wrong: asking again cannot help."""


class BusyError(OSError):
    """The service asks to wait."""

    def __init__(self, seconds: float):
        super().__init__(f"busy for {seconds} s")
        self.seconds = seconds


class TokenBucket:
    """At most ``rate`` requests a second on average, ``burst`` at once; None: without a bound."""

    def __init__(self, rate: float | None, burst: int = 1):
        self.rate, self.burst = rate, burst
        self.tokens, self.at = float(burst), time.monotonic()
        self.lock = threading.Lock()

    def take(self) -> None:
        """Wait for one's turn."""
        with self.lock:
            now = time.monotonic()
            if self.rate:
                self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
                self.tokens -= 1
                wait = max(0.0, self.at - now) + max(0.0, -self.tokens / self.rate)
            else:
                wait = max(0.0, self.at - now)
            self.at = max(self.at, now)
        if wait > 0:
            time.sleep(wait)

    def pause(self, seconds: float) -> None:
        """No request for so long."""
        with self.lock:
            self.at = max(self.at, time.monotonic() + seconds)


_buckets: dict[tuple, TokenBucket] = {}
_lock = threading.Lock()


def bucket(service: str, rate: float | None) -> TokenBucket:
    """The bucket that all requests of this worker to ``service`` share."""
    with _lock:
        return _buckets.setdefault((service, rate), TokenBucket(rate))


def opened(call: urllib.request.Request, timeout: float):
    """The reply to a request; refusals and waiting times as errors of their own."""
    try:
        return urllib.request.urlopen(call, timeout=timeout)
    except urllib.error.HTTPError as error:
        if error.code in BUSY:
            after = error.headers.get("Retry-After", "")
            raise BusyError(float(after) if after.replace(".", "", 1).isdigit() else BUSY_SECONDS) from error
        if error.code in REFUSED:
            raise ConfigurationError(f"the service refuses: {error.code} {error.reason}") from error
        raise


def in_flight(items: Iterable, call: Callable, turns: TokenBucket, most: int = IN_FLIGHT) -> Iterator[tuple[object, object, Exception | None]]:
    """(item, answer, failure) of ``call(item)`` in the order of ``items``, at most ``most`` at once.

    ``call`` takes a turn from the bucket for each request it makes.
    """

    def run(item):
        try:
            return item, call(item), None
        except ConfigurationError:
            raise
        except BusyError as error:
            turns.pause(error.seconds)
            return item, None, error
        except Exception as error:  # this row's failure
            return item, None, error

    with ThreadPoolExecutor(max_workers=most) as pool:
        waiting: deque = deque()
        try:
            for item in items:
                waiting.append(pool.submit(run, item))
                if len(waiting) >= most:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for rest in waiting:
                rest.cancel()
