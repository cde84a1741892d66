"""What a collector needs around its requests: payload checks and waiting. The request itself is a function that the caller passes."""

from __future__ import annotations

import time
from collections.abc import Callable
from email.utils import parsedate_to_datetime


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or a date; None for anything else."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def with_retries(get: Callable[[], object], tries: int = 4, first_wait: float = 5.0, longest_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """get()'s answer (with status_code and headers); answers 429 and 5xx are asked for again, after the time the server names or a doubling one."""
    for k in range(tries):
        answer = get()
        if k + 1 == tries or not (answer.status_code == 429 or answer.status_code >= 500):
            return answer
        asked = retry_after(answer.headers.get("Retry-After"), time.time())
        sleep(min(longest_wait, first_wait * 2**k if asked is None else asked))
    raise ValueError("tries must be positive")


def is_error_payload(payload: object) -> bool:
    """Whether a [meta, records] document is an error envelope, one that begins with a message."""
    return isinstance(payload, list) and len(payload) > 0 and isinstance(payload[0], dict) and "message" in payload[0]


def has_observations(payload: object) -> bool:
    """Whether a [meta, records] document has records with a date, be their values null; a total of 0 says that it has none."""
    if is_error_payload(payload) or not isinstance(payload, list) or len(payload) < 2:
        return False
    meta, records = payload[0], payload[1]
    empty = isinstance(meta, dict) and isinstance(meta.get("total"), int) and meta["total"] <= 0
    return not empty and isinstance(records, list) and len(records) > 0 and isinstance(records[0], dict) and "date" in records[0]
