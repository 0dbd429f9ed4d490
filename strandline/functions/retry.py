"""[EMB-4, SRC-3] Calls that are tried again."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

from strandline.functions.text import retry_delay

Result = TypeVar("Result")


def with_retry(call: Callable[[], Result], attempts: int, wait: tuple[float, float]) -> Result:
    """The result of the first attempt that gives one. Waits are random, up to twice as long after each attempt, so that many tasks that
    fail together don't come back together."""
    attempt = 1
    while True:
        try:
            return call()
        except Exception:
            if attempt >= attempts:
                raise
            time.sleep(random.uniform(wait[0], retry_delay(attempt, 2 * wait[0], wait[1])))
            attempt += 1
