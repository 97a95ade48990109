"""When runs start: every so often, by cron, or at times of day; with bounds, jitter, retries and a policy for failures."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def duration(text: str) -> float:
    """Seconds of texts such as 90s, 5m or 1h30m."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])", text)
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*(ms|[smhdw])|\s", "", text):
        raise ValueError(f"unreadable duration {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def _field(text: str, low: int, high: int, names: dict[str, int] | None = None) -> set[int]:
    out: set[int] = set()
    number = lambda x: (names or {}).get(x.upper(), None) if not x.isdigit() else int(x)
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span in ("*", "?") else (number(a), number(b) if b else high if step else number(a))
        if first is None or last is None or not (low <= first <= high and low <= last <= high):
            raise ValueError(f"unreadable cron field {text!r}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


_MONTHS = {m: k for k, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
_DAYS = {d: k for k, d in enumerate("SUN MON TUE WED THU FRI SAT".split(), 1)}


def next_cron(text: str, after: datetime) -> datetime:
    """The first time after one, in UTC: second minute hour day month weekday (1 is Sunday) [year]."""
    parts = text.split()
    if len(parts) not in (6, 7):
        raise ValueError("cron has six or seven fields")
    seconds, minutes, hours, days = (_field(p, a, b) for p, (a, b) in zip(parts, ((0, 59), (0, 59), (0, 23), (1, 31)), strict=False))
    months, weekdays = _field(parts[4], 1, 12, _MONTHS), _field(parts[5], 1, 7, _DAYS)
    years = _field(parts[6], 1970, 2199) if len(parts) == 7 else None
    t = after.replace(microsecond=0) + timedelta(seconds=1)
    while t.year <= after.year + 10:
        if t.month not in months or t.day not in days or (t.isoweekday() % 7) + 1 not in weekdays or years and t.year not in years:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0, second=0)
        elif t.hour not in hours:
            t = (t + timedelta(hours=1)).replace(minute=0, second=0)
        elif t.minute not in minutes:
            t = (t + timedelta(minutes=1)).replace(second=0)
        elif t.second not in seconds:
            t += timedelta(seconds=1)
        else:
            return t
    raise ValueError(f"{text!r} never comes")


def next_time(at: str, now: datetime) -> datetime:
    """The next HH:MM of the clock that now is on."""
    hour, minute = (int(x) for x in at.split(":"))
    t = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return t if t > now else t + timedelta(days=1)


@dataclass
class Schedule:
    mode: str = "every"
    value: str = "1h"
    repeat: int | None = None
    lasts: str | None = None
    jitter: str | None = None
    attempts: int = 1
    backoff: str = "5s"
    on_failure: str = "abort"  # abort, continue (counts as failed), ignore
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], datetime] = datetime.now
    stopped: Callable[[], bool] = lambda: False

    def wait(self) -> float:
        now = self.now()
        if self.mode == "every":
            w = duration(self.value)
        else:
            w = ((next_cron if self.mode == "cron" else next_time)(self.value, now) - now).total_seconds()
        return w + (random.uniform(0, duration(self.jitter)) if self.jitter else 0)

    def run(self, job: Callable[[], None]) -> dict[str, int]:
        """Runs until the bounds are met or it is stopped; being stopped is no failure."""
        began, done = self.now(), {"succeeded": 0, "failed": 0}
        while not self.stopped() and (self.repeat is None or sum(done.values()) < self.repeat) and (self.lasts is None or (self.now() - began).total_seconds() < duration(self.lasts)):
            if self.mode != "every" or sum(done.values()):
                self.sleep(self.wait())
            for k in range(self.attempts):
                try:
                    job()
                    done["succeeded"] += 1
                    break
                except Exception:
                    if k + 1 < self.attempts:
                        self.sleep(duration(self.backoff) * 2**k)
                        continue
                    if self.on_failure == "abort":
                        raise
                    done["failed" if self.on_failure == "continue" else "succeeded"] += 1
        return done
