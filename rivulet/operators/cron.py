"""Cron expressions with seconds: second minute hour day-of-month month day-of-week [year]."""

from __future__ import annotations

import functools
from datetime import datetime, timedelta

import numpy as np

from rivulet.errors import QueryError

_MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
_DAYS = {d: i for i, d in enumerate("SUN MON TUE WED THU FRI SAT".split(), 1)}


_FIRST = datetime(1970, 1, 1)
#: Days since 1970 of the years that a schedule may name.
_LEAST, _MOST = 0, (datetime(2199, 12, 31) - _FIRST).days


class CronSchedule:
    """The instants of a cron expression, in UTC. Days of the week run from 1 (Sunday); one of both day fields is ?."""

    def __init__(self, text: str):
        parts = text.upper().split()
        if len(parts) not in (6, 7):
            raise QueryError(f"not a cron expression: {text!r}")
        self.text = text
        limits = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7), (1970, 2199)]
        names = [{}, {}, {}, {}, _MONTHS, _DAYS, {}]
        fields = [self._field(p, lo, hi, n) for p, (lo, hi), n in zip([*parts, "*"][:7], limits, names)]
        self.seconds, self.minutes, self.hours, self.days, self.months, self.weekdays, self.years = fields
        self.last_day = parts[3] == "L"

    @staticmethod
    def _field(text: str, low: int, high: int, names: dict[str, int]) -> frozenset[int]:
        out: set[int] = set()
        for part in text.split(","):
            body, _, step = part.partition("/")
            number = lambda x: names[x] if x in names else int(x)
            try:
                if body in ("*", "?", "L"):
                    a, b = low, high
                elif "-" in body:
                    a, b = map(number, body.split("-"))
                else:
                    a = number(body)
                    b = high if step else a
                if not low <= a <= high or not low <= b <= high or (step and int(step) < 1):
                    raise ValueError(part)
            except (ValueError, KeyError):
                raise QueryError(f"bad cron field {text!r}") from None
            span = range(a, b + 1) if a <= b else [*range(a, high + 1), *range(low, b + 1)]
            out.update(list(span)[:: int(step or 1)])
        return frozenset(out)

    def _day(self, day: datetime) -> bool:
        last = (day + timedelta(days=1)).month != day.month
        dom = last if self.last_day else day.day in self.days
        return day.year in self.years and day.month in self.months and dom and (day.isoweekday() % 7 + 1) in self.weekdays

    @functools.cached_property
    def _of_day(self) -> np.ndarray:
        """The schedule's seconds of a day."""
        return np.array(sorted(3600 * h + 60 * m + s for h in self.hours for m in self.minutes for s in self.seconds), np.int64)

    def _next_day(self, day: int) -> int:
        """The first day of the schedule from ``day`` on, in days since 1970; -1 if there is none."""
        at = _FIRST + timedelta(days=day)
        while at.year <= max(self.years):
            if self._day(at):
                return (at - _FIRST).days
            at += timedelta(days=1)
        return -1

    def after(self, seconds: np.ndarray) -> np.ndarray:
        """The first instant after each of ``seconds`` (epoch); -1 where there is none. No instants are listed: a day's seconds and the days at hand are enough."""
        day, second = np.divmod(np.asarray(seconds, np.int64), 86400)
        days, at = np.unique(day, return_inverse=True)
        own = np.array([self._next_day(d) if _LEAST <= d <= _MOST else -1 for d in days.tolist()], np.int64)
        then = np.array([self._next_day(d + 1) if _LEAST <= d + 1 <= _MOST else -1 for d in days.tolist()], np.int64)
        k = np.searchsorted(self._of_day, second, side="right")
        today = (own[at] == day) & (k < len(self._of_day))
        later = np.where(own[at] > day, own[at], then[at])
        out = np.where(today, day * 86400 + self._of_day[np.minimum(k, len(self._of_day) - 1)], later * 86400 + self._of_day[0])
        return np.where(today | (later >= 0), out, -1)

    def between(self, low: int, high: int) -> list[int]:
        """The instants from ``low`` on, up to the first one after ``high``."""
        out, t = [], low - 1
        while t <= high and (t := int(self.after(np.array([t]))[0])) >= 0:
            out.append(t)
        return out
