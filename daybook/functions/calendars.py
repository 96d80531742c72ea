"""Months of recurrence calendars by rule, for any year: nothing here depends on other rows, on the input or on a table.

Days are counted as `date.toordinal` counts them. Arithmetic calendars follow their leap rules; the Chinese calendar and its
Korean kin follow new moons and the sun's longitude, from published series for both. The one calendar that is a civil table
(Umm al-Qura) can't be made by rule: whoever expands hands its months in, see `operators/expand.py`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from math import floor, radians, sin

DAY_MAX = date.max.toordinal()
MEAN_MONTH = 29.530588861


@dataclass(frozen=True)
class Slot:
    """A month: its number, whether it is the leap month after that of this number, its first day and its length."""

    number: int
    leap: bool
    first: int
    days: int


class Calendar:
    """months(year): the slots of a year; year_of(day): the year that a day lies in. Years are numbered without gaps."""

    def __init__(self, months: Callable[[int], list[Slot]], guess: Callable[[int], int], low: int = -(1 << 30), high: int = 1 << 30):
        self.months, self.low, self.high, self._guess = lru_cache(4096)(months), low, high, guess

    def first(self, year: int) -> int:
        return self.months(year)[0].first

    def year_of(self, day: int) -> int:
        year = min(max(self._guess(day), self.low), self.high)
        while year > self.low and self.first(year) > day:
            year -= 1
        while year < self.high and self.first(year + 1) <= day:
            year += 1
        last = self.months(year)[-1]
        if not self.first(year) <= day < last.first + last.days:
            raise ValueError("DTSTART lies outside the calendar's years")
        return year


def _run(first: int, lengths: list[int], names: list[tuple[int, bool]] | None = None) -> list[Slot]:
    out = []
    for k, n in enumerate(lengths):
        number, leap = names[k] if names else (k + 1, False)
        out.append(Slot(number, leap, first, n))
        first += n
    return out


def _leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def _gregorian_first(year: int) -> int:
    y = year - 1
    return 365 * y + y // 4 - y // 100 + y // 400 + 1


def gregorian(year: int) -> list[Slot]:
    return _run(_gregorian_first(year), [31, 28 + _leap(year), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def coptic(epoch: int) -> Callable[[int], list[Slot]]:
    """Twelve months of 30 days and five or six days."""
    return lambda year: _run(epoch + 365 * (year - 1) + year // 4, [30] * 12 + [5 + (year % 4 == 3)])


def islamic(epoch: int) -> Callable[[int], list[Slot]]:
    """Months of 30 and 29 days in turn, eleven leap years in thirty."""
    return lambda year: _run(epoch + 354 * (year - 1) + (3 + 11 * year) // 30, [30 - k % 2 for k in range(11)] + [29 + ((14 + 11 * year) % 30 < 11)])


def indian(year: int) -> list[Slot]:
    own = year + 78
    return _run(_gregorian_first(own) + 80, [30 + _leap(own)] + [31] * 5 + [30] * 6)


def _hebrew_first(year: int) -> int:
    """The first day of Tishri: the mean new moon, put off so that no feast falls on a wrong day and no year has a wrong length."""

    def elapsed(y: int) -> int:
        months = (235 * y - 234) // 19
        parts = 12084 + 13753 * months
        day = 29 * months + parts // 25920
        return day + (3 * (day + 1) % 7 < 3)

    before, own, after = elapsed(year - 1), elapsed(year), elapsed(year + 1)
    return -1373427 + own + (2 if after - own == 356 else 1 if own - before == 382 else 0)


def hebrew(year: int) -> list[Slot]:
    first = _hebrew_first(year)
    days = _hebrew_first(year + 1) - first
    leap = (7 * year + 1) % 19 < 7
    lengths = [30, 30 if days % 10 == 5 else 29, 29 if days % 10 == 3 else 30, 29, 30, *([30] if leap else []), 29, 30, 29, 30, 29, 30, 29]
    names = [*((k, False) for k in range(1, 6)), *([(5, True)] if leap else []), *((k, False) for k in range(6, 13))]
    return _run(first, lengths, names)


# The sun and the moon. Days of these functions are real numbers since 0001-01-01, universal time, on the scale of ordinals.


def _delta(day: float) -> float:
    """Dynamical minus universal time, in days: a parabola about 1820, lower within the last two centuries."""
    year = 1 + day / 365.2425
    u = (year - 1820) / 100
    if 1900 <= year < 2050:
        t = year - 2000
        seconds = 63.86 + 0.3345 * t - 0.0603 * t * t / 10 if 2000 <= year < 2005 else 62.92 + 0.32217 * t + 0.005589 * t * t if year >= 2005 else 63 + 0.35 * t * (1 if t > -30 else 0) - (21 + 0.2 * (-30 - t) if t <= -30 else 0)
    else:
        seconds = -20 + 32 * u * u
    return seconds / 86400


# The series for the moon's phases (coefficient, power of the eccentricity's factor, multiples of the sun's
# anomaly, the moon's anomaly and its argument of latitude).
PHASE = [
    (-0.40720, 0, 0, 1, 0), (0.17241, 1, 1, 0, 0), (0.01608, 0, 0, 2, 0), (0.01039, 0, 0, 0, 2), (0.00739, 1, -1, 1, 0), (-0.00514, 1, 1, 1, 0),
    (0.00208, 2, 2, 0, 0), (-0.00111, 0, 0, 1, -2), (-0.00057, 0, 0, 1, 2), (0.00056, 1, 1, 2, 0), (-0.00042, 0, 0, 3, 0), (0.00042, 1, 1, 0, 2),
    (0.00038, 1, 1, 0, -2), (-0.00024, 1, -1, 2, 0), (-0.00007, 0, 2, 1, 0), (0.00004, 0, 0, 2, -2), (0.00004, 0, 3, 0, 0), (0.00003, 0, 1, 1, -2),
    (0.00003, 0, 0, 2, 2), (-0.00003, 0, 1, 1, 2), (0.00003, 0, -1, 1, 2), (-0.00002, 0, -1, 1, -2), (-0.00002, 0, 1, 3, 0), (0.00002, 0, 0, 4, 0),
]
EPOCH_JD = 1721424.5  # the Julian day of 0000-12-31, ordinal 0


@lru_cache(8192)
def new_moon(k: int) -> float:
    """The k-th new moon after the first of the year 2000."""
    t = k / 1236.85
    jde = 2451550.09766 + MEAN_MONTH * k + t * t * (0.00015437 + t * (-0.00000015 + 0.00000000073 * t))
    e = 1 - t * (0.002516 + 0.0000074 * t)
    sun = radians(2.5534 + 29.1053567 * k - t * t * (0.0000014 + 0.00000011 * t))
    moon = radians(201.5643 + 385.81693528 * k + t * t * (0.0107582 + t * (0.00001238 - 0.000000058 * t)))
    lat = radians(160.7108 + 390.67050284 * k - t * t * (0.0016118 + t * (0.00000227 - 0.000000011 * t)))
    node = radians(124.7746 - 1.56375588 * k + t * t * (0.0020672 + 0.00000215 * t))
    jde += sum(c * e**p * sin(a * sun + b * moon + d * lat) for c, p, a, b, d in PHASE) - 0.00017 * sin(node)
    jde += 0.000325 * sin(radians(299.77 + 0.107408 * k - 0.009173 * t * t)) + 0.000165 * sin(radians(251.88 + 0.016321 * k)) + 0.000164 * sin(radians(251.83 + 26.651886 * k)) + 0.000126 * sin(radians(349.42 + 36.412478 * k)) + 0.00011 * sin(radians(84.66 + 18.206239 * k))
    day = jde - EPOCH_JD
    return day - _delta(day)


def sun_longitude(day: float) -> float:
    """The sun's apparent longitude in degrees."""
    t = (day + _delta(day) + EPOCH_JD - 2451545) / 36525
    m = radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    centre = (1.914602 - t * (0.004817 + 0.000014 * t)) * sin(m) + (0.019993 - 0.000101 * t) * sin(2 * m) + 0.000289 * sin(3 * m)
    return (280.46646 + t * (36000.76983 + 0.0003032 * t) + centre - 0.00569 - 0.00478 * sin(radians(125.04 - 1934.136 * t))) % 360


def _when_sun_at(angle: float, near: float) -> float:
    """The moment nearest to `near` at which the sun's longitude is `angle`."""
    for _ in range(6):
        off = (angle - sun_longitude(near) + 180) % 360 - 180
        near += off * 365.2422 / 360
    return near


class Lunisolar:
    """Months begin on days of new moons at a meridian; the eleventh holds the winter solstice; in a year between solstices
    of thirteen months the first without a major solar term is a leap month. zone: hours east at a day."""

    def __init__(self, zone: Callable[[float], float]):
        self.zone = zone
        self.solstice, self.sui = lru_cache(4096)(self._solstice), lru_cache(4096)(self._sui)

    def local(self, moment: float) -> int:
        return floor(moment + self.zone(moment) / 24)

    def _solstice(self, year: int) -> int:
        return self.local(_when_sun_at(270, _gregorian_first(year) + 354.5))

    def moon_before(self, day: int) -> int:
        """The number of the last new moon whose day isn't after this one."""
        k = round((day - 730125.6) / MEAN_MONTH)
        while self.local(new_moon(k)) > day:
            k -= 1
        while self.local(new_moon(k + 1)) <= day:
            k += 1
        return k

    def _term(self, day: int) -> int:
        """How many major terms the sun has passed when a day begins at the meridian."""
        return floor(sun_longitude(day - self.zone(day) / 24) / 30)

    def _sui(self, year: int) -> list[Slot]:
        """Months from the eleventh of the year before, which holds its solstice, up to that of this year."""
        a, b = self.moon_before(self.solstice(year - 1)), self.moon_before(self.solstice(year))
        firsts = [self.local(new_moon(k)) for k in range(a, b + 1)]
        out, number, leaped = [], 11, b - a == 12
        for k, (first, after) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
            leap = False
            if k:
                leap = not leaped and self._term(first) == self._term(after)
                leaped |= leap
                number += not leap
            out.append(Slot((number - 1) % 12 + 1, leap, first, after - first))
        return out

    def months(self, year: int) -> list[Slot]:
        own, after = self.sui(year), self.sui(year + 1)
        begin = next(k for k, s in enumerate(own) if s.number == 1 and not s.leap)
        end = next(k for k, s in enumerate(after) if s.number == 1 and not s.leap)
        return own[begin:] + after[:end]


def _beijing(day: float) -> float:
    return 8.0 if day >= 704191 else 1397 / 180  # 1929-01-01


def _seoul(day: float) -> float:
    """The meridians of Korean clocks."""
    steps = [(696608, 3809 / 450), (697978, 8.5), (713398, 9.0), (716097, 8.5)]  # 1908-04-01, 1912-01-01, 1954-03-21, 1961-08-10
    at = bisect_right([s[0] for s in steps], day)
    return [3809 / 450, 8.5, 9.0, 8.5, 9.0][at]


#: Years that are no leap years although the equinox after them is within the series' error after noon.
SHORT = (1502, 1601)


@lru_cache(4096)
def _persian_first(year: int) -> int:
    """The cycle of 33 years holds up to 1501; from then on the day whose noon at 52.5 degrees east follows the equinox."""
    if year <= 1502:
        return 226895 + 365 * (year - 1) + (8 * year + 21) // 33
    equinox = _when_sun_at(0, 226895.5 + 365.24219 * (year - 1)) + 3.5 / 24
    return floor(equinox + 0.5) - (year - 1 in SHORT)


def persian(year: int) -> list[Slot]:
    first = _persian_first(year)
    return _run(first, [31] * 6 + [30] * 5 + [_persian_first(year + 1) - first - 336])


def _near(epoch: int, length: float) -> Callable[[int], int]:
    return lambda day: int((day - epoch) / length) + 1


#: By the name of the library that also knows these calendars: how each is made.
BY_RULE: dict[str, tuple[Callable[[int], list[Slot]], Callable[[int], int]]] = {
    **{name: (gregorian, _near(1, 365.2425)) for name in ("gregorian", "buddhist", "japanese", "roc")},
    "coptic": (coptic(103605), _near(103605, 365.25)),
    "ethiopic": (coptic(2796), _near(2796, 365.25)),
    "ethiopic-amete-alem": (coptic(2796), _near(2796, 365.25)),
    "islamic-civil": (islamic(227015), _near(227015, 354.3667)),
    "islamic-tbla": (islamic(227014), _near(227014, 354.3667)),
    "indian": (indian, _near(_gregorian_first(79) + 80, 365.2425)),
    "hebrew": (hebrew, _near(-1373429, 365.2468)),
    "persian": (persian, _near(226895, 365.2424)),
    "chinese": (Lunisolar(_beijing).months, _near(1, 365.2425)),
    "dangi": (Lunisolar(_seoul).months, _near(1, 365.2425)),
}


@lru_cache
def by_rule(name: str) -> Calendar:
    months, guess = BY_RULE[name]
    return Calendar(months, guess)


def of_table(years: dict[int, list[Slot]], rest: Calendar) -> Calendar:
    """Years of a table, and those of another calendar before and after it; the last of `rest` before the table, and the
    table's last, are cut or stretched so that no day is in two years."""

    def months(year: int) -> list[Slot]:
        if year in years:
            return years[year]
        out = rest.months(year)
        if year + 1 in years and (gap := years[year + 1][0].first - out[-1].first) > 0:
            return [*out[:-1], Slot(out[-1].number, out[-1].leap, out[-1].first, gap)]
        if year - 1 in years and (begin := years[year - 1][-1].first + years[year - 1][-1].days) != out[0].first:
            return [Slot(1, False, begin, out[1].first - begin), *out[1:]]
        return out

    return Calendar(months, rest._guess)
