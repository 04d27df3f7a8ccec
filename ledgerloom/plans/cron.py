"""Five-field schedules: when one is due next, in its own time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DAYS = {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())}
_FIELDS = (("minute", 0, 59, {}), ("hour", 0, 23, {}), ("day", 1, 31, {}), ("month", 1, 12, _MONTHS), ("weekday", 0, 7, _DAYS))


def parse(expression: str) -> list[set[int]]:
    """The allowed values of each field; lists, ranges, steps and names."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("five fields are needed")
    out = []
    for part, (name, lo, hi, names) in zip(parts, _FIELDS, strict=True):
        own: set[int] = set()
        for item in part.lower().split(","):
            span, _, step = item.partition("/")
            n = int(step) if step else 1
            if n < 1:
                raise ValueError(f"bad step in {name}")
            value = lambda x, names=names: names[x] if x in names else int(x)
            if span == "*":
                a, b = lo, hi
            elif "-" in span:
                a, b = map(value, span.split("-"))
            else:
                a = value(span)
                b = hi if step else a
            if not lo <= a <= b <= hi:
                raise ValueError(f"{name} is out of range")
            own.update(range(a, b + 1, n))
        out.append({0 if name == "weekday" and v == 7 else v for v in own})
    return out


def next_run(expression: str, after: datetime, zone: str = "UTC") -> datetime:
    """The first due minute after an instant, as UTC. With both days set, either will do; a time that a clock change skips is due when the clock goes on."""
    minute, hour, day, month, weekday = parse(expression)
    fields = expression.split()
    either = fields[2] != "*" and fields[4] != "*"
    tz = ZoneInfo(zone)
    local = after.astimezone(tz).replace(second=0, microsecond=0, tzinfo=None) + timedelta(minutes=1)
    end = local + timedelta(days=366 * 5)
    while local < end:
        if local.month not in month:
            local = (local.replace(day=1, hour=0, minute=0) + timedelta(days=32)).replace(day=1)
            continue
        by_day, by_week = local.day in day, (local.weekday() + 1) % 7 in weekday
        if not (by_day or by_week if either else by_day and by_week):
            local = local.replace(hour=0, minute=0) + timedelta(days=1)
            continue
        if local.hour not in hour:
            local = local.replace(minute=0) + timedelta(hours=1)
            continue
        if local.minute in minute:
            at = local.replace(tzinfo=tz).astimezone(timezone.utc)
            if at > after.astimezone(timezone.utc):
                return at
        local += timedelta(minutes=1)
    raise ValueError("never due")


def describe(expression: str) -> str:
    minute, hour, day, month, weekday = expression.split()
    parse(expression)
    names = [d.capitalize() for d in _DAYS]
    time = f"at {int(hour):02d}:{int(minute):02d}" if hour.isdigit() and minute.isdigit() else f"every {minute[2:]} minutes" if minute.startswith("*/") and hour == "*" else f"at minute {minute} of hour {hour}"
    days = "" if weekday == "*" else " on " + ", ".join(names[d % 7] if isinstance(d, int) else d for d in sorted(parse(expression)[4]))
    return time + days + ("" if day == "*" else f" on day {day}") + ("" if month == "*" else f" in month {month}")
