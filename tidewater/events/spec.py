"""Event analysis statements: their grammar and what they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from tidewater.errors import UnsupportedSql
from tidewater.plans.tokens import Group, Token, split_on, text_of, tree, words

UNITS = {"MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800}


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Member:
    column: str
    values: tuple


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Both:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Common:
    """What every analysis may carry."""

    dataset: str
    since: datetime | None = None
    until: datetime | None = None
    where: object = None
    breakdown: str | None = None


@dataclass(frozen=True)
class Funnel:
    common: Common
    steps: tuple[str, ...]
    window_seconds: int
    mode: str = "STRICT_ORDER"


@dataclass(frozen=True)
class Retention:
    common: Common
    birth: str | None
    back: str | None
    period: str
    mode: str = "BOUNDED"
    periods: int | None = None
    at: int | None = None


@dataclass(frozen=True)
class Segment:
    common: Common
    measure: str
    bucket: str
    event: str | None = None


@dataclass(frozen=True)
class Paths:
    common: Common
    start: str | None = None
    end: str | None = None
    depth: int = 5
    top: int = 20
    gap_seconds: int | None = None


@dataclass(frozen=True)
class CreateDataset:
    name: str
    source: str
    is_query: bool
    actor: str
    time: str
    event: str
    tiebreak: str | None = None
    properties: tuple[str, ...] | None = None
    options: dict = field(default_factory=dict)


class Reader:
    """Clauses in their fixed order."""

    def __init__(self, sql: str):
        self.items = tree(sql)
        self.at = 0

    def take(self, *expected: str) -> bool:
        if words(self.items[self.at :], *expected):
            self.at += len(expected)
            return True
        return False

    def need(self, *expected: str) -> None:
        if not self.take(*expected):
            raise UnsupportedSql(f"expected {' '.join(expected)} at: {text_of(self.items[self.at :][:4]) or 'the end'}")

    def next(self, kind: str, said: str):
        if self.at >= len(self.items) or (self.items[self.at].kind != kind and not (kind == "word" and self.items[self.at].kind == "name")):
            raise UnsupportedSql(f"expected {said} at: {text_of(self.items[self.at :][:4]) or 'the end'}")
        self.at += 1
        return self.items[self.at - 1]

    def name(self) -> str:
        return self.next("word", "a name").text.strip('"`')

    def string(self) -> str:
        return literal(self.next("string", "a quoted string"))

    def number(self) -> int:
        text = self.next("number", "a whole number").text
        if not text.isdigit():
            raise UnsupportedSql(f"expected a whole number, not {text}")
        return int(text)

    def span(self) -> int:
        n, unit = self.number(), self.name().upper()
        unit = unit[:-1] if unit.endswith("S") else unit
        if unit not in UNITS:
            raise UnsupportedSql(f"unknown unit {unit}; MINUTE, HOUR, DAY and WEEK are known")
        return n * UNITS[unit]

    def one_of(self, *options: str) -> str:
        found = self.name().upper()
        if found not in options:
            raise UnsupportedSql(f"expected one of {', '.join(options)}, not {found}")
        return found

    def done(self) -> None:
        if self.at != len(self.items):
            raise UnsupportedSql(f"unexpected: {text_of(self.items[self.at :][:6])}")


def literal(token: Token):
    if token.kind == "string":
        return token.text[1:-1].replace("''", "'")
    if token.kind == "number":
        return int(token.text) if token.text.isdigit() else float(token.text)
    if token.upper in ("TRUE", "FALSE"):
        return token.upper == "TRUE"
    raise UnsupportedSql(f"expected a literal, not {token.render()}")


def moment(text: str) -> datetime:
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        raise UnsupportedSql(f"{text!r} is no date or timestamp") from None
    return found.replace(tzinfo=None)


def predicate(items: list):
    """p OR p, p AND p, NOT p, (p), column op literal, IN (literals), IS [NOT] NULL."""
    for op in ("OR", "AND"):
        parts: list[list] = [[]]
        for x in items:
            if x.kind == "word" and x.upper == op:
                parts.append([])
            else:
                parts[-1].append(x)
        if len(parts) > 1:
            return Both(op, tuple(predicate(p) for p in parts))
    if words(items, "NOT"):
        return Not(predicate(items[1:]))
    if len(items) == 1 and items[0].kind == "group":
        return predicate(items[0].items)
    if not items or items[0].kind not in ("word", "name"):
        raise UnsupportedSql(f"not a property condition: {text_of(items)}")
    column, rest = items[0].text.strip('"`'), items[1:]
    if words(rest, "IS", "NULL") and len(rest) == 2:
        return IsNull(column, False)
    if words(rest, "IS", "NOT", "NULL") and len(rest) == 3:
        return IsNull(column, True)
    if words(rest, "IN") and len(rest) == 2 and isinstance(rest[1], Group):
        return Member(column, tuple(_value(v) for v in split_on(rest[1].items, ",")))
    if rest and rest[0].kind == "mark" and rest[0].text in ("=", "<>", "!=", "<", "<=", ">", ">="):
        return Compare(column, rest[0].text, _value(rest[1:]))
    raise UnsupportedSql(f"not a property condition: {text_of(items)}")


def _value(items: list):
    if len(items) == 2 and items[0].kind == "mark" and items[0].text == "-" and items[1].kind == "number":
        return -literal(items[1])
    if len(items) != 1 or isinstance(items[0], Group):
        raise UnsupportedSql(f"expected a literal, not {text_of(items)}")
    return literal(items[0])


def _tail(r: Reader, dataset: str, breakdown: bool = True) -> Common:
    since = moment(r.string()) if r.take("FROM") else None
    until = moment(r.string()) if r.take("TO") else None
    where = None
    if r.take("WHERE"):
        begin = r.at
        while r.at < len(r.items) and not words(r.items[r.at :], "BREAKDOWN", "BY"):
            r.at += 1
        where = predicate(r.items[begin : r.at])
    by = r.name() if breakdown and r.take("BREAKDOWN", "BY") else None
    r.done()
    if since is not None and until is not None and since >= until:
        raise UnsupportedSql(f"empty range: {since} to {until}")
    return Common(dataset, since, until, where, by)


def parse(sql: str) -> Funnel | Retention | Segment | Paths | CreateDataset:
    r = Reader(sql)
    kind = r.name().upper()
    if kind == "FUNNEL":
        group = r.next("group", "the steps in brackets")
        steps = tuple(_value(s) for s in split_on(group.items, ","))
        if not 2 <= len(steps) <= 32 or not all(isinstance(s, str) for s in steps):
            raise UnsupportedSql("a funnel has 2 to 32 quoted steps")
        r.need("ON")
        dataset = r.name()
        r.need("WINDOW")
        window = r.span()
        if window <= 0:
            raise UnsupportedSql("a funnel's window is above 0")
        mode = r.one_of("STRICT_ORDER", "ANY_ORDER") if r.take("MODE") else "STRICT_ORDER"
        if mode == "ANY_ORDER":
            raise UnsupportedSql("unsupported: MODE ANY_ORDER")
        return Funnel(_tail(r, dataset), steps, window, mode)
    if kind == "RETENTION":
        r.need("ON")
        dataset = r.name()
        event = lambda: None if r.take("ANY", "EVENT") else r.string()
        r.need("BIRTH")
        birth = event()
        r.need("RETURN")
        back = event()
        r.need("PERIOD")
        period = r.one_of("DAY", "WEEK", "MONTH")
        mode = r.one_of("BOUNDED", "UNBOUNDED") if r.take("MODE") else "BOUNDED"
        periods = r.number() if r.take("PERIODS") else None
        at = r.number() if r.take("AT") else None
        if at is not None and periods is not None and at > periods:
            raise UnsupportedSql("AT is beyond PERIODS")
        return Retention(_tail(r, dataset), birth, back, period, mode, periods, at)
    if kind == "SEGMENT":
        measure = r.one_of("COUNT", "UNIQUES", "COUNT_PER_UNIQUE")
        r.need("ON")
        dataset = r.name()
        event = r.string() if r.take("EVENT") else None
        r.need("BUCKET")
        bucket = r.one_of("HOUR", "DAY", "WEEK", "MONTH")
        return Segment(_tail(r, dataset), measure, bucket, event)
    if kind == "PATHS":
        r.need("ON")
        dataset = r.name()
        start = r.string() if r.take("STARTING", "AT") else None
        end = r.string() if start is None and r.take("ENDING", "AT") else None
        depth = r.number() if r.take("DEPTH") else 5
        top = r.number() if r.take("TOP") else 20
        gap = r.span() if r.take("MAXGAP") else None
        if depth < 2 or not 1 <= top <= 1000:
            raise UnsupportedSql("PATHS takes a DEPTH of 2 at least and a TOP of 1 to 1000")
        return Paths(_tail(r, dataset, breakdown=False), start, end, depth, top, gap)
    if kind == "CREATE":
        return _create(r)
    raise UnsupportedSql(f"not an event statement: {kind}")


def _create(r: Reader) -> CreateDataset:
    r.need("EVENT", "DATASET")
    name = r.name()
    if r.take("FROM"):
        parts = [r.name()]
        while r.at < len(r.items) and r.items[r.at].kind == "mark" and r.items[r.at].text == ".":
            r.at += 1
            parts.append(r.name())
        source, is_query = ".".join(parts), False
    else:
        r.need("AS")
        source, is_query = text_of(r.next("group", "a query in brackets").items), True
    r.need("ACTOR")
    actor = r.name()
    r.need("TIME")
    time = r.name()
    r.need("EVENT")
    event = r.name()
    tiebreak = r.name() if r.take("TIEBREAK") else None
    properties = None
    if r.take("PROPERTIES"):
        group = r.next("group", "property names in brackets")
        properties = tuple(p[0].text.strip('"`') for p in split_on(group.items, ",") if p)
    options = {}
    if r.take("WITH"):
        for part in split_on(r.next("group", "options in brackets").items, ","):
            if len(part) != 3 or part[1].text != "=" or part[0].text.lower() not in ("shards", "refresh_key", "time_unit"):
                raise UnsupportedSql(f"unknown option: {text_of(part)}")
            options[part[0].text.lower()] = str(literal(part[2]))
    r.done()
    return CreateDataset(name, source, is_query, actor, time, event, tiebreak, properties, options)
