"""Timestamps of many forms and zones, as one instant in UTC.

Each text is turned into a mask of character classes (9 for a digit, a for a letter). A mask
is given a parser once; all texts of a mask in a batch are then cut at fixed places and
computed with in numpy. Zones are tables of transitions with a version.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Months in Spanish and English by their first three letters; "set" is Peruvian.
MONTHS = {
    "ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12,
}
# Hours from UTC of zone abbreviations that mean one thing wherever they are read. Others
# ("CST", "IST", "BST") mean something only within a zone.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "pet": -5, "clt": -4, "clst": -3, "est": -5, "edt": -4, "mdt": -6, "pst": -8, "pdt": -7,
    "cet": 1, "cest": 2, "wet": 0, "west": 1, "brt": -3, "art": -3, "bot": -4, "cot": -5,
}
# Names that people use in zones for which the zone database has figures only.
SPOKEN = {
    "America/Lima": {"pet": -5}, "America/Santiago": {"clt": -4, "clst": -3}, "America/Sao_Paulo": {"brt": -3, "brst": -2},
    "America/Argentina/Buenos_Aires": {"art": -3}, "America/La_Paz": {"bot": -4}, "America/Bogota": {"cot": -5},
    "America/Guayaquil": {"ect": -5}, "America/Caracas": {"vet": -4}, "America/Montevideo": {"uyt": -3},
}
FIRST_DAY, LAST_DAY = 0, 365 * 130 + 32  # zone tables run from 1970 to 2099; other days are asked of the zone one by one
HOUR = 3600


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of a zone, in seconds: ``offsets[i]`` holds for clock times from ``clock[i - 1]``
    up to ``clock[i]``, and ``names[i]`` is what the zone is called then. Of a clock hour that occurs twice the
    first counts; one that is skipped counts with the offset before. ``version`` is that of the zone database.
    ``spoken`` has the offsets of every name, the latest last."""

    zone: str
    version: str
    clock: np.ndarray
    offsets: np.ndarray
    names: list[str]
    spoken: dict[str, tuple[int, ...]]

    def at(self, local: int) -> tuple[int, str]:
        """Offset and name at a clock time."""
        i = int(np.searchsorted(self.clock, local, side="right"))
        return int(self.offsets[i]), self.names[i]

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        utc = local - self.offsets[np.searchsorted(self.clock, local, side="right")]
        for i in np.flatnonzero((local < (FIRST_DAY + 1) * 86400) | (local >= (LAST_DAY - 1) * 86400)):
            utc[i] = local[i] - _offset_of_clock(self.zone, int(local[i]))
        return utc


def _offset_of_clock(zone: str, local: int) -> int:
    """Offset of a zone at a clock time of any year."""
    from datetime import datetime, timedelta

    clock = (datetime(1970, 1, 1) + timedelta(seconds=local)).replace(tzinfo=zoneinfo.ZoneInfo(zone))
    return int(clock.utcoffset().total_seconds())


def zone_version() -> str:
    """Version of the zone database that this process reads."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            try:
                with open(f"{folder}/{name}") as f:
                    return f.readline().strip().removeprefix("# version ")
            except OSError:
                continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1024)
def zone_table(zone: str) -> ZoneTable | None:
    """The table of a zone, found by bisection between days; None if there is no such zone. No zone of the
    database has two changes within two days."""
    from datetime import UTC, datetime, timedelta

    try:
        info = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    start = datetime(1970, 1, 1, tzinfo=UTC)

    def offset(second: int) -> int:
        return int((start + timedelta(seconds=second)).astimezone(info).utcoffset().total_seconds())

    def name(second: int) -> str:
        return (start + timedelta(seconds=second)).astimezone(info).tzname().lower()

    clock, offsets, names = [], [offset(0)], [name(0)]
    before = offsets[0]
    for day in range(FIRST_DAY + 1, LAST_DAY):
        here = offset(day * 86400)
        if here != before:
            low, high = (day - 1) * 86400, day * 86400
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == before else (low, middle)
            clock.append(high + max(before, here))
            offsets.append(here)
            names.append(name(day * 86400))
            before = here
    spoken: dict[str, tuple[int, ...]] = {k: (v * HOUR,) for k, v in SPOKEN.get(zone, {}).items()}
    for word, seconds in zip(names, offsets):
        spoken[word] = (*(x for x in spoken.get(word, ()) if x != seconds), seconds)
    return ZoneTable(zone, zone_version(), np.array(clock, np.int64), np.array(offsets, np.int64), names, spoken)


@lru_cache(maxsize=65536)
def abbreviation(zone: str | None, word: str) -> tuple[int, ...]:
    """Offsets that an abbreviation may have in a zone: those that the zone itself gives it, else the one that
    it has everywhere; none if it is unknown or means several things."""
    table = zone_table(_zone_name(zone)) if zone else None
    if table is not None and word in table.spoken:
        return table.spoken[word]
    return (ABBREVIATIONS[word] * HOUR,) if word in ABBREVIATIONS else ()


_DATE = (
    r"(?P<iy>9{4})[-/](?P<im>9{1,2})[-/](?P<id>9{1,2})|(?P<cy>9{4})(?P<cm>99)(?P<cd>99)(?!9)|"
    r"(?P<n1>9{1,2})[-/.](?P<n2>9{1,2})[-/.](?P<ny>9{4}|99)(?!9)|"
    r"(?P<td>9{1,2})[ -](?:aa )?(?P<tm>a{3,})\.?,?[ -](?:aa )?(?P<ty>9{4})|(?P<um>a{3,})\.? (?P<ud>9{1,2}),? (?P<uy>9{4})"
)
_TIME = (
    r"(?P<hour>9{1,2})[:.](?P<minute>99)(?:[:.](?P<second>99)(?:[.,](?P<fraction>9+))?)?|"
    r"(?P<hour2>99)(?P<minute2>99)(?P<second2>99)"
)
_ZONE = (
    r"(?: ?(?P<sign>[-+])(?P<zh>99):?(?P<zm>99))? ?\[?(?P<zone>aa+[/_-][a_]+(?:[/-][a_]+)*)\]?|"
    r" ?(?P<sign2>[-+])(?P<zh2>99)(?::?(?P<zm2>99))?|"
    r" ?(?P<abbr>aaa+)(?:(?P<sign3>[-+])(?P<zh3>9{1,2}))?| ?(?P<letter>a)"
)
_MASK = re.compile(
    rf"(?P<epoch>9{{13}}|9{{10}})|(?:(?P<weekday>aa+)[,.]? )?(?:{_DATE})(?:(?:,? |(?P<t>a))(?:{_TIME})(?: ?(?P<half>a\.? ?a\.?)(?!a))?(?:{_ZONE})?)?"
)


def _mask_table() -> dict[int, str]:
    letters = {ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyzñáéíóúü"}
    return letters | {ord(c): "9" for c in "0123456789"}


_TO_MASK = _mask_table()


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Where a mask has which field; None if it is no timestamp. Made once for each mask."""
    m = _MASK.fullmatch(mask)
    return {k: m.span(k) for k, v in m.groupdict().items() if v is not None} if m else None


def _digits(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    value = np.zeros(len(codes), np.int64)
    for i in range(*span):
        value = value * 10 + (codes[:, i].astype(np.int64) - 48)
    return value


def _words(codes: np.ndarray, span: tuple[int, int], meaning) -> list:
    """Meaning of the letters of a field, looked up once for each distinct word."""
    part = np.ascontiguousarray(codes[:, span[0] : span[1]])
    words, where = np.unique(part.view(f"U{span[1] - span[0]}").ravel(), return_inverse=True)
    return np.array([meaning(str(w)) for w in words], dtype=object)[where.ravel()]


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether there is such a date."""
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (year >= 1)
    months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + day - 1, ok & (first + day - 1 < after)


def _to_number(values: list) -> tuple[np.ndarray, np.ndarray]:
    known = np.array([v is not None for v in values], bool)
    return np.array([v if v is not None else 0 for v in values], np.int64), known


def _parse_group(texts: list[str], fields: dict, zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds UTC of texts of one mask, and which of them are timestamps."""
    n, width = len(texts), len(texts[0])
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(n, width)
    num = lambda k: _digits(codes, fields[k])
    if "epoch" in fields:
        value = num("epoch")
        wide = fields["epoch"][1] - fields["epoch"][0] == 13
        return value * (1_000 if wide else 1_000_000), np.ones(n, bool)
    ok = np.ones(n, bool)
    if "iy" in fields or "cy" in fields:
        k = "i" if "iy" in fields else "c"
        year, month, day = num(k + "y"), num(k + "m"), num(k + "d")
    elif "ny" in fields:
        one, two, year = num("n1"), num("n2"), num("ny")
        month_first = orders == "MDA"
        ok &= month_first | (orders == "DMA")
        day, month = np.where(month_first, two, one), np.where(month_first, one, two)
        if fields["ny"][1] - fields["ny"][0] == 2:
            year = year + np.where(year < 70, 2000, 1900)
    else:
        k = "t" if "ty" in fields else "u"
        month, known = _to_number(_words(codes, fields[k + "m"], lambda w: MONTHS.get(w[:3])))
        ok &= known
        year, day = num(k + "y"), num(k + "d")
    days, real = _days(year, month, day)
    ok &= real
    second, micros = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if "hour" in fields or "hour2" in fields:
        end = "2" if "hour2" in fields else ""
        hour, minute = num("hour" + end), num("minute" + end)
        if "second" + end in fields:
            second = num("second" + end)
        if "fraction" in fields:
            a, b = fields["fraction"]
            micros = _digits(codes, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
        if "half" in fields:
            half, known = _to_number(_words(codes, fields["half"], lambda w: {"am": 0, "pm": 12}.get(re.sub("[. ]", "", w))))
            ok &= known & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + half
        ok &= (hour <= 24) & (minute < 60) & (second <= 60) & ((hour < 24) | ((minute == 0) & (second == 0)))
        second = hour * HOUR + minute * 60 + second
    if "t" in fields:
        ok &= np.array([w == "t" for w in _words(codes, fields["t"], str)], bool)
    local = days * 86400 + second

    offset, fixed = np.zeros(n, np.int64), np.zeros(n, bool)
    named = zones.copy()
    for end in ("", "2", "3"):
        if "sign" + end in fields:
            minutes = num("zm" + end) if "zm" + end in fields else 0
            sign = np.array([-1 if w == "-" else 1 for w in _words(codes, fields["sign" + end], str)])
            offset, fixed = sign * (num("zh" + end) * HOUR + minutes * 60), np.ones(n, bool)
    if "abbr" in fields:
        words = _words(codes, fields["abbr"], str)
        meant = [abbreviation(z, w) for z, w in zip(zones, words)]
        known = np.array([bool(x) for x in meant], bool)
        ok &= known
        if "sign3" not in fields:
            offset, fixed = np.array([x[-1] if x else 0 for x in meant], np.int64), known
            for i in (i for i, x in enumerate(meant) if len(x) > 1):  # the one that holds then, else the latest
                seconds, word = zone_table(_zone_name(zones[i])).at(int(local[i]))
                offset[i] = seconds if word == words[i] else offset[i]
    if "letter" in fields:
        letter = _words(codes, fields["letter"], str)
        ok &= (letter == "z") | (letter == "h")
        fixed = letter == "z"
    if "zone" in fields and not fixed.any():
        named = _words(codes, fields["zone"], str)
    utc = np.where(fixed, local - offset, local)
    for zone in {z for z, f in zip(named, fixed) if not f}:
        here = ~fixed & np.array([z == zone for z in named], bool)
        table = zone_table(_zone_name(zone)) if zone else None
        if table is None:
            ok &= ~here
        else:
            utc[here] = table.to_utc(local[here])
    return utc * 1_000_000 + micros, ok


@lru_cache(maxsize=4096)
def _zone_name(zone: str) -> str:
    """A zone's name in its own case, from any."""
    return _zone_names().get(zone.lower(), zone)


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    return {z.lower(): z for z in zoneinfo.available_timezones()}


def parse_instants(texts: Iterable, zones: Iterable, orders: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds UTC and their validity, for texts with the zone and the order of figures
    (DMA or MDA) of their source."""
    plain = [None if t is None else " ".join(t.lower().split()) for t in texts]
    zone, order = np.array(list(zones), dtype=object), np.array(list(orders), dtype=object)
    by_mask: dict[str, list[int]] = {}
    for i, t in enumerate(plain):
        if t:
            by_mask.setdefault(t.translate(_TO_MASK), []).append(i)
    out, valid = np.zeros(len(plain), np.int64), np.zeros(len(plain), bool)
    for mask, rows in by_mask.items():
        fields = (parser_of if len(mask) <= 80 else parser_of.__wrapped__)(mask)  # long masks aren't kept
        if fields is not None:
            at = np.array(rows)
            out[at], valid[at] = _parse_group([plain[i] for i in rows], fields, zone[at], order[at])
    return out, valid


def instant_micros(version: str):
    """Column function (text, zone, order) -> microseconds UTC. Fails where a worker has another
    version of the zone database than the driver."""

    @F.pandas_udf(T.LongType())
    def parse(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
        if zone_version() != version:
            raise RuntimeError(f"zone database {zone_version()} here, {version} at the driver")
        clean = lambda s: [None if x is None or x != x else x for x in s]
        value, valid = parse_instants(clean(text), clean(zone), clean(order))
        return pd.Series(pd.array(value, dtype="Int64")).mask(~valid)

    return parse


def normal_instants(
    df: DataFrame, sources: DataFrame, fields: list[str], on: str = "portal", suffix: str = "_us"
) -> DataFrame:
    """Adds ``<field>_us``: microseconds since 1970 UTC of each text field, null where it states no
    real calendar date.

    ``sources`` (``portal, zona_horaria, orden_fecha``) gives the zone for texts without one and
    the order of dates in figures; a row of unknown or null source gets instants only from texts
    that need neither. Blank texts give null. Row number, ties and other columns
    stay as they are.
    """
    parse = instant_micros(zone_version())
    side = sources.select(
        F.col(on).alias("__source"), F.col("zona_horaria").alias("__zone"), F.col("orden_fecha").alias("__order")
    ).dropDuplicates(["__source"])
    joined = df.join(side, df[on] == side["__source"], "left")
    values = {f"{f}{suffix}": parse(F.col(f), F.col("__zone"), F.col("__order")) for f in fields}
    return joined.select(*[df[c] for c in df.columns], *[v.alias(k) for k, v in values.items()])


def stated_instants(listings: DataFrame, portals: DataFrame, fields: list[str]) -> DataFrame:
    """``anuncio_id, campo, segundos_utc``: a row for each field that states a date. A listing
    delivered twice counts once; its rows are reduced before anything is parsed."""
    once = listings.select("anuncio_id", "portal", *fields).dropDuplicates(["anuncio_id"])
    parsed = normal_instants(once, portals, fields)
    pairs = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f"{f}_us").alias("us")) for f in fields])
    return (
        parsed.select("anuncio_id", F.explode(pairs).alias("p"))
        .where("p.us is not null")
        .select("anuncio_id", "p.campo", F.floor(F.col("p.us") / 1_000_000).cast("bigint").alias("segundos_utc"))
    )
