"""Problem 3: bring dates and times written in many ways to one date or one UTC instant.

Every value gets the array of all its valid interpretations (format and local date) in one Arrow pass. Where there are several, a Viterbi path over the records of each source in their order
chooses, with penalties for a switch of format, a jump back in time and a reading against the policy.
With the policy day_first, numbers that do not begin with the year are read day first unless that is
impossible, and two digits of a year are of this century, whatever the neighbours say: the reading is chosen
within the row, and there is no path. With `learn` these are only preferences, and the path decides.

The chains are cut into ranges of (source, order). A range is summarised by the least costs between the
readings of its first and last record; the summaries of chains that cross ranges, at most two a range, are
joined on the driver, and each range is then decoded on its own. No source is gathered in one task.

Null, blank and unreadable values come out with null date and instant; ties keep the earlier reading.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
import unicodedata
import zoneinfo
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut

# First three letters of month names, without accents (English, Spanish, German, French).
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "mar": 3, "mae": 3, "apr": 4, "abr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "ago": 8,
    "aou": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dic": 12, "dez": 12,
}

# Abbreviations of zones as used in Europe and the United States.
ABBREVIATIONS = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "ut": "+00:00", "wet": "+00:00", "west": "+01:00", "bst": "+01:00", "ist": "+01:00", "cet": "+01:00", "mez": "+01:00",
    "cest": "+02:00", "mesz": "+02:00", "eet": "+02:00", "eest": "+03:00", "msk": "+03:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00",
    "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "akst": "-09:00", "akdt": "-08:00", "hst": "-10:00",
}

#: Numbers of the formats; a greater number is no better.
ISO, COMPACT, DAY_FIRST, MONTH_FIRST, DAY_NAME, NAME_DAY, EITHER = range(1, 8)
#: Added to a format's number where two digits of a year are read as one of the last century.
LAST_CENTURY = 10
AGAINST_POLICY, SWITCH, BACKWARD, OLD = 1e6, 1.0, 2.0, 0.5
BACKWARD_DAYS = 45
#: Rows of one range, which one task decodes in memory.
RANGE_ROWS = 500_000

_TIME = re.compile(r"^(.*?)(?:[Tt]|,?\s+(?:at |um |a las )?|,)(\d{1,2})\s?[:hH](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\b\.?)?\s*(.*)$")
_COMPACT_TIME = re.compile(r"^(\d{8})[Tt ](\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?()\s*((?:[A-Za-z+\-\[(].*)?)$")
_OFFSET = re.compile(r"^(?:UTC|GMT)?\s?([+\-\u2212])(\d{1,2})(?::?(\d{2}))?(?:\s*[(\[].*)?$", re.I)
_NAMED = re.compile(r"^[\[(]?\s*([A-Za-z]+(?:/[A-Za-z_+\-]+)+)\s*[\])]?$")
_WEEKDAY = re.compile(r"^[^\W\d_]{2,10}\.?, ?(?=\d)")
_ISO = re.compile(r"^(\d{4})([-/. ])(\d{1,2})\2(\d{1,2})$")
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})$")
_NUMBERS = re.compile(r"^(\d{1,2})([-/. ])\s?(\d{1,2})\2\s?(\d{4}|\d{2})$")
_DAY_NAME = re.compile(r"^(\d{1,2})(?:st|nd|rd|th|\.|º|er)?[ -]?(?:of |de )?[ -]?([^\W\d_]{3,12})\.?,?[ -](?:de |del |of )?(\d{4}|\d{2})$", re.I)
_NAME_DAY = re.compile(r"^([^\W\d_]{3,12})\.?[ -](\d{1,2})(?:st|nd|rd|th)?,?[ -](\d{4}|\d{2})$", re.I)
_NO_ZONE = frozenset(["", "h", "hrs", "uhr", "hours", "h."])
_EPOCH = dt.date(1970, 1, 1)


@functools.cache
def _zones() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


@functools.cache
def _zone(name: str) -> str | None:
    """A zone's name as Spark knows it, or None."""
    name = name.strip()
    if "/" in name and name in _zones():
        return name
    return ABBREVIATIONS.get(name.lower().strip("[]().").replace(".", ""))


def _days(form: int, y: str, m: int, d: int) -> Iterator[tuple[int, int]]:
    """(format, days since 1970-01-01) of each year the text may mean; none for no date. Two digits may mean two centuries."""
    for year, of in [(int(y), form)] if len(y) > 2 else [(2000 + int(y), form), (1900 + int(y), form + LAST_CENTURY)]:
        try:
            yield of, (dt.date(year, m, d) - _EPOCH).days
        except ValueError:
            pass


def _month(name: str) -> int:
    bare = "".join(c for c in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(c))
    return MONTHS.get(bare[:3], 0)


@functools.lru_cache(maxsize=65536)
def interpretations(text: str) -> list[tuple[int, int]]:
    """(format, day) of every valid reading of a date text, in order of format."""
    text = _WEEKDAY.sub("", text.strip())
    found: list[tuple[int, int]] = []
    if m := _ISO.match(text):
        found += _days(ISO, m[1], int(m[3]), int(m[4]))
    elif m := _COMPACT.match(text):
        found += _days(COMPACT, m[1], int(m[2]), int(m[3]))
    elif m := _NUMBERS.match(text):
        a, b = int(m[1]), int(m[3])
        if a == b:
            found += _days(EITHER, m[4], a, b)
        else:
            found += [*_days(DAY_FIRST, m[4], b, a), *_days(MONTH_FIRST, m[4], a, b)]
    elif m := _DAY_NAME.match(text):
        found += _days(DAY_NAME, m[3], _month(m[2]), int(m[1]))
    elif m := _NAME_DAY.match(text):
        found += _days(NAME_DAY, m[3], _month(m[1]), int(m[2]))
    return sorted(found)


def read_value(value: str | None, office: str | None = None) -> tuple[list[tuple[int, int]], str | None, str | None, int | None]:
    """(readings, time of day, zone, epoch milliseconds) of one value.

    The zone is the one in the value, else the office's, else UTC. A time no clock shows, or with a tail
    that is no zone, leaves no reading.
    """
    text = " ".join((value or "").split())
    if not text:
        return [], None, None, None
    if text.isascii() and text.isdigit() and len(text) in (10, 13):
        return [], None, None, int(text) * (1000 if len(text) == 10 else 1)
    m = _COMPACT_TIME.match(text) or _TIME.match(text)
    if not m:
        return interpretations(text), None, None, None
    date, h, minute, second, fraction, half, tail = m.groups()
    hour = int(h)
    if half:
        if not 1 <= hour <= 12:
            return [], None, None, None
        hour = hour % 12 + (12 if half[0] in "pP" else 0)
    if hour > 23 or int(minute) > 59 or int(second or 0) > 59:
        return [], None, None, None
    if (tail or "").strip().lower() in _NO_ZONE:
        zone = (_zone(office) if office else None) or "UTC"
    elif (o := _OFFSET.match(tail)) and int(o[2]) <= 14 and int(o[3] or 0) < 60:
        zone = f"{'+' if o[1] == '+' else '-'}{int(o[2]):02d}:{o[3] or '00'}"
    else:
        n = _NAMED.match(tail)
        zone = _zone(n[1]) if n else _zone(tail)
        if zone is None:
            return [], None, None, None
    return interpretations(date.rstrip(" ,")), f"{hour:02d}:{minute}:{second or '00'}.{(fraction or '0')[:6].ljust(6, '0')}", zone, None


def parse_values(df: DataFrame, value_col: str, zone_col: str | None = None) -> DataFrame:
    """df with formats and days (all valid readings), time_of_day, zone and epoch_ms; other columns untouched."""
    added = [("formats", pa.list_(pa.int32())), ("days", pa.list_(pa.int32())), ("time_of_day", pa.string()), ("zone", pa.string()), ("epoch_ms", pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(value_col).to_pylist()
            offices = batch.column(zone_col).to_pylist() if zone_col else [None] * len(values)
            read = [read_value(v, z) for v, z in zip(values, offices)]
            new = [[[f for f, _ in r[0]] for r in read], [[d for _, d in r[0]] for r in read], [r[1] for r in read], [r[2] for r in read], [r[3] for r in read]]
            for (name, kind), column in zip(added, new):
                batch = batch.append_column(name, pa.array(column, kind))
            yield batch

    schema = T.StructType([*df.schema.fields])
    for name, kind in zip([a for a, _ in added], (T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.StringType(), T.StringType(), T.LongType())):
        schema = schema.add(name, kind)
    return df.mapInArrow(work, schema)


Readings = list[tuple[int, int]]


def _costs(readings: Readings, policy: str) -> list[float]:
    """Cost of each reading by itself: readings against the policy cost more than any neighbours could."""
    if len(readings) == 1:
        return [0.0]
    wrong = MONTH_FIRST if policy == "day_first" else DAY_FIRST if policy == "month_first" else -1
    old = OLD if wrong < 0 else AGAINST_POLICY
    return [AGAINST_POLICY * (f % LAST_CENTURY == wrong) + old * (f > LAST_CENTURY) + 1e-3 * i for i, (f, _) in enumerate(readings)]


def _step(before: tuple[int, int], after: tuple[int, int]) -> float:
    a, b = before[0] % LAST_CENTURY, after[0] % LAST_CENTURY
    # 04/04 is written alike either way
    alike = a == b or EITHER in (a, b) and {a, b} <= {DAY_FIRST, MONTH_FIRST, EITHER}
    return SWITCH * (not alike) + BACKWARD * (after[1] < before[1] - BACKWARD_DAYS)


def _advance(cost: list[float], before: Readings, after: Readings, policy: str) -> tuple[list[float], list[int]]:
    """Least cost of each reading of the next record, and the reading before it comes from."""
    if len(before) == len(after) == 1:
        return [cost[0] + _step(before[0], after[0])], [0]
    out, came = [], []
    for own, b in zip(_costs(after, policy), after):
        least, at = min((c + _step(a, b), i) for i, (c, a) in enumerate(zip(cost, before)))
        out.append(least + own)
        came.append(at)
    return out, came


def _transfer(chain: list[Readings], policy: str, start: list[list[float]] | None = None) -> list[list[float]]:
    """Least costs from each reading of the first record to each of the last, without the first one's own cost."""
    n = len(chain[0])
    rows = start or [[0.0 if i == j else float("inf") for j in range(n)] for i in range(n)]
    for before, after in zip(chain, chain[1:]):
        rows = [_advance(row, before, after, policy)[0] for row in rows]
    return rows


def viterbi(chain: list[Readings], policy: str, first: int | None = None, last: int | None = None) -> list[int]:
    """Number of the chosen reading of each record; first and last fix those of the ends."""
    if not chain:
        return []
    cost, back = _costs(chain[0], policy), []
    if first is not None:
        cost = [c if i == first else float("inf") for i, c in enumerate(cost)]
    for before, after in zip(chain, chain[1:]):
        cost, came = _advance(cost, before, after, policy)
        back.append(came)
    at = min(range(len(cost)), key=cost.__getitem__) if last is None else last
    out = [at]
    for came in reversed(back):
        at = came[at]
        out.append(at)
    return out[::-1]


def _chains(sources: list, formats: list, days: list) -> Iterator[tuple[object, list[Readings], list[int]]]:
    """(source, its chain of readings, the rows they stand in), one source after the other."""
    chain: list[Readings] = []
    at: list[int] = []
    for i, s in enumerate(sources):
        if i and s != sources[i - 1]:
            yield sources[i - 1], chain, at
            chain, at = [], []
        if formats[i]:
            chain.append(list(zip(formats[i], days[i])))
            at.append(i)
    if len(sources):
        yield sources[-1], chain, at


#: Policies that decide every value by itself, and the format each reads only where no other is possible.
RULES = {"day_first": MONTH_FIRST, "month_first": DAY_FIRST}


def readings_by_rule(parsed: DataFrame, policy: str = "day_first") -> DataFrame:
    """parsed with the column reading: the number of the reading least against the policy, null where there is none.

    It is the one the path would choose, since a reading against the policy costs more than any neighbours can give.
    """
    against = F.transform("formats", lambda f: (f % LAST_CENTURY == RULES[policy]).cast("int") + (f > LAST_CENTURY).cast("int"))
    return parsed.withColumn("reading", (F.array_position(against, F.array_min(against)) - 1).cast("int"))


def choose_readings(parsed: DataFrame, source_col: str, order_cols: list[str], policy: str = "day_first") -> DataFrame:
    """parsed with the column reading: the number of the chosen reading, null where there is none.

    Records without a reading take no part in the chains. Null sources form a source of their own. A policy that
    decides every value by itself needs neither sources nor order.
    """
    if policy in RULES:
        return readings_by_rule(parsed, policy)
    spark = parsed.sparkSession
    # written before the ranges are sampled, so that nothing is parsed twice; ranges are as many as their rows ask for
    parsed = cut(parsed)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parsed.count() // RANGE_ROWS))
    ranged = parsed.repartitionByRange(ranges, source_col, *order_cols).sortWithinPartitions(source_col, *order_cols).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # (source, first readings, last readings, costs between them)
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("__part")[0].as_py()
            for source, chain, _ in _chains(*(batch.column(c).to_pylist() for c in ("s", "formats", "days"))):
                if not chain:
                    continue
                if last is not None and last[0] == source:
                    last = (source, last[1], chain[-1], _transfer([last[2], *chain], policy, last[3]))
                    if first[0] == source:
                        first = last
                else:
                    last = (source, chain[0], chain[-1], _transfer(chain, policy))
                    first = first or last
        ends = [] if first is None else [first] if first[0] == last[0] else [first, last]
        rows = [
            {"part": part, "i": i, "s": s, "af": [f for f, _ in a], "ad": [d for _, d in a], "bf": [f for f, _ in b], "bd": [d for _, d in b], "m": [x for row in m for x in row]}
            for i, (s, a, b, m) in enumerate(ends)
        ]
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("i", pa.int32()), ("s", pa.string()), ("af", ints), ("ad", ints), ("bf", ints), ("bd", ints), ("m", pa.list_(pa.float64()))]))

    summary = "part int, i int, s string, af array<int>, ad array<int>, bf array<int>, bd array<int>, m array<double>"
    narrow = ranged.select(F.col(source_col).cast("string").alias("s"), "formats", "days", "__part")
    ends = sorted(narrow.mapInArrow(summarise, summary).collect(), key=lambda r: (r["part"], r["i"]))
    fixed: dict[tuple[int, str], tuple[int, int]] = {}
    at = 0
    while at < len(ends):
        stop = at
        while stop + 1 < len(ends) and ends[stop + 1]["s"] == ends[at]["s"]:
            stop += 1
        if stop > at:
            fixed |= _join_ranges([ends[k] for k in range(at, stop + 1)], policy)
        at = stop + 1
    held = spark.sparkContext.broadcast(fixed)

    def whole_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows regrouped so that the part of a source within this range is whole."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sources = batch.column("__s").to_pylist()
            begin = len(sources)
            while begin and sources[begin - 1] == sources[-1]:
                begin -= 1
            if rest and (begin or rest[-1].column("__s")[0].as_py() != sources[0]):
                head = 0
                while head < begin and sources[head] == rest[-1].column("__s")[0].as_py():
                    head += 1
                yield pa.Table.from_batches([*rest, batch.slice(0, head)])
                batch, begin, rest = batch.slice(head), begin - head, []
            if begin > 0:
                yield pa.Table.from_batches([batch.slice(0, begin)])
            rest.append(batch.slice(max(begin, 0)))
        if rest:
            yield pa.Table.from_batches(rest)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_sources(batches):
            if not rows.num_rows:
                continue
            picks: list[int | None] = [None] * rows.num_rows
            part = rows.column("__part")[0].as_py()
            for source, chain, at in _chains(*(rows.column(c).to_pylist() for c in ("__s", "formats", "days"))):
                first, last = held.value.get((part, source), (None, None))
                for i, pick in zip(at, viterbi(chain, policy, first, last)):
                    picks[i] = pick
            yield from rows.drop_columns(["__part", "__s"]).append_column("reading", pa.array(picks, pa.int32())).to_batches(max_chunksize=10_000)

    schema = T.StructType([*parsed.schema.fields]).add("reading", T.IntegerType())
    return ranged.withColumn("__s", F.col(source_col).cast("string")).mapInArrow(decode, schema)


def _join_ranges(ends: list, policy: str) -> dict[tuple[int, str], tuple[int, int]]:
    """For the ranges one chain crosses: (first, last) reading of each, by Viterbi over the ranges."""
    cost: list[float] = []
    back = []
    for k, r in enumerate(ends):
        first, last = list(zip(r["af"], r["ad"])), list(zip(r["bf"], r["bd"]))
        if k:
            entry, came = _advance(cost, list(zip(ends[k - 1]["bf"], ends[k - 1]["bd"])), first, policy)
        else:
            entry, came = _costs(first, policy), [0] * len(first)
        through = [min((entry[a] + r["m"][a * len(last) + b], a) for a in range(len(first))) for b in range(len(last))]
        back.append(([a for _, a in through], came))
        cost = [c for c, _ in through]
    out, at = {}, min(range(len(cost)), key=cost.__getitem__)
    for r, (entered, came) in zip(reversed(ends), reversed(back)):
        first = entered[at]
        out[r["part"], r["s"]] = (first, at)
        at = came[first]
    return out


def normalise(chosen: DataFrame) -> DataFrame:
    """chosen with written_date, utc_instant (timestamp_ntz, UTC; null for dates without a time) and kind.

    A local time that occurs twice is the first; one that is skipped moves on by the gap.
    """
    day = F.when(F.col("reading").isNotNull(), F.date_from_unix_date(F.get("days", F.col("reading"))))
    local = F.concat(day.cast("string"), F.lit(" "), F.col("time_of_day")).try_cast("timestamp_ntz")
    utc = F.when(local.isNotNull(), F.convert_timezone(F.col("zone"), F.lit("UTC"), local))
    epoch = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(epoch_ms as decimal(20, 3)) / 1000)")
    return chosen.withColumns({"written_date": day, "utc_instant": F.coalesce(utc, F.when(F.col("epoch_ms").isNotNull(), epoch))}).withColumn(
        "kind", F.when(F.col("utc_instant").isNotNull(), "instant").when(F.col("written_date").isNotNull(), "date").otherwise("unreadable")
    )


def normalise_timestamps(df: DataFrame, value_col: str, source_col: str, order_cols: list[str], zone_col: str | None = None, policy: str = "day_first") -> DataFrame:
    """df with written_date, utc_instant and kind ('date', 'instant' or 'unreadable') for each value."""
    return normalise(choose_readings(parse_values(df, value_col, zone_col), source_col, order_cols, policy))


def normalise_by_rule(df: DataFrame, value_col: str, zone_col: str | None = None, policy: str = "day_first") -> DataFrame:
    """As normalise_timestamps under a policy that decides every value by itself."""
    return normalise(readings_by_rule(parse_values(df, value_col, zone_col), policy))
