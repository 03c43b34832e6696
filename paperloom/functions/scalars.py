"""Scalar functions: text, dates, amounts, identifiers and masking, as JVM column expressions.

All of them return null for null. Patterns stay literals, so the JVM compiles each once a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.dims import CURRENCY_CODES, CURRENCY_SIGNS, DATE_FIELDS, INTEGER_FIELDS, CONTAINMENT_FIELDS, MONTH_NAMES, NIT_WEIGHTS, NUMERIC_FIELDS, PII, PII_ORDER

SPACES = r"(?U)\s+"
TRIMMED = " .,:;-_\"'()"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column) -> Column:
    """Lower case, one space between words, without punctuation at the ends."""
    return F.btrim(F.lower(collapse(text)), F.lit(TRIMMED))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return bind(F.regexp_extract(text, pattern, n), lambda found: F.when(found != "", found))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd, or null where the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (F.lpad(year, 4, "0") != "0000"), text.try_cast("date").cast("string"))


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for number, names in enumerate(MONTH_NAMES, 1) for name in names for x in (name, number)])
    return F.try_element_at(table, F.lower(name))


def normalize_date(value: Column, day_first: bool = True) -> Column:
    """The first date in a text as yyyy-mm-dd.

    Tried in turn: yyyy-mm-dd, d/m/yyyy (the parts change places where the month can't be one), Month d,
    yyyy and d Month yyyy. One of the first two forms that is no date gives null at once; an unknown month
    name goes on to the next form.
    """
    # Patterns of the four forms.
    iso = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"
    numbers = r"(?U)\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
    month_day = r"(?U)\b([A-Za-z]{3,10})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
    day_month = r"(?U)\b(\d{1,2})\s+(?:de\s+)?([A-Za-z]{3,10})\.?,?\s+(?:de\s+)?(\d{4})\b"
    a, b = group(value, numbers, 1).cast("int"), group(value, numbers, 2).cast("int")
    day, month = (a, b) if day_first else (b, a)
    swap = (month > 12) & (day <= 12)
    return (
        F.when(value.rlike(iso), iso_date(group(value, iso, 1), group(value, iso, 2), group(value, iso, 3)))
        .when(value.rlike(numbers), iso_date(group(value, numbers, 3), F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)))
        .when(month_number(group(value, month_day, 1)).isNotNull(), iso_date(group(value, month_day, 3), month_number(group(value, month_day, 1)), group(value, month_day, 2)))
        .otherwise(iso_date(group(value, day_month, 3), month_number(group(value, day_month, 2)), group(value, day_month, 1)))
    )


# Patterns of amounts.
AMOUNT = r"(?U)(-?)\s*\$?\s*(-?)(\d{1,3}(?:[.,]\d{3})*|\d+)(?:[.,](\d{1,2}))?"
#: The same, but a plain run of digits is read whole.
AMOUNT_WHOLE = r"(?U)(-?)\s*\$?\s*(-?)(\d{1,3}(?:[.,]\d{3})+(?!\d)|\d+)(?:[.,](\d{1,2})(?!\d))?"


def normalize_amount(value: Column, compat: bool = True) -> Column:
    """The first amount in a text as a double, written 1,234.56 or 1.234,56.

    With compat, of a run of more than three digits without separators only the first three are read, as
    the established results have it; without, the whole run.
    """
    pattern = AMOUNT if compat else AMOUNT_WHOLE
    text = F.replace(value, F.lit("\u00a0"), F.lit(" "))
    whole = F.regexp_replace(group(text, pattern, 3), "[.,]", "")
    part = F.rpad(F.coalesce(group(text, pattern, 4), F.lit("0")), 2, "0")
    number = F.concat(whole, F.lit("."), part).try_cast("double")
    minus = F.regexp_extract(text, pattern, 1).isin("-") | F.regexp_extract(text, pattern, 2).isin("-")
    return F.when(minus, -number).otherwise(number)


def currency_in_text(text: Column) -> Column:
    """The first currency code in the text, else that of the first sign (in the order $, €, £) in it."""
    out = F.when(F.lit(False), "")
    for sign, code in CURRENCY_SIGNS.items():
        out = out.when(text.contains(sign), code)
    return F.coalesce(group(text, rf"(?U)\b({'|'.join(CURRENCY_CODES)})\b"), out)


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: c.cast("int"))


def nit_check_digit(base: Column) -> Column:
    """Check digit of a NIT's base (digits only, at most 15)."""
    weights = F.array(*[F.lit(w) for w in NIT_WEIGHTS])
    terms = F.zip_with(F.reverse(_digits(base)), weights, lambda d, w: F.coalesce(d, F.lit(0)) * w)
    rest = F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 11
    return F.when(base.rlike(r"^\d{1,15}$"), F.when(rest < 2, rest).otherwise(11 - rest))


# Fixed value: a NIT without dots and spaces.
NIT = r"^(\d{6,10})[-\s]?(\d)$"


def looks_like_nit(value: Column) -> Column:
    return F.regexp_replace(value, "[. ]", "").rlike(NIT)


def is_valid_nit(value: Column) -> Column:
    bare = F.regexp_replace(value, "[. ]", "")
    return looks_like_nit(value) & (nit_check_digit(group(bare, NIT, 1)) == group(bare, NIT, 2).cast("int"))


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for the empty string."""
    doubled = F.transform(F.reverse(_digits(digits)), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.coalesce(digits.rlike(r"^\d+$") & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0), F.lit(False))


_OPEN, _CLOSE = "\ue000", "\ue001"


def _mask_where(text: Column, pattern: str, kind: str, keep) -> tuple[Column, Column]:
    """(masked text, number masked): matches for which keep(digits) holds, by sentinels around each match."""
    marked = F.regexp_replace(F.regexp_replace(text, f"[{_OPEN}{_CLOSE}]", ""), f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    parts = F.split(marked, f"[{_OPEN}{_CLOSE}]")
    hit = lambda p, i: (i % 2 == 1) & keep(F.regexp_replace(p, r"\D", ""))
    masked = F.array_join(F.transform(parts, lambda p, i: F.when(hit(p, i), F.lit(f"[REDACTED:{kind}]")).otherwise(p)), "")
    count = F.size(F.filter(parts, hit))
    return masked, count


def mask_step(text: Column, kind: str) -> tuple[Column, Column]:
    """(text with one kind of personal data masked, number of masks)."""
    pattern = "(?U)" + PII[kind] if kind != "email" else PII[kind]
    if kind == "credit_card":
        return _mask_where(text, pattern, kind, lambda d: F.length(d).between(13, 16) & luhn_ok(d))
    if kind == "phone":
        return _mask_where(text, pattern, kind, lambda d: F.length(d).between(9, 13))
    return F.regexp_replace(text, pattern, f"[REDACTED:{kind}]"), F.regexp_count(text, F.lit(pattern))


def mask_pii(df, text_col: str, out_col: str):
    """df with out_col (masked text) and a column n_<kind> for each kind; one projection a kind, no UDF."""
    current = F.col(text_col)
    for kind in PII_ORDER:
        masked, count = mask_step(current, kind)
        df = df.withColumns({f"n_{kind}": F.coalesce(count, F.lit(0)), f"__{kind}": masked})
        current = F.col(f"__{kind}")
    return df.withColumn(out_col, current).drop(*[f"__{k}" for k in PII_ORDER])


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer as text: without a code fence, from the first { to the last }; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^```(?:json|JSON)?\s*", ""), r"\s*```$", ""))
    inner = F.when(bare.startswith("{"), bare).otherwise(group(bare, r"(?s)(\{.*\})"))
    return F.when(F.schema_of_variant(F.try_parse_json(inner)).startswith("OBJECT"), inner)


def trace_id(key: Column | None = None) -> Column:
    """32 hexadecimal characters: always the same for a key, or a new one for each row without."""
    return F.replace(F.uuid(), F.lit("-"), F.lit("")) if key is None else F.md5(key.cast("string"))


def today_iso() -> Column:
    return F.current_date().cast("string")


def cost_usd(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """What tokens cost at prices a million, which the caller states; rounded to six digits."""
    millionths = input_tokens.cast("decimal(18,0)") * F.lit(str(input_price)).cast("decimal(12,6)") + output_tokens.cast("decimal(18,0)") * F.lit(str(output_price)).cast("decimal(12,6)")
    return F.round(millionths / 1_000_000, 6).cast("double")


def split_list(text: Column) -> Column:
    """The parts of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.btrim(p)), lambda p: p != "")


def values_match(name: Column, predicted: Column, truth: Column) -> Column:
    """Whether two values of a field agree, by its kind; null and empty values never do."""
    p, t = predicted, truth
    numeric = F.abs(F.coalesce(p.try_cast("double"), normalize_amount(p)) - F.coalesce(t.try_cast("double"), normalize_amount(t))) < 0.01
    integer = p.try_cast("double").cast("bigint") == t.try_cast("double").cast("bigint")
    a, b = normalize_text(p), normalize_text(t)
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    same = (a == b) | (name.isin(*CONTAINMENT_FIELDS) & (F.length(shorter) >= 4) & F.contains(longer, shorter))
    dates = F.coalesce(normalize_date(p) == normalize_date(t), F.lit(False))
    kind = F.when(name.isin(*NUMERIC_FIELDS), numeric).when(name.isin(*INTEGER_FIELDS), integer).when(name.isin(*DATE_FIELDS), dates).otherwise(same)
    filled = p.isNotNull() & t.isNotNull() & (p != "") & (t != "")
    return F.coalesce(filled & kind, F.lit(False))
