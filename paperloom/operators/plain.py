"""Documents of plain (ASCII) text, classified, read, checked and scored within their row, in one pass over Arrow batches.

The rules are those of classify, layout, extract, validate and score, and their tables and patterns are the same;
only what a document's score depends on is worked out, and a rule runs only where no label gave the field. Keys,
dates and lines that come again are looked up. What is not read here is left to the column expressions: texts
with other characters, contracts with carriage returns, unknown types, dates in rare forms and sums beyond all measure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from decimal import ROUND_HALF_UP, Decimal
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.dims import CURRENCY_CODES, CURRENCY_SIGNS, DATE_FIELDS, DOC_TYPES, ERROR_COST, FIELD_COST, FIELDS, KEYWORDS, MAX_HITS, MONTH_NAMES, NIT_WEIGHTS, NUMERIC_FIELDS, PAYMENT_METHODS, REQUIRED, WARN_COST
from paperloom.functions.scalars import AMOUNT, NIT, TRIMMED
from paperloom.operators import extract as E
from paperloom.operators import layout as L
from paperloom.operators.classify import needed_texts
from paperloom.operators.validate import GENERIC_TAX_ID, ISO_DATE

BLANK = "\t\n\x0b\x0c\r "
#: How many different lines, keys or dates are remembered at once.
REMEMBERED = 20_000


class NotRead(Exception):
    """A document that the column expressions must read."""


def compiled(pattern: str) -> re.Pattern:
    """A pattern of the JVM for ASCII texts (without carriage returns, where it has a dot or a dollar sign)."""
    for ours, theirs in (("(?U)", ""), ("(?iu)", "(?i)"), (r"[^\p{L}]", "[^A-Za-z]"), (r"\p{Lu}", "[A-Z]"), (r"\p{Ll}", "[a-z]")):
        pattern = pattern.replace(ours, theirs)
    return re.compile(pattern, re.ASCII)


def _group(text: str, pattern: re.Pattern, n: int = 1) -> str | None:
    found = pattern.search(text)
    return (found[n] or None) if found else None


@lru_cache(REMEMBERED)
def rounded(x: float, digits: int = 3) -> float:
    """Half up, by the decimal form of a number, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


# --- classification --------------------------------------------------------------------------------

# Fixed value: a keyword's pattern that is one text, or one of several, between word boundaries.
_TEXTS = re.compile(r"\\b(?:\(\?:)?([a-z0-9](?:[a-z0-9 |-]*[a-z0-9])?)\)?\\b")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _whole_texts(pattern: str) -> bool:
    """Whether counting each text of a pattern by itself counts its matches: no two of them share a word, so none overlap."""
    found = _TEXTS.fullmatch(pattern)
    words = [set(t.split(" ")) for t in found[1].split("|")] if found else []
    return bool(found) and sum(map(len, words)) == len(set().union(*words))


_PATTERNS = {t: [(tuple(needed_texts(p)), w, None if _whole_texts(p) else compiled(p)) for p, w in pairs] for t, pairs in KEYWORDS.items()}


def _count(low: str, words: tuple[str, ...], pattern: re.Pattern | None) -> int:
    """How often a keyword is found; one of words is there."""
    if pattern is not None:
        return min(len(pattern.findall(low)), MAX_HITS)
    n = 0
    for word in words:
        at, size = low.find(word), len(word)
        while at >= 0 and n < MAX_HITS:
            end = at + size
            whole = not (at and low[at - 1] in _LETTERS) and low[end : end + 1] not in _LETTERS
            n += whole
            at = low.find(word, end if whole else at + 1)
    return n


def type_of(text: str) -> str:
    """The type with the highest score by keywords, the first declared of several; a form where nothing is found."""
    low, best, chosen = text.lower(), 0.0, "form"
    for doc_type in DOC_TYPES:
        score = 0.0
        for words, weight, pattern in _PATTERNS[doc_type]:
            for t in words:
                if t in low:
                    score += _count(low, words, pattern) * weight
                    break
        if score and (score := rounded(score)) > best:
            best, chosen = score, doc_type
    return chosen


# --- layout ----------------------------------------------------------------------------------------

_HEAD = re.compile(rf"\s*(?:\d{{1,2}}[.)]\s+)?({L._KEY})\s*", re.ASCII)
_KEY_ALONE, _ITEM, _COLUMNS, _GAP, _TITLE, _SPACES = (compiled(p) for p in (L.KEY_ALONE, L.ITEM, L.COLUMNS, L.GAP, L.TITLE_CASE, r"\s+"))


@lru_cache(REMEMBERED)
def _key(head: str) -> str | None:
    """The key in what stands before a line's first colon."""
    found = _HEAD.fullmatch(head)
    return found[1].strip(" ") if found else None


def _pair(bare: str) -> tuple[str, str] | None:
    head, colon, rest = bare.partition(":")
    if not colon or (key := _key(head)) is None:
        return None
    value = rest.strip(BLANK)
    return (key, value) if value else None


def _cells(line: str) -> list[tuple[str, str]]:
    """Pairs of a line that holds several, as layout.split_pairs has them."""
    if ":" not in line:
        return []
    cells = [c for part in _GAP.split(line) if (c := part.strip(BLANK))]
    if len(cells) < 2:
        return []
    held, found = None, []
    for cell in cells:
        if full := _pair(cell):
            found.append(full)
        elif held is not None and ":" not in cell:
            found.append((held.strip(" "), cell.strip(" ")))
        held = None if full else _group(cell, _KEY_ALONE)
    return found if len(found) >= 2 or (found and _KEY_ALONE.search(cells[0])) else []


@lru_cache(REMEMBERED)
def _kind(bare: str) -> str:
    """The category of a line that is no pair."""
    words = sum(w != "" for w in _SPACES.split(bare))
    if _ITEM.search(bare):
        return "ListItem"
    if words >= 3 and _COLUMNS.search(bare):
        return "Table"
    title = (bare.upper() == bare and bare.lower() != bare) or (not bare.endswith(".") and _TITLE.search(bare))
    return "Title" if title and words <= 8 else "NarrativeText"


def elements(text: str) -> list[tuple[str, str | None, str | None]]:
    """(text, key, value) of each element in order; the last two are null for what is no pair."""
    out: list[tuple[str, str | None, str | None]] = []
    for line in text.splitlines():
        if ("  " in line or "\t" in line) and (several := _cells(line)):
            out.extend((f"{k}: {v}", k, v) for k, v in several)
        elif bare := line.strip(BLANK):
            pair = _pair(bare)
            out.append((bare, *pair) if pair and len(pair[1]) <= L.LONGEST_VALUE else (bare, None, None))
    return out


# --- values ----------------------------------------------------------------------------------------

_ISO = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b", re.ASCII)
_NUMBERS = re.compile(r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", re.ASCII)
_MONTH_DAY = re.compile(r"\b([A-Za-z]{3,10})\.?\s+(\d{1,2}),?\s+(\d{4})\b", re.ASCII)
_DAY_MONTH = re.compile(r"\b(\d{1,2})\s+(?:de\s+)?([A-Za-z]{3,10})\.?,?\s+(?:de\s+)?(\d{4})\b", re.ASCII)
_MONTHS = {name: number for number, names in enumerate(MONTH_NAMES, 1) for name in names}
_AMOUNT, _NIT, _TAX_ID, _TERM, _YEAR, _ID, _TOTAL, _PARTIES, _DOCUMENT = (compiled(p) for p in (AMOUNT, NIT, GENERIC_TAX_ID, E.TERM, E.YEAR, E.ID_LIKE, E.TOTAL, E.PARTIES, E.DOCUMENT_WORDS))
_ISO_ONLY = compiled(ISO_DATE)
_DIGIT, _THREE = re.compile(r"\d", re.ASCII), re.compile("^[A-Z]{3}$")
_CODE = re.compile(rf"\b({'|'.join(CURRENCY_CODES)})\b", re.ASCII)
_CONTRACT = {f: compiled(p) for f, p in E.CONTRACT_RULES.items()}
_METHODS = [(m, re.compile(rf"\b{m}\b", re.ASCII)) for m in PAYMENT_METHODS]


def _date(year: str, month: int, day: int) -> str | None:
    try:
        return date(int(year), month, day).isoformat()
    except ValueError:
        return None


@lru_cache(REMEMBERED)
def date_in(raw: str) -> str | None:
    """As scalars.normalize_date, day first."""
    if m := _ISO.search(raw):
        return _date(m[1], int(m[2]), int(m[3]))
    if m := _NUMBERS.search(raw):
        day, month = int(m[1]), int(m[2])
        return _date(m[3], day, month) if month > 12 and day <= 12 else _date(m[3], month, day)
    if (m := _MONTH_DAY.search(raw)) and (month := _MONTHS.get(m[1].lower())):
        return _date(m[3], month, int(m[2]))
    m = _DAY_MONTH.search(raw)
    month = _MONTHS.get(m[2].lower()) if m else None
    return _date(m[3], month, int(m[1])) if month else None


def amount_in(raw: str) -> float | None:
    """As scalars.normalize_amount."""
    m = _AMOUNT.search(raw)
    if not m:
        return None
    number = float(m[3].replace(",", "").replace(".", "") + "." + (m[4] or "0").ljust(2, "0"))
    return -number if m[1] or m[2] else number


def currency_in(text: str) -> str | None:
    return _group(text, _CODE) or next((code for sign, code in CURRENCY_SIGNS.items() if sign in text), None)


Value = tuple[str | None, float | None, float]


def coerced(field: str, raw: str) -> Value:
    """(text, number, penalty), as extract.coerce has them."""
    either = lambda good, bad, p: (bad, None, p) if good is None else (good, None, 0.0)
    if field in NUMERIC_FIELDS:
        return None, amount_in(raw), 0.0
    if field == "term_months":
        m = _TERM.search(raw)
        return None, m and float(m[1]) * (12 if m[2].lower().startswith("year") else 1), 0.0
    if field in DATE_FIELDS:
        return either(date_in(raw), raw, 0.25)
    if field == "currency":
        return either(_group(raw.upper(), _CODE), raw[:3].upper(), 0.3)
    if field == "payment_method":
        low = raw.lower()
        return either(next((m for m in PAYMENT_METHODS if m in low), None), raw, 0.2)
    if field == "fiscal_year":
        return either(_group(raw, _YEAR, 0), raw, 0.2)
    if field.endswith("_number") or field == "form_id":
        ident = _group(raw, _ID, 0)
        return either(ident and ident.strip(" "), raw, 0.2)
    return raw.strip(" ").rstrip(".;,"), None, 0.0


# --- extraction ------------------------------------------------------------------------------------


@cache
def _labels() -> tuple[frozenset[str], dict[str, dict[str, list[tuple[str, int, str]]]]]:
    by: dict[str, dict[str, list[tuple[str, int, str]]]] = {}
    for doc_type, field, rank, label in E.label_rows():
        by.setdefault(doc_type, {}).setdefault(re.match(r"[^ (]+", label)[0], []).append((field, rank, label))
    return frozenset(label for *_, label in E.label_rows()), by


@lru_cache(REMEMBERED)
def _labelled(doc_type: str, key: str) -> list[tuple[str, tuple[int, int], float]]:
    """(field, (pass, rank), confidence) of the labels that a key meets."""
    known, by = _labels()
    nkey = _SPACES.sub(" ", key).strip(" ").lower().strip(TRIMMED)
    first = re.match(r"[^ (]+", nkey)
    out = []
    for field, rank, label in by[doc_type].get(first[0] if first else "", ()):
        if nkey == label:
            out.append((field, (E.EXACT, rank), max(0.55, 0.92 - 0.04 * rank)))
        elif nkey.startswith((label + " ", label + "(")) and len(label) >= 3 and len(nkey) - len(label) <= 12 and nkey not in known:
            out.append((field, (E.NEAR, rank), max(0.5, 0.82 - 0.04 * rank)))
    return out


@lru_cache(REMEMBERED)
def _is_name(bare: str) -> bool:
    """Whether a line that is no pair may be a vendor's name."""
    return "A" <= bare[0] <= "Z" and not _DOCUMENT.search(bare) and not _DIGIT.search(bare) and len(_SPACES.split(bare)) <= 6 and _kind(bare) in ("Title", "NarrativeText")


def _vendor(elems: list) -> str | None:
    for text, key, _ in elems[:6]:
        if key is None and _is_name(text):
            return text
    return None


def _parties(text: str) -> str | None:
    m = _PARTIES.search(text)
    return "; ".join(_SPACES.sub(" ", m[n]).strip(" ") for n in (1, 2)) if m else None


def _ruled(doc_type: str, field: str, text: str, elems: list) -> tuple[str | None, float]:
    """(raw text, confidence) of a field's rule, as extract._rules has them."""
    if doc_type in ("invoice", "receipt"):
        if field == "currency":
            return currency_in(text), 0.7
        if field == "vendor":
            return _vendor(elems), 0.6
        if field == "total":
            return _group(text, _TOTAL), 0.6
        if field == "payment_method" and doc_type == "receipt":
            low = text.lower()
            return next((m for m, p in _METHODS if p.search(low)), None), 0.6
    elif doc_type == "contract":
        if field == "parties":
            return _parties(text), 0.7
        if field in _CONTRACT:
            return _group(text, _CONTRACT[field]), 0.7
        if field == "currency":
            return currency_in(text), 0.65
    elif doc_type == "report" and field == "title":
        return next((t for t, key, _ in elems[:5] if key is None and _kind(t) == "Title"), None), 0.6
    return None, 0.0


@lru_cache(REMEMBERED)
def _thousandths(confidence: float, penalty: float) -> int:
    return round(1000 * rounded(min(0.98, max(0.05, confidence - penalty))))


def fields_of(doc_type: str, text: str) -> dict[str, tuple[str | None, float | None, int]]:
    """name -> (value_str, value_num, confidence in thousandths), as extract.extract_fields has them."""
    elems = elements(text)
    best: dict[str, tuple[tuple[int, int], str, float]] = {}
    for _, key, value in elems:
        if key:
            for field, rank, confidence in _labelled(doc_type, key):
                if field not in best or rank < best[field][0]:
                    best[field] = rank, value, confidence
    out = {}
    for field in FIELDS[doc_type]:
        for is_rule in (False, True):
            if is_rule:
                raw, confidence = _ruled(doc_type, field, text, elems)
                if raw is None:
                    continue
            elif field in best:
                _, raw, confidence = best[field]
                raw = raw.strip(" ")
            else:
                continue
            value_str, value_num, penalty = (raw, None, 0.0) if is_rule and field in ("vendor", "title", "parties") else coerced(field, raw)
            if value_str or value_num is not None:
                out[field] = value_str, value_num, _thousandths(confidence, penalty)
                break
    return out


# --- checks and scores -----------------------------------------------------------------------------


def _nit_fits(base: str, digit: str) -> bool:
    rest = sum(int(d) * w for d, w in zip(reversed(base), NIT_WEIGHTS)) % 11
    return int(digit) == (rest if rest < 2 else 11 - rest)


def findings_of(doc_type: str, fields: dict) -> tuple[list[str], int]:
    """(fields that errors name, number of warnings), as validate.validate_fields has them."""
    errors, warnings = [f for f in REQUIRED[doc_type] if f not in fields], 0
    for f, (text, number, _) in fields.items():
        if number is not None:
            if f in NUMERIC_FIELDS:
                warnings += number < 0
            elif f == "term_months" and doc_type == "contract":
                warnings += number <= 0 or number > 600
        elif f in DATE_FIELDS:
            # most are dates as they were read, of which nothing is to be said
            if date_in(text) != text:
                if not _ISO_ONLY.search(text):
                    warnings += 1
                elif _date(text[:4] if text[:4] != "0000" else "2000", int(text[5:7]), int(text[8:])) is None:
                    errors.append(f)
        elif f == "currency":
            warnings += not _THREE.search(text)
        elif f == "vendor_tax_id":
            if m := _NIT.search(text.replace(".", "").replace(" ", "")):
                if not _nit_fits(m[1], m[2]):
                    errors.append(f)
            else:
                warnings += not _TAX_ID.search(text)
    if doc_type == "invoice":
        subtotal, tax, total, issue, due = (fields.get(f, (None, None)) for f in ("subtotal", "tax", "total", "issue_date", "due_date"))
        subtotal, tax, total, issue, due = subtotal[1], tax[1], total[1], issue[0], due[0]
        # rounding moves a sum by less than a cent: only sums that are about to differ are rounded
        if subtotal is not None and tax is not None and total is not None and not abs(subtotal + tax - total) <= 0.03:
            if not abs(subtotal + tax) < 1e15:
                raise NotRead
            if abs(rounded(subtotal + tax, 2) - total) > 0.05:
                errors.append("total")
        if issue is not None and due is not None:
            if not (date_in(issue) == issue and date_in(due) == due):
                raise NotRead
            if due < issue:
                errors.append("due_date")
    return errors, warnings


Score = tuple[str, float, float, int, int, float]


def score_of(text: str, doc_type: str | None = None, more_warnings: int = 0) -> Score | None:
    """(doc_type, mean_confidence, coverage, n_errors, n_warnings, confidence), as score.score_documents has them; null if not read."""
    if not text.isascii():
        return None
    if doc_type is None:
        doc_type = type_of(text)
    if doc_type not in FIELDS or (doc_type == "contract" and "\r" in text):
        return None
    fields = fields_of(doc_type, text)
    try:
        errors, warnings = findings_of(doc_type, fields)
    except NotRead:
        return None
    warnings += more_warnings
    thousandths = sum([f[2] for f in fields.values()])
    for name in {*errors} & fields.keys():
        thousandths -= min(fields[name][2], round(1000 * FIELD_COST))
    mean = thousandths / 1000 / len(fields) if fields else 0.0
    wanted = REQUIRED[doc_type]
    coverage = sum([f in fields for f in wanted]) / len(wanted)
    raw = mean * (0.5 + 0.5 * coverage) - ERROR_COST * len(errors) - WARN_COST * warnings
    return doc_type, mean, coverage, len(errors), warnings, rounded(max(0.0, min(1.0, raw)))


SCORE = "doc_type string, mean_confidence double, coverage double, n_errors bigint, n_warnings bigint, confidence double"


def _scored(typed: bool) -> Callable[[Iterator], Iterator]:
    def of_batches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [part.split(" ")[0] for part in SCORE.split(", ")]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            texts, given, low = (batch.column(c).to_pylist() for c in ("text", "given_type", "low"))
            # a type column says all; a requested type counts only where it is a known one
            scores = [None if typed and g is None else score_of(t, g if typed or g in FIELDS else None, w) for t, g, w in zip(texts, given, low)]
            left = pa.array([t if s is None else None for t, s in zip(texts, scores)], pa.string())
            columns = zip(*[s or (None,) * len(names) for s in scores]) if scores else [()] * len(names)
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds)], batch.column("given_type"), batch.column("low"), left], ["doc_id", *names, "given_type", "low", "text"])

    return of_batches


def score_plain(docs: DataFrame, typed: bool) -> DataFrame:
    """docs (doc_id, text, given_type, low) with the columns of SCORE; text is null where they were worked out, and only there.

    given_type: the type, if typed, else one that was asked for or null. low: warnings there are besides.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "given_type", F.col("low").cast("bigint").alias("low")).mapInArrow(_scored(typed), f"doc_id {kind}, {SCORE}, given_type string, low bigint, text string")
