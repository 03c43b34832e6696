"""Problem 5: split fields that hold several values, by a parsing expression grammar.

Ordered alternatives, tried from the first, each either taking the whole field or giving way to the next:

    field     <- lead? (json / numbered / strong / quoted / comma / joined) end
    json      <- a JSON array of texts
    numbered  <- ('(' n ')' / n ')' / n '.') item, with n = 1, 2, 3, ...
    strong    <- item (sep item)* sep?       sep: line break / tab / ';' / '|' / '//', outside quotes
    quoted    <- quote (sep? quote / sep item)*
    comma     <- item (',' (legal form / 'and'? item))*
    joined    <- item (('/' / '&' / 'and' / 'y' / 'und' / 'et') item)*
    item      <- quote / bracketed / bare

    bracketed <- open (bracketed / any but close)* close

A quote that is never closed, or has text right after it, and a bracket that is never closed make the parser
go back and read them as bare text, with an error flag. A legal form after a comma belongs to the item before it; a single word beside a
joining word (Bakers and Millers, & Sons, Salud y Vida) is part of a name and no item.

Null and blank fields have no items. Positions count from 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Opening and closing quotes.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "'": "'", "‘": "’", "‹": "›"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}

# Legal forms that may follow a comma.
LEGAL_FORM = re.compile(
    r"(?:S\.? ?A\.? de C\.? ?V\.?|S\. de R\.L\.(?: de C\.V\.)?|Inc\.?|Incorporated|L\.?L\.?C\.?|Ltd\.?|Limited|L\.?P\.?|LLP|PLC|Co\.?|Corp\.?|Corporation|Company|GmbH(?: & Co\. KG)?|AG|KG|OHG|SE|e\.V\."
    r"|S\.?A\.?S\.?|S\.?A\.?|S\.?L\.?U?\.?|S\.?R\.?L\.?|Ltda\.?|B\.?V\.?|N\.?V\.?|S\.?p\.?A\.?|Cooperative|Pty(?:\.? Ltd\.?)?|A/S|AB|Oy)(?![\w&])",
    re.I,
)
LEAD_IN = re.compile(r"\s*(?:(?:by and )?between|entre|zwischen|parties|partes|parteien|parties to this agreement)\b\s*:?\s+", re.I)
JOINING = re.compile(r"(?:\s*,)?\s+(?:and|y|e|und|et|&)\s+|\s+/\s+|(?<=\S)\s*//\s*", re.I)
FAMILY_WORDS = frozenset("sons son brothers bros hijos hermanos söhne gebrüder fils co company cia partners associates".split())
NUMBERED = re.compile(r"\(\s*(\d{1,3})\s*\)\s*|(?<![\w.])(\d{1,3})[.)]\s+")


class _Failed(Exception):
    """An alternative does not fit; the next one is tried."""


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.flags = text, set[str]()
        self.closed: dict[int, int] | None = None

    def quote(self, at: int) -> tuple[str, int]:
        """The text in the quote that opens here, and where it ends. Doubled or escaped quotes count once."""
        text = self.text
        close = QUOTES.get(text[at : at + 1])
        if close is None or (text[at] == "'" and at and text[at - 1].isalnum()):
            raise _Failed
        out, i = [], at + 1
        while i < len(text):
            c = text[i]
            if c == "\\" and text[i + 1 : i + 2] in (close, "\\"):
                out.append(text[i + 1])
                i += 2
            elif c == close and text[i + 1 : i + 2] == close:
                out.append(close)
                i += 2
            elif c == close and not (close in "'’" and text[i + 1 : i + 2].isalnum()):
                return "".join(out), i + 1
            else:
                out.append(c)
                i += 1
        self.flags.add("unclosed quote")
        raise _Failed

    def whole_quote(self, at: int, seps: re.Pattern) -> tuple[str, int]:
        """A quote that ends its item: a separator or the end follows."""
        inside, end = self.quote(at)
        rest = re.compile(r"[^\S\n\t]*").match(self.text, end).end()
        if rest < len(self.text) and not seps.match(self.text, rest) and not re.match(r"[.;,]?\s*$", self.text[rest:]):
            self.flags.add("text after quote")
            raise _Failed
        return inside, end

    def bracketed(self, at: int) -> int:
        """Where the bracket that opens here is closed, those inside it included. One never closed is bare text."""
        if self.closed is None:
            self.closed, open_ = {}, []
            for i, c in enumerate(self.text):
                if c in BRACKETS:
                    open_.append(i)
                elif open_ and c == BRACKETS[self.text[open_[-1]]]:
                    self.closed[open_.pop()] = i + 1
        if at not in self.closed:
            self.flags.add("unclosed bracket")
            raise _Failed
        return self.closed[at]

    def split(self, seps: re.Pattern) -> list[tuple[str, bool]]:
        """(item, was quoted) between the separators that are outside quotes and brackets."""
        text, items, start, i = self.text, [], 0, 0
        while i <= len(text):
            if not text[start:i].strip() and i < len(text) and text[i] in QUOTES:
                try:
                    inside, end = self.whole_quote(i, seps)
                    items.append((inside, True))
                    i = start = end
                    m = seps.match(text, re.compile(r"[^\S\n\t]*").match(text, i).end()) or seps.match(text, i)
                    if m and m.end() > i:
                        i = start = m.end()
                    elif not text[i:].strip(" .;,\t\n"):
                        return items
                    continue
                except _Failed:
                    pass
            if i < len(text) and text[i] in BRACKETS and not seps.match(text, i):
                try:
                    i = self.bracketed(i)
                    continue
                except _Failed:
                    pass
            m = seps.match(text, i) if i < len(text) else None
            if m and m.end() > i and not self._in_quotes(start, i):
                items.append((text[start:i], False))
                i = start = m.end()
            elif i == len(text):
                items.append((text[start:], False))
                break
            else:
                i += 1
        return items

    def _in_quotes(self, start: int, at: int) -> bool:
        """Whether a quote within the item that begins at start is closed only after this place."""
        part, rest = self.text[start:at], self.text[at:]
        marks = len(re.findall(r'(?<!\\)"', part))
        return marks % 2 == 1 and '"' in rest and re.search(r'(?:^|\s)"[^"]*$', part) is not None

    # alternatives

    def json(self) -> list[tuple[str, bool]]:
        if not self.text.lstrip().startswith("["):
            raise _Failed
        try:
            values = json.loads(self.text)
        except ValueError:
            self.flags.add("broken array")
            raise _Failed from None
        return [(v if isinstance(v, str) else json.dumps(v), True) for v in values if v is not None]

    def numbered(self) -> list[tuple[str, bool]]:
        marks, want, at = [], 1, 0
        for m in NUMBERED.finditer(self.text):
            if int(m[1] or m[2]) == want and (want > 1 or not self.text[: m.start()].strip(" \t\n:")):
                marks.append(m)
                want += 1
        if not marks:
            raise _Failed
        items = []
        for m, after in zip(marks, [*marks[1:], None]):
            item = self.text[m.end() : after.start() if after else len(self.text)]
            items.append((re.sub(r"[\s;,|]+$", "", re.sub(r"[;,]?\s*(?:and|y|und|et|&)\s*$", "", item) if after else item), False))
        return items

    def strong(self) -> list[tuple[str, bool]]:
        for seps in (r"\s*[\r\n]+\s*", r"\s*\t\s*\|?\s*(?:\t\s*)?", r"\s*;[\s;]*", r"\s*\|[\s|]*", r"\s+//\s+"):
            pattern = re.compile(seps)
            if not pattern.search(self.text):
                continue
            items = self.split(pattern)
            if len([i for i in items if i[0].strip()]) > 1 or (len(items) > 1 and not items[-1][0].strip()):
                return items
        raise _Failed

    def quoted(self) -> list[tuple[str, bool]]:
        """Quotes side by side, or with commas or joining words between them."""
        text, items, i = self.text, [], 0
        gap = re.compile(r"\s*(?:,|/|&|\band\b|\by\b|\bund\b)?\s*(?:and\s+|y\s+)?", re.I)
        while i < len(text):
            inside, end = self.quote(i)
            items.append((inside, True))
            m = gap.match(text, end)
            if m.end() == end and end < len(text) and text[end:].strip(" ."):
                raise _Failed
            i = m.end()
            if not text[i:].strip(" ."):
                break
            if text[i] not in QUOTES:
                raise _Failed
        return items

    def comma(self) -> list[tuple[str, bool]]:
        if "," not in self.text:
            raise _Failed
        items: list[tuple[str, bool]] = []
        raw = self.split(re.compile(r","))
        for item, quoted in raw:
            bare = item.strip()
            form = None if quoted else LEGAL_FORM.match(bare)
            if form and items and not items[-1][1]:
                # a legal form, alone or before a joining word, ends the item before it
                tail = bare[form.end() :]
                if not tail.strip(" .;") or JOINING.match(tail):
                    items[-1] = (items[-1][0].rstrip() + "," + item, False)
                    continue
            items.append((item, quoted))
        return items

    def joined(self) -> list[tuple[str, bool]]:
        return [(self.text, False)]


def _unjoin(item: str) -> list[str]:
    """Parts between joining words, where both sides are names of more than one word."""
    cuts = list(JOINING.finditer(item))
    if not cuts:
        return [item]
    parts, joins, at = [], [], 0
    for m in cuts:
        if item[:at].count("(") > item[:at].count(")"):
            continue
        parts.append(item[at : m.start()])
        joins.append(m[0])
        at = m.end()
    parts.append(item[at:])
    out = [parts[0]]
    for join, part in zip(joins, parts[1:]):
        words = part.split()
        alone = len(words) < 2 and not (words and LEGAL_FORM.search(part))
        if words and words[0].strip(".,").lower() in FAMILY_WORDS and (alone or LEGAL_FORM.match(" ".join(words[1:])) or words[1].startswith((",", "."))):
            out[-1] += join + part
        elif alone and len(out[-1].split()) >= 2 and part is parts[-1]:
            out[-1] += join + part
        elif len(out[-1].split()) < 2 and "//" not in join:
            out[-1] += join + part
        else:
            out.append(part)
    return out


def split_packed(text: str | None) -> tuple[list[str], list[str]]:
    """(items in order, error flags) of one field."""
    if text is None or not text.strip():
        return [], []
    lead = LEAD_IN.match(text)
    body = text[lead.end() :] if lead else text.strip()
    parser = _Parser(body)
    items: list[tuple[str, bool]] = [(body, False)]
    for name in ("json", "numbered", "strong", "quoted", "comma", "joined"):
        flags = set(parser.flags)
        try:
            items = getattr(parser, name)()
            break
        except _Failed:
            parser.flags = flags | {f for f in parser.flags if f.startswith(("unclosed", "broken"))}
    out: list[str] = []
    for item, quoted in items:
        if quoted:
            out.append(item.strip())
            continue
        for part in _unjoin(item):
            out.append(_unquote(_tidy(part)))
    return [x for x in out if x and re.search(r"\w", x)], sorted(parser.flags)


def _tidy(part: str) -> str:
    part = re.sub(r"^\s*(?:(?:and|y|und|et)\s+|&\s*)", "", part, flags=re.I)
    part = re.sub(r"^[\s;,|/]+|[\s;,|/]+$", "", part)
    return part


def _unquote(part: str) -> str:
    if len(part) > 1 and QUOTES.get(part[0]):
        try:
            inside, end = _Parser(part).quote(0)
            if end == len(part):
                return inside.strip()
        except _Failed:
            pass
    return re.sub(r'""', '"', part) if '""' in part else part


def split_values(df: DataFrame, id_cols: list[str], packed_col: str) -> DataFrame:
    """(*id_cols, pos, item, n_items, flags): one row per value, with the error flags of its field."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*id_cols).schema) + ", __items array<string>, flags array<string>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [split_packed(t) for t in batch["__packed"]]
            out = batch[id_cols].copy()
            out["__items"], out["flags"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    rows = df.select(*id_cols, F.col(packed_col).alias("__packed")).mapInPandas(work, schema)
    exploded = rows.select(*id_cols, F.size("__items").alias("n_items"), "flags", F.posexplode("__items").alias("__pos", "item"))
    return exploded.select(*id_cols, (F.col("__pos") + 1).alias("pos"), "item", "n_items", "flags")
