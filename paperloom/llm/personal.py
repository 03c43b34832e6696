"""Problem 7: find personal information in free text and put typed placeholders in its place.

Generators with high recall propose overlapping spans of seven kinds; boosted trees, one set a kind, score
each span from its format and its context; thresholds calibrated on held-out text (by F2, as a leak is worse than a mask too many) select, and overlaps go
to the higher score. The trees are fitted here, on a bounded number of sentences written by the generator
in personal_training (TRAINING_TEXTS of them, a documented parameter), never on the texts to redact.

Null texts stay null and hold nothing; what is already a placeholder is left alone; white space, empty and
very long texts go through unchanged where nothing personal is found.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.boosting import BoostedTrees
from paperloom.llm.names import _NICKS, LEGAL, PARTICLES, TITLES, TRADES, fold, given_names, trades_of

KINDS = ("person", "email", "phone", "id_number", "iban", "credit_card", "address")
TRAINING_TEXTS = 6000
#: Persons have the most look-alikes and get the most trees.
PERSON_TREES = {"rounds": 90, "depth": 5, "rate": 0.2}

# Words that stand before (or after) an item of a kind.
CUES = {
    "phone": "tel telephone phone telefon telefono call cell mobile movil celular handy fax tfno ruf telefonisch llamar anrufen al on or contact for at whatsapp",
    "id": "ssn social security national id passport pasaporte reisepass cedula ciudadania dni nie cc c.c ausweis personalausweis identity identificacion applicant's applicants holder copy licence curp nss",
    "iban": "iban account cuenta konto compte into bank",
    "card": "card tarjeta karte visa mastercard amex carte",
    "ref": "ref reference lot item tracking po inv invoice order pedido case against nit duplicate contract factura rechnung quoting with claim under deliver see ticket vat rfc parcel",
    "person": "by attn contact signed client customer seller buyer saw name nombre call met contactar bitte an member submitted prepared applicant author submitter filed approved to emergency employee dear via for",
    "address": "address lives vive en notices go at neighbour file an lieferung wohnt direccion domicilio home to ship adresse",
    "money": "usd eur cop gbp mxn cad chf jpy brl total tax freight fees saldo limit subtotal price uber por $ € £",
}
_CUE_OF: dict[str, set[str]] = {}
for _g, _ws in CUES.items():
    for _w in _ws.split():
        _CUE_OF.setdefault(_w, set()).add(_g)
CUE_GROUPS = tuple(CUES)

# Common words that are no part of a name.
STOPWORDS = frozenset(
    """a an and as at asked approved antes attached attn before batch bis bitte by call claim client closed confirmed contact contactar contacto
    copy date de del delivery deliver department der die das dear duplicate el emergency employee en enviar fees for from form goods has he her his
    holder home is item la las le left lives los lieferung mail mailto member met mit name no nombre not notices of on or our para paid pay per please
    por prepared price que questions receipt refund remit report request saldo se senor she shipped signed signer stamp submitted tax tel the their
    this to total under und unter und until up vive von was we will with y you your an al con driver gate got papers back weiterleiten telephone phone
    address account card id under vigente identificacion applicant invoice author date loyalty cashier charged checked via neighbour""".split()
)

# Capitalised words of documents, departments and places; a run that holds one is seldom a name.
NOT_NAMES = frozenset(
    """agreement annual application bank branch compras contract control department desk due executive facilities factura field finance fiscal form governing
    human identificacion invoice lago law legal lower maintenance neu no norte north office operations order page payment port procurement project purchase
    quality receipt recibo rechnung report research resources review safety sales san santa security services shipping site south stamp state statement storage
    summary support tesoreria terms total toner unit upper villa warehouse cop eur gbp mxn usd ssn dni nie iban nit reisepass passport pasaporte ausweis
    holdings group house hotel bakery books apotheke january february march april may june july august september october november december""".split()
)

# Street words by language.
_EN_STREET = r"(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Lane|Ln\.?|Court|Ct\.?|Drive|Way|Place|Square|Terrace|Close|Crescent|Parkway)"
_FR_STREET = r"(?:rue|avenue|boulevard|chemin|impasse|quai|allée|cours|place)"
_ES_STREET = r"(?:Calle|Avenida|Avda\.?|Av\.?|Paseo|Plaza|Camino|Ronda|Carretera|Travesía|Gran Vía)"
_CO_STREET = r"(?:Carrera|Cra\.?|Cr\.?|Kra\.?|Kr\.?|Calle|Cll\.?|Cl\.?|Diagonal|Dg\.?|Transversal|Tv\.?|Avenida|Av\.?|Ak\.?|Ac\.?)"
_IT_STREET = r"(?:Via|Viale|Piazza|Piazzale|Corso|Vicolo|Largo|Strada|Rua|Travessa|Praça|Praca|Alameda)"
_DE_STREET = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig)"
_W = r"[^\W\d_][\w'’.-]*"

_ADDRESS = [
    re.compile(rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]? (?:{_W} ){{1,3}}?{_EN_STREET}(?!\w)(?:,? (?:Apt|Unit|Suite|Flat|Apartment|#)\.? ?\w+)?", re.I),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: bis| ter)?,? {_FR_STREET} (?:(?:de|du|des|la|le|les|d'|l') ?)*{_W}", re.I),
    re.compile(rf"(?<!\w){_CO_STREET} ?\d+ ?[A-Z]?(?: bis)? ?(?:No\.?|Nº|N°|Nro\.?|#) ?\d+ ?[A-Z]?(?: bis)? ?[-–] ?\d+", re.I),
    re.compile(rf"(?<!\w){_ES_STREET} (?:(?:de|del|la|las|los|el) )*{_W}(?: {_W})?,? (?:n[º°.]? ?)?\d{{1,5}}(?:, ?(?:piso|puerta|bajo|esc\.?|planta) ?\w+)?", re.I),
    re.compile(rf"(?<!\w){_IT_STREET} (?:(?:de|del|della|dei|di|da|do|dos|das|la|le|lo) )*{_W}(?: {_W})?,? (?:n[º°.]? ?)?\d{{1,5}}(?:/[A-Za-z](?!\w))?", re.I),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}},? {_IT_STREET} (?:(?:de|del|della|dei|di|da|do|dos|das|la|le|lo) )*{_W}", re.I),
    re.compile(rf"(?<!\w)[^\W\d_]{{2,}}{_DE_STREET} ?\d{{1,4}} ?(?:[a-z](?!\w))?", re.I),
    re.compile(r"(?<!\w)(?:[^\W\d_]+(?:er|-))[ -](?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm) ?\d{1,4} ?(?:[a-z](?!\w))?", re.I),
]
_STREET_WORD = re.compile(rf"\b(?:{_EN_STREET}|{_FR_STREET}|{_ES_STREET}|{_CO_STREET}|{_IT_STREET})(?!\w)|{_DE_STREET}", re.I)
_AT, _DOT = r"(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?| at )", r"(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )"
_EMAIL = [
    re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?@ ?| ?[(\[{{] ?at ?[)\]}}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[{{] ?dot ?[)\]}}] ?)[A-Za-z0-9-]+)+"),
    re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z]{{2,}})+"),
]
_PHONE = re.compile(r"(?<![\w.,/+-])(?:\+|00 ?)?\(?\d(?:[\d]|[ ().-]{1,2}(?=[\d(])){5,20}\d(?![\w])")
_ID = [
    re.compile(r"(?<![\w.,/-])\d{3}[- ]?\d{2}[- ]?\d{4}(?![\w-])(?!/\d)"),
    re.compile(r"(?<![\w.,/-])\d{4,7}/\d{2,4}(?![\w-])"),
    re.compile(r"(?<![\w.,/-])[A-Z]{1,3} ?\d{6,9}(?![\w-])"),
    re.compile(r"(?<![\w.,/-])\d{1,3}(?:\.\d{3}){2,3}(?:-\d)?(?![\w-])"),
    re.compile(r"(?<![\w.,/-])\d{6,11}(?![\w/-])"),
    re.compile(r"(?<![\w.,/-])\d{1,2}\.?\d{3}\.?\d{3}[- ]?[A-Z](?![\w-])"),
    re.compile(r"(?<![\w.,/-])[XYZ]-?\d{7}-?[A-Z](?![\w-])"),
]
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")
_TOKEN = re.compile(r"[^\W\d_][\w]*(?:['’][^\W\d_]+)*")
_MASK = re.compile(r"\[REDACTED:[a-z_]+\]")

# Lengths of account numbers by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

_DATE = re.compile(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2}))$")
_AMOUNT = re.compile(r"^(?:\d{1,3}(?:[.,]\d{3})*[.,]\d{2}|\d{1,3}(?:[.,]\d{3})+|\d+[.,]\d{1,2})$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(maxsize=200_000)
def _lexicon(token: str) -> int:
    """3 a given name, 2 a short form of one, 1 a name one slip away, 0 none."""
    word = fold(token)
    if word in _NICKS:
        return 3 if word in _NICKS[word] else 2
    return 1 if len(word) >= 5 and given_names(word) else 0


@lru_cache(maxsize=200_000)
def _business(token: str) -> bool:
    word = fold(token).strip(".")
    return word in TRADES or word.replace(".", "") in LEGAL or (len(word) > 4 and bool(trades_of(word)))


def _case(word: str) -> int:
    return 2 if word.isupper() else 1 if word[:1].isupper() else 0


def _persons(text: str, tokens: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Spans that may be a person: (start, end, form)."""
    n = len(tokens)
    gap = lambda i: text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else "\n"
    common = lambda i: fold(tokens[i][2]) in STOPWORDS
    initial = lambda i: len(tokens[i][2]) == 1 and text[tokens[i][1] : tokens[i][1] + 1] in (".", " ", "", "\n", ",", ";")

    def surnames_after(i: int, case: int) -> int:
        """Last token of the initials and one or two surnames that follow token i; i itself if none."""
        j = i
        while j + 1 < n and gap(j) in (" ", ". ") and initial(j + 1) and len(tokens[j + 1][2]) == 1 and text[tokens[j + 1][1] : tokens[j + 1][1] + 1] == ".":
            j += 1
        k, words = j, 0
        while words < 2 and k + 1 < n and gap(k) in ((". ", " ", ".") if len(tokens[k][2]) == 1 or (k == i and len(tokens[k][2]) <= 3) else (" ", "-")):
            nxt = tokens[k + 1][2]
            if common(k + 1) or (len(nxt) == 1 and not (words and text[tokens[k + 1][1] : tokens[k + 1][1] + 1] == ".")) or (case and not _case(nxt)):
                break
            if case == 0 and _case(nxt):
                break
            k, words = k + 1, words + 1
        return k if words else i

    def words_before(i: int, case: int, first_gap: tuple[str, ...]) -> int:
        """First token of one or two surnames before token i; i itself if none."""
        k, words = i, 0
        while words < 2 and k > 0 and gap(k - 1) in (first_gap if k == i else (" ", "-")):
            before = tokens[k - 1][2]
            if common(k - 1) or len(before) < 2 or fold(before) in TITLES or (_case(before) == 0) != (case == 0):
                break
            k, words = k - 1, words + 1
        if k < i and first_gap == (", ",) and k and gap(k - 1) == ". " and len(tokens[k - 1][2]) == 1 and (_case(tokens[k - 1][2]) > 0) == (case > 0):
            k -= 1
        return k

    for i, (start, end, word) in enumerate(tokens):
        if len(word) > 1 and _lexicon(word):
            case = _case(word)
            last = surnames_after(i, case)
            if last > i:
                yield start, tokens[last][1] + (text[tokens[last][1] : tokens[last][1] + 1] == "." and len(tokens[last][2]) == 1), "given first"
            tail = i
            while tail + 1 < n and gap(tail) in (" ", ". ") and len(tokens[tail + 1][2]) == 1 and text[tokens[tail + 1][1] : tokens[tail + 1][1] + 1] == ".":
                tail += 1
            stop = tokens[tail][1] + (tail > i)
            first = words_before(i, case, (", ",))
            if first < i:
                yield tokens[first][0], stop, "surname comma"
            if last == i:
                first = words_before(i, case, (" ",))
                if first < i:
                    yield tokens[first][0], stop, "surname first"
        elif len(word) == 1 and text[end : end + 1] == "." and (i == 0 or gap(i - 1) not in (".", "-", "'")):
            if i and len(tokens[i - 1][2]) == 1 and gap(i - 1) == ". ":
                continue  # an initial after an initial
            case = _case(word) and 1
            last = surnames_after(i, case)
            words = [t[2] for t in tokens[i + 1 : last + 1]]
            if any(len(w) >= 3 for w in words):
                yield start, tokens[last][1], "initial"
            first = words_before(i, case, (", ",))
            if first < i:
                stop = end + 1
                yield tokens[first][0], stop, "surname initial"


def _runs(text: str, tokens: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Spans that may be a person whatever the given name: runs of capitalised words, and lower-case words after a cue."""
    n = len(tokens)
    folded = [fold(t[2]) for t in tokens]
    gap = lambda i: text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else "\n"
    plain = [f not in STOPWORDS and f not in TITLES and not f.endswith(("'s", "’s")) and re.sub("['’]", "", f).isalpha() for f in folded]
    capital = [bool(_case(t[2])) and p for t, p in zip(tokens, plain)]
    joined = lambda i: gap(i) in (" ", "-") or (gap(i) == ". " and len(tokens[i][2]) == 1)
    stop = lambda i: tokens[i][1] + (len(tokens[i][2]) == 1 and text[tokens[i][1] : tokens[i][1] + 1] == ".")

    def following(i: int) -> int:
        """The next word of the run token i is in, past particles; -1 at its end."""
        k = i
        while joined(k) and k + 1 < n:
            k += 1
            if capital[k]:
                return k
            if folded[k] not in PARTICLES or k > i + 3:
                return -1
        return -1

    def cued(i: int) -> bool:
        """Whether a person cue, and perhaps a title, stands right before token i."""
        while i and folded[i - 1] in TITLES and gap(i - 1) in (" ", ". "):
            i -= 1
        return i > 0 and "person" in _CUE_OF.get(folded[i - 1], ()) and gap(i - 1).strip(" ") in ("", ":", ".")

    for a in range(n):
        if capital[a]:
            b, words = a, 1
            while words <= 5:
                given = b + 1
                if words <= 3 and len(tokens[b][2]) > 1 and gap(b) == ", " and given < n and capital[given]:
                    yield tokens[a][0], stop(given), "run comma"
                    if joined(given) and given + 1 < n and capital[given + 1]:
                        yield tokens[a][0], stop(given + 1), "run comma"
                if (b := following(b)) < 0:
                    break
                words += 1
                if words <= 5 and any(len(t[2]) > 2 for t in tokens[a : b + 1]):
                    yield tokens[a][0], stop(b), "run"
        elif plain[a] and cued(a):
            b, words = a, 1
            while words < 5 and (joined(b) or (gap(b) == ", " and len(tokens[b][2]) > 1)) and b + 1 < n and plain[b + 1] and not capital[b + 1]:
                b, words = b + 1, words + 1
                yield tokens[a][0], stop(b), "cue"


PERSON_FORMS = ("given first", "surname comma", "surname first", "initial", "surname initial", "run", "run comma", "cue")
FIRST_RUN = PERSON_FORMS.index("run")


def propose(text: str) -> list[tuple[int, int, str, int]]:
    """All candidate spans: (start, end, kind, number of the generator)."""
    out: list[tuple[int, int, str, int]] = []
    masked = [m.span() for m in _MASK.finditer(text)]
    for g, pattern in enumerate(_EMAIL):
        out += [(m.start(), m.end(), "email", g) for m in pattern.finditer(text)]
    for g, pattern in enumerate(_ADDRESS):
        out += [(m.start(), m.end(), "address", g) for m in pattern.finditer(text)]
    for g, pattern in enumerate(_ID):
        out += [(m.start(), m.end(), "id_number", g) for m in pattern.finditer(text)]
    for m in _IBAN.finditer(text):
        end, want = m.end(), IBAN_LENGTH.get(text[m.start() : m.start() + 2])
        if want:
            seen, at = 0, m.start()
            while at < m.end() and seen < want:
                seen += text[at] != " "
                at += 1
            end = at if seen == want else end
        out.append((m.start(), end, "iban", 0))
    out += [(m.start(), m.end(), "credit_card", 0) for m in _CARD.finditer(text)]
    for m in _PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start() + (m[0][0] == "(" and ")" not in m[0]), m.end(), "phone", 0))
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    known = [(a, b, "person", PERSON_FORMS.index(form)) for a, b, form in _persons(text, tokens)]
    spans = {c[:2] for c in known}
    out += known + [(a, b, "person", PERSON_FORMS.index(form)) for a, b, form in _runs(text, tokens) if (a, b) not in spans]
    return [c for c in dict.fromkeys(out) if not _overlaps(masked, c[0], c[1])]


def _overlaps(spans: list[tuple], start: int, end: int) -> bool:
    """Whether one of the spans, which are in order and apart, has a character in common with start..end."""
    at = bisect.bisect_left(spans, (end,))
    return at > 0 and spans[at - 1][1] > start


# Lengths of the groups of digits of common formats.
_GROUPS = {(3, 2, 4): 1, (3, 3, 4): 2, (4, 4, 4, 4): 3, (6, 4): 4, (4, 2): 5, (9,): 6, (10,): 7, (16,): 8, (8,): 9, (7,): 10, (2, 3, 2, 2, 2): 11, (1, 3, 3, 4): 12, (1, 3, 3, 3): 13, (3, 3, 3, 1): 14, (2, 3, 3, 4): 15, (3, 6, 1): 16, (4, 3, 4): 17, (2, 2, 2): 18, (1, 3, 3): 19, (3, 3): 20, (3, 3, 3): 21}

_AFTER = re.compile(r"(-|, |\.? )(?:[^\W\d_][\w'’]*)")
_BEFORE = re.compile(r"([^\W\d_][\w'’]*)(-|, |\.? )$")


def _goes_on(text: str, start: int, end: int) -> tuple[int, int]:
    """How a span of names goes on to the right and to the left: 1 hyphen, 2 comma, 3 blank, 4 an initial; 0 not at all."""
    kinds = {"-": 1, ", ": 2, " ": 3, ". ": 4}
    after, before = _AFTER.match(text, end, end + 24), _BEFORE.search(text[max(0, start - 24) : start])
    word = after[0][len(after[1]) :] if after else ""
    right = kinds[after[1]] if word[:1].isupper() and fold(word) not in STOPWORDS else 0
    left = kinds[before[2]] if before and before[1][0].isupper() and fold(before[1]) not in STOPWORDS and fold(before[1]) not in TITLES else 0
    return right, left


_NO_DIGIT, _NO_LETTER = re.compile(r"\D+"), re.compile(r"[\W\d_]+")
_LEFT_WORD = re.compile(r"[^\s,;:()<>\[\]/]+")


def features(text: str, start: int, end: int, kind: str, generator: int) -> list[float]:
    span = text[start:end]
    digits = _NO_DIGIT.sub("", span)
    letters = len(_NO_LETTER.sub("", span))
    look_back = text[max(0, start - 48) : start]
    last_left = _LEFT_WORD.findall(look_back)
    bare_left = look_back.rstrip(" ")
    compact = re.sub(r"[ -]", "", span)
    groups = tuple(len(g) for g in re.findall(r"\d+", span))
    left = [fold(w).strip(".'\"!?") for w in last_left[-8:]][-4:]
    while left and left[-1] in TITLES | {"no", "num", "nr", "number", "n", "", "sr", "number"}:
        left.pop()
    right_words = [w for w in _LEFT_WORD.findall(text[end : end + 40])][:2]
    right = [fold(w).strip(".'\"!?") for w in right_words]
    near = _CUE_OF.get(left[-1], set()) if left else set()
    wide = set().union(*(_CUE_OF.get(w, set()) for w in left[-3:])) if left else set()
    before, after = text[start - 1 : start], text[end : end + 1]
    words = [m[0] for m in _TOKEN.finditer(span)]
    line_start = bare_left[-1:] in ("", "\n")
    values = [
        generator,
        len(span),
        len(digits),
        letters,
        span.startswith(("+", "00")),
        "(" in span,
        13 <= len(digits) <= 19 and luhn(digits),
        kind == "iban" and mod97(compact) if compact[:2].isalpha() and compact.isalnum() and compact.isascii() else False,
        bool(_DATE.match(span)),
        bool(_AMOUNT.match(span)),
        _GROUPS.get(groups, 0),
        len(groups),
        "-" in span,
        "." in span,
        "/" in span,
        *(g in near for g in CUE_GROUPS),
        *(g in wide for g in CUE_GROUPS),
        0 if not before or before == "\n" else 1 if before == " " else 2 if before.isalnum() else 3 if before in "-/.,#" else 4,
        0 if not after or after == "\n" else 1 if after == " " else 2 if after.isalnum() else 3 if after in ".,;:)" else 4,
        sum(_lexicon(w) == 3 for w in words) if kind == "person" else 0,
        sum(_lexicon(w) > 0 for w in words) if kind == "person" else 0,
        sum(len(w) == 1 for w in words),
        len(words),
        any(_business(w) for w in right_words[:2]) if kind in ("person", "address") else 0,
        any(_business(w) for w in words) if kind in ("person", "address") else 0,
        _case(words[0]) if words else 0,
        bool(_STREET_WORD.search(span)) if kind in ("person", "address") else 0,
        bool(right_words and text[end : end + 1] == " " and right_words[0][:1].isupper()),
        bool(right and right[0] in {"usd", "eur", "cop", "gbp", "mxn", "€", "$"}),
        line_start,
        bool(last_left and text[start - 1 : start] == " " and last_left[-1][:1].isupper() and not bare_left.endswith((":", "."))),
        bool(right_words and right_words[0].islower() and after == " " and right[0] not in _CUE_OF),
        text[max(0, start - 2) : start].rstrip(" ")[-1:] == ":",
        _lexicon(words[0]) if kind == "person" and words else 0,
        sum(fold(w) in NOT_NAMES for w in words) if kind == "person" else 0,
        bool(right) and kind == "person" and right[0] in NOT_NAMES,
        *(_goes_on(text, start, end) if kind == "person" else (0, 0)),
    ]
    return [float(v) for v in values]


class Redactor:
    """Fitted trees and thresholds; small enough to travel with each task."""

    def __init__(self, training_texts: int = TRAINING_TEXTS, seed: int = 5) -> None:
        from paperloom.llm.personal_training import labelled_texts

        rows: dict[str, list[list[float]]] = {k: [] for k in KINDS}
        labels: dict[str, list[bool]] = {k: [] for k in KINDS}
        held: dict[str, list[bool]] = {k: [] for k in KINDS}
        for number, (text, truth) in enumerate(labelled_texts(training_texts, seed)):
            true, whole = {(s, k) for s, _, k in truth}, set(truth)
            for start, end, kind, generator in propose(text):
                rows[kind].append(features(text, start, end, kind, generator))
                # of a run's many ends only the right one counts
                by_run = kind == "person" and generator >= FIRST_RUN
                labels[kind].append((start, end, kind) in whole if by_run else (start, kind) in true)
                held[kind].append(number % 4 == 3)
        self.trees: dict[str, BoostedTrees] = {}
        self.thresholds: dict[str, float] = {}
        self.held_out_f1: dict[str, float] = {}
        for kind in KINDS:
            x, y, h = np.array(rows[kind]), np.array(labels[kind], dtype=bool), np.array(held[kind], dtype=bool)
            self.trees[kind] = BoostedTrees(**(PERSON_TREES if kind == "person" else {})).fit(x[~h], y[~h])
            p = self.trees[kind].predict(x[h])
            best = max(np.linspace(0.05, 0.9, 35), key=lambda t: (_weighed(p >= t, y[h]), -abs(t - 0.5)))
            self.thresholds[kind], self.held_out_f1[kind] = float(best), _f1(p >= best, y[h])

    def find_many(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text the (start, end, kind) of its items, in order, without overlaps; scored together.

        A text that comes again is searched once.
        """
        known = list(dict.fromkeys(texts))
        if len(known) < len(texts):
            found = dict(zip(known, self.find_many(known)))
            return [found[t] for t in texts]
        proposed: list[tuple[int, tuple[int, int, str, int]]] = []
        rows: dict[str, list[list[float]]] = {}
        members: dict[str, list[int]] = {}
        for t, text in enumerate(texts):
            for c in propose(text) if text else ():
                rows.setdefault(c[2], []).append(features(text, *c))
                members.setdefault(c[2], []).append(len(proposed))
                proposed.append((t, c))
        scores = np.zeros(len(proposed))
        for kind, own in members.items():
            p = self.trees[kind].predict(np.array(rows[kind]))
            scores[own] = np.where(p >= self.thresholds[kind], p, 0.0)
        by_text: dict[int, list[tuple[float, tuple[int, int, str, int]]]] = {}
        for score, (t, c) in zip(scores, proposed):
            if score > 0:
                by_text.setdefault(t, []).append((float(score), c))
        out: list[list[tuple[int, int, str]]] = []
        for t in range(len(texts)):
            taken: list[tuple[int, int, str]] = []
            for _, (start, end, kind, _) in sorted(by_text.get(t, ()), key=lambda x: (-round(x[0], 2), x[1][0] - x[1][1], x[1][0])):
                if not _overlaps(taken, start, end):
                    bisect.insort(taken, (start, end, kind))
            out.append(taken)
        return out

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        return self.find_many([text])[0]


def replace_items(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with each item replaced by the placeholder of its kind."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in items:
        out += [text[at:start], f"[REDACTED:{kind}]"]
        at = end
    return "".join(out) + text[at:]


def _weighed(found: np.ndarray, true: np.ndarray) -> float:
    """an item left in the text counts more than a placeholder too many."""
    hit = (found & true).sum()
    return float(5 * hit / max(1, found.sum() + 4 * true.sum()))


def _f1(found: np.ndarray, true: np.ndarray) -> float:
    hit = (found & true).sum()
    return float(2 * hit / max(1, found.sum() + true.sum()))


@lru_cache(maxsize=2)
def fitted(training_texts: int = TRAINING_TEXTS) -> Redactor:
    return Redactor(training_texts)


def redact_texts(texts: DataFrame, id_cols: list[str], text_col: str, training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """(*ids, redacted_text, redacted, items array<struct<kind, start_pos, end_pos>>): a row for each row.

    redacted is true where the text held personal information, found now or masked before.
    """
    redactor = fitted(training_texts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*id_cols).schema)
    schema += ", redacted_text string, redacted boolean, items array<struct<kind:string,start_pos:int,end_pos:int>>"
    held = texts.sparkSession.sparkContext.broadcast(redactor)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            texts_, flags, items_ = [], [], []
            for text, items in zip(batch["__text"], model.find_many(list(batch["__text"]))):
                redacted = replace_items(text, items)
                texts_.append(redacted)
                flags.append(bool(redacted and _MASK.search(redacted)))
                items_.append([{"kind": k, "start_pos": a, "end_pos": b} for a, b, k in items])
            out = batch[id_cols].copy()
            out["redacted_text"], out["redacted"], out["items"] = texts_, flags, items_
            yield out

    return texts.select(*id_cols, F.col(text_col).alias("__text")).mapInPandas(work, schema)
