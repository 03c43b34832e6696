"""Problem 1: link the spellings of one company or one person.

Names are parsed into parts (core words, line of trade, legal form; given name, initials, surnames),
distinct parses are joined on their keys by the pigeonhole segment join, and each candidate pair is
verified part by part with a banded edit distance. Pairs that agree in all parts merge at once; a
shorter form (an initial for a name, a part left out) joins only when exactly one fuller entity fits,
so that relatives and sister firms stay apart.

Null, empty and placeholder names belong to nobody and get no link. Repeated names count once.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.segment_join import banded, segment_join
from paperloom.operators.components import connected_components
from paperloom.session import cut

# Titles before names.
TITLES = frozenset("mr mrs ms miss dr dra sr sra srta ing lic prof herr frau don dona mag dipl abg arq".split())

# Given names and their short forms.
GIVEN = {
    "abigail": "abby", "alejandra": "ale jandra sandra", "alejandro": "alex jandro", "alexander": "alex sandy", "antonio": "toni tono",
    "beatriz": "bea betty", "benjamin": "ben benji benny", "charlotte": "lottie charly", "concepcion": "concha conchita", "daniela": "dani",
    "daniel": "dan danny", "dolores": "lola loli", "edward": "eddie ed ned ted", "elizabeth": "beth liz lizzie betty eliza", "enrique": "quique kike",
    "francisco": "fco paco pancho", "friedrich": "fritz fred", "gabriel": "gabo gabi", "gertrud": "trudi gerti", "guadalupe": "lupe lupita",
    "henry": "hank harry hal", "ignacio": "nacho", "james": "jim jimmy jamie", "johannes": "hans hannes", "jose": "pepe chepe",
    "katherine": "kate kathy katie kat", "ludwig": "lutz", "margaret": "maggie meg peggy", "maria": "mari ma", "michael": "mike mick mickey",
    "patricia": "pat patty trish", "rafael": "rafa", "richard": "dick rick rich", "robert": "bob rob bobby", "rosario": "charo chayo",
    "santiago": "santi chago", "susana": "susi susy", "teresa": "tere", "theodore": "theo ted", "victoria": "vicky vicki tori",
    "wilhelm": "willi helmi", "william": "bill billy will", "zacharias": "zach zack", "thomas": "tom tommy", "joseph": "joe", "manuel": "manolo",
    "juan": "", "carlos": "", "luis": "lucho", "miguel": "", "pedro": "", "pablo": "", "laura": "", "ana": "", "carmen": "", "isabel": "chabela",
    "john": "jack", "peter": "pete", "anna": "", "hans": "", "heinrich": "heinz", "klaus": "", "karl": "", "mary": "molly", "paul": "", "david": "dave",
}

# Words for a line of trade.
TRADES = (
    "agropecuaria ceramics comercializadora construction consulting distribution druckerei energy engineering foods hardware international "
    "laboratories logistics manufacturing maschinenbau packaging pharmaceuticals servicios services technologies textiles transportes transport "
    "trading holding industries solutions systems electronics chemicals automotive furniture plastics printing security software studio"
).split()

# Short forms of trades that are no beginning of the word and no thinned-out spelling of it.
TRADE_ALIASES = {"svcs": ["servicios", "services"], "cial": ["comercializadora"], "int'l": ["international"], "transports": ["transportes", "transport"]}

# Legal forms, written without dots and spaces, and what they stand for.
LEGAL = {
    "llc": "llc", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corporation": "corp", "corp": "corp", "co": "co", "company": "co",
    "gmbh": "gmbh", "gesmbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "sa": "sa", "sociedadanonima": "sa", "sas": "sas", "sl": "sl",
    "sociedadlimitada": "sl", "cooperative": "coop", "coop": "coop", "cooperativa": "coop", "srl": "srl", "plc": "plc", "kg": "kg", "ohg": "ohg", "bv": "bv",
    "sadecv": "sadecv", "limitedliabilitycompany": "llc", "gesellschaftmbh": "gmbh", "ltda": "ltda",
}
CONNECTORS = frozenset(["and", "y", "und", "et", "e", "&", "+"])

# Words that belong to the surname they precede.
PARTICLES = frozenset("de del dela la las los le da das do dos di della du des van von der den ter ten zu zum zur".split())

PLACEHOLDERS = frozenset(
    "n/a na n.a. none null unknown s/n sn n/d nd tbd ??? ? - -- . x xx xxx (illegible) illegible unleserlich desconocido ilegible unbekannt anonymous various varios pending test".split()
)

_DIGIT_LETTERS = str.maketrans("01358", "olesb")


@functools.lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case, without accents, with white space collapsed."""
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKD", text)
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c)).lower().replace("ß", "ss")).strip()


def unread(token: str, merge: bool = True) -> str:
    """Undo what a scanner does to letters: digits within words and, with merge, rn for m."""
    if any(c.isalpha() for c in token) and any(c.isdigit() for c in token):
        token = token.translate(_DIGIT_LETTERS)
    return token.replace("rn", "m") if merge else token


_NICKS: dict[str, list[str]] = {}
for _full, _short in GIVEN.items():
    for _n in _short.split():
        _NICKS.setdefault(_n, []).append(_full)
for _full in GIVEN:
    _NICKS[_full] = [_full]


class NearIndex:
    """A fixed list of words, to find those within k edits (swaps of neighbours count as one) without comparing all.

    Words within k edits have a text in common once up to k letters are taken out of each.
    """

    def __init__(self, words: Iterable[str], k: int) -> None:
        self.order = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.k = k
        self.held: dict[str, list[str]] = {}
        for word in self.order:
            for short in self._shorter(word):
                self.held.setdefault(short, []).append(word)

    def _shorter(self, word: str) -> set[str]:
        out = last = {word}
        for _ in range(self.k):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            out = out | last
        return out

    def near(self, word: str, k: int) -> list[str]:
        if len(word) > max(map(len, self.order)) + self.k:
            return []
        found = {w for short in self._shorter(word) for w in self.held.get(short, ())}
        return sorted((w for w in found if banded(word, w, k) <= k), key=self.order.__getitem__)


_GIVEN_INDEX, _TRADE_INDEX = NearIndex(GIVEN, 1), NearIndex(TRADES, 2)


def given_names(token: str) -> list[str]:
    """The given names a token may stand for: itself, what it is short for, or a name one slip away."""
    if token in _NICKS:
        return _NICKS[token]
    if len(token) < 4:
        return []
    near = _GIVEN_INDEX.near(token, 1)
    return [n for n in near if n[0] == token[0]] or [n for n in near if len(n) > 4]


def _thinned(short: str, word: str) -> bool:
    it = iter(word)
    return short[0] == word[0] and all(c in it for c in short)


@functools.lru_cache(maxsize=200_000)
def trades_of(token: str) -> list[str]:
    """The lines of trade a word may stand for; abbreviations may stand for several."""
    dotted, bare = token.endswith("."), unread(token.strip(".").replace(".", ""), False)
    if bare in TRADE_ALIASES:
        return TRADE_ALIASES[bare]
    if len(bare) < 2:
        return []
    exact = [t for t in TRADES if t == bare]
    if exact:
        return exact
    near = [t for t in _TRADE_INDEX.near(bare, 2) if len(t) >= 8 or banded(bare, t, 1) <= 1] if len(bare) >= 5 else []
    if near:
        return near
    vowels = sum(c in "aeiou" for c in bare)
    if dotted or vowels <= 1 or len(bare) <= 4 or any(t.startswith(bare) for t in TRADES):
        return [t for t in TRADES if len(bare) >= 3 and (t.startswith(bare) or _thinned(bare, t) or (len(bare) > 3 and bare[-1] == "s" and t.startswith(bare[:-1])))]
    return []


def parse_company(name: str) -> dict | None:
    """core words in order, lines of trade (empty if none is named), legal form ('' if none)."""
    text = fold(name)
    if text in PLACEHOLDERS or not any(c.isalpha() for c in text):
        return None
    tokens = [t for t in re.split(r"[\s,;]+", text.replace("-", " ") if "co-op" not in text else text.replace("co-op", "coop").replace("-", " ")) if t]
    legal = ""
    for width in (3, 2, 1):
        tail = unread("".join(tokens[-width:]).replace(".", "")) if len(tokens) > width else ""
        if tail in LEGAL:
            legal, tokens = LEGAL[tail], tokens[:-width]
            break
        if width == 1 and len(tail) >= 7 and (near := [v for k, v in LEGAL.items() if len(k) >= 7 and banded(tail, k, 1) <= 1]):
            legal, tokens = near[0], tokens[:-1]
    trade, core = [], []
    for t in tokens:
        if t in CONNECTORS:
            continue
        if not trade and len(t.strip(".")) > 1 and (found := trades_of(t)):
            trade = found
        elif bare := unread(re.sub(r"[^a-z0-9]", "", t), False):
            core.append(bare)
    if not core:
        core, trade = [t for t in trade[:1]], []
    return {"kind": "vendor", "core": core, "trade": sorted(trade), "legal": legal} if core else None


def attach_particles(words: list[str]) -> list[str]:
    """The words with each particle written together with the word it precedes; one at the end stays."""
    out, held = [], ""
    for w in words:
        held += w
        if w not in PARTICLES:
            out.append(held)
            held = ""
    return out + [held] * bool(held)


def parse_person(name: str) -> dict | None:
    """given names (several for an ambiguous short form), or their initial; middle initial; surnames."""
    text = fold(name)
    if text in PLACEHOLDERS or not any(c.isalpha() for c in text):
        return None
    head, comma, tail = text.partition(",")
    split = lambda s: [t for t in re.split(r"[\s\-]+", s) if t.strip(".")]
    front = split(head)
    while front and front[0].strip(".") in TITLES and len(front) + len(split(tail)) > 1:
        front = front[1:]
    bare = lambda t: unread(re.sub(r"[^a-z0-9]", "", t), False)
    if comma and split(tail):
        rest = [bare(t) for t in split(tail)]
        given, middle, surnames = rest[0], rest[1:2], [bare(t) for t in front] + rest[2:]
    else:
        tokens = [bare(t) for t in front]
        tokens = [t for t in tokens if t]
        if not tokens:
            return None
        at = 0
        if len(tokens) > 1 and len(tokens[0]) > 1 and not given_names(tokens[0]):
            later = [i for i, t in enumerate(tokens[1:], 1) if len(t) > 1 and given_names(t)]
            initials = [i for i, t in enumerate(tokens[1:], 1) if len(t) == 1]
            at = later[0] if later else initials[0] if initials and len(tokens) > initials[0] and all(len(t) == 1 for t in tokens[initials[0] :]) else 0
        if at:
            given, middle, surnames = tokens[at], tokens[at + 1 : at + 2], tokens[:at] + tokens[at + 2 :]
        else:
            given, rest = tokens[0], tokens[1:]
            middle = rest[:1] if len(rest) > 1 and len(rest[0]) == 1 else []
            surnames = rest[len(middle) :]
    middle = [m for m in middle if m]
    if middle and len(middle[0]) > 1:
        surnames, middle = surnames + middle, []
    surnames = attach_particles([s for s in surnames if s])
    if not surnames:
        return None
    names = [given] if len(given) == 1 else given_names(given) or given_names(given.replace("rn", "m")) or [given]
    return {"kind": "submitter", "given": sorted(names), "middle": middle[0] if middle else "", "surnames": surnames}


def _near(a: str, b: str, k: int = 1) -> bool:
    """Within k slips, as written or with every rn taken for an m that a scanner misread."""
    return banded(a, b, k) <= k or ("rn" in a or "rn" in b) and banded(a.replace("rn", "m"), b.replace("rn", "m"), k) <= k


def _words_agree(a: list[str], b: list[str]) -> bool:
    """The same core words, one slip each allowed, in any order, or written together."""
    if len(a) == len(b) and (all(map(_near, a, b)) or len(a) == 2 and _near(a[0], b[1]) and _near(a[1], b[0])):
        return True
    if len(a) != len(b):
        x, y = "".join(a), "".join(b)
        k = 2 if min(len(x), len(y)) >= 10 else 1
        return _near(x, y, k) or len(b) == 2 and _near(x, b[1] + b[0], k) or len(a) == 2 and _near(y, a[1] + a[0], k)
    return False


def compare_companies(x: dict, y: dict) -> str:
    """'same', 'less' (x is a shorter form of y), 'more' (the reverse) or '' (not the same)."""
    if x["legal"] and y["legal"] and x["legal"] != y["legal"] or x["trade"] and y["trade"] and not set(x["trade"]) & set(y["trade"]):
        return ""
    less = more = False
    a, b = x["core"], y["core"]
    if not _words_agree(a, b):
        if len(a) != 2 or len(b) != 2:
            return ""
        short_a, short_b = [len(t) == 1 for t in a], [len(t) == 1 for t in b]
        fits = False
        for p, q in ((b, short_b), (b[::-1], short_b[::-1])):
            if all(s[0] == t[0] if len(s) == 1 or len(t) == 1 else _near(s, t) for s, t in zip(a, p)):
                fits = True
        if not fits or any(short_a) == any(short_b):
            return ""
        less, more = any(short_a), any(short_b)
    if x["trade"] and y["trade"]:
        less, more = less or len(x["trade"]) > len(y["trade"]), more or len(y["trade"]) > len(x["trade"])
    elif x["trade"] or y["trade"]:
        less, more = less or not x["trade"], more or not y["trade"]
    if bool(x["legal"]) != bool(y["legal"]):
        less, more = less or not x["legal"], more or not y["legal"]
    return "" if less and more else "less" if less else "more" if more else "same"


def compare_persons(x: dict, y: dict) -> str:
    """'same', 'less' (x is a shorter form of y), 'more' (the reverse) or '' (not the same)."""
    less = more = False
    initial_x, initial_y = len(x["given"][0]) == 1, len(y["given"][0]) == 1
    if initial_x or initial_y:
        if not {g[0] for g in x["given"]} & {g[0] for g in y["given"]}:
            return ""
        less, more = initial_x and not initial_y, initial_y and not initial_x
    elif not set(x["given"]) & set(y["given"]) and not (len(x["given"]) == len(y["given"]) == 1 and x["given"][0] not in GIVEN and _near(x["given"][0], y["given"][0])):
        return ""
    if x["middle"] != y["middle"]:
        if x["middle"] and y["middle"]:
            return ""
        less, more = less or not x["middle"], more or not y["middle"]
    a, b = x["surnames"], y["surnames"]
    for s, t in zip(a, b):
        if len(s) == 1 or len(t) == 1:
            if s[0] != t[0]:
                return ""
            less, more = less or len(s) < len(t) == len(t) and len(s) == 1 and len(t) > 1, more or len(t) == 1 and len(s) > 1
        elif not _near(s, t):
            return ""
    if len(a) != len(b):
        less, more = less or len(a) < len(b), more or len(b) < len(a)
    return "" if less and more else "less" if less else "more" if more else "same"


def fullness(p: dict) -> int:
    """How much of the name is given; a shorter form always has less than the fuller one it fits."""
    if p["kind"] == "vendor":
        return 4 * sum(len(t) > 1 for t in p["core"][:2]) * (2 if len(p["core"]) == 1 else 1) + (3 if len(p["trade"]) == 1 else 1 if p["trade"] else 0) + (1 if p["legal"] else 0)
    return 2 * (len(p["given"][0]) > 1) + (1 if p["middle"] else 0) + 2 * sum(2 if len(s) > 1 else 1 for s in p["surnames"])


def join_keys(p: dict) -> list[tuple[str, str, int, str]]:
    """(space, key, k, role): the whole name, and what shorter forms of it share with the fuller one.

    Whole names may differ by one slip a word, so k is 1 for one word, 3 for two or three (a swap takes two
    edits), and the number of words beyond that; below 10 letters segments for k = 3 would tell nothing, and k
    is 1. Keys of a length either could have are in both spaces. Persons with a known given name meet within
    that name only, on their surnames: a given name thousands share would make a segment that tells nothing.
    Shorter forms and fuller ones meet only each other, so that a surname a tenth of all share costs its few
    short forms times its bearers, not the square of these. The side with fewer keys asks (role s).
    """
    out: list[tuple[str, str, int, str]] = []

    def whole(space: str, key: str, words: int, role: str = "") -> None:
        if "rn" in key:
            whole(space, key.replace("rn", "m"), words, role)
        if len(key) <= 11 or words == 1:
            out.append((space, key, 1, role))
        if len(key) >= 10 and words > 1:
            out.append((space, key, max(3, words), role))

    if p["kind"] == "vendor":
        if all(len(t) > 1 for t in p["core"]):
            # the other order is found, and need not be sought
            for key, role in (("".join(p["core"]), ""), ("".join(p["core"][::-1]), "r")):
                if not role or key != "".join(p["core"]):
                    whole("v", key, 2, role)
        if len(p["core"]) > 3:
            whole(f"v{len(p['core'])}", "".join(p["core"]), len(p["core"]))
        if len(p["core"]) == 2:
            a, b = p["core"]
            for word, other in ((a, b), (b, a)):
                if len(word) > 1:
                    whole(f"w{other[0]}", word, 1, "s" if len(other) == 1 else "f")
                    if 1 < len(other) and len(a) + len(b) < 12:
                        # of two short words with a slip each, the other one has its first or its last letter right
                        whole(f"x{other[0]}", word, 1)
                        whole(f"y{other[-1]}", word, 1)
        return list(dict.fromkeys(out))

    lead = list(itertools.takewhile(lambda s: len(s) > 1, p["surnames"]))
    complete = len(lead) == len(p["surnames"])
    parts = ["".join(lead[: n + 1]) for n in range(len(lead))]
    named = [g for g in p["given"] if len(g) > 1]
    # an unknown given name may itself hold a slip: it is part of the key
    bases = [(f"p{g}", "") if g in GIVEN else ("u", g) for g in named] or [(f"i{p['given'][0]}", "")]
    for base, given in bases:
        extra = bool(given)
        for n, key in enumerate(parts, 1):
            last = n == len(parts)
            if last and complete:
                whole(f"{base}={n}", given + key, n + extra)
            # nearly every name may be a shorter form of one with more surnames, which are few: these ask
            if last:
                whole(f"{base}<{n}", given + key, n + extra, "f")
            if not (last and complete):
                whole(f"{base}<{n}", given + key, n + extra, "s")
    for initial in {g[0] for g in p["given"]}:
        for n, key in enumerate(parts, 1):
            if named:
                whole(f"q{initial}{n}", key, n, "f")
            elif n == len(parts):
                whole(f"q{initial}{n}", key, n, "s")
    return list(dict.fromkeys(out))


_TRADE_BITS = {t: 1 << i for i, t in enumerate(TRADES)}
_LEGAL_BITS = {v: 1 << len(TRADES) + i for i, v in enumerate(dict.fromkeys(LEGAL.values()))}
ALL_TRADES, ALL_LEGAL = sum(_TRADE_BITS.values()), sum(_LEGAL_BITS.values())


def kind_bits(p: dict) -> int:
    """The lines of trade and legal forms a company may have; all where the name has none, and for persons."""
    trade, legal = p.get("trade"), p.get("legal")
    return (sum(_TRADE_BITS[t] for t in trade) if trade else ALL_TRADES) | (_LEGAL_BITS[legal] if legal else ALL_LEGAL)


def pack(p: dict) -> str:
    """A parse as a short text, equal for equal parses; unpack reads it."""
    return json.dumps([p["core"], p["trade"], p["legal"]] if p["kind"] == "vendor" else [p["given"], p["middle"], p["surnames"], 0], separators=(",", ":"))


@functools.lru_cache(maxsize=100_000)
def unpack(rid: str) -> dict:
    parts = json.loads(rid)
    if len(parts) == 3:
        return {"kind": "vendor", "core": parts[0], "trade": parts[1], "legal": parts[2]}
    return {"kind": "submitter", "given": parts[0], "middle": parts[1], "surnames": parts[2]}


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, name in zip(batch["kind"], batch["name"]):
            p = parse_company(name) if kind == "vendor" else parse_person(name)
            if p is not None:
                rows.append((kind, name, pack(p), fullness(p)))
        yield pd.DataFrame(rows, columns=["kind", "name", "rid", "fullness"])


def _key_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parsed = [(rid, unpack(rid)) for rid in batch["rid"]]
        rows = [(space, key, k, role, rid, kind_bits(p)) for rid, p in parsed for space, key, k, role in join_keys(p)]
        yield pd.DataFrame(rows, columns=["space", "key", "k", "role", "rid", "kinds"])


def _verify_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, b in zip(batch["left_rid"], batch["right_rid"]):
            x, y = unpack(a), unpack(b)
            if x["kind"] != y["kind"]:
                continue
            verdict = compare_companies(x, y) if x["kind"] == "vendor" else compare_persons(x, y)
            if verdict == "same":
                rows.append(("same", a, b))
            elif verdict:
                rows.append(("less", a, b) if verdict == "less" else ("less", b, a))
        yield pd.DataFrame(rows, columns=["verdict", "a", "b"])


def link_names(names: DataFrame) -> DataFrame:
    """(kind, name, entity): every distinct name with the entity it names; entity is a stable text id.

    names: kind ('vendor' or 'submitter'), name. Other columns are ignored. Null and placeholder names
    are left out; an empty table gives an empty result.
    """
    distinct = names.select("kind", "name").where("name is not null and kind is not null").distinct()
    parsed = cut(distinct.mapInPandas(_parse_batches, "kind string, name string, rid string, fullness int"))
    records = parsed.select("rid", "fullness").distinct()
    # few bytes but much work a row: an explicit number of partitions is not coalesced away
    spread = max(names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = records.select("rid").repartition(spread, F.xxhash64("rid")).mapInPandas(_key_batches, "space string, key string, k int, role string, rid string, kinds bigint")
    candidates = segment_join(keys, records, (ALL_TRADES, ALL_LEGAL)).repartition(spread, "left_rid", "right_rid")
    verified = cut(candidates.mapInPandas(_verify_batches, "verdict string, a string, b string").distinct())

    same = connected_components(verified.where("verdict = 'same'"))
    classes = records.join(same.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("label", "rid").alias("class"), "fullness")
    score = classes.groupBy("class").agg(F.max("fullness").alias("full"))
    scored = cut(classes.select("rid", "class").join(score, "class"))
    side = lambda c: scored.select(F.col("rid").alias(c), F.col("class").alias(f"{c}_class"), F.col("full").alias(f"{c}_full"))
    up = (
        verified.where("verdict = 'less'")
        .join(side("a"), "a")
        .join(side("b"), "b")
        .where("a_class <> b_class and a_full < b_full")
        .select("a_class", "b_class")
        .distinct()
    )
    up = cut(up)
    tops = up.join(up.select(F.col("a_class").alias("b_class")).distinct(), "b_class", "left_anti")
    only = tops.groupBy("a_class").agg(F.count("*").alias("n"), F.min("b_class").alias("top")).where("n = 1")
    final = scored.join(only.select(F.col("a_class").alias("class"), "top"), "class", "left").select("rid", F.coalesce("top", "class").alias("entity"))
    return parsed.join(final, "rid").select("kind", "name", F.sha2("entity", 256).substr(1, 16).alias("entity"))


def name_pairs(linked: DataFrame, block: int = 1000) -> DataFrame:
    """(kind, name_a, name_b) of all different spellings of one entity, name_a < name_b by code points.

    The spellings of an entity are cut into blocks, and pairs of blocks meet, so that an entity with a third
    of all names is spread over as many tasks as it has blocks.
    """
    names = linked.select("kind", "entity", "name").distinct()
    sizes = names.groupBy("kind", "entity").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    spread = names.join(sizes, ["kind", "entity"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    a = spread.select("kind", "entity", own.alias("block"), F.col("name").alias("name_a"))
    b = spread.select("kind", "entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("name").alias("name_b"))
    return a.join(b, ["kind", "entity", "block"]).where("name_a < name_b").select("kind", "name_a", "name_b")
