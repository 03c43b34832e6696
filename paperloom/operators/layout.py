"""Layout: split texts into lines and lines into typed elements, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import bind, group, normalize_text

# Patterns of lines, keys, pairs, list items and columns.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_KEY = r"[A-Za-z][A-Za-z0-9 .#/&()%_'\-]{0,60}?"
PAIR = rf"(?U)^\s*(?:\d{{1,2}}[.)]\s+)?({_KEY})\s*[:：]\s*(\S.*?)\s*$"
KEY_ALONE = rf"(?U)^\s*({_KEY})\s*[:：]\s*$"
ITEM = r"(?U)^\s*(?:[-*•▪]|\d+[.)]|[a-z][.)])\s+\S"
COLUMNS = r"(?U)\S(?:\s{2,}|\t|\s\|\s)\S"
GAP = r"(?U)\s{2,}|\t"
TITLE_CASE = r"^[^\p{L}]*\p{Lu}\p{Ll}*(?:[^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$"
LONGEST_VALUE = 200


def lines(text: Column) -> Column:
    """The lines of a text, without a last empty one."""
    parts = F.split(text, LINE_BREAK)
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: White space as the JVM's Unicode classes have it, for trimming without a pattern.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = "\ue000"


def bare_line(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def read_pair(bare: Column) -> Column:
    """struct<key, value> of a line that is a pair, by one match of the pattern; null for any other line.

    The match puts a mark between key and value; a key never holds the mark, so the first one is it.
    """
    colon = bare.contains(":") | bare.contains("：")

    def halves(marked: Column) -> Column:
        return F.when(marked != bare, F.struct(F.btrim(F.substring_index(marked, _CUT, 1)).alias("key"), F.btrim(F.substr(marked, F.instr(marked, _CUT) + 1)).alias("value")))

    return F.when(colon, bind(F.regexp_replace(bare, PAIR, f"$1{_CUT}$2"), halves))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def category(line: Column) -> Column:
    """Title, KeyValue, ListItem, NarrativeText, Table or Other, the first that fits."""
    return bind(bare_line(line), lambda bare: _category(bare, read_pair(bare)))


def _category(bare: Column, pair: Column) -> Column:
    title = ((F.upper(bare) == bare) & (F.lower(bare) != bare)) | (bare.rlike(TITLE_CASE) & ~bare.endswith("."))
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "Other")
        .when(F.coalesce(F.length(pair["value"]) <= LONGEST_VALUE, F.lit(False)), "KeyValue")
        .when(bare.rlike(ITEM), "ListItem")
        .when(bare.rlike(COLUMNS) & (_words(bare) >= 3), "Table")
        .when(title & (_words(bare) <= 8), "Title")
        .otherwise("NarrativeText")
    )


def element(line: Column) -> Column:
    def build(bare: Column) -> Column:
        return bind(F.struct(read_pair(bare).alias("pair")), lambda held: of_pair(bare, held["pair"]))

    def of_pair(bare: Column, pair: Column) -> Column:
        kind = _category(bare, pair)
        return bind(kind, lambda k: F.struct(k.alias("category"), bare.alias("text"), F.when(k == "KeyValue", pair["key"]).alias("key"), F.when(k == "KeyValue", pair["value"]).alias("value")))

    return bind(bare_line(line), build)


_PAIR_TYPE = "array<struct<key:string,value:string>>"


def split_pairs(line: Column) -> Column:
    """array<struct<key, value>> of several key: value cells in one line; empty if the line is not such.

    One pass from the left holds a key that stands alone until the next cell; a cell without a colon is its
    value. Two pairs, or one whose key stood alone in the first cell, are needed.
    """
    cells = F.filter(F.transform(F.split(line, GAP), bare_line), lambda c: c != "")
    none = F.lit(None).cast("string")
    pair = lambda k, v: F.struct(F.btrim(k).alias("key"), F.btrim(v).alias("value"))
    start = F.struct(none.alias("held"), F.expr("array()").cast(_PAIR_TYPE).alias("pairs"))

    def step(acc: Column, cell: Column) -> Column:
        return bind(F.struct(read_pair(cell).alias("pair")), lambda held: with_pair(acc, cell, held["pair"]))

    def with_pair(acc: Column, cell: Column, full: Column) -> Column:
        closes = acc["held"].isNotNull() & ~cell.contains(":") & ~cell.contains("：")
        held = F.when(full.isNull() & cell.rlike(KEY_ALONE), group(cell, KEY_ALONE)).otherwise(none)
        added = F.when(full.isNotNull(), F.array(full)).when(closes, F.array(pair(acc["held"], cell))).otherwise(F.expr("array()").cast(_PAIR_TYPE))
        return F.struct(held.alias("held"), F.concat(acc["pairs"], added).alias("pairs"))

    found = F.aggregate(cells, start, step)["pairs"]
    enough = (F.size(found) >= 2) | ((F.size(found) == 1) & F.get(cells, F.lit(0)).rlike(KEY_ALONE))
    usable = (F.size(cells) >= 2) & (line.contains(":") | line.contains("："))
    return F.when(usable & enough, found).otherwise(F.expr("array()").cast(_PAIR_TYPE))


def elements(text: Column) -> Column:
    """array<struct<category, text, key, value>> of a text, in order, without empty lines."""

    def of_pairs(line: Column, pairs: Column) -> Column:
        as_elements = F.transform(pairs, lambda p: F.struct(F.lit("KeyValue").alias("category"), F.concat(p["key"], F.lit(": "), p["value"]).alias("text"), p["key"].alias("key"), p["value"].alias("value")))
        return F.when(F.size(pairs) > 0, as_elements).otherwise(F.array(element(line)))

    def of_line(line: Column) -> Column:
        spaced = line.contains("  ") | line.contains("\t")
        return F.when(spaced, bind(split_pairs(line), lambda pairs: of_pairs(line, pairs))).otherwise(F.array(element(line)))

    return F.filter(F.flatten(F.transform(lines(text), of_line)), lambda e: e["text"] != "")


def explode_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, category, text, key, value): one row an element, pos from 0. Null and empty texts have none."""
    rows = docs.select(id_col, F.posexplode(elements(F.col(text_col))).alias("pos", "e"))
    return rows.select(id_col, "pos", "e.category", F.col("e.text").alias("text"), "e.key", "e.value")


def from_partition(parts: Column) -> Column:
    """array<struct<category, text, key, value>> from the elements another partitioner gives (array<struct<category, text>>).

    Titles, list items and tables stay what they are; of all else a pair is a pair and the rest is text.
    """

    def one(part: Column) -> Column:
        bare = bare_line(part["text"])
        kept = part["category"].isin("Title", "ListItem", "Table")
        return bind(
            F.struct(bare.alias("t"), F.when(~kept, read_pair(bare)).alias("p")),
            lambda h: F.struct(
                F.when(kept, part["category"]).when(h["p"].isNotNull(), "KeyValue").otherwise("NarrativeText").alias("category"), h["t"].alias("text"), h["p"]["key"].alias("key"), h["p"]["value"].alias("value")
            ),
        )

    return F.filter(F.transform(parts, one), lambda e: e["text"] != "")


def key_values(elements_col: Column) -> Column:
    """array<struct<pos, key, nkey, value>> of the pairs with both a key and a value."""
    numbered = F.transform(elements_col, lambda e, i: F.struct(i.alias("pos"), e["category"].alias("category"), e["key"].alias("key"), e["value"].alias("value")))
    pairs = F.filter(numbered, lambda e: (e["category"] == "KeyValue") & (e["key"] != "") & (e["value"] != ""))
    return F.transform(pairs, lambda e: F.struct(e["pos"], e["key"], normalize_text(e["key"]).alias("nkey"), e["value"]))


# --- recognised words of scanned pages -------------------------------------------------------------


def assemble_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, text, confidence, n_words): pages from recognised words.

    words: doc_id, page, block, par, line, seq, text, conf. Blank words are dropped; lines come in the order
    of (block, paragraph, line), words in that of seq. confidence is the mean of the words' conf >= 0, over
    100, and 0 if there is none. A page is what one task holds.
    """
    kept = words.where("text is not null and trim(text) <> ''")
    by_line = kept.groupBy("doc_id", "page", "block", "par", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ").alias("line_text"),
        F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf_sum"),
        F.count(F.when(F.col("conf") >= 0, 1)).alias("conf_n"),
        F.count("*").alias("n"),
    )
    return by_line.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "par", "line", "line_text"))), lambda w: w["line_text"]), "\n").alias("text"),
        F.coalesce(F.try_divide(F.sum("conf_sum"), F.sum("conf_n")) / 100, F.lit(0.0)).alias("confidence"),
        F.sum("n").alias("n_words"),
    )


def number_lines(words: DataFrame) -> DataFrame:
    """words with line_no: lines counted from 0 in the order their first word appears on the page."""
    page = Window.partitionBy("doc_id", "page")
    first = words.where("text is not null and trim(text) <> ''").withColumn("__first", F.min("seq").over(Window.partitionBy("doc_id", "page", "block", "par", "line")))
    return first.withColumn("line_no", F.dense_rank().over(page.orderBy("__first")) - 1).drop("__first")
