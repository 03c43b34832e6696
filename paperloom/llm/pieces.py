"""Problem 10: cut long texts into pieces at natural boundaries, each repeating the end of the one before.

A token is a longest run of letters, digits and underscores or a longest run of other characters that are
not white space. A text above the limit is cut at the strongest boundary (paragraph, line, sentence, word)
near its middle; halves still above the limit less the overlap are cut again; then every piece but the
first gets the last tokens of the piece before it.

Null and empty texts have size 0 and come out as one empty piece. A single token is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")

#: The same in the JVM's dialect.
JVM_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{IsWhite_Space}]+"

_SENTENCE_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")


def token_count(text: Column) -> Column:
    """Size of a text in tokens, counted in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(JVM_TOKEN)), F.lit(0))


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the gap before each token: 4 paragraph, 3 line, 2 sentence, 1 word, 0 none."""
    out = [0] * len(spans)
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1] : spans[i][0]]
        if not gap:
            continue
        lines = gap.count("\n") or gap.count("\r")
        if lines >= 2 or "\u2029" in gap:
            out[i] = 4
        elif lines == 1 or "\u2028" in gap:
            out[i] = 3
        else:
            out[i] = 2 if _SENTENCE_END.search(text[spans[i - 1][0] : spans[i - 1][1]]) else 1
    return out


def cuts(strengths: list[int], limit: int, overlap: int) -> list[int]:
    """Numbers of the tokens that begin a piece, after the first, for a text of len(strengths) tokens."""
    n = len(strengths)
    if n <= limit:
        return []
    room, out, open_parts = limit - overlap, [], [(0, n)]
    while open_parts:
        i, j = open_parts.pop()
        size = j - i
        if size <= room or (i == 0 and j < n and size <= limit):
            continue
        middle, best = (i + j) / 2, None
        for share in (0.25, 0.45):
            near = int(size * share)
            low, high = max(i + 1, int(middle) - near, i + min(overlap, size // 3)), min(j - 1, int(middle) + near, j - min(overlap, size // 3))
            best = max(range(low, high + 1), key=lambda c: (strengths[c], -abs(c - middle)))
            if strengths[best] > 0:
                break
        out.append(best)
        open_parts += [(i, best), (best, j)]
    return sorted(out)


def split_text(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first token, end token, start character, character where the new part begins, end character) a piece.

    The parts text[new:end] joined together are the text again.
    """
    text = text or ""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, len(spans), 0, 0, len(text))]
    starts = [0, *cuts(boundary_strengths(text, spans), limit, overlap), len(spans)]
    out = []
    for k, (i, j) in enumerate(zip(starts, starts[1:])):
        first = max(0, i - overlap) if k else 0
        new = spans[i][0] if k else 0
        end = spans[j][0] if j < len(spans) else len(text)
        out.append((first, j, spans[first][0] if k else 0, new, end))
    return out


def split_documents(docs: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, piece, pieces, size, overlap, start_pos, new_pos, end_pos[, piece_text]): every text as pieces of at most `limit` tokens.

    Pieces count from 1. A text of no more characters than the limit can't exceed it and stays in the JVM.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= limit).select(
        "id",
        *(F.lit(1).alias(c) for c in ("piece", "pieces")),
        token_count(F.col("text")).alias("size"),
        *(F.lit(0).alias(c) for c in ("overlap", "start_pos", "new_pos")),
        F.coalesce(F.length("text"), F.lit(0)).alias("end_pos"),
        *([F.coalesce("text", F.lit("")).alias("piece_text")] if with_text else []),
    )
    columns = ["id", "piece", "pieces", "size", "overlap", "start_pos", "new_pos", "end_pos"] + (["piece_text"] if with_text else [])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch["id"], batch["text"]):
                parts, last = split_text(text, limit, overlap), 0
                for k, (i, j, start, new, end) in enumerate(parts, 1):
                    rows.append((doc, k, len(parts), j - i, last - i if k > 1 else 0, start, new, end, *([text[start:end]] if with_text else [])))
                    last = j
                    held += end - start
                if held > 1 << 24:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    schema = f"id {id_type}, piece int, pieces int, size int, overlap int, start_pos int, new_pos int, end_pos int" + (", piece_text string" if with_text else "")
    long = docs.where(F.length("text") > limit).mapInPandas(pieces, schema)
    return short.unionByName(long).withColumnRenamed("id", id_col)
