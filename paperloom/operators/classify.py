"""Document types from weighted keywords: one pass over the text, no join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.dims import DOC_TYPES, KEYWORDS, MAX_HITS
from paperloom.functions.scalars import bind


def needed_texts(pattern: str) -> list[str]:
    """Plain texts of which a match of a keyword's pattern holds at least one: a cheap look before the pattern."""
    plain = pattern.replace(r"\b", "").removesuffix(r"\s*")
    head, _, choice = plain.partition("(?:")
    return [head] if head else choice.rstrip(")").split("|")


def _hits(low: Column, pattern: str) -> Column:
    """How often a pattern is found; most texts hold few keywords, and looking for plain text costs little."""
    present = reduce(lambda a, b: a | b, [low.contains(t) for t in needed_texts(pattern)])
    return F.when(present, F.least(F.regexp_count(low, F.lit("(?U)" + pattern)), F.lit(MAX_HITS))).otherwise(0)


def keyword_scores(text: Column) -> Column:
    """map<type, score>: the weights of the patterns found, each counted at most three times."""

    def score(low: Column, doc_type: str) -> Column:
        return F.round(reduce(lambda a, b: a + b, [_hits(low, p) * F.lit(w) for p, w in KEYWORDS[doc_type]]), 3)

    return bind(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.create_map(*[x for t in DOC_TYPES for x in (F.lit(t), score(low, t))]))


def best_type(scores: Column) -> Column:
    """struct<doc_type, confidence>: the type with the highest score, with the margin to the second as confidence.

    Ties go to the type declared first; a document without any hit is a form with confidence 0.35.
    """

    def rank(held: Column) -> Column:
        return F.array_sort(F.array(*[F.struct((-F.element_at(held, F.lit(t))).alias("score"), F.lit(i).alias("ord"), F.lit(t).alias("doc_type")) for i, t in enumerate(DOC_TYPES)]))

    def pick(ranked: Column) -> Column:
        best, second = -ranked[0]["score"], -ranked[1]["score"]
        margin = (best - second) / F.greatest(best, F.lit(1.0))
        return F.struct(
            F.when(best > 0, ranked[0]["doc_type"]).otherwise("form").alias("doc_type"),
            F.when(best > 0, F.round(0.35 + 0.6 * F.least(F.lit(1.0), margin), 3)).otherwise(0.35).alias("confidence"),
        )

    return bind(scores, lambda held: bind(rank(held), pick))


def model_type(answer: Column) -> Column:
    """struct<doc_type, confidence> from a model's JSON answer; null for an unknown type or no number."""
    doc_type = F.lower(F.trim(F.get_json_object(answer, "$.type")))
    said = F.get_json_object(answer, "$.confidence")
    confidence = F.when(said.isNull(), 0.8).otherwise(said.try_cast("double"))
    good = doc_type.isin(*DOC_TYPES) & confidence.isNotNull()
    return F.when(good, F.struct(doc_type.alias("doc_type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence")))


def classify(text: Column, answer: Column | None = None, requested: Column | None = None) -> Column:
    """struct<doc_type, confidence, method>: as requested, else by the model's answer, else by keywords.

    With an answer that can't be used, the keywords' confidence is capped at 0.6.
    """
    return bind(best_type(keyword_scores(text)), lambda keywords: _decide(keywords, answer, requested))


def _decide(keywords: Column, answer: Column | None, requested: Column | None) -> Column:
    pack = lambda s, c, m: F.struct(s["doc_type"].alias("doc_type"), c.alias("confidence"), F.lit(m).alias("method"))
    out = pack(keywords, keywords["confidence"], "heuristic")
    if answer is not None:
        model = model_type(answer)
        out = F.when(answer.isNull(), out).when(model.isNotNull(), pack(model, model["confidence"], "model")).otherwise(pack(keywords, F.least(keywords["confidence"], F.lit(0.6)), "heuristic"))
    if requested is not None:
        out = F.when(requested.isin(*DOC_TYPES), F.struct(requested.alias("doc_type"), F.lit(1.0).alias("confidence"), F.lit("requested").alias("method"))).otherwise(out)
    return out
