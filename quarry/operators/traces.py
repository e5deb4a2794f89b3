"""What an answer was made from: evidence with its sentences and terms, the steps of the graph, and what may ground an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.citations import best_sentence
from quarry.operators.scope import scope_verdict

#: Keywords of a question, characters of a matched sentence, and the shortest name that counts in a question.
KEYWORDS = 8
SENTENCE_CHARS = 260
NAME_CHARS = 3
#: Triples that only stand in for others.
STAND_INS = ("synth:", "fallback:")
NO_WORD = r"[^\p{L}\p{N}_]+"


def keywords(searches: Column, most: int = KEYWORDS) -> Column:
    """The first words of three characters or more of a question's searches, repeated ones too."""
    words = F.flatten(F.transform(F.coalesce(searches, F.array().cast("array<string>")), lambda s: F.split(F.coalesce(s, F.lit("")), NO_WORD)))
    return F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, most)


def paragraph_index(text: Column, sentence: Column) -> Column:
    """Which paragraph (from 0, blank ones left out) has the sentence; 0 if none has."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    at = F.array_position(F.transform(parts, lambda p: (F.length(sentence) > 0) & p.contains(sentence)), True)
    return F.greatest(F.coalesce(at, F.lit(0)) - 1, F.lit(0)).cast("int")


def evidence_trace(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """hits: ``query_id``, ``source_id``, ``rank``, ``score``, ``text``; questions:
    ``query_id``, ``searches``. For each hit its ``matched_sentence``, the
    ``paragraph_index`` of that, the ``matched_terms`` of the question's keywords
    in its text and its score as ``confidence``."""
    rows = hits.join(questions.select("query_id", keywords(F.col("searches")).alias("keywords")), "query_id")
    said = F.substring(best_sentence(F.col("text"), F.col("keywords")), 1, SENTENCE_CHARS)
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"matched_sentence": said, "matched_terms": F.filter("keywords", lambda k: low.contains(F.lower(k)))})
    rows = rows.withColumn("paragraph_index", paragraph_index(F.col("text"), F.col("matched_sentence")))
    return rows.select("query_id", "source_id", "rank", "matched_sentence", "paragraph_index", "matched_terms", F.coalesce("score", F.lit(0.0)).cast("double").alias("confidence"))


def reasoning_trace(questions: DataFrame, hits: DataFrame, triples: DataFrame) -> DataFrame:
    """One row per question (``query_id``, ``query``, ``searches``): ``evidence``
    (``evidence_trace`` by rank), ``steps`` (triples by rank: ``query_id``,
    ``rank``, ``triple_id``, ``subject_name``, ``relation``, ``object_name``,
    ``confidence``), and how many there are. hits and triples are the best few of
    each question; questions without any have empty arrays."""
    found = evidence_trace(hits, questions)
    fields = [c for c in found.columns if c not in ("query_id", "rank")]
    evidence = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("evidence"))
    parts = ("rank", "triple_id", "subject_name", "relation", "object_name", "confidence")
    steps = triples.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("steps"))
    out = questions.select("query_id", F.col("query").alias("question"), keywords(F.col("searches")).alias("keywords"))
    out = out.join(evidence, "query_id", "left").join(steps, "query_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(t[c].dataType)) for c, t in (("evidence", evidence.schema), ("steps", steps.schema))}
    out = out.withColumns(empty)
    return out.withColumns({"evidence_count": F.size("evidence"), "step_count": F.size("steps")})


def is_worthy(triple_id: Column, subject: Column, object_: Column, validation: Column, review: Column) -> Column:
    """Whether a triple may ground an answer: it has both names and isn't a stand-in."""
    named = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    stand_in = [F.coalesce(triple_id.startswith(p), F.lit(False)) for p in STAND_INS]
    return named(subject) & named(object_) & ~stand_in[0] & ~stand_in[1] & (F.coalesce(review, F.lit("")) != "synthetic") & (F.coalesce(validation, F.lit("")) != "fallback")


def prompt_triples(triples: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of ``triples`` (``query_id``, ``triple_id``, names, statuses,
    ``evidence_source_ids``) that may ground the answer to their question
    (``query_id``, ``query``, ``articles``, ``modules``, ``terms``: names of its
    subject). They are worthy, and their sources lie in the question's scope; where
    that can't be told, a name must hold one of the terms or a part (three
    characters at least) that the question has. A question without articles and
    modules has no scope, so all sources lie in it."""
    asked = questions.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("__query"), F.col("articles").alias("__articles"), F.col("modules").alias("__modules"), F.coalesce("terms", F.array().cast("array<string>")).alias("__terms"))
    rows = triples.join(asked, "query_id")
    free = F.col("__articles").isNull() & F.col("__modules").isNull()
    none = F.array().cast("array<string>")
    verdict = F.when(free, True).otherwise(scope_verdict(F.coalesce("evidence_source_ids", none), F.coalesce("__articles", none), F.coalesce("__modules", none)))
    names = F.lower(F.concat_ws(" ", "subject_name", "object_name"))
    hit = F.exists("__terms", lambda t: names.contains(F.lower(t))) | F.exists(F.split(names, NO_WORD), lambda p: (F.length(p) >= NAME_CHARS) & F.col("__query").contains(p))
    worthy = is_worthy(*map(F.col, ("triple_id", "subject_name", "object_name", "validation_status", "review_status")))
    return rows.filter(worthy & F.coalesce(verdict, hit)).select(*triples.columns)
