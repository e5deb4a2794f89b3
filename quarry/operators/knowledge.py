"""Building a knowledge graph from sentences with typed patterns, and its review."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUSTED = 0.75
MARKS = "。！？!?."
SENTENCE = f"[^{MARKS}]+[{MARKS}]*"


@dataclass(frozen=True)
class Entity:
    kind: str
    name: str
    patterns: tuple[str, ...]

    @property
    def id(self) -> str:
        slug = "".join(c if c.isalnum() or c == "_" else " " for c in self.name.lower()).split()
        return f"{self.kind.lower()}:{'-'.join(slug) or 'item'}"


def entities_in(text: Column, entities: Sequence[Entity]) -> Column:
    """Entities with a pattern in the text, in the order of the list, each id once."""
    found = []
    for e in entities:
        hit = reduce(lambda a, p: a | text.rlike(f"(?i){p}"), e.patterns, F.lit(False))
        found.append(F.when(hit, F.struct(F.lit(e.id).alias("id"), F.lit(e.name).alias("name"), F.lit(e.kind).alias("kind"))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def relation_of(sentence: Column, cues: dict[str, Sequence[str]]) -> Column:
    """The first relation, in the order of ``cues``, of which the sentence has a cue."""
    low = F.lower(sentence)
    return F.coalesce(*[F.when(reduce(lambda a, c: a | low.contains(c.lower()), words, F.lit(False)), F.lit(r)) for r, words in cues.items()])


def kg_sentences(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per ``sentence`` that isn't blank, or per line of a text without any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = text.rlike(f"[^{MARKS} ]|[^{MARKS}][{MARKS}]")
    parts = F.when(some, F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(1))).otherwise(F.split(text, "\n"))
    # Outer, as Spark would else cut each text twice: once to see whether there is anything to explode.
    return rows.withColumn("sentence", F.explode_outer(parts)).withColumn("sentence", F.trim("sentence")).filter("sentence <> ''")


def confidence(relation: Column, kind: Column, sentence: Column) -> Column:
    main = F.when(kind == "flowchart", 0.95).when(kind == "text", 0.83).when(kind == "reference", 0.72).otherwise(0.75)
    main = F.least(F.lit(0.99), main + F.when(F.length(sentence) < 120, 0.03).otherwise(0.0))
    return (
        F.when(relation == "NEXT_STEP", F.when(kind == "flowchart", 0.97).otherwise(0.88))
        .when(relation.isin("CONTRAINDICATED_FOR", "NOT_RECOMMENDED_FOR"), F.when(kind == "text", 0.92).otherwise(0.86))
        .when(relation.isin("RECOMMENDS", "APPLIES_TO", "REQUIRES"), main)
        .when(relation == "ASSOCIATED_WITH", F.when(kind == "text", 0.74).otherwise(0.68))
        .when(relation == "CITES", 0.98)
        .when(relation == "MENTIONS", 0.65)
        .otherwise(0.6)
    )


def triple_id() -> Column:
    raw = F.concat_ws("|", "subject_id", "relation", "object_id", F.array_join("evidence_source_ids", "|"), F.substring("evidence_text", 1, 180))
    return F.concat(F.lit("triple:"), F.lpad(F.lower(F.hex(F.crc32(raw))), 8, "0"))


def _pair(subject: Column, object_: Column) -> list[Column]:
    return [c[f].alias(f"{w}_{n}") for w, c in (("subject", subject), ("object", object_)) for f, n in (("id", "id"), ("name", "name"), ("kind", "type"))]


def sentence_triples(chunks: DataFrame, entities: Sequence[Entity], cues: dict[str, Sequence[str]]) -> DataFrame:
    """chunks: ``chunk_id``, ``text``, ``source_ids``. For each sentence with a
    cue, the first entity as the subject and each other one as an object."""
    said = kg_sentences(chunks.select("chunk_id", "source_ids", "text")).drop("text")
    said = said.withColumn("relation", relation_of(F.col("sentence"), cues)).filter("relation is not null")
    # Patterns are tried once for each sentence: a filter on what they find would try them again.
    said = said.withColumn("found", entities_in(F.col("sentence"), entities))
    rows = said.withColumn("object", F.explode_outer(F.slice("found", F.lit(2), F.greatest(F.size("found") - 1, F.lit(0))))).filter("object is not null")
    rows = rows.select(*_pair(F.get("found", F.lit(0)), F.col("object")), "relation", F.col("sentence").alias("evidence_text"), F.concat(F.array("chunk_id"), "source_ids").alias("evidence_source_ids"), F.lit("text").alias("evidence_kind"))
    return rows.withColumn("confidence", confidence(F.col("relation"), F.col("evidence_kind"), F.col("evidence_text")))


def mention_triples(pages: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    """pages: ``page_id``, ``text``. Every two entities of a page, the earlier in the list first."""
    rows = pages.withColumn("found", entities_in(F.col("text"), entities)).select("page_id", "text", "found", F.posexplode_outer("found").alias("i", "subject"))
    rows = rows.withColumn("object", F.explode_outer(F.slice("found", F.col("i") + 2, F.size("found")))).filter("object is not null")
    rows = rows.select(*_pair(F.col("subject"), F.col("object")), F.lit("MENTIONS").alias("relation"), F.substring("text", 1, 1000).alias("evidence_text"), F.array("page_id").alias("evidence_source_ids"), F.lit("text").alias("evidence_kind"))
    return rows.withColumn("confidence", F.lit(0.65))


def article_triples(chunks: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    """chunks: ``chunk_id``, ``article_id``, ``title``. What an article's title mentions."""
    rows = chunks.withColumn("object", F.explode(entities_in(F.col("title"), entities)))
    article = F.struct(F.concat(F.lit("article:"), "article_id").alias("id"), F.col("title").alias("name"), F.lit("Article").alias("kind"))
    rows = rows.select(*_pair(article, F.col("object")), F.lit("MENTIONS").alias("relation"), F.col("title").alias("evidence_text"), F.array("chunk_id").alias("evidence_source_ids"), F.lit("text").alias("evidence_kind"))
    return rows.withColumn("confidence", F.lit(0.65))


def link_triples(links: DataFrame) -> DataFrame:
    """links: ``page_id``, ``source_code``, ``target_code``, ``anchor``, ``kind``, ``text``. Steps from page to page."""
    rows = links.filter((F.col("kind") == "flow") & (F.coalesce("target_code", F.lit("")) != ""))
    name = F.coalesce("source_code", "page_id")
    node = lambda c: F.struct(c.alias("id"), c.alias("name"), F.lit("GuidelinePage").alias("kind"))
    text = F.when(F.coalesce("anchor", F.lit("")) != "", F.col("anchor")).otherwise(F.substring("text", 1, 240))
    rows = rows.select(*_pair(node(name), node(F.col("target_code"))), F.lit("NEXT_STEP").alias("relation"), text.alias("evidence_text"), F.array("page_id").alias("evidence_source_ids"), F.lit("flowchart").alias("evidence_kind"))
    return rows.withColumn("confidence", F.lit(0.97))


def validate(candidates: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that the rules (``subject_type``, ``relation``, ``object_type``)
    allow and that are no loops, with status and id; and the rest."""
    keys = ["subject_type", "relation", "object_type"]
    rows = candidates.withColumn("triple_id", triple_id())
    good = rows.join(rules, keys, "left_semi").filter("subject_id <> object_id")
    bad = rows.join(rules, keys, "left_anti").unionByName(rows.join(rules, keys, "left_semi").filter("subject_id = object_id"))
    trusted = F.col("confidence") >= TRUSTED
    good = good.withColumns(
        {
            "confidence": F.least(F.lit(1.0), F.round("confidence", 3)),
            "validation_status": F.when(trusted, "trusted").otherwise("needs_review"),
            "review_status": F.when(trusted, "auto_trusted").otherwise("pending"),
        }
    )
    return good, bad


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision (by ``pos``) about each triple that has an id."""
    rows = decisions.filter(F.trim(F.coalesce("triple_id", F.lit(""))) != "")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("triple_id").orderBy(F.desc("pos")))).filter("n = 1").drop("n", "pos")


def apply_reviews(triples: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: ``triple_id``, ``decision``, ``new_confidence``, ``by``, ``note``. Rejected triples go."""
    rows = triples.join(decisions, "triple_id", "left")
    word = F.lower(F.coalesce("decision", F.lit("")))
    given = F.col("decision").isNotNull()
    rows = rows.filter(~(given & word.isin("reject", "rejected", "discard", "false")))
    value = F.coalesce("new_confidence", "confidence")
    note = F.coalesce("note", F.lit(""))
    return rows.withColumns(
        {
            "validation_status": F.when(given, F.when(value >= TRUSTED, "trusted").otherwise("needs_review")).otherwise(F.col("validation_status")),
            "review_status": F.when(given, F.when(word.isin("approve", "approved", "accept", "accepted"), "human_trusted").otherwise("human_reviewed")).otherwise(F.col("review_status")),
            "evidence_text": F.when(given & (note != ""), F.concat("evidence_text", F.lit("\n[review_note] "), note)).otherwise(F.col("evidence_text")),
            "confidence": F.when(given, F.least(F.lit(1.0), F.greatest("confidence", value))).otherwise(F.col("confidence")),
        }
    ).drop("decision", "new_confidence", "note")


def review_queue(triples: DataFrame, rejected: DataFrame, below: float = 0.9) -> DataFrame:
    """What a person should look at: unsure triples, and candidates that were rejected."""
    unsure = (F.col("confidence") < below) | (F.col("validation_status") != "trusted") | (F.col("review_status") != "auto_trusted")
    a = triples.filter(unsure).withColumns({"item_type": F.lit("triple"), "action": F.lit("review")})
    b = rejected.withColumns({"item_type": F.lit("candidate"), "action": F.lit("validate")})
    return a.unionByName(b, allowMissingColumns=True)
