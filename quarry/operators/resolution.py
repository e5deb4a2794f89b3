"""What a question names, what else to search for, and where a graph search begins and ends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_decision_page, page_code, token_set
from quarry.operators.knowledge import Entity
from quarry.operators.scope import ordered_union

DIGITS = 6
#: Confidence of edges with a general relation and with another, and what a name in the question adds.
GENERAL_RELATIONS = ("RELATED_TO", "EDGE")
GENERAL, NAMED, SAID = 0.66, 0.8, 0.08
#: Score of triples around the best hits, and for each hop up to two; confidence of stand-ins, and for each rank.
AROUND, HOP = 0.72, 0.12
STAND_IN, RANK = 0.58, 0.03


def mentions(text: Column, pattern: str, terms: Sequence[str]) -> Column:
    """What the pattern finds in a text (in its own case) and those of ``terms``
    that it contains in any case; sorted, each once."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    listed = F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t)))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), listed)))


def expand_queries(queries: DataFrame, hints: Mapping[str, str], pattern: str, terms: Sequence[str], contexts: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """queries: ``query_id``, ``query``. Adds ``entities`` and ``searches``: the
    question, the hint of each word of ``hints`` that it contains, its entities,
    and for each entity the first of ``contexts`` (pattern, words) that it
    matches; each once, blanks left out."""
    question = F.trim(F.coalesce("query", F.lit("")))
    rows = queries.withColumn("entities", mentions(question, pattern, terms))
    said = F.array_compact(F.array(*[F.when(question.contains(k), F.lit(v)) for k, v in hints.items()])) if hints else F.array().cast("array<string>")
    named = F.when(F.size("entities") > 0, F.array(F.array_join("entities", " "))).otherwise(F.array().cast("array<string>"))
    about = lambda e: F.coalesce(*[F.when(e.rlike(p), F.concat(e, F.lit(f" {words}"))) for p, words in contexts], F.lit(""))
    around = F.transform("entities", about)
    searches = F.concat(F.array(question), said, named, around)
    return rows.withColumn("searches", F.array_distinct(F.filter(F.transform(searches, F.trim), lambda s: s != "")))


def _aliases(entities: Sequence[Entity]) -> dict[str, Entity]:
    """Names, ids and patterns in lower case; of equal ones the last holds."""
    return {key.lower(): e for e in entities for key in (e.name, e.id, *e.patterns)}


def normalized(term: Column, entities: Sequence[Entity]) -> Column:
    """The entity that a term names: by name, id or pattern as it stands, else
    the first pattern that is found in it. Null if none."""
    aliases = _aliases(entities)
    struct = lambda e: F.struct(F.lit(e.id).alias("id"), F.lit(e.name).alias("name"))
    low = F.lower(F.trim(term))
    exact = [F.when(low == key, struct(e)) for key, e in aliases.items()]
    found = [F.when(term.rlike(f"(?i){key}"), struct(e)) for key, e in aliases.items()]
    return F.coalesce(*exact, *found)


def resolve_entities(queries: DataFrame, entities: Sequence[Entity], phrases: Mapping[str, str]) -> DataFrame:
    """queries: ``query_id``, ``query``. The entities that a question names, a
    row each (``query_id``, ``entity``, ``name``): by its tokens and its words
    between spaces, commas and question marks; without any, by entity names that
    it contains; and in any case by ``phrases`` (name by needle)."""
    text = F.coalesce("query", F.lit(""))
    low = F.lower(text)
    words = F.filter(F.split(text, r"[\s,，?？]+"), lambda w: w != "")
    tokens = queries.select("query_id", F.explode(F.array_distinct(F.concat(token_set(text), words))).alias("term"))
    # A term is looked up once, however many questions have it.
    terms = tokens.select("term").distinct().withColumn("hit", normalized(F.col("term"), entities)).filter("hit is not null")
    by_token = tokens.join(terms, "term").select("query_id", "hit.id", "hit.name").distinct()
    struct = lambda e: F.struct(F.lit(e.id).alias("id"), F.lit(e.name).alias("name"))
    inside = lambda pairs: F.array_compact(F.array(*[F.when(low.contains(needle), struct(e)) for needle, e in pairs]))
    aliases = _aliases(entities)
    named = queries.select("query_id", F.explode(inside([(e.name.lower(), e) for e in entities])).alias("e")).join(by_token, "query_id", "left_anti")
    parts = [by_token, named.select("query_id", "e.*")]
    known = [(needle, aliases[name.lower()]) for needle, name in phrases.items() if name.lower() in aliases]
    if known:
        parts.append(queries.select("query_id", F.explode(inside(known)).alias("e")).select("query_id", "e.*"))
    return reduce(DataFrame.unionByName, parts).select("query_id", F.col("id").alias("entity"), "name").distinct()


def edge_triples(edges: DataFrame, nodes: DataFrame, queries: DataFrame, near: DataFrame) -> DataFrame:
    """Edges as triples with a score for each question near whose seeds they lie.

    edges: ``edge_id``, ``source``, ``relation``, ``target``; nodes: ``node``,
    ``name``, ``kind``; near: ``query_id``, ``entity`` (see ``graph.reach``).
    Edges of nodes without a name of their own are left out. Named relations
    are surer than general ones, and a name in the question counts."""
    who = lambda side: nodes.select(F.col("node").alias(side), F.col("name").alias(f"{side}_name"), F.col("kind").alias(f"{side}_type"))
    rows = edges.join(who("source"), "source").join(who("target"), "target")
    own = lambda side: F.coalesce(F.trim(f"{side}_name"), F.lit("")) != ""
    rows = rows.filter(own("source") & own("target") & (F.col("source_name") != F.col("source")) & (F.col("target_name") != F.col("target")))
    rows = rows.withColumn("confidence", F.when(F.col("relation").isin(*GENERAL_RELATIONS), GENERAL).otherwise(NAMED))
    ends = near.select("query_id", "entity")
    asked = rows.join(ends.withColumnRenamed("entity", "source"), "source").unionByName(rows.join(ends.withColumnRenamed("entity", "target"), "target")).dropDuplicates(["query_id", "edge_id"])
    low = F.lower(F.coalesce("query", F.lit("")))
    said = low.contains(F.lower("source_name")) | low.contains(F.lower("target_name"))
    asked = asked.join(queries, "query_id").withColumn("score", F.round(F.col("confidence") + F.when(said, SAID).otherwise(0.0), DIGITS))
    return asked.select(
        "query_id",
        F.concat(F.lit("edge:"), "edge_id").alias("triple_id"),
        F.col("source").alias("subject_id"),
        F.col("source_name").alias("subject_name"),
        "relation",
        F.col("target").alias("object_id"),
        F.col("target_name").alias("object_name"),
        "confidence",
        "score",
    )


def merge_hits(lists: Sequence[DataFrame], top_k: int) -> DataFrame:
    """Hits of several stages (``query_id``, ``triple_id``, ``score``,
    ``confidence``) by score, then confidence; each triple once with its best
    hit, the first ``top_k``. Adds ``stage``, the number of the list, and ``rank``."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "triple_id", "score", "confidence", F.lit(k).alias("stage")) for k, x in enumerate(lists)])
    best = [F.desc("score"), F.desc("confidence"), F.col("stage")]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "triple_id").orderBy(*best))).filter("n = 1").drop("n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best, "triple_id"))).filter(F.col("rank") <= top_k)


def expanded_hits(subgraph: DataFrame, triples: DataFrame, depth: int = 1) -> DataFrame:
    """Triples of a subgraph around the best hits (``graph.subgraph``) as hits of one score, by the depth walked."""
    score = round(AROUND + HOP * min(2, depth), DIGITS)
    return subgraph.select("query_id", "triple_id").join(triples.select("triple_id", "confidence"), "triple_id").select("query_id", "triple_id", F.lit(score).alias("score"), "confidence")


def seed_candidates(triples: DataFrame, pages: DataFrame, names: DataFrame, most: int = 8, of_triples: int = 6, of_pages: int = 4) -> DataFrame:
    """Where to look next, in order, each once, at most ``most`` for a question:
    both ends of its best ``of_triples`` triples, codes and modules of its best
    ``of_pages`` pages, then what it names. triples: ``query_id``, ``rank``,
    ``subject_name``, ``object_name``; pages: ``query_id``, ``rank``, ``code``,
    ``module``; names: ``query_id``, ``name``."""

    def pairs(rows: DataFrame, n: int, *columns: str) -> DataFrame:
        both = rows.filter(F.col("rank") <= n).select("query_id", "rank", F.posexplode(F.array(*columns)).alias("k", "item"))
        return both.select("query_id", F.trim("item").alias("item"), (F.col("rank") * len(columns) + F.col("k")).alias("place"))

    named = names.select("query_id", F.trim("name").alias("item"), F.lit(0).alias("place"))
    lists = [pairs(triples, of_triples, "subject_name", "object_name"), pairs(pages, of_pages, "code", "module"), named]
    return ordered_union([x.filter("item <> ''") for x in lists], most)


def article_rollup(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """chunks: ``article_id``, ``pos``, ``title``, ``reference_ids``; references:
    ``article_id``, ``ref_number``. Of each article: ``title`` (the first that
    isn't empty, else its id), ``chunk_count`` and ``reference_count``, the
    different numbers that its chunks or entries have."""
    titled = F.min(F.when(F.coalesce("title", F.lit("")) != "", F.struct("pos", "title")))
    of_chunks = chunks.groupBy("article_id").agg(F.count("*").alias("chunk_count"), titled["title"].alias("title"))
    numbers = chunks.select("article_id", F.explode("reference_ids").alias("ref_number")).unionByName(references.select("article_id", "ref_number")).filter("ref_number is not null").distinct()
    counts = numbers.groupBy("article_id").agg(F.count("*").alias("reference_count"))
    rows = of_chunks.join(counts, "article_id", "full_outer").join(references.select("article_id").distinct(), "article_id", "full_outer")
    return rows.select("article_id", F.coalesce("title", "article_id").alias("title"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chunk_count", "reference_count")))


def chunk_sources(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """chunks: ``chunk_id``, ``article_id``, ``reference_ids``; references:
    ``article_id``, ``ref_number``, ``entry_id`` (of equal ones the greatest id
    holds). ``source_ids``: the chunk, then the entries it cites, in its order."""
    entries = references.groupBy("article_id", "ref_number").agg(F.max("entry_id").alias("entry_id"))
    cited = chunks.select("chunk_id", "article_id", F.posexplode("reference_ids").alias("at", "ref_number")).join(entries, ["article_id", "ref_number"])
    found = cited.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entry_id"))), lambda x: x["entry_id"]).alias("entries"))
    rows = chunks.select("chunk_id").join(found, "chunk_id", "left")
    return rows.select("chunk_id", F.concat(F.array("chunk_id"), F.coalesce("entries", F.array().cast("array<string>"))).alias("source_ids"))


def entry_page(text: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The page of the first rule (words, page) of which a text has a word, in any case; null without."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cases = [F.when(reduce(lambda a, w: a | low.contains(w.lower()), words, F.lit(False)), F.lit(page)) for words, page in rules]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def seed_pages(queries: DataFrame, hits: DataFrame, rules: Sequence[tuple[Sequence[str], str]], page_type: str = "clinical_guideline") -> DataFrame:
    """The page where a question's walk begins: by ``rules``, else the best hit
    (``query_id``, ``rank``, ``page_type``, ``code``) that is a decision page.
    ``seed`` and ``origin``: intent_map, hit_fallback or none."""
    decisions = hits.filter((F.col("page_type") == page_type) & is_decision_page("code"))
    best = decisions.groupBy("query_id").agg(F.min_by(page_code("code"), F.struct("rank", "code")).alias("best"))
    rows = queries.join(best, "query_id", "left").withColumn("intent", entry_page(F.col("query"), rules))
    origin = F.when(F.col("intent").isNotNull(), "intent_map").when(F.col("best").isNotNull(), "hit_fallback").otherwise("none")
    return rows.select("query_id", F.coalesce("intent", "best").alias("seed"), origin.alias("origin"))


def source_triples(hits: DataFrame, seeds: DataFrame, needed: int = 2, chars: int = 240) -> DataFrame:
    """Stand-ins where a graph has too little: the first seed of each question
    mentions the sources of its best hits. hits: ``query_id``, ``rank``,
    ``source_id``, ``code``, ``text``; seeds: ``query_id``, ``item``, ``position``."""
    name = F.coalesce(F.nullif(F.trim("code"), F.lit("")), "source_id")
    rows = hits.withColumn("object_name", name).join(seeds.filter("position = 1").select("query_id", "item"), "query_id", "left")
    rows = rows.join(hits.filter("rank = 1").select("query_id", name.alias("own")), "query_id", "left").filter(F.col("rank") <= needed)
    rows = rows.withColumn("subject_name", F.coalesce("item", "own"))
    confidence = F.round(STAND_IN + RANK * F.col("rank"), DIGITS)
    return rows.select(
        "query_id",
        F.concat_ws(":", F.lit("synth"), "rank", "subject_name", "object_name").alias("triple_id"),
        "subject_name",
        F.lit("MENTIONS").alias("relation"),
        "object_name",
        confidence.alias("confidence"),
        confidence.alias("score"),
        F.substring("text", 1, chars).alias("evidence_text"),
    )


def node_focus(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges (``source``, ``relation``, ``target``) that touch each seed (``query_id``, ``entity``), each once."""
    keep = ["query_id", "source", "relation", "target"]
    ends = [edges.join(seeds.select("query_id", F.col("entity").alias(side)), side).select(*keep) for side in ("source", "target")]
    return ends[0].unionByName(ends[1]).distinct()


def merged_concepts(nodes: DataFrame) -> DataFrame:
    """nodes: ``node``, ``label``, ``kind``. Nodes with one name are one concept:
    ``concept``, the ``kind`` and ``label`` of the first by id, and how many
    (``n``) and which (``nodes``, sorted) it joins. Triple nodes are none."""
    key = F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), r"\s+", " ")), F.lit(""))
    rows = nodes.filter(F.lower(F.coalesce("kind", F.lit(""))) != "triple").withColumn("concept", F.coalesce(key, F.col("node")))
    first = F.min(F.struct("node", "kind", "label"))
    return rows.groupBy("concept").agg(first["kind"].alias("kind"), first["label"].alias("label"), F.count_distinct("node").alias("n"), F.array_sort(F.collect_set("node")).alias("nodes"))


def graph_statistics(triples: DataFrame, candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: candidates, rejected ones, triples and those that are trusted."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    trusted = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("validation_status") == "trusted").alias("trusted"))
    return trusted.crossJoin(count(candidates, "candidates")).crossJoin(count(rejected, "rejected"))  # rows of one


def chapter_of(text: Column, chapters: Sequence[tuple[str, str]]) -> Column:
    """chapters: title and id. The id of the longest title that a line has, spaces apart."""
    squashed = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))
    ordered = sorted(chapters, key=lambda c: -len(c[0]))
    return F.coalesce(*[F.when(squashed.contains(t.replace(" ", "")), F.lit(i)) for t, i in ordered])
