"""Ranking literature: evidence tiers, journals, citations in guidelines, relevance."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_any, doi_key, journal_key, overlap, pieces, title_key, token_set
from quarry.tables import stage

#: Scores of journal tiers; a journal that isn't known has the last.
JOURNAL_SCORES = {"T0": 1.0, "T1": 0.9, "T2G": 0.85, "T2": 0.75, "T3": 0.4}
UNKNOWN_JOURNAL = 0.55
#: Publication types of weak evidence, and those that are penalised.
WEAK_TYPES = ("case reports", "letter", "editorial", "comment", "news", "published erratum")
PENALTY_TYPES = ("editorial", "letter", "comment", "news", "published erratum", "retracted publication")
#: Names of registration trials.
TRIALS = ("ZUMA[-\\s]?\\d*", "JULIET", "TRANSCEND", "TRANSFORM", "BELINDA", "EPCORE", "POLARIX", "GOYA", "PHOENIX", "ROSEWOOD", "LOTIS", "STARGLO", "ALEXANDER", "PILOT", "ELARA", "CARTITUDE", "KARMA")
#: Patterns of single-arm and registration trials, of evidence from practice, and of phase two.
SINGLE_ARM = ("single[- ]arm", "single[- ]center", "open[- ]label", "pivotal", "registrational", "seamless", r"phase\s*1b/?2", r"phase\s*i/?ii", r"phase\s*ib/?ii")
REAL_WORLD = ("real[- ]world", "retrospective", "observational", "chart review", r"multicen(?:ter|tre)\s+retrospective")
PHASE_TWO = r"phase\s*(ii|2|1b/?2|i/?ii|ib/?ii)"


@dataclass(frozen=True)
class Concepts:
    """What a question is about."""

    terms: tuple[str, ...] = ()
    biomarkers: tuple[str, ...] = ()
    interventions: tuple[str, ...] = ()
    target_mesh: tuple[str, ...] = ()
    target_terms: tuple[str, ...] = ()
    competing: tuple[tuple[str, ...], ...] = ()
    lines: tuple[tuple[str, ...], ...] = field(default=())

    @property
    def must(self) -> tuple[str, ...]:
        return tuple(t.lower() for t in (*self.biomarkers, *self.interventions) if t)


def _squashed(text: Column) -> Column:
    return F.regexp_replace(text, "[- ]", "")


def mentions(text: Column, term: str) -> Column:
    """Whether a lower-case text has the term, with or without its hyphens and spaces."""
    return text.contains(term) | _squashed(text).contains(term.replace("-", "").replace(" ", ""))


def _said(text: Column, *patterns: str) -> Column:
    """Whether a pattern is found as a word or words, in any case."""
    return text.rlike(rf"(?i)\b({'|'.join(patterns)})\b")


def evidence_tier(title: Column, abstract: Column, pub_types: Column, in_guideline: Column) -> Column:
    """E1 (strongest) to E5. The order of the cases is the rule; publication
    types are searched as one text, so phase i also finds phase ii."""
    text = F.concat_ws("\n", title, abstract)
    types = F.lower(F.array_join(pub_types, " | "))
    has = lambda *needles: contains_any(types, needles)
    weak = has(*WEAK_TYPES) | (has("review") & ~has("systematic review", "meta-analysis"))
    phase_two = has("clinical trial, phase ii", "clinical trial, phase 2") | _said(text, PHASE_TWO)
    phase_one = has("clinical trial, phase i", "clinical trial, phase 1")
    pivotal = _said(text, *TRIALS, *SINGLE_ARM)
    strong = has("meta-analysis", "systematic review", "guideline", "randomized controlled trial", "clinical trial, phase iii", "clinical trial, phase 3")
    named = text.rlike(r"(?i)\bphase\s*(iii|3)\b") & text.rlike(r"(?i)\brandomi[sz]ed\b|\brct\b")
    return (
        F.when(weak & in_guideline, "E1")
        .when(weak, "E5")
        .when(strong | named | in_guideline, "E1")
        .when(pivotal & (phase_two | phase_one | has("clinical trial")), "E2")
        .when(_said(text, *REAL_WORLD) | has("retrospective studies", "case-control studies"), "E4")
        .otherwise("E3")
    )


def journal_index(journals: DataFrame) -> DataFrame:
    """Keys of journals (``pos``, ``full_name``, ``iso_abbr``, ``aliases``): the first journal with a key has it."""
    names = F.concat(F.array("full_name", "iso_abbr"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = journals.select("*", F.posexplode(names).alias("at", "name")).withColumn("key", journal_key("name")).filter("key <> ''")
    return keys.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("pos", "at"))).filter("n = 1").drop("n", "name")


#: Characters that two keys must share at the start of the shorter one before they are compared.
STEM = 8


def join_journals(articles: DataFrame, index: DataFrame, id_col: str = "pmid", name_col: str = "journal") -> DataFrame:
    """Each article's journal: by its key, else the first whose key contains the
    article's or is contained in it. Containment is tried for the different
    names that no key equals, where the first ``STEM`` characters of the one
    (all of a shorter one) stand somewhere in the other."""
    rows = articles.withColumn("key", journal_key(name_col))
    index = index.select("key", "at", F.col("pos").alias("journal_pos"), F.col("tier").alias("journal_tier"))
    exact = rows.select("key").distinct().join(index, "key", "left")
    open_ = exact.filter("journal_pos is null and key <> ''").select("key")
    stem = lambda key: F.substring(key, 1, STEM)
    known = index.select(F.struct("journal_pos", "at", "journal_tier").alias("journal"), F.col("key").alias("other"))
    inside = open_.withColumn("piece", F.explode(pieces(F.col("key"), STEM))).join(known.withColumn("piece", stem(F.col("other"))), "piece").filter(F.col("key").contains(F.col("other")))
    around = open_.withColumn("piece", stem(F.col("key"))).join(known.withColumn("piece", F.explode(pieces(F.col("other"), STEM))), "piece").filter(F.col("other").contains(F.col("key")))
    soft = inside.select("key", "journal").unionByName(around.select("key", "journal")).groupBy("key").agg(F.min("journal").alias("m"))
    soft = soft.select("key", "m.journal_pos", "m.journal_tier")
    found = exact.filter("journal_pos is not null").select("key", "journal_pos", "journal_tier").unionByName(soft)
    return rows.join(found, "key", "left").drop("key")


def journal_score(tier: Column) -> Column:
    return reduce(lambda c, kv: c.when(tier == kv[0], kv[1]), JOURNAL_SCORES.items(), F.when(F.lit(False), 0.0)).otherwise(UNKNOWN_JOURNAL)


def guideline_index(citations: DataFrame) -> DataFrame:
    """Cited works (``pos``, ``pmid``, ``doi``, ``title``, ``source``) by each kind
    of key: ``kind``, ``key``, sorted ``sources``, the first ``label``."""
    keys = F.array(
        F.struct(F.lit("pmid").alias("kind"), F.trim(F.col("pmid")).alias("key")),
        F.struct(F.lit("doi").alias("kind"), doi_key("doi").alias("key")),
        F.struct(F.lit("title").alias("kind"), title_key("title").alias("key")),
    )
    rows = citations.select("pos", "source", "title", F.inline(keys)).filter("key is not null and key <> ''")
    return rows.groupBy("kind", "key").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min_by("title", "pos").alias("label"))


def cited_in_guideline(articles: DataFrame, index: DataFrame, id_col: str = "pmid") -> DataFrame:
    """Adds ``guideline_label`` and ``guideline_by``: found by pmid, else by doi, else by title."""
    rows = articles
    for kind, key in (("pmid", F.trim(F.col("pmid"))), ("doi", doi_key("doi")), ("title", title_key("title"))):
        part = index.filter(F.col("kind") == kind).select(F.col("key").alias(f"k_{kind}"), F.col("label").alias(f"l_{kind}"))
        rows = rows.withColumn(f"k_{kind}", key).join(part, f"k_{kind}", "left").drop(f"k_{kind}")
    by = F.when(F.col("l_pmid").isNotNull(), "pmid").when(F.col("l_doi").isNotNull(), "doi").when(F.col("l_title").isNotNull(), "title")
    return rows.withColumns({"guideline_by": by, "guideline_label": F.coalesce("l_pmid", "l_doi", "l_title")}).drop("l_pmid", "l_doi", "l_title")


def must_bonus(title: Column, blob: Column, must: tuple[str, ...]) -> Column:
    if not must:
        return F.lit(0.0)
    each = [F.when(mentions(title, t), 0.25).when(mentions(blob, t), 0.12).otherwise(-0.18) for t in must]
    return F.greatest(F.lit(-0.35), F.least(F.lit(0.45), reduce(lambda a, b: a + b, each)))


def population(blob: Column, mesh: Column, mesh_major: Column, c: Concepts) -> Column:
    """How well an article's patients fit: disease, line of therapy, required terms."""
    lower = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower)
    targets = F.array(*[F.lit(m.lower()) for m in c.target_mesh]).cast("array<string>")
    major, any_ = F.arrays_overlap(lower(mesh_major), targets), F.arrays_overlap(lower(mesh), targets)
    text = contains_any(blob, c.target_terms)
    score = F.when(major, 1.0).when(any_, 0.85).when(text, 0.75).otherwise(0.5)
    hit = major | any_ | text
    rivals = [contains_any(blob, phrases) for phrases in c.competing]
    rival = F.when(hit, reduce(lambda a, b: a + b, [F.when(r, 0.08).otherwise(0.0) for r in rivals], F.lit(0.0))).otherwise(
        F.when(reduce(lambda a, b: a | b, rivals, F.lit(False)), 0.55).otherwise(0.0)
    )
    out, minus = score, rival
    if c.lines:
        n = reduce(lambda a, b: a + b, [contains_any(blob, p).cast("int") for p in c.lines])
        out, minus = F.least(F.lit(1.0), out + 0.12 * n), minus + F.when(n == 0, 0.12).otherwise(0.0)
    if c.must:
        n = reduce(lambda a, b: a + b, [mentions(blob, t).cast("int") for t in c.must])
        out, minus = F.least(F.lit(1.0), out + 0.08 * n), minus + F.when(n == 0, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out - minus))


def recency(year: Column, now: int) -> Column:
    """exp(-age / 3); 0.4 without a year."""
    y = F.substring(year.cast("string"), 1, 4)
    age = F.greatest(F.lit(0), F.lit(now) - F.when(y.rlike(r"^\d{4}$"), y.cast("int")))
    return F.coalesce(F.exp(-age / 3.0), F.lit(0.4))


def penalty(title: Column, abstract: Column, pub_types: Column, language: Column) -> Column:
    kinds = F.transform(pub_types, F.lower)
    lang = F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, PENALTY_TYPES))), 0.6).otherwise(0.0)
        + F.when(F.trim(F.coalesce(abstract, F.lit(""))) == "", 0.5).otherwise(0.0)
        + F.when((lang != "") & ~lang.isin("eng", "en", "english"), 0.3).otherwise(0.0)
        + F.when(F.coalesce(title, F.lit("")).rlike(r"(?i)\bretract"), 0.8).otherwise(0.0)
    )


def rank_articles(articles: DataFrame, concepts: Concepts, now: int, top_k: int = 5) -> DataFrame:
    """articles: ``query_id``, ``pmid``, ``place`` (1 is first), ``title``,
    ``abstract``, ``pub_types``, ``mesh``, ``mesh_major``, ``language``, ``year``,
    ``journal_tier``, ``in_guideline``. Articles without any required term go,
    unless a question would lose all. Fitting populations come first, then
    better tiers, then works that guidelines cite, then the score.

    What a question's articles have in common is one row for each question, counted
    first, so only the best ``top_k`` of a task meet in one place."""
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    rows = articles.withColumn("blob", F.lower(F.concat(title, F.lit("\n"), abstract)))
    match = F.lit(True)
    if concepts.must:
        squashed = _squashed(F.col("blob"))
        match = reduce(lambda a, t: a | squashed.contains(t.replace("-", "").replace(" ", "")), concepts.must, F.lit(False))
    rows = rows.withColumn("match", match)
    counts = rows.groupBy(F.col("query_id").alias("__query")).agg(F.count("*").alias("n"), F.max("match").alias("any"))
    counts = stage(counts, "articles-counts")
    rows = rows.join(counts, F.col("query_id").eqNullSafe(F.col("__query"))).filter(F.col("match") | ~F.col("any")).drop("match", "any", "__query")
    wanted = token_set(F.lit(" ".join(concepts.terms)))
    rank_part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (F.col("place") - 1) / F.greatest("n", F.lit(1))))
    bonus = must_bonus(F.lower(title), F.col("blob"), concepts.must)
    rel = 0.45 * overlap(wanted, token_set(F.concat(title, F.lit(" "), abstract))) + 0.20 * rank_part + 0.20 * overlap(wanted, token_set(title)) + 0.15 * (bonus + 0.35) / 0.8
    rows = rows.withColumns(
        {
            "tier": evidence_tier(title, abstract, F.col("pub_types"), F.col("in_guideline")),
            "population": F.round(population(F.col("blob"), F.col("mesh"), F.col("mesh_major"), concepts), 6),
            "relevance": F.round(rel, 6),
            "journal_score": journal_score(F.col("journal_tier")),
            "recency": F.round(recency(F.col("year"), now), 6),
            "penalty": penalty(title, abstract, F.col("pub_types"), F.col("language")),
        }
    )
    score = 0.40 * F.col("population") + 0.25 * F.col("journal_score") + 0.20 * F.col("recency") + 0.15 * F.col("relevance") - F.col("penalty")
    rows = rows.withColumn("score", F.round(score, 6)).drop("blob", "n")
    order = Window.partitionBy("query_id").orderBy((F.col("population") < 0.35).cast("int"), "tier", (~F.col("in_guideline")).cast("int"), F.desc("score"), "place")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def relax(counts: list[int], enough: int = 5, least: int = 3, most: int = 300) -> int:
    """Which of the queries, strictest first, to take by their numbers of
    results: the first with ``enough``, else the last with ``least``, else the
    last; a first one with more than ``most`` asks for a tighter query (-1)."""
    if counts and counts[0] > most:
        return -1
    for k, n in enumerate(counts):
        if n >= enough:
            return k
    some = [k for k, n in enumerate(counts) if n >= least]
    return some[-1] if some else len(counts) - 1


def classify_feedback(rows: DataFrame, rules: dict[str, tuple[str, ...]], other: str = "other", positive: str = "positive") -> DataFrame:
    """rows: ``comment``, ``picked``, ``rating``, ``helpful``. ``rules`` map
    categories, most important first, to words. Adds ``primary`` (a valid pick,
    else the first that matches, else by rating) and all ``tags``."""
    text = F.lower(F.trim(F.coalesce(F.col("comment"), F.lit(""))))
    found = F.array_compact(F.array(*[F.when(contains_any(text, tuple(w.lower() for w in words)), F.lit(k)) for k, words in rules.items()]))
    picked = F.when(F.col("picked").isin(*rules) & (F.col("picked") != other), F.col("picked"))
    tags = F.array_distinct(F.array_compact(F.concat(F.array(picked), found)))
    good = (F.coalesce(F.col("helpful"), F.lit("")) == "yes") | (F.coalesce(F.col("rating"), F.lit(0)) >= 4)
    tags = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.when(good, positive).otherwise(other)))
    return rows.withColumn("tags", tags).withColumn("primary", F.get("tags", F.lit(0)))
