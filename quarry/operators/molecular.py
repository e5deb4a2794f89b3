"""Variants in free text, their evidence records, and how far a record's statement holds."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_any

#: One-letter and three-letter names of amino acids.
AMINO = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "E": "Glu", "Q": "Gln", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val"}
GENE = r"[A-Z][A-Z0-9]{1,9}"
PROTEIN = r"p\.[A-Za-z]{1,3}\d+(?:[A-Za-z]{1,3}|\*|fs\*?\d*|del|dup)?"
SHORT = r"[ARNDCEQGHILKMFPSTWYV]\d{1,4}[ARNDCEQGHILKMFPSTWYV\*]"
CDNA = r"c\.[\d_+\-]+(?:[ACGT]+>[ACGT]+|del[ACGT]*|dup[ACGT]*|ins[ACGT]+)"
VARIANT = rf"\b({GENE})[\s:,]+(?:({CDNA})[\s,;(]*)?({PROTEIN}|{SHORT})?"


def protein_long(name: Column) -> Column:
    """``p.V600E`` or ``V600E`` as ``p.Val600Glu``; other forms stay."""
    plain = F.regexp_replace(name, r"^p\.", "")
    table = F.create_map(*[F.lit(x) for kv in AMINO.items() for x in kv])
    a, n, b = (F.regexp_extract(plain, r"^([A-Z])(\d+)([A-Z])$", k) for k in (1, 2, 3))
    return F.when(plain.rlike(r"^[A-Z]\d+[A-Z]$"), F.concat(F.lit("p."), F.try_element_at(table, a), n, F.try_element_at(table, b))).when(name.startswith("p."), name).otherwise(F.concat(F.lit("p."), plain))


def parse_variants(rows: DataFrame, text_col: str = "text", genes: tuple[str, ...] = ()) -> DataFrame:
    """Every variant of a text once: ``request_id``, ``at``, ``gene``, ``cdna``, ``protein``, ``status``, ``warnings``."""
    g, c, p = (F.regexp_extract_all(text_col, F.lit(VARIANT), F.lit(k)) for k in (1, 2, 3))
    found = rows.select("request_id", F.posexplode(F.arrays_zip(g.alias("gene"), c.alias("cdna"), p.alias("protein"))).alias("at", "v")).select("request_id", "at", "v.*")
    found = found.filter((F.col("cdna") != "") | (F.col("protein") != ""))
    if genes:
        found = found.filter(F.col("gene").isin(*genes))
    found = found.withColumns({"cdna": F.nullif("cdna", F.lit("")), "protein": F.when(F.col("protein") != "", protein_long(F.col("protein")))})
    first = Window.partitionBy("request_id", "gene", "protein", "cdna").orderBy("at")
    found = found.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    status = F.when(F.col("cdna").isNotNull(), "cdna_level").otherwise("protein_level_only")
    warnings = F.array_compact(F.array(F.when(F.col("cdna").isNull(), F.lit("missing_cdna")), F.when(F.col("protein").isNull(), F.lit("missing_protein"))))
    return found.withColumns({"status": status, "warnings": warnings})


def task_matrix(variants: DataFrame, providers: DataFrame) -> DataFrame:
    """Each variant with each provider, a short list of names."""
    return variants.join(providers.select("provider"), F.lit(True))


def distinct_records(records: DataFrame) -> DataFrame:
    """One record of each (provider, record, variant), the first; errors stay."""
    first = Window.partitionBy("provider", "record_id", "variant_id").orderBy("pos")
    rows = records.withColumn("n", F.when(F.col("is_error"), F.lit(1)).otherwise(F.row_number().over(first)))
    return rows.filter("n = 1").drop("n")


def match_variants(records: DataFrame, variants: DataFrame) -> DataFrame:
    """Each record's variant: by id, else by protein in its text, else by gene, else a request's only one."""
    v = variants.select("request_id", "variant_id", "gene", "protein", F.count("*").over(Window.partitionBy("request_id")).alias("of"))
    joined = records.withColumnRenamed("variant_id", "given").join(v, "request_id", "left")
    text = F.lower(F.coalesce("text", F.lit("")))
    word = F.lower(F.regexp_replace(F.coalesce("protein", F.lit("")), r"^p\.", ""))
    level = (
        F.when(F.col("given") == F.col("variant_id"), 1)
        .when((word != "") & text.contains(word), 2)
        .when(text.contains(F.lower("gene")), 3)
        .when(F.col("of") == 1, 4)
    )
    order = Window.partitionBy("request_id", "record_id").orderBy(F.col("level").asc_nulls_last(), "variant_id")
    rows = joined.withColumn("level", level).withColumn("n", F.row_number().over(order)).filter("n = 1")
    return rows.withColumn("variant_id", F.when(F.col("level").isNotNull(), F.col("variant_id"))).drop("n", "of", "gene", "protein", "given")


def disease_match(record: Column, asked: Column, family: tuple[str, ...] = ("lymphoma",), group: tuple[str, ...] = ("leukemia", "myeloma", "hematologic")) -> Column:
    """direct, same family, same group, other or unknown."""
    r, a = F.lower(F.trim(F.coalesce(record, F.lit("")))), F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    has = lambda c, words: reduce(lambda x, w: x | c.contains(w), words, F.lit(False))
    return (
        F.when((r == "") | (a == ""), "unknown")
        .when((r == a) | r.contains(a) | a.contains(r), "direct")
        .when(has(r, family) & has(a, family), "family")
        .when(has(r, (*family, *group)) & has(a, (*family, *group)), "group")
        .otherwise("other")
    )


def safety_gate(level: Column, match: Column, review_status: Column, status: Column) -> Column:
    """allow, downgrade or confirm; a stricter rule overrides a milder one."""
    return (
        F.when(status == "protein_level_only", F.when(match == "other", "confirm").otherwise("downgrade"))
        .when(match.isin("other", "unknown"), "confirm")
        .when(F.lower(F.coalesce(review_status, F.lit(""))).isin("submitted", "conflicting"), "downgrade")
        .when(match.isin("family", "group") | (level > F.lit("B")), "downgrade")
        .otherwise("allow")
    )


def rank_cards(cards: DataFrame, top_k: int | None = None) -> DataFrame:
    """Cards of a request: closer diseases first, then safer decisions, then higher levels, then input order."""
    place = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(99))
    order = Window.partitionBy("request_id").orderBy(place("match", ("direct", "family", "group", "other", "unknown")), place("decision", ("allow", "downgrade", "confirm")), F.col("level").asc_nulls_last(), "pos")
    rows = cards.withColumn("rank", F.row_number().over(order))
    return rows if top_k is None else rows.filter(F.col("rank") <= top_k)


def decision_of(cards: DataFrame) -> DataFrame:
    """The strictest decision among a request's cards."""
    rows = cards.groupBy("request_id").agg(F.bool_or(F.col("decision") == "confirm").alias("c"), F.bool_or(F.col("decision") == "downgrade").alias("d"))
    return rows.select("request_id", F.when(F.col("c"), "confirm").when(F.col("d"), "downgrade").otherwise("allow").alias("decision"))


def cache_key(*parts: Column) -> Column:
    """A request's key: sha256 of its fields in order, with blanks trimmed and letters lower-cased."""
    return F.sha2(F.to_json(F.array(*[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts])), 256)


def missing_information(blocking: Column, advisory: Column) -> Column:
    """What is still to be asked, blocking questions first, each once."""
    return F.array_distinct(F.concat(blocking, advisory))


#: How closely a card's disease is met; words of a variant's classification, and of an evidence item.
DIRECT, NEAR = "DLBCL直接证据", "LBCL近似证据"
UNSURE = ("conflicting", "vus", "uncertain")
SUPPORTING = ("supports", "relevant", "druggable")
EVIDENCE_KINDS = ("predictive", "diagnostic", "prognostic", "oncogenic")


def card_counts(cards: DataFrame) -> DataFrame:
    """Cards by ``provider``: all, and those whose ``disease_match`` is direct, near or neither."""
    match = F.coalesce("disease_match", F.lit(""))
    return cards.groupBy("provider").agg(
        F.count("*").alias("cards"), F.count_if(match == DIRECT).alias("direct"), F.count_if(match == NEAR).alias("near"), F.count_if(~match.isin(DIRECT, NEAR)).alias("proxy")
    )


def clinvar_level(classification: Column, review: Column) -> Column:
    """L4 or L5 from a variant's classifications and review states (each joined to one text)."""
    said = lambda *words: contains_any(F.lower(F.coalesce(classification, F.lit(""))), words)
    stars = contains_any(F.coalesce(review, F.lit("")), ("3", "4"))
    return (
        F.when(said("pathogenic"), F.when(said("somatic", "oncogenic"), "L4").otherwise("L5"))
        .when(said("oncogenic"), "L4")
        .when(said(*UNSURE), "L5")
        .when(stars, "L4")
        .otherwise("L5")
    )


def civic_level(level: Column, kind: Column, direction: Column) -> Column:
    """L2 to L4 from an evidence item's level, type and direction."""
    level, kind, direction = F.upper(F.coalesce(level, F.lit(""))), F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(direction, F.lit("")))
    high = level.isin("A", "B")
    return (
        F.when(high & direction.isin(*SUPPORTING), "L2")
        .when(level.isin("C", "D"), "L3")
        .when(contains_any(kind, EVIDENCE_KINDS), F.when(high, "L2").otherwise("L3"))
        .otherwise("L4")
    )


def annotate(variants: DataFrame, lookups: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Facts about each variant's gene. lookups: by the name of the new column, a
    table of ``gene`` and ``value``, one each, and what holds for other genes."""
    for name, (table, default) in lookups.items():
        variants = variants.join(table.select("gene", F.col("value").alias(name)), "gene", "left").withColumn(name, F.coalesce(name, F.lit(default)))
    return variants


#: What our levels are called in other frameworks; the last is for any other level.
AMP_TIERS = {"L1": "Tier I", "L2": "Tier I/II", "L3": "Tier II", "L4": "Tier III", "L5": "Tier IV"}
ESCAT_LEVELS = {"L1": "I-A", "L2": "I-B", "L3": "II-B", "L4": "III-A", "L5": "V"}
ESCAT_PROGNOSTIC = {"L1": "IV", "L2": "IV", "L3": "IV", "L4": "V", "L5": "V"}
THERAPY_KINDS = ("predictive", "therapeutic", "therapy")
#: Classes of inherited variants by the words of their classification, the first that is found.
ACMG_CLASSES = (("LP", "likely pathogenic"), ("P", r"(?<!likely )\bpathogenic\b"), ("LB", "likely benign"), ("B", r"(?<!likely )\bbenign\b"), ("VUS", "uncertain|vus|conflicting"))


def framework_levels(level: Column, kind: Column, provider: Column, classification: Column) -> Column:
    """A card's level (``L1`` to ``L5``) as ``amp`` tier; as ``escat`` level for
    evidence of therapy or prognosis, else null; and the ``acmg`` class of ClinVar's
    records of inherited variants, else null. Unknown levels count as ``L5``."""
    level, kind = F.upper(F.coalesce(level, F.lit("L5"))), F.lower(F.coalesce(kind, F.lit("")))

    def of(names: Mapping[str, str]) -> Column:
        found = F.lit(names["L5"])
        for known, name in names.items():
            found = F.when(level == known, name).otherwise(found)
        return found

    therapy = F.exists(F.array(*map(F.lit, THERAPY_KINDS)), lambda k: kind.contains(k))
    escat = F.when(therapy, of(ESCAT_LEVELS)).when(kind.contains("prognostic"), of(ESCAT_PROGNOSTIC))
    said = F.lower(F.coalesce(classification, F.lit("")))
    acmg = F.coalesce(*[F.when(said.rlike(words), F.lit(name)) for name, words in ACMG_CLASSES])
    inherited = (F.lower(F.coalesce(provider, F.lit(""))) == "clinvar") & kind.contains("germline")
    return F.struct(of(AMP_TIERS).alias("amp"), escat.alias("escat"), F.when(inherited, acmg).alias("acmg"))
