"""Dictionaries of rules as tables: texts meet them in a join, not in a branch for each alias.

A rule is a row ``rule``, ``alias``, ``concept`` and may have ``capture``, the number
of words after the alias that it gives back. A word is a run of letters and digits with
hyphens inside, lower-cased; an alias occurs where its words stand in a row.
The plan is the same for ten rules and for a million.

A position whose word starts a rule learns how many words such rules have, gives that
many words as keys, and meets the rules by the whole key. So it makes as many rows as there are
lengths of rules (few), however many rules start with its word, and only the words
that the longest alias and capture need go along with it, never the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_words(text: str | Column) -> Column:
    """The words of a text that rules compare, in order; none for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))


def rule_matches(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place where a rule's alias occurs: the id, ``rule``, ``concept``,
    ``at`` (the number of words before it), ``n_words`` of the alias and ``captured``, the
    words after it joined by spaces (null where a rule has no capture or the
    text ends before). Rules without a word match nothing; a rule that is there twice counts once."""
    has = "capture" in rules.columns
    rules = rules.select("rule", "concept", rule_words("alias").alias("words"), (F.coalesce("capture", F.lit(0)) if has else F.lit(0)).cast("int").alias("capture"))
    rules = rules.filter(F.size("words") > 0).distinct().withColumn("first", F.col("words")[0])
    longest = rules.agg(F.coalesce(F.max(F.size("words") + F.col("capture")), F.lit(1))).first()[0]
    texts = docs.select(F.col(id_col).alias("id"), rule_words(text_col).alias("all"))
    # An outer generator, so that the words are cut once.
    here = texts.select("id", F.posexplode_outer(F.transform("all", lambda w, i: F.slice(F.col("all"), i + 1, longest))).alias("at", "next")).filter("next is not null")
    heads = rules.groupBy("first").agg(F.collect_set(F.size("words")).alias("lengths"))  # at most ``longest`` of them
    here = here.withColumn("first", F.col("next")[0]).join(heads, "first").select("id", "at", "next", F.explode("lengths").alias("n"))
    here = here.filter(F.size("next") >= F.col("n")).withColumn("key", F.array_join(F.slice("next", 1, F.col("n")), " "))
    met = here.join(rules.select("rule", "concept", "capture", F.array_join("words", " ").alias("key")), "key")
    n = F.col("n")
    tail = F.slice("next", n + 1, F.col("capture"))
    captured = F.when((F.col("capture") > 0) & (F.size(tail) == F.col("capture")), F.array_join(tail, " "))
    return met.select(F.col("id").alias(id_col), "rule", "concept", F.col("at").cast("int").alias("at"), n.alias("n_words"), captured.alias("captured"))


def longest_matches(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the matches that start at one word those of the longest alias, and of
    one alias's rules the first."""
    order = Window.partitionBy(id_col, "at").orderBy(F.desc("n_words"), "rule")
    return matches.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def concepts(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``concept`` of each text with ``n`` matches, ``first_at`` and ``captured``: what the
    first match that captured something gave."""
    got = F.min_by("captured", F.struct("at", "rule")).alias("captured")
    some = matches.filter("captured is not null").groupBy(id_col, "concept").agg(got)
    every = matches.groupBy(id_col, "concept").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    return every.join(some, [id_col, "concept"], "left")
