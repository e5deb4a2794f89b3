"""Resolving, filtering and checking citations, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.citations import cited_sources, renumber, resolver_refs
from quarry.functions.text import sentences

MAX_ATTACHED = 6
WINDOW_CHARS = 420


def best_sentence(text: Column, keywords: Column) -> Column:
    """The sentence that contains most keywords, the first of equals; the first without any."""
    said = sentences(text)
    words = F.filter(F.transform(keywords, F.lower), lambda k: F.length(k) > 1)
    scored = F.transform(said, lambda s, i: F.struct(F.size(F.filter(words, lambda k: F.lower(s).contains(k))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], F.lit(""))


def sentence_windows(rows: DataFrame, text: Column, keywords: Column, limit: int = WINDOW_CHARS) -> DataFrame:
    """``rows`` with the ``sentence`` of ``best_sentence`` and the ``window``
    around it: the sentence after, then the one before, and so on in turns, as
    long as sentences (without the spaces between) fit into ``limit``
    characters. The first neighbour comes in whatever its length; a side whose
    next sentence doesn't fit waits for the other; both stuck is the end."""
    words = F.filter(F.transform(keywords, F.lower), lambda k: F.length(k) > 1)
    rows = rows.withColumns({"__said": sentences(text), "__words": words})
    hits = F.transform("__said", lambda s, i: F.struct(F.size(F.filter("__words", lambda k: F.lower(s).contains(k))).alias("n"), (-i).alias("at")))
    rows = rows.withColumns({"__sizes": F.transform("__said", F.length), "__at": -F.array_max(hits)["at"]})
    size, last = lambda i: F.get("__sizes", i), F.size("__said")

    def grown(w: Column, _: Column) -> Column:
        go = (w["total"] < limit) & ~w["end"]
        after = go & (w["right"] < last) & ((w["total"] + size(w["right"]) <= limit) | (w["parts"] == 1))
        total = w["total"] + F.when(after, size(w["right"])).otherwise(0)
        parts = w["parts"] + after.cast("int")
        before = go & (w["left"] >= 0) & (total < limit) & ((total + size(w["left"]) <= limit) | (parts == 1))
        return F.struct(
            (w["left"] - before.cast("int")).alias("left"),
            (w["right"] + after.cast("int")).alias("right"),
            (total + F.when(before, size(w["left"])).otherwise(0)).alias("total"),
            (parts + before.cast("int")).alias("parts"),
            (~(after | before)).alias("end"),
        )

    start = F.struct((F.col("__at") - 1).alias("left"), (F.col("__at") + 1).alias("right"), size(F.col("__at")).alias("total"), F.lit(1).alias("parts"), F.lit(False).alias("end"))
    rows = rows.withColumn("__w", F.when(last > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), start, grown)))
    window = F.array_join(F.slice("__said", F.col("__w.left") + 2, F.col("__w.right") - F.col("__w.left") - 1), " ")
    out = rows.withColumns({"sentence": F.coalesce(F.get("__said", F.col("__at")), F.lit("")), "window": F.coalesce(window, F.lit(""))})
    return out.drop("__said", "__words", "__sizes", "__at", "__w")


def resolve_references(hits: DataFrame, entries: DataFrame, max_attached: int = MAX_ATTACHED) -> DataFrame:
    """References that hits cite in the sentence closest to the question.

    hits: ``query_id``, ``rank``, ``source_id``, ``article_id``, ``text``,
    ``keywords`` and ``reference_ids`` (numbers the hit may cite). entries:
    ``article_id``, ``ref_number``, ``entry_id``, one each. Numbers are followed
    in order of hits until a question would get more than ``max_attached``
    references; one that came before links again without counting. Returns
    ``query_id``, ``source_id``, ``ref_number``, ``entry_id``, ``place``.
    """
    numbers = F.array_intersect(resolver_refs(best_sentence(F.col("text"), F.col("keywords"))), F.col("reference_ids"))
    cited = hits.select("query_id", "rank", "source_id", "article_id", F.posexplode(numbers).alias("at", "ref_number"))
    found = cited.join(entries.select("article_id", "ref_number", "entry_id"), ["article_id", "ref_number"])
    # Where a question's first references are first named, up to one too many; no task orders all that it cites.
    firsts = found.groupBy("query_id", "article_id", "ref_number").agg(F.min(F.struct("rank", "at")).alias("first"))
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).filter(F.col("n") <= max_attached + 1)
    firsts = firsts.groupBy("query_id").agg(F.collect_list("first").alias("firsts"))
    before = F.size(F.filter("firsts", lambda x: x <= F.struct("rank", "at"))).cast("long")
    found = found.join(firsts, "query_id").withColumn("place", before).filter(F.col("place") <= max_attached)
    return found.select("query_id", "source_id", "ref_number", "entry_id", "place")


def keep_cited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers: ``query_id``, ``answer``; hits: ``query_id``, ``rank``, ``source_id``.
    Keeps the hits that the answer cites, with their new numbers; an answer that
    cites none keeps all. Adds ``new_answer`` and ``new_rank``."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    rows = answers.join(n, "query_id").withColumn("kept", F.filter(cited_sources(F.col("answer")), lambda i: i.between(1, F.col("n_hits"))))
    rows = rows.withColumn("new_answer", F.when(F.size("kept") > 0, renumber(F.col("answer"), F.col("kept"))).otherwise(F.col("answer")))
    joined = rows.join(hits, "query_id").withColumn("new_rank", F.when(F.size("kept") > 0, F.array_position("kept", F.col("rank").cast("int"))).otherwise(F.col("rank")).cast("long"))
    return joined.filter("new_rank > 0").drop("n_hits", "kept")


def keep_attached(links: DataFrame, kept: DataFrame, answers: DataFrame, by_article: bool = False) -> DataFrame:
    """References stay if a kept source links them and the answer has a marker
    at all. By number alone, as a default: ``by_article`` also asks for the article."""
    marked = answers.filter(F.col("answer").rlike(r"(?i)\[S\d+\]")).select("query_id")
    alive = links.join(kept.select("query_id", "source_id").distinct(), ["query_id", "source_id"], "left_semi").join(marked, "query_id", "left_semi")
    keys = ["query_id", "ref_number", *(["article_id"] if by_article else [])]
    return links.join(alive.select(*keys).distinct(), keys, "left_semi")


def verify_answers(rows: DataFrame, inline_sources: str = r"(来源|参考文献|引用来源)\s*[:：]", boundary: tuple[str, ...] = ("未直接提及", "没有直接提及")) -> DataFrame:
    """rows: ``answer``, ``entities``, ``evidence`` (all texts), ``n_hits``,
    ``n_figures``, ``kind``. Adds citation counts, uncovered entities, ``issues``
    and ``ok``. Only answers of kind guideline are bound to evidence."""
    answer = F.coalesce(F.col("answer"), F.lit(""))
    marks = F.regexp_extract_all(answer, F.lit(r"(\[S\d+\])"), F.lit(1))
    guideline = F.col("kind") == "guideline"
    low = F.lower(F.coalesce(F.col("evidence"), F.lit("")))
    open_ = F.filter("entities", lambda e: ~low.contains(F.lower(e)))
    said = F.lit(False)
    for text in boundary:
        said = said | answer.contains(text)
    issue = lambda test, name: F.when(guideline & test, F.lit(name))
    issues = F.array_compact(
        F.array(
            issue(F.size(marks) == 0, "answer_missing_source_citations"),
            issue((F.size(open_) > 0) & (F.col("n_figures") == 0) & ~said, "uncovered_entities_without_boundary_statement"),
            issue((F.col("n_hits") == 0) & (F.col("n_figures") == 0), "no_retrieved_evidence"),
            issue(answer.rlike(inline_sources), "answer_contains_inline_sources"),
        )
    )
    return rows.withColumns(
        {
            "citation_count": F.size(F.array_distinct(marks)),
            "raw_citation_count": F.size(marks),
            "uncovered": F.when(guideline, open_).otherwise(F.array().cast("array<string>")),
            "issues": issues,
            "ok": F.size(issues) == 0,
        }
    )


def display_index(groups: list[DataFrame]) -> DataFrame:
    """One numbering over several lists of evidence (``query_id``, ``key``), each ordered by ``place``."""
    rows = None
    for k, g in enumerate(groups):
        part = g.select("query_id", "key", "place", F.lit(k).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "place", "key")))


def place_tables(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """Where the tables among an answer's sources are shown: at the first
    paragraph that cites them, or behind all (null). paragraphs: ``query_id``,
    ``at``, ``text``; tables: ``query_id``, ``number`` (of the source). Adds ``at``."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\[S(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))
    cited = paragraphs.select("query_id", "at", F.explode(numbers).alias("number")).groupBy("query_id", "number").agg(F.min("at").alias("at"))
    return tables.join(cited, ["query_id", "number"], "left")
