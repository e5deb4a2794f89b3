r"""Recurring lines, found with a log-template tree, are dropped from documents.

A line is parsed to a fixed depth: by its number of words, then by its first
``DEPTH`` words, with words that hold a digit masked. Lines of one leaf are
generalised word by word: a word stays where at least ``MIN_DOCS`` documents
have it at that place in the leaf, any other becomes a variable field. The
result is the line's template, if at least ``SIMILARITY`` of its words stay or
are masked and at least ``CONSTANT`` of them stay. A template is recurring if lines of ``MIN_DOCS`` documents or more have it, and
every line with a recurring template goes.

Documents with equal texts count as one, so copies of a whole document don't
make its lines recur. Words are runs of anything but ASCII white space.

Counts are made on keys (two 64-bit hashes of a line or text) and partly before
each shuffle, so a line that most documents share is one row where words are
compared. The documents' texts are shuffled twice: once to have one text per
different line, once to join the places of what is dropped. Of the joins, one
side has one row for each key; where a key is hot on the other side (a line that
every document has, a text with many copies), adaptive execution splits it.

Defined results: a null text has no lines and stays null; blank lines stay; a
repeated row counts once and is cleaned like its copies; an empty table gives an
empty result; words and lines of any length take linear time. ``drop_lines``
keeps all columns of the documents, whatever their names. Expressions only: no
Python runs on data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stage

DEPTH = 3
MIN_DOCS = 3
SIMILARITY = 0.8
CONSTANT = 0.5
FIELD = "<*>"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\v\f\r"
SPACE = r"[\x20\x09-\x0D]"


def keys_of(text: Column, name: str) -> list[Column]:
    """128 bits of a text, as columns ``name`` with 1 and 2."""
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(1), text).alias(f"{name}2")]


def named(name: str) -> list[str]:
    return [f"{name}1", f"{name}2"]


LINE, TEXT, LEAF = named("line"), named("text"), named("leaf")


def odd(line: Column) -> Column:
    """Whether more than single spaces between words is there as white space."""
    test = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in BLANKS[1:]:
        test = test | line.contains(c)
    return test


def masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit(FIELD)).otherwise(word)


def with_leaf(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The place of each ``line`` in the tree, ``leaf``: its number of words and
    the first ``depth`` of them, masked. No pattern tries a word from more than
    its start, so long words are passed once."""
    line = F.col("line")
    head = F.regexp_extract(line, rf"^{SPACE}*+((?:{WORD}+{SPACE}*+){{0,{depth}}}+)", 1)
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    rows = lines.withColumns({"head": head, "odd": odd(line)})
    count = F.when(F.col("odd"), F.regexp_count(line, F.lit(WORD))).otherwise(spaces + 1)
    fields = F.regexp_replace("head", rf"(?<!{WORD[:-1]})[^\x20\x09-\x0D0-9]*+[0-9]{WORD[:-1]}*+", FIELD)
    rows = rows.withColumn("count", count).withColumn("head", F.when(F.col("head").rlike("[0-9]"), fields).otherwise(F.col("head")))
    plain = F.when(F.col("odd"), F.regexp_replace("head", f"{SPACE}++", " ")).otherwise(F.col("head"))
    return rows.withColumn("leaf", F.concat_ws("\n", "count", F.rtrim(plain))).drop("head", "odd", "count")


def lines_of(docs: DataFrame, text_col: str) -> DataFrame:
    """The lines of texts that aren't null that have words, with keys of line and text."""
    # Keys come first: beside the explode they would be made anew for each line.
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null").select("text", *keys_of(F.col("text"), "text"))
    lines = texts.select(*TEXT, F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.filter(F.trim("line", F.lit(BLANKS)) != "").select("line", *TEXT, *keys_of(F.col("line"), "line"))


def recurring(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """The lines that recur: their key (``line1``, ``line2``), ``template`` and
    ``docs``, how many documents have the template."""
    lines = lines_of(docs, text_col)
    pairs = stage(with_leaf(lines, depth).select(*LINE, *TEXT, *keys_of(F.col("leaf"), "leaf")).distinct(), "line-pairs")
    counted = pairs.groupBy(*LEAF, *LINE).agg(F.count("*").alias("docs"))
    # A leaf with too few documents can't have a recurring template.
    full = counted.groupBy(*LEAF).agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs).select(*LEAF)
    some = counted.join(full, LEAF)
    text = lines.groupBy(*LINE).agg(F.first("line").alias("line")).join(some, LINE)
    words = F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
    placed = text.select(*LEAF, *LINE, "docs", F.posexplode(words).alias("place", "word"))
    placed = stage(placed.withColumn("word", masked(F.col("word"))), "line-words")
    constant = placed.groupBy(*LEAF, "place", "word").agg(F.sum("docs").alias("n")).filter((F.col("n") >= min_docs) & (F.col("word") != FIELD))
    marked = placed.join(constant.drop("n").withColumn("stays", F.lit(True)), [*LEAF, "place", "word"], "left")
    templates = marked.groupBy(*LEAF, *LINE).agg(
        F.count("stays").alias("stay"),
        F.count_if(F.col("word") == FIELD).alias("masked"),
        F.count("*").alias("n_words"),
        F.sort_array(F.collect_list(F.struct("place", F.when(F.col("stays"), F.col("word")).otherwise(F.lit(FIELD)).alias("word")))).alias("words"),
    )
    templates = templates.filter((F.col("stay") + F.col("masked") >= F.lit(similarity) * F.col("n_words")) & (F.col("stay") >= F.lit(CONSTANT) * F.col("n_words")))
    templates = stage(templates.select(*LINE, F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("template")), "line-templates")
    seen = pairs.select(*LINE, *TEXT).join(templates, LINE).select("template", *TEXT).distinct()
    often = seen.groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return templates.join(often, "template").select(*LINE, "template", "docs")


def drop_lines(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None, **options) -> DataFrame:
    """One row per document: its columns (those of ``keep``, or all) as the
    struct ``row``, ``n_lines``, ``n_dropped`` and the cleaned ``text``."""
    row = F.struct("*") if keep is None else F.struct(*(F.col(f"`{c}`") for c in keep))
    gone = recurring(docs, text_col, **options).select(*LINE)
    keyed = docs.select(row.alias("row"), F.col(text_col).alias("text"), *keys_of(F.col(text_col), "text"))
    at = keyed.drop("row").filter("text is not null").select(*TEXT, F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    at = at.select(*TEXT, "place", *keys_of(F.col("line"), "line"))
    drops = at.join(gone, LINE).groupBy(*TEXT).agg(F.collect_set("place").alias("places"))
    found = keyed.join(drops, TEXT, "left")
    found = found.withColumn("lines", F.when(F.col("places").isNotNull(), F.split("text", "\n", -1)))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    places = F.coalesce("places", F.array().cast("array<int>"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), places)
    clean = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n"))
    return found.select(
        "row",
        F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
        F.size(places).cast("long").alias("n_dropped"),
        clean.alias("text"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    return drop_lines(docs, keep=("doc_id",)).select("row.doc_id", "n_lines", "n_dropped", "text")


#: DuckDB SQL for ``line_digest``.
ORACLE_SQL = rf"""
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS line FROM t),
u AS (SELECT * FROM p WHERE regexp_matches(line, '{WORD}')),
l AS (
  SELECT line, count(*) AS docs, regexp_extract_all(line, '{WORD}') AS ws FROM u GROUP BY line),
f AS (
  SELECT *, concat_ws(chr(10), len(ws), array_to_string(list_transform(ws[1:{DEPTH}], lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{FIELD}' ELSE w END), chr(10))) AS leaf FROM l),
g AS (SELECT leaf FROM f GROUP BY leaf HAVING sum(docs) >= {MIN_DOCS}),
w AS (
  SELECT leaf, line, docs, place, CASE WHEN regexp_matches(ws[place], '[0-9]') THEN '{FIELD}' ELSE ws[place] END AS word
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS place FROM f SEMI JOIN g USING (leaf))),
c AS (SELECT leaf, place, word FROM w WHERE word <> '{FIELD}' GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
m AS (
  SELECT line, string_agg(coalesce(c.word, '{FIELD}'), ' ' ORDER BY w.place) AS template
  FROM w LEFT JOIN c ON w.leaf = c.leaf AND w.place = c.place AND w.word = c.word
  GROUP BY line HAVING count(c.word) + count(*) FILTER (w.word = '{FIELD}') >= {SIMILARITY} * count(*) AND count(c.word) >= {CONSTANT} * count(*)),
o AS (SELECT template FROM m JOIN u USING (line) GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
gone AS (SELECT line FROM m SEMI JOIN o USING (template)),
x AS (
  SELECT text, line, i, line IN (SELECT line FROM gone) AS g
  FROM (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t)),
y AS (
  SELECT text, count(*) AS n_lines, count(*) FILTER (g) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT g), '') AS clean FROM x GROUP BY text)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, clean AS text
FROM documents d LEFT JOIN y ON d.text = y.text
"""
