"""Benchmark passages in documents, found with an Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words of letters, digits and all
characters beyond ASCII. Windows of ``window`` consecutive words of each
benchmark item (the whole item if it is shorter) go into one automaton over
word numbers, and each document is scanned once. Word positions are mapped
back to character offsets in the original text.

The items are written once to the shared folder, in blocks of about
``BLOCK_WORDS`` words, and the workers read them there, so the driver never
holds them. Nearly every benchmark is one block, whose automaton a task makes
once. Of a larger one it holds one block's automaton at a time: a batch of
documents passes them in turn, its hits are united, and the documents are still
read once.

Defined results: a null or empty text has no words and no hits; an item
without words has no window; a null item id counts as a hit without a name;
item ids that come twice count once; an empty benchmark hits nothing. Columns
of the documents may have any names, and rows may be repeated.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.rows import ROWS_AT_ONCE, with_columns
from quarry.llm.shared import new_path

WINDOW = 10
BLOCK_WORDS = 250_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes to word bytes in lower case, all others to spaces.
_FOLD = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else 0x20 for i in range(256)
)
SCHEMA = "n_words long, hits array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Scanner:
    """The automaton of one block of items and what it finds in a text."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for w in windows(words_of(text), window):
                key = tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w)
                owners[key] |= set() if item is None else {item}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.automaton.add_word(key, (len(key), names))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The runs of hit words (first and last) and the items found."""
        runs: list[list[int]] = []
        found: set[str] = set()
        if words and self.any:
            number = self.numbers.get
            for last, (n, names) in self.automaton.iter(tuple([number(w, 0) for w in words])):
                found |= names
                _add(runs, last - n + 1, last)  # ends come in ascending order
        return runs, found


def _add(runs: list[list[int]], first: int, last: int) -> None:
    """Put a run after others, of which those that it touches become part of it."""
    while runs and runs[-1][1] >= first - 1:
        before = runs.pop()
        first, last = min(first, before[0]), max(last, before[1])
    runs.append([first, last])


class Benchmark:
    """Blocks of items in the shared folder, with the scanner that a task used last."""

    def __init__(self, path: str, blocks: int, window: int):
        self.path, self.blocks, self.window = path, blocks, window
        self.last: tuple[int, Scanner] | None = None

    def scanner(self, block: int) -> Scanner:
        if self.last is None or self.last[0] != block:
            from pyarrow import fs, parquet

            self.last = None  # one automaton at a time
            store, path = fs.FileSystem.from_uri(self.path)
            files = [f.path for f in store.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
            items = [(r["item"], r["text"]) for f in sorted(files) for r in parquet.read_table(f, columns=["item", "text"], filesystem=store, partitioning=None).to_pylist()]
            self.last = block, Scanner(items, self.window)
        return self.last[1]

    def find(self, texts: list[str | None]) -> dict[str, list]:
        words = [words_of(t) for t in texts]
        runs: list[list[list[int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for block in range(self.blocks):
            scan = self.scanner(block).scan
            for k, w in enumerate(words):
                found, names = scan(w)
                runs[k] += found
                items[k] |= names
        hits = []
        for text, found in zip(texts, runs, strict=True):
            united: list[list[int]] = []
            for first, last in sorted(found):
                _add(united, first, last)
            at = [m.span() for m in re.finditer(WORD, text)] if united else []
            hits.append([{"first": a, "last": b, "start": at[a][0], "end": at[b][1]} for a, b in united])
        return {"n_words": list(map(len, words)), "hits": hits, "items": list(map(sorted, items))}


def store_benchmark(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Benchmark:
    """Write the items to the shared folder in blocks of bounded size."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size = F.length("text") / 2 + 1  # words have a character and a separator at least
    blocks = int((items.agg(F.sum(size)).first()[0] or 0) // BLOCK_WORDS) + 1
    path = new_path(benchmark.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
    return Benchmark(path, blocks, window)


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str | Column = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per document: its columns as the struct ``row``, ``n_words``,
    the runs of hit words ``hits`` and the ids of the ``items`` found."""
    text = F.col(text) if isinstance(text, str) else text
    stored = store_benchmark(benchmark, item_col, item_text, window)
    # Several blocks are read again for each list of texts, so lists are as long as batches then.
    rows_at_once = ROWS_AT_ONCE if stored.blocks == 1 else 1 << 30
    return with_columns(docs, text, lambda: Benchmark(stored.path, stored.blocks, stored.window).find, SCHEMA, keep, rows_at_once)


def n_hit() -> Column:
    """Hit words of a row of ``find_benchmark``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_benchmark(docs, benchmark, keep=("doc_id",)).select(
        "row.doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    return find_benchmark(docs, benchmark).filter(F.size("hits") == 0).select("row.*")


#: DuckDB SQL for ``contamination_digest`` where ids are unique.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
item_pos AS (
  SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM item_words WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM item_pos),
lens AS (SELECT DISTINCT k FROM wins),
doc_pos AS (
  SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM words CROSS JOIN lens WHERE len(ws) >= k),
grams AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM doc_pos),
found AS (SELECT doc_id, item_id, g.k AS k, p FROM grams g JOIN wins w ON g.k = w.k AND g.gram = w.gram),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
