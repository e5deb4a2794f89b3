"""Text expressions: tokenizers, keys, sentences and overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of terms, tokens and sentence ends define what searches find.
CJK = r"一-鿿"
#: Terms of two characters or more; a single one between others is none.
LONG_TERM = rf"[A-Za-z][A-Za-z0-9-]+|[0-9]{{2,}}|[{CJK}]{{2,}}"
TOKEN = rf"[a-zA-Z0-9]+|[{CJK}]+"
SENTENCE_END = r"(?<=[.。!?！？])\s+|\n+"


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def cased_terms(text: Column | str) -> Column:
    """The terms of ``search_terms`` in the text's own case. Without higher-order
    functions, so texts without CJK characters stay in compiled code."""
    text = _text(text)
    plain = F.regexp_extract_all(text, F.lit(LONG_TERM), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(rf"[{CJK}]{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.when(text.rlike(f"[{CJK}]"), F.concat(plain, pairs)).otherwise(plain)


def search_terms(text: Column | str) -> Column:
    """Terms for lexical search: lower-cased runs of letters (with digits and
    hyphens), digits or CJK characters, of two characters or more, in order.
    CJK runs also give their bigrams, which stand in for a word segmenter."""
    return F.transform(cased_terms(text), F.lower)


def token_set(text: Column | str) -> Column:
    """Distinct lower-cased runs of letters and digits, or of CJK characters, of any length."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit(TOKEN), F.lit(0)), F.lower))


def overlap(query_tokens: Column, doc_tokens: Column) -> Column:
    """The share of the query's tokens that the document has."""
    return F.size(F.array_intersect(query_tokens, doc_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))


def sentences(text: Column | str) -> Column:
    """Trimmed sentences that are not blank, split after end marks and at line breaks."""
    return F.filter(F.transform(F.split(_text(text), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_text(text), r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def page_code(code: Column | str) -> Column:
    """A page code in upper case with single spaces."""
    return F.upper(F.regexp_replace(F.trim(_text(code)), r"\s+", " "))


def module_of(code: Column | str) -> Column:
    part = F.trim(F.split_part(_text(code), F.lit("-"), F.lit(1)))
    return F.when(part != "", part)


def is_decision_page(code: Column | str) -> Column:
    code = page_code(code)
    return code.rlike(r"^[A-Z]+-\d+$") & ~code.contains(" OF ")


def title_key(title: Column | str, limit: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(_text(title)), rf"[^a-z0-9{CJK}]+", " ")), 1, limit)


def journal_key(name: Column | str) -> Column:
    name = F.regexp_replace(F.lower(_text(name)), "&", " and ")
    name = F.regexp_replace(name, r"\bthe\b", " ")
    return F.trim(F.regexp_replace(name, rf"[^a-z0-9{CJK}]+", " "))


def doi_key(doi: Column | str) -> Column:
    key = F.regexp_replace(F.lower(F.trim(_text(doi))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    key = F.regexp_replace(key, r"[.,;\s]+$", "")
    return F.when(key != "", key)


def capitals(text: Column | str) -> Column:
    """In upper case, one character for one: ß gives ẞ, not SS, so that lower
    case leads back to it; a character without a single capital stays."""
    text = F.replace(_text(text), F.lit("ß"), F.lit("ẞ"))
    single = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c))
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(single, ""))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_text(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_lines(text: Column | str, noise: tuple[str, ...] = ()) -> Column:
    """Lines with white space squeezed, without blank lines and those that a noise pattern matches."""
    lines = F.transform(F.split(_text(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    kept = F.filter(lines, lambda x: reduce(lambda a, p: a & ~x.rlike(p), noise, x != ""))
    return F.array_join(kept, "\n")


def snippet(text: Column | str, chars: int = 320) -> Column:
    return F.substring(F.replace(_text(text), F.lit("\n"), F.lit(" ")), 1, chars)


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, n: a | text.contains(n), needles, F.lit(False))


def hits_of(text: Column, needles: tuple[str, ...]) -> Column:
    """The needles that the text contains, as an array."""
    return F.filter(F.array(*map(F.lit, needles)), lambda n: text.contains(n))


def pieces(text: Column, longest: int, shortest: int = 1) -> Column:
    """The different parts of a text of ``shortest`` to ``longest`` characters. A
    word stands in a text only if its first ``longest`` characters are one of
    them, so that containment can be joined by key and then tested."""
    at = lambda i: F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), at)))


def plain_spaces(text: Column | str) -> Column:
    """Without soft hyphens, with plain hyphens, single spaces and at most one blank line."""
    text = F.regexp_replace(F.translate(_text(text), "‐‑–­", "---"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def wide_tildes(text: Column | str) -> Column:
    """Tildes between letters or digits as wide ones, so that Markdown strikes nothing out."""
    return F.regexp_replace(_text(text), r"([0-9A-Za-z])\s*~\s*(?=[0-9A-Za-z])", "$1～")


def repaired_dashes(text: Column | str) -> Column:
    """Dashes that a wrong encoding left as a replacement mark and C."""
    return F.replace(_text(text), F.lit("�C"), F.lit("–"))


def is_safe_image(name: Column) -> Column:
    """A PNG's bare file name, without folders, climbing or control characters."""
    return F.coalesce(F.lower(name).endswith(".png") & ~name.contains("..") & ~name.rlike(r"[/\\\x00-\x1f]"), F.lit(False))


def is_noise_label(label: Column) -> Column:
    """A node's label that tells nothing: blank, a number, or a kind with a number."""
    return F.trim(_text(label)).rlike(r"(?i)^(\d*|\[\d+\]|(node|edge|entity|item|page|triple)[:_-]?\d*)$")
