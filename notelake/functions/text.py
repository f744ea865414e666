"""Tokens, folding, stems, slugs and redaction as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}]+"
#: A query word; marks that stand after a letter belong to it.
QUERY_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*"
#: What a text is made of, in turn: a term with its marks, and what stands between terms.
PIECE = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+"

#: Query fields and operators that aren't search words.
QUERY_FIELDS = ("path", "type", "title", "description", "tags", "extra", "body", "content")
QUERY_OPERATORS = ("AND", "OR", "NOT", "NEAR")

#: Inflection endings in the order they are tried.
STEM_ENDINGS = ("ations", "ation", "ions", "ing", "ion", "ed")

#: Small Latin letters that decompose into a bare letter and marks, and those bare letters.
_MARKED = [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and len(unicodedata.normalize("NFKD", c)) > 1 and unicodedata.normalize("NFKD", c)[0].isascii()]
ACCENTED = "".join(c for c, b in _MARKED if b.isalpha())
BARE = "".join(b for c, b in _MARKED if b.isalpha())

#: Kinds of secrets and their patterns (no look-around), in the order they apply.
SECRETS = (
    ("private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("GitHub token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("token assignment", r"""token = "[0-9a-f]{40}\""""),
)


def query_tokens(query: Column) -> Column:
    """The search words of a query, without field prefixes and operators."""
    bare = F.regexp_replace(query, rf"(?i)\b({'|'.join(QUERY_FIELDS)}):", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit(QUERY_WORD), F.lit(0)), lambda t: ~F.upper(t).isin(*QUERY_OPERATORS))


def distinct_tokens(tokens: Column) -> Column:
    """Tokens without those that an earlier one equals in lower case."""
    first = lambda own, low: F.filter(own, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return _once(F.array_distinct(tokens), lambda own: _once(F.transform(own, F.lower), lambda low: first(own, low)))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, and not again for every element of an array."""
    return F.transform(F.array(value), of)[0]


def fold(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or stand after it. ASCII has
    neither, and is only lowered."""
    bare = F.regexp_replace(F.translate(F.lower(text), ACCENTED, BARE), r"\p{M}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(bare)


def index_terms(text: Column) -> Column:
    """The index's terms of a text, in order; an underscore parts terms."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4)


def slug(text: Column) -> Column:
    """A file name of a title."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def stem(token: Column) -> Column:
    """A safe prefix of an inflected word, or null: letters only, five or more, not all capitals."""
    low = F.lower(token)
    out = F.when(low.endswith("s") & ~low.endswith("es") & (F.char_length(low) >= 6), F.substring(low, F.lit(1), F.char_length(low) - 1))
    for ending in reversed(STEM_ENDINGS):
        out = F.when(low.endswith(ending) & (F.char_length(low) - len(ending) >= 5), F.substring(low, F.lit(1), F.char_length(low) - len(ending))).otherwise(out)
    return F.when(token.rlike(r"^\p{L}{5,}$") & (F.upper(token) != token), out)


def redact(text: Column) -> Column:
    """The text with every secret replaced by its kind."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def join_text(*parts: Column) -> Column:
    """The non-empty parts, one a line."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def words_of(text: Column) -> Column:
    """The distinct lowered words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def fit(text: Column, room: Column) -> Column:
    """The text cut to so many characters, with a mark where there is room for one."""
    mark = F.lit("\n[truncated]\n")
    cut = F.concat(F.regexp_replace(F.substring(text, F.lit(1), room - 13), r"\s+$", ""), mark)
    return F.when(room <= 0, "").when(F.char_length(text) <= room, text).when(room <= 13, F.substring(text, F.lit(1), room)).otherwise(cut)
