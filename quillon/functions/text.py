"""Scalar text functions as Catalyst expressions; Arrow UDFs only where Spark has no equivalent."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the token pattern of the math-aware tokenizer (commands, scripts, words).
TOKENS = r"\\[A-Za-z@]+\{[A-Za-z0-9]+\}|\\[A-Za-z@]+|[A-Za-z][_^](?:\{[A-Za-z0-9]+\}|[A-Za-z0-9])|\p{L}(?:(?:\p{L}|-)*\p{L})?"
# Routing patterns by tag, in order of priority.
ROUTES = {
    "AUTOFORMALIZATION": [r"\blean\b", r"\bmathlib\b", r"\bformalize\b", r"\btranslate\b.*\blean\b"],
    "VERIFICATION": [r"\bverify\b", r"\bcheck\b", r"\bvalid(ate)?\b", r"\bcorrect\b"],
    "LOOKUP": [r"\bwhat\s+is\b", r"\bdefin(e|ition)\b", r"\b(lemma|theorem|corollary|proposition)\s+\d", r"\bnotation\b", r"\bstate(ment)?\s+of\b"],
    "SYNTHESIS": [r"\bprove\b", r"\bproof\b", r"\bshow\s+that\b", r"\bderive\b", r"\bsketch\b"],
}
ROUTE_PREFIX = 200


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def name_key(s: pd.Series) -> pd.Series:
    """Case-folded, compatibility-decomposed, without marks, ASCII letters and digits only."""
    drop = re.compile("[^a-z0-9]+")
    return s.map(lambda x: drop.sub("", "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))), na_action="ignore")


def tokens(text: Column) -> Column:
    """Math-aware tokens in order: ``\\cmd{arg}`` is ``cmd_arg``, ``\\cmd`` is ``cmd``, ``X_{ij}`` is ``X_ij``; case kept.

    Null gives null, a text without words an empty array. Give composed text.
    """
    found = F.regexp_extract_all(F.replace(text, F.lit("$"), F.lit(" ")), F.lit(TOKENS), F.lit(0))
    return F.transform(found, token)


def token(t: Column) -> Column:
    command = F.regexp_replace(F.regexp_replace(F.substring(t, 2, 1_000_000), r"\{", "_"), r"\}", "")
    script = F.concat(F.substring(t, 1, 1), F.lit("_"), F.regexp_replace(F.substring(t, 3, 1_000_000), r"[{}]", ""))
    return F.when(t.startswith("\\"), command).when(t.rlike(r"^[A-Za-z][_^]"), script).otherwise(t)


def words(text: Column) -> Column:
    """Letter words with inner hyphens, case kept: the word branch of ``tokens``."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}(?:(?:\p{L}|-)*\p{L})?"), F.lit(0))


def trigrams(s: Column) -> Column:
    """The set of trigrams; a string under three characters is its own, an empty one has none."""
    n = F.length(s)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(s)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def route(query: Column) -> Column:
    """The tag of the first pattern that matches the first 200 characters, white space collapsed, any case; else LOOKUP."""
    q = F.trim(F.regexp_replace(F.substring(query, 1, ROUTE_PREFIX), r"\s+", " "))
    out = F.lit("LOOKUP")
    for tag, patterns in reversed(ROUTES.items()):
        out = F.when(q.rlike("(?i)" + "|".join(patterns)), tag).otherwise(out)
    return out


def label(name: Column, mark: Column) -> Column:
    """``name mark`` of the parts that are there; null if neither is."""
    return F.nullif(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(mark, F.lit(""))), F.lit(""))


def wrapped(text: Column, tag: str) -> Column:
    """The text between ``<tag>`` marks with the same marks inside it escaped; empty and null give the empty string."""
    start, end = f"<{tag}>", f"</{tag}>"
    safe = F.replace(F.replace(text, F.lit(end), F.lit(f"&lt;/{tag}&gt;")), F.lit(start), F.lit(f"&lt;{tag}&gt;"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").otherwise(F.concat(F.lit(start), safe, F.lit(end)))


# Passages stripped from retrieved text.
INJECTIONS = ["<|im_start|>", "<|im_end|>", "[INST]"]


def sanitized(text: Column) -> Column:
    for x in INJECTIONS:
        text = F.replace(text, F.lit(x), F.lit(""))
    return F.regexp_replace(text, "(?i)ignore previous instructions", "")


def strip_tex_comments(text: Column) -> Column:
    """Drops ``%`` to the end of the line unless an odd number of backslashes precedes it."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)%[^\n]*", "$1")


def strip_version(paper: Column) -> Column:
    return F.regexp_replace(paper, r"v\d+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def prefixed(*parts: Column) -> Column:
    """Parts joined with their byte lengths in front, so that no two lists of parts read alike; null counts as empty."""
    some = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*(x for p in some for x in (F.lpad(F.octet_length(p).cast("string"), 8, "0"), p)))


def paper_of_chunk(chunk: Column) -> Column:
    """The paper id in a chunk id: without the hash; of textbooks with their prefix."""
    return F.regexp_extract(chunk, r"^(?:arxiv:)?(.*):[0-9a-f]{16}$", 1)


def latex_atoms(text: Column) -> Column:
    """Commands, numbers and single characters of a formula."""
    return F.regexp_extract_all(text, F.lit(r"\\[A-Za-z]+|\\.|[0-9]+|[^\s]"), F.lit(0))
