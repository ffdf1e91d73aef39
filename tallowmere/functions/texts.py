"""Texts: normal forms, tokens, pair matching, counts and signals."""

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A reference of so many tokens counts as contained or overlapping, from this coverage on.
LEAST_TOKENS, HIGH_OVERLAP = 4, 0.80


def ascii_normal(c: Column) -> Column:
    """Lower-cased, everything but a-z and 0-9 as one blank, trimmed; empty for NULL."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and case folding, which Spark lacks; ``_`` and non-words become one blank."""

    def one(t):
        if t is None:
            return ""
        t = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(ch if ch.isalnum() else " " for ch in t).split())

    for s in texts:
        yield s.map(one, na_action=None)


@F.pandas_udf(StringType())
def undiacritic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower-cased without diacritics, only a-z, 0-9 and blanks."""

    def one(t):
        if t is None:
            return ""
        t = unicodedata.normalize("NFD", t.lower())
        return " ".join("".join(ch if ch.isascii() and ch.isalnum() else "" if unicodedata.combining(ch) else " " for ch in t).split())

    for s in texts:
        yield s.map(one, na_action=None)


def tokens(normal: Column) -> Column:
    """The blank-separated tokens of a normalised text; none of an empty one."""
    return F.filter(F.split(normal, " "), lambda x: x != "")


def coverage(candidate: Column, reference: Column) -> Column:
    """The share of the reference's distinct tokens that the candidate has; 0 of none."""
    ref = F.array_distinct(reference)
    return F.when(F.size(ref) == 0, 0.0).otherwise(F.size(F.array_intersect(candidate, ref)) / F.greatest(F.size(ref), F.lit(1)))


def pair_match(candidate: Column, reference: Column) -> Column:
    """EXACT, CONTAINED (a reference of four tokens or more), HIGH_OVERLAP (coverage of 0.80 or more) or NONE, of normalised texts."""
    ref = tokens(reference)
    whole = F.concat(F.lit(" "), candidate, F.lit(" "))
    return (
        F.when((candidate == "") | (reference == ""), "NONE")
        .when(candidate == reference, "EXACT")
        .when((F.size(ref) >= LEAST_TOKENS) & whole.contains(F.concat(F.lit(" "), reference, F.lit(" "))), "CONTAINED")
        .when((F.size(ref) >= LEAST_TOKENS) & (coverage(tokens(candidate), ref) >= HIGH_OVERLAP), "HIGH_OVERLAP")
        .otherwise("NONE")
    )


def match_priority(kind: Column) -> Column:
    return F.when(kind == "EXACT", 0).when(kind == "CONTAINED", 1).when(kind == "HIGH_OVERLAP", 2).otherwise(3)


def content_metrics(text: Column, shortest: int = 35, longest: int = 350) -> dict[str, Column]:
    """Words, sentences (one at least), words a sentence and whether the text is too short or too long."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n]+"))
    sentences = F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[.!?]+(\s|$)")), F.lit(1))
    return {"words": words.cast("long"), "sentences": sentences.cast("long"), "words_per_sentence": words / sentences, "too_short": words < shortest, "too_long": words > longest}


def percentages(text: Column) -> Column:
    """Every ``12.5 %`` in the text as a share, with a decimal point or comma."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)\s*%"), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double") / 100)


def overclaims(text: Column, claim: str, negation: str) -> Column:
    """A wording that claims too much, unless a negated form of it stands there."""
    return F.coalesce(text.rlike(claim) & ~text.rlike(negation), F.lit(False))


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases the normalised text contains as whole words."""
    whole = F.concat(F.lit(" "), ascii_normal(text), F.lit(" "))
    return sum((F.when(whole.contains(f" {p} "), 1).otherwise(0) for p in phrases), F.lit(0))


def language_signal(text: Column, letters: str, lexicon: Sequence[str], least_letters: int = 2, least_words: int = 3) -> Column:
    """True with enough of the language's letters or of its frequent words, repeats counted."""
    hits = F.size(F.filter(tokens(ascii_normal(text)), lambda x: x.isin(list(lexicon))))
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{letters}]")) >= least_letters) | (hits >= least_words)


def span(text: Column, part: Column) -> tuple[Column, Column]:
    """Start (from 0) and end of the first place of ``part``; NULL if there is none."""
    at = F.nullif(F.call_function("locate", part, text), F.lit(0))
    return at - 1, at - 1 + F.length(part)


def sections(parts: Sequence[Column], separator: str = "\n") -> tuple[Column, list[Column]]:
    """The non-null parts joined by ``separator`` and the start of each part in the whole."""
    starts, at = [], F.lit(0)
    for p in parts:
        starts.append(F.when(p.isNotNull(), at))
        at = at + F.when(p.isNotNull(), F.length(p) + len(separator)).otherwise(0)
    return F.concat_ws(separator, *parts), starts


def json_in(text: Column) -> Column:
    """The JSON of an answer: what a code fence holds, else from the first ``{`` to the last ``}``; NULL if none parses."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def safe_name(c: Column) -> Column:
    """A name of a-z, 0-9 and ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def technical_terms(text: Column, names: Sequence[str] = ()) -> Column:
    """How many words (runs without white space) hold an underscore, two capitals A-Z in a row or, in any case, one of the names."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.contains("_") | w.rlike("[A-Z]{2,}") | F.array_contains(F.array(*[F.lower(w).contains(n.lower()) for n in names] or [F.lit(False)]), True))
    return F.size(found).cast("long")


def heavy_prose(text: Column, lexicon: Sequence[str], least: int = 5) -> Column:
    """Whether at least ``least`` of the text's words (runs of a-z in lower case, repeats counted) are in the lexicon."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0)
    return F.size(F.filter(words, lambda w: w.isin(list(lexicon)))) >= least
