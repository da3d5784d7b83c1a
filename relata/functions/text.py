"""Column functions on text: normal forms, labels, token sets, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relata.config import RELATED_TO

# fixed values: pronouns
PERSONAL = ("he", "him", "his", "she", "her", "hers")
IMPERSONAL = ("it", "its")
PLURAL = ("they", "them", "their")
PRONOUNS = PERSONAL + IMPERSONAL + PLURAL

# fixed values: gloss patterns, "Full Name (FN)" and "FN (Full Name)"
FULL_THEN_SHORT = r"([A-Z][A-Za-z.&\-]*(?:\s+[A-Za-z.&\-]+){0,4})\s*\(\s*([A-Z][A-Za-z.&]{1,9})\s*\)"
SHORT_THEN_FULL = r"\b([A-Z][A-Z.&]{1,9})\s*\(\s*([A-Z][A-Za-z.&\-]*(?:\s+[A-Za-z.&\-]+){0,4})\s*\)"


def squeeze(c: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_surface(c: Column) -> Column:
    """Canonical form of a mention's surface; null gives ''."""
    return squeeze(F.translate(F.lower(F.coalesce(c, F.lit(""))), "’.", "'"))


def normalize_phrase(c: Column) -> Column:
    """Form in which gold and predicted phrases are compared."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def readable_label(path: Column) -> Column:
    label = F.substring(F.regexp_replace(F.upper(F.replace(path, F.lit("→"), F.lit("_"))), "[^A-Z0-9_]", ""), 1, 40)
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(RELATED_TO))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_phrase(c), " "), lambda x: x != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(token_set(a), token_set(b))


def is_upper(c: Column) -> Column:
    """Some letter, and no lower-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def label_key(entity1: Column, entity2: Column, context: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", text(entity1), text(entity2), F.substring(text(context), 1, 60))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda x: x != ""))


def clean_number(c: Column) -> Column:
    """NaN and infinities to null, as a JSON payload needs it."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)
