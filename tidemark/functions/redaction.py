"""Redaction of records: structured identifiers, names outside the wording's vocabulary, and the
single words of a record's names wherever else they stand.  Plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns of the rules, in the order they are applied.
CLAIM_ID = ("CLAIM_ID", r"(?i)\bCLM[-\s]?\d{4}[-\s]?\d{4,6}\b")
POLICY_ID = ("POLICY_ID", r"\b(?:POL|HO|DP)[-\s]?\d{2,4}[-\s]?\d{5,8}\b")
EMAIL = ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b")
PHONE = ("PHONE", r"(?:\+?1[-.\s]?)?\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}|\b(?:\+?1[-.\s]?)?\d{3}[-.\s]\d{3}[-.\s]\d{4}\b")
ADDRESS = ("ADDRESS", r"\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way)\b")
TITLED = ("NAME", r"\b(?:Mr|Mrs|Ms|Miss|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?")
PAIR = ("NAME", r"\b[A-Z][a-z]{1,15}\s+[A-Z][a-z]{1,15}\b")
HEALTH = (
    "HEALTH",
    r"(?i)[^.\n]*\b(?:injur(?:y|ies|ed)|stitch(?:es)?|fractur\w*|concussion|sprain\w*|bruis\w*|hospital\w*|paramedic\w*|smoke inhalation"
    r"|broken (?:arm|wrist|leg|ankle|hand|rib|nose)|cut (?:his|her|their) (?:hand|arm|leg|finger|head|foot))\b[^.\n]*\.?",
)
# Words that are no names although the wording may not have them, and titles.
STOP = (
    "the his her their our does did is was were do not no yes she he they we it this that monday tuesday wednesday thursday friday saturday sunday "
    "adjuster claimant policyholder please under per"
).split()
NAME_TITLES = "mr mrs ms miss dr".split()


class Rules(NamedTuple):
    """Ordered rules, the vocabulary that names are never made of, and the labels whose
    patterns must not be found in a clean text."""

    ordered: tuple[tuple[str, str], ...]
    vocabulary: tuple[str, ...]
    strict: tuple[str, ...] = ("CLAIM_ID", "EMAIL", "PHONE")


def with_claim_ids(vocabulary: Sequence[str]) -> Rules:
    """Claim numbers go, too."""
    return Rules((CLAIM_ID, POLICY_ID, EMAIL, PHONE, ADDRESS, TITLED, PAIR), tuple(vocabulary))


def keeping_claim_ids(vocabulary: Sequence[str], health: bool = False) -> Rules:
    """Claim numbers stay; with ``health`` whole sentences on injuries go, after the names."""
    return Rules((POLICY_ID, EMAIL, PHONE, ADDRESS, TITLED, PAIR, *((HEALTH,) if health else ())), tuple(vocabulary), ("EMAIL", "PHONE"))


def wording_vocabulary(texts: DataFrame, text: str, most: int = 200_000) -> list[str]:
    """The words of a wording corpus, lower case, with the fixed stop words; more than ``most``
    are an error, as the list is part of every task's plan."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).distinct()
    found = [r[0] for r in words.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a vocabulary of more than {most} words")
    return sorted({*found, *STOP})


def is_vocabulary(phrase: Column, vocabulary: Sequence[str]) -> Column:
    """Whether any word of a phrase is one of the wording's."""
    return F.exists(F.split(phrase, r"(?U)\s+"), lambda w: F.lower(F.btrim(w, F.lit("."))).isin(list(vocabulary)))


def _wide(pattern: str) -> str:
    """The pattern with letters, blanks and word ends of all scripts."""
    return "(?U)" + pattern


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(_wide(pattern)), F.lit(0))


def _swap_names(text: Column, pattern: str, vocabulary: Sequence[str]) -> Column:
    """Matches that are no vocabulary replaced: the text's pieces and its matches put together anew."""
    swapped = F.transform(_matches(text, pattern), lambda m: F.when(is_vocabulary(m, vocabulary), m).otherwise(F.lit("[NAME]")))
    return F.array_join(F.zip_with(F.split(text, _wide(pattern), -1), F.concat(swapped, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def name_tokens(text: Column, vocabulary: Sequence[str]) -> Column:
    """The single words, of over two letters, of every name of a text; an empty array for null."""
    known = list(vocabulary)
    phrases = F.filter(F.concat(_matches(text, TITLED[1]), _matches(text, PAIR[1])), lambda m: ~is_vocabulary(m, known))
    words = F.flatten(F.transform(phrases, lambda m: F.transform(F.split(m, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(".")))))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin([*known, *NAME_TITLES]))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def _any_word(tokens: Column) -> Column:
    """A pattern of whole words; tokens are letters only, longest first."""
    ordered = F.array_sort(tokens, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.concat(F.lit(r"(?U)\b(?:"), F.array_join(ordered, "|"), F.lit(r")\b"))


def redact_text(text: Column, rules: Rules, also: Column | None = None) -> Column:
    """The rules in order, then the words of ``also`` as names.  Null and empty stay."""
    for label, pattern in rules.ordered:
        text = _swap_names(text, pattern, rules.vocabulary) if label == "NAME" else F.regexp_replace(text, _wide(pattern), f"[{label}]")
    return text if also is None else F.when(F.size(also) > 0, F.regexp_replace(text, _any_word(also), F.lit("[NAME]"))).otherwise(text)


def label_counts(clean: Column, labels: Sequence[str], before: Column) -> Column:
    """A map of placeholders that redaction put into a text, beyond those that stood there before."""
    count = lambda c, x: F.regexp_count(c, F.lit(rf"\[{x}\]"))
    entries = F.array(*(F.struct(F.lit(x).alias("key"), (count(clean, x) - count(before, x)).alias("value")) for x in labels))
    return F.map_filter(F.map_from_entries(entries), lambda k, v: v > 0)


def is_clean(text: Column, rules: Rules, also: Column) -> Column:
    """No strict rule matches any more and no word of ``also`` is left; null is clean."""
    dirty = F.when(F.size(also) > 0, F.rlike(text, _any_word(also))).otherwise(F.lit(False))
    for label, pattern in rules.ordered:
        if label in rules.strict:
            dirty = dirty | text.rlike(_wide(pattern))
    return ~F.coalesce(dirty, F.lit(False))


# ---- nested values --------------------------------------------------------------------------


def strings_of(value: Column, kind: T.DataType) -> Column:
    """All strings of a nested value as one array, without nulls and map keys."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [strings_of(value[f.name], f.dataType) for f in kind.fields if _holds_text(f.dataType)]
        return F.coalesce(F.concat(*parts), none) if parts else none
    if isinstance(kind, T.ArrayType) and _holds_text(kind.elementType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings_of(x, kind.elementType))), none)
    if isinstance(kind, T.MapType) and _holds_text(kind.valueType):
        return strings_of(F.map_values(value), T.ArrayType(kind.valueType))
    return none


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    return _holds_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def redact_nested(value: Column, kind: T.DataType, rules: Rules, also: Column) -> Column:
    """A nested value with every string in it redacted, its type unchanged, nulls kept."""
    if not _holds_text(kind):
        return value
    if isinstance(kind, T.StringType):
        return redact_text(value, rules, also)
    if isinstance(kind, T.StructType):
        fields = [redact_nested(value[f.name], f.dataType, rules, also).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType, rules, also))
    return F.transform_values(value, lambda _, v: redact_nested(v, kind.valueType, rules, also))


def scrub(df: DataFrame, fields: Sequence[str], rules: Rules, tokens: str = "name_words", clean: str = "is_clean") -> DataFrame:
    """``df`` with ``fields``, flat or nested, redacted together: the words of a name found in one
    of them go from all.  Two columns are added: the words, and whether nothing was left.

    Null fields stay null, other columns as they are; no shuffle, all of it in the JVM.
    """
    if {tokens, clean} & set(df.columns):
        raise ValueError("the added columns must have new names")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = F.concat(*(strings_of(F.col(f), kinds[f]) for f in fields))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform(texts, lambda t: name_tokens(t, rules.vocabulary)))))
    done = df.withColumn(tokens, words)
    done = done.withColumns({f: redact_nested(F.col(f), kinds[f], rules, F.col(tokens)) for f in fields})
    left = F.concat(*(strings_of(F.col(f), kinds[f]) for f in fields))
    return done.withColumn(clean, F.forall(left, lambda t: is_clean(t, rules, F.col(tokens))))
