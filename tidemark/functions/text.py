"""Columns over text: labelled lines, citations, redaction, numbers, JSON and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A chunk reference between ASCII or full-width brackets.
CITATION = r"[\[【]([A-Z]{2}-\d{4}_[\d-]+#\d{2})[\]】]"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\(\d{3}\) ?\d{3}[ \-]\d{2} ?\d{2}|\d{3}[.\-]\d{3}[.\-]\d{4}"
CLAIM = r"(?i)\bCLM-\d{4}-\d{8}\b"


def or_null(c: Column) -> Column:
    """Null for the empty string that a failed match gives."""
    return F.nullif(c, F.lit(""))


def labelled(text: Column, label: str) -> Column:
    """The value of the first ``LABEL: value`` line, any case, null where there is none or it is blank."""
    return or_null(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{label}[^:\r\n]*:([^\r\n]*)", 1)))


def labelled_lines(text: Column, labels: Sequence[str]) -> Column:
    """A map of the known labels that stand in the text; the first line of a label counts."""
    pairs = F.array(*(F.struct(F.lit(x).alias("key"), labelled(text, x).alias("value")) for x in labels))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def citations(text: Column) -> Column:
    """Distinct cited chunk ids in order; null gives an empty list."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def dangling(cited: Column, known: Column) -> Column:
    return F.array_sort(F.array_except(cited, F.coalesce(known, F.array().cast("array<string>"))))


def redact(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered rules ``(label, pattern)``; matches become ``[LABEL]``."""
    for label, pattern in rules:
        text = F.regexp_replace(text, pattern, f"[{label}]")
    return text


def redaction_counts(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A map of the number of matches of each rule on the text the rules before it left."""
    entries = []
    for label, pattern in rules:
        entries.append(F.struct(F.lit(label).alias("key"), F.regexp_count(text, F.lit(pattern)).alias("value")))
        text = F.regexp_replace(text, pattern, f"[{label}]")
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: v > 0)


def is_clean(text: Column, rules: Sequence[tuple[str, str]], also: Column | None = None) -> Column:
    """No rule matches and none of the words of ``also`` is left."""
    dirty = F.lit(False)
    for _, pattern in rules:
        dirty = dirty | text.rlike(pattern)
    if also is not None:
        dirty = dirty | F.exists(also, lambda w: F.lower(text).contains(F.lower(w)))
    return ~F.coalesce(dirty, F.lit(False))


def numbers_in(text: Column) -> Column:
    """All whole numbers of a text, thousands commas removed."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,]*"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"))


def preview(text: Column, size: int = 110) -> Column:
    """White space collapsed, cut to ``size`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def fingerprint(text: Column, size: int = 12) -> Column:
    """The start of the SHA-256 of the text with Unix line ends."""
    return F.substring(F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256), 1, size)


def verdict(reply: Column) -> Column:
    """The verdict word of a grader's reply, thinking parts left out; null where unparsed."""
    return or_null(F.upper(F.regexp_extract(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"(?i)VERDICT:\s*(PASS|FAIL)", 1)))


def json_object(reply: Column) -> Column:
    """From the first brace to the last, null where there is none."""
    return or_null(F.regexp_extract(reply, r"(?s)\{.*\}", 0))


def wait_seconds(message: Column, cap: float = 900.0) -> Column:
    """Seconds of a ``7m2.5s`` style wait in a quota message, capped; null where there is none."""
    at = r"(?:(\d+)h)?(?:(\d+)m)?(\d+(?:\.\d+)?)s"
    part = lambda i: F.coalesce(or_null(F.regexp_extract(message, at, i)).cast("double"), F.lit(0.0))
    return F.when(message.rlike(at), F.least(F.lit(cap), part(1) * 3600 + part(2) * 60 + part(3)))


#: The dashes that count as hyphens in cited codes.
HYPHENS = "‐‑‒–—−"


def same_hyphens(text: Column) -> Column:
    return F.translate(text, HYPHENS, "-" * len(HYPHENS))


def rounded_fraction(k: Column, n: Column) -> Column:
    """``k/n pct%`` as text."""
    return F.format_string("%d/%d %d%%", k.cast("long"), n.cast("long"), F.round(F.coalesce(100 * F.try_divide(k, n), F.lit(0.0))).cast("long"))


def contains_word(payload: Column, words: Sequence[str]) -> Column:
    """Whether a serialised record holds one of the words, whole and in any case."""
    return F.coalesce(payload, F.lit("")).rlike(r"(?i)\b(?:" + "|".join(words) + r")\b")


def quota_fields(message: Column) -> Column:
    """Unit, limit, used, requested and wait of a quota message; unit ``unknown`` where unreadable."""
    number = lambda name: or_null(F.regexp_extract(message, rf"(?i){name}\D{{0,3}}(\d+)", 1)).cast("long")
    unit = or_null(F.regexp_extract(message, r"\b(TPM|TPD|RPM|RPD)\b", 1))
    return F.struct(
        F.coalesce(unit, F.lit("unknown")).alias("unit"), number("limit").alias("limit"), number("used").alias("used"),
        number("requested").alias("requested"), wait_seconds(message).alias("wait_s"),
    )


def numeric_entries(headers: Column) -> Column:
    """The entries of a string map whose values are numbers, as numbers."""
    return F.map_filter(F.transform_values(headers, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())


def route(user: Column, canary: Sequence[str], active: str, trial: str) -> Column:
    """The version a user gets: the trial one for canary users."""
    return F.when(F.coalesce(user.isin(list(canary)), F.lit(False)), trial).otherwise(active)


def render(template: str, values: dict[str, Column]) -> Column:
    """A template's ``{name}`` marks replaced; values are not looked into for further marks."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), F.coalesce(values[at[1]].cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def problems(**tests: Column) -> Column:
    """The names of the tests that did not hold, in order; a null test did not hold."""
    return F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())


def split_first(text: Column, mark: str = ":") -> Column:
    """``(head, tail)`` around the first mark; later marks stay in the tail, which is null without one."""
    at = F.instr(text, mark)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.struct(F.trim(head).alias("head"), F.when(at > 0, F.trim(F.substring(text, at + len(mark), F.length(text)))).alias("tail"))


def text_diff(before: Column, after: Column) -> Column:
    """A unified diff of two texts, empty where equal; an Arrow UDF, as no built-in does this."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "before", "after", lineterm="")) for x, y in zip(a, b, strict=True)])

    return F.when(before.eqNullSafe(after), F.lit("")).otherwise(diff(before, after))
