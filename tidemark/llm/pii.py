"""Personal data in free text: found by a conditional random field, replaced by placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.crf import Crf, read_lexicon
from tidemark.llm.pii_examples import ABBREVIATED, KINDS, TITLES, labelled_table
from tidemark.llm.tokens import VOCABULARIES

_AT, _DOT = r"(?:@|\s*[(\[]\s*at\s*[)\]]\s*)", r"(?:\.|\s*[(\[]\s*dot\s*[)\]]\s*)"
_EMAIL = re.compile(rf"[^\W_][\w.+'\-]*{_AT}[\w\-]+(?:{_DOT}[\w\-]*[^\W\d_])+", re.I)
_AT_SIGN = re.compile(r"[(\[]\s*at\s*[)\]]", re.I)
_JOINT = r"\s*[(\[]\s*(?:at|dot)\s*[)\]]\s*"
_BEFORE, _AFTER = re.compile(rf"(?:{_JOINT})$", re.I), re.compile(_JOINT, re.I)
_IN_ADDRESS = frozenset(".+-'@")
_TITLE = re.compile(rf"^(?:{'|'.join(sorted({t.rstrip('.') for t in TITLES if len(t.rstrip('.')) > 1}, key=len, reverse=True))})\b\.?\s*", re.I)
_ABBREVIATION = re.compile(rf"\b(?:{'|'.join(sorted(ABBREVIATED))})$", re.I)
_PHONE_BODY = re.compile(r"[+(\d].*\d", re.S)


#: Public vocabularies whose ranks tell how common a word is, in lower case and with a capital.
LEXICON = ("byte_bpe_50k", "byte_bpe_multi_50k")


@lru_cache(maxsize=2)
def trained_tagger(examples: int = 20_000, epochs: int = 4, seed: int = 11, part: int | None = None, lean: float = 0.6, folder: str = VOCABULARIES) -> Crf:
    """The tagger fitted to ``examples`` rows of the labelled table; the same every time.

    ``lean`` evens out precision and recall on phrases and names that had no part in the fit.
    """
    lexicon = read_lexicon([f"{folder}/{name}.tiktoken" for name in LEXICON])
    tagger = Crf(KINDS, lexicon).fit(labelled_table(examples, seed, part), epochs=epochs)
    tagger.lean = lean
    return tagger


def _address_run(text: str, start: int, end: int) -> tuple[int, int]:
    """The span widened, as far as it goes, over what an e-mail address can hold."""
    while True:
        while start and (text[start - 1].isalnum() or text[start - 1] == "_" or text[start - 1] in _IN_ADDRESS):
            start -= 1
        if not (m := _BEFORE.search(text, max(0, start - 40), start)):
            break
        start = m.start()
    while True:
        while end < len(text) and (text[end].isalnum() or text[end] == "_" or text[end] in _IN_ADDRESS):
            end += 1
        if not (m := _AFTER.match(text, end)):
            return start, end
        end = m.end()


def exact_item(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The span of a tagged item by the rules of its kind, None where nothing is left.

    E-mail addresses widen or shrink to the whole address; phones run from the first plus
    sign, bracket or digit to the last digit; names lose titles, possessives and stray
    marks; addresses keep the dot of an abbreviated street type unless it ends the sentence.
    """
    if kind == "email":
        for m in _EMAIL.finditer(text, *_address_run(text, start, end)):
            if m.start() < end and m.end() > start:
                return m.span()
        return None
    if kind == "phone":
        if text[start] == "(" and ")" not in text[start:end]:
            start += 1
        m = _PHONE_BODY.search(text[start:end])
        return (start + m.start(), start + m.end()) if m else None
    if kind == "name":
        if m := _TITLE.match(text[start:end]):
            start += m.end()
        if text[start:end].lower().endswith(("'s", "’s")):
            end -= 2
        while start < end and not text[start].isalpha():
            start += 1
        while start < end and not (text[end - 1].isalpha() or text[end - 1] == "." and re.search(r"(?:^|\W)\w\.$", text[start:end])):
            end -= 1
        return (start, end) if any(c.isalpha() for c in text[start:end]) else None
    while start < end and not text[start].isalnum():
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if start == end:
        return None
    if kind == "address" and text[end : end + 1] == "." and _ABBREVIATION.search(text[start:end]) and re.match(r"\.(?:[.,;:)?!]|\s+[(a-z\-])", text[end:]):
        end += 1
    return start, end


def items_of(tagger: Crf, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Checked items of each text in order, none overlapping."""
    out = []
    for text, tagged in zip(texts, tagger.decode(texts), strict=True):
        kept: list[tuple[int, int, str]] = []
        mail = "@" in text or _AT_SIGN.search(text) is not None
        for start, end, kind in tagged:
            if kind == "name" and mail and (inside := exact_item(text, start, end, "email")) and inside[0] <= start and end <= inside[1]:
                kind = "email"  # a name within an address is no item of its own
            if (span := exact_item(text, start, end, kind)) and (not kept or span[0] >= kept[-1][1]):
                kept.append((*span, kind))
        out.append(kept)
    return out


def find_personal_data(df: DataFrame, text: str, keep: list[str], tagger: Crf | None = None) -> DataFrame:
    """``(*keep, kind, item, start)``: one row per item of personal data, exactly as it stands.

    Null and empty texts give no rows, neither do texts without items; repeated rows give
    repeated items; a text of any length is one sequence.  Map-only: the model (some 14 MB,
    fixed by its hashed feature spaces) is broadcast, each distinct text of an Arrow batch
    is decoded once.
    """
    model = df.sparkSession.sparkContext.broadcast(tagger or trained_tagger())
    fields = {f.name: f for f in df.schema.fields}
    rows = df.select(*keep, df[text].alias("_text")).where("_text IS NOT NULL AND _text != ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code, texts = pd.factorize(b["_text"])
            found = items_of(model.value, list(texts))
            hits = [(i, texts[c][s:e], kind, s) for i, c in enumerate(code) for s, e, kind in found[c]]
            out = b[keep].iloc[[h[0] for h in hits]].reset_index(drop=True)
            yield out.assign(kind=[h[2] for h in hits], item=[h[1] for h in hits], start=[h[3] for h in hits])

    head = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keep)
    return rows.mapInPandas(run, f"{head}, kind string, item string, start int")


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """``text`` with each item replaced by its kind in square brackets."""
    parts, at = [], 0
    for start, end, kind in items:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact_personal_data(df: DataFrame, text: str, tagger: Crf | None = None) -> DataFrame:
    """``df`` with ``text`` redacted; null stays null, texts without items stay as they are."""
    model = df.sparkSession.sparkContext.broadcast(tagger or trained_tagger())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code, texts = pd.factorize(b[text])
            found = items_of(model.value, list(texts))
            done = [redact(t, f) for t, f in zip(texts, found, strict=True)]
            b[text] = [None if c < 0 else done[c] for c in code]
            yield b

    return df.mapInPandas(run, df.schema)
