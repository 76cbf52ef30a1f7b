import re

import pytest
from pyspark.sql import functions as F

from tests.llm.pii_held_out import FRESH, SENTENCES
from tidemark.llm import pii
from tidemark.llm.pii_examples import KINDS, Grammar, labelled_table

MARKS = {"n": "name", "N": "name", "J": "name", "e": "email", "p": "phone", "i": "id_number", "a": "address"}


@pytest.fixture(scope="module")
def tagger():
    return pii.trained_tagger()


def marked(sentence):
    """A hand-marked sentence's text and items; N and J stand for a name with a title before it."""
    text, items, at = "", [], 0
    for m in re.finditer(r"\[([^|\]]*)\|(.?)\]", sentence):
        text, at = text + sentence[at : m.start()], m.end()
        before = m[1].split(" ")[0] + " " if m[2] in ("N", "J") else ""
        if m[2] in MARKS:
            items.append((len(text) + len(before), len(text) + len(m[1]), MARKS[m[2]]))
        text += m[1]
    return text + sentence[at:], items


def accuracy(tagger, rows):
    """Precision and recall of whole items."""
    hit = made = true = 0
    for (_, items), got in zip(rows, pii.items_of(tagger, [t for t, _ in rows]), strict=True):
        hit, made, true = hit + len(set(items) & set(got)), made + len(got), true + len(items)
    return hit / made, hit / true


def test_phrases_and_names_are_split_without_overlap():
    a, b = Grammar(1, 0), Grammar(1, 1)
    for x in ("given_names", "families", "ends", "told", "plain", "does", "reaches", "onsets"):
        assert not set(getattr(a, x)) & set(getattr(b, x)) and getattr(b, x)


def test_phrases_and_names_never_seen():
    precision, recall = accuracy(pii.trained_tagger(12_000, part=0), labelled_table(1500, 77, part=1))
    assert precision > 0.85 and recall > 0.78


def test_ordinary_sentences(tagger):
    precision, recall = accuracy(tagger, [marked(s) for s in SENTENCES])
    assert precision > 0.9 and recall > 0.9
    precision, recall = accuracy(tagger, [marked(s) for s in FRESH])
    assert precision > 0.85 and recall > 0.8


def test_pruning_changes_nothing(tagger):
    texts = [t for t, _ in labelled_table(300, 8)] + ["", "   ", "?", "no data " * 20_000 + "call Robert Chen"]
    want = tagger.decode(texts)
    live, tagger._live = tagger._live, lambda run, table, trans: run.ids > 0
    try:
        assert tagger.decode(texts) == want
    finally:
        tagger._live = live
    assert tagger.decode(texts, tokens=50) == want


@pytest.mark.parametrize(
    ("text", "span", "kind", "want"),
    [
        ("to " + "a." * 300 + "z@mail.example.org now", (3, 8), "email", "a." * 300 + "z@mail.example.org"),
        ("to jo.lee (at) mail (dot) example (dot) org.", (40, 43), "email", "jo.lee (at) mail (dot) example (dot) org"),
        ("see JO@X.COM, ok", (4, 6), "email", "JO@X.COM"),
        ("dial +1 (415) 555-2671.", (5, 23), "phone", "+1 (415) 555-2671"),
        ("ext 4412", (4, 8), "phone", "4412"),
        ("Dr. Lee's car", (0, 9), "name", "Lee"),
        ("M. Lee", (0, 6), "name", "M. Lee"),
        ("at Rose Cottage,", (3, 16), "address", "Rose Cottage"),
        ("at 12 Elm St., flat", (3, 12), "address", "12 Elm St."),
    ],
)
def test_exact_item(text, span, kind, want):
    a, b = pii.exact_item(text, *span, kind)
    assert text[a:b] == want


def test_nothing_left_is_no_item():
    assert pii.exact_item("a - b", 2, 3, "name") is None and pii.exact_item("no mail", 0, 2, "email") is None and pii.exact_item("--", 0, 2, "address") is None


def test_table_with_nulls_copies_and_extra_columns(spark, tagger):
    loss = "The parcel went to 39 Harley Street."
    rows = [(1, loss, "q"), (1, loss, "q"), (2, None, None), (3, "", "q"), (None, "Spoke with Robert Chen.", "q"), (4, "no data " * 50_000, "q")]
    df = spark.createDataFrame(rows, "id int, text string, kind string").withColumn("start", F.lit(1))
    got = sorted(map(str, (tuple(r) for r in pii.find_personal_data(df, "text", ["id"], tagger).select("id", "kind", "item").collect())))
    assert got == sorted(map(str, [(1, "address", "39 Harley Street")] * 2 + [(None, "name", "Robert Chen")]))
    clean = [r["text"] for r in pii.redact_personal_data(df, "text", tagger).collect()]
    assert clean[0] == "The parcel went to [ADDRESS]." and clean[2] is None and clean[3] == "" and clean[4] == "Spoke with [NAME]." and clean[5] == rows[5][1]
    assert pii.find_personal_data(df.limit(0), "text", ["id"], tagger).collect() == []


def test_redaction_replaces_every_item_and_nothing_else(tagger):
    for text, _ in labelled_table(200, seed=5):
        items = pii.items_of(tagger, [text])[0]
        once = pii.redact(text, items)
        assert sum(once.count(f"[{k.upper()}]") for k in KINDS) == len(items)
        for a, b, kind in reversed(items):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        assert once == text


def test_labels_fit_their_text():
    for text, items in labelled_table(300, seed=1):
        assert all(text[a:b].strip() == text[a:b] != "" for a, b, _ in items)
