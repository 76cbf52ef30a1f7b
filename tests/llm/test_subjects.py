import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import subjects as s

WORDS = {"fire": "smoke soot flames ember matches kiln ashes".split(), "water": "leak drain valve pipe flood pump basin".split(), "law": "court brief appeal motion counsel statute jury".split()}
FILLER = ["Nothing else was decided.", "A copy went to the desk.", "See item 4 of the list.", "The folder was closed on Monday."]


def make(n, seed):
    r, rows = random.Random(seed), []
    for _ in range(n):
        areas = set(r.sample(sorted(WORDS), r.choice((0, 1, 1, 2))))
        lines = [f"This part is about {a} and {b}." for x in areas for a, b in (r.sample(WORDS[x], 2) for _ in range(r.choice((2, 3))))]
        for x in set(WORDS) - areas:
            if r.random() < 0.3:
                lines.append(f"As an aside, someone mentioned {r.choice(WORDS[x])}.")
        lines += r.sample(FILLER, 3)
        r.shuffle(lines)
        rows.append((" ".join(lines), areas))
    return rows


@pytest.fixture(scope="module")
def model():
    return s.train(sorted(WORDS), make(500, 1), [t for t, _ in make(300, 2)])


def test_held_out_documents(model):
    held = make(400, 9)
    scores = model.document_scores(s.parse([t for t, _ in held]), len(held))
    got = {(i, model.subjects[j]) for i, j in zip(*np.nonzero(scores >= model.thresholds), strict=True)}
    want = {(i, a) for i, (_, areas) in enumerate(held) for a in areas}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.95


def test_second_best_sentence_counts(model):
    p = s.parse(["", "one", "Smoke and soot. Flames and ember."])
    assert p.doc.tolist() == [1, 2, 2]
    once = model.document_scores(s.parse(["This part is about smoke and soot."]), 1)
    assert (once == 0).all()
    text = "This part is about smoke and soot. Nothing else. This part is about flames and ember."
    both = s.parse([text, "Nothing.", text])
    scores, p = model.document_scores(both, 3), model.sentence_scores(both)
    assert np.allclose(scores, [np.sort(p[both.doc == i], axis=0)[-2] if (both.doc == i).sum() > 1 else 0 * p[0] for i in range(3)])


def test_sentences():
    def cut(text):
        v = s.Vocabulary()
        p, names = s.parse([text], v), list(v.word)
        return [" ".join(names[w] for w in p.word[p.row == i]) for i in range(p.n)]

    assert cut("He came. She left; nobody cared.\nthe end") == ["he came", "she left nobody cared", "the end"]
    assert cut("See p. 4 (a). \r\n\n  «Voilà.» Oui! 3 x") == ["see p", "a", "voilà", "oui", "x"]
    assert cut(" \n .. 12 \n") == [] and cut("No end here") == ["no end here"]


def test_misspelt_words_share_features():
    p = s.parse(["sistered sisterde sitsered Sistered"])
    a, b, c, d = (set(p.vocabulary.features[w].tolist()) for w in p.word)
    assert a == d and len(a & b) == 1 and len(a & c) == 1 and len(a) == 3


def test_thresholds_come_from_the_data_at_every_size():
    few = s.train(sorted(WORDS), make(30, 5), [t for t, _ in make(60, 6)])
    other = s.train(sorted(WORDS), make(30, 7), [t for t, _ in make(60, 8)])
    assert not np.allclose(few.thresholds, other.thresholds) and ((few.thresholds > 0) & (few.thresholds < 1)).all()
    score, truth = np.array([[0.9], [0.8], [0.3], [0.2]] * 50), np.array([[True], [True], [False], [False]] * 50)
    assert 0.3 < s.calibrate(score, truth)[0] < 0.8
    assert s.calibrate(np.zeros((0, 2)), np.zeros((0, 2), bool)).shape == (2,)


def test_labels_from_metadata():
    known = [({"path": "law/x", "kind": None}, {"law"})] * 12 + [({"path": "mixed", "kind": "k"}, {"fire"}), ({"path": "mixed", "kind": "k"}, set())] * 8
    others = [{"path": "law/x", "kind": "k"}, {"path": "mixed", "kind": None}, {"path": None, "kind": None}]
    assert s.metadata_labels(known, others) == [{"law"}, None, None]
    assert s.metadata_labels(known[:5], others) == [None, None, None] and s.metadata_labels([], []) == []


def test_table(spark, model):
    text = "This part is about smoke and soot. This part is about flames and ember."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n "), (None, text), (5, "x" * 300_000), (6, (FILLER[0] + " ") * 20_000 + text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("subject", F.lit("z")).withColumn("score", F.lit(1))
    got = sorted(map(str, (tuple(r) for r in s.subject_areas(df, model).select("doc_id", "subject").collect())))
    assert got == sorted(map(str, [(1, "fire"), (1, "fire"), (None, "fire"), (6, "fire")]))
    assert s.subject_areas(df.limit(0), model).collect() == []


def test_training_from_tables(spark):
    rows = make(300, 4)
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, (t, _) in enumerate(rows)] + [(999, None, None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, a) for i, (_, areas) in enumerate(rows[:260]) for a in (areas or [None])] + [(999, "law")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(a, f"all about {a}") for a in WORDS] + [("empty", None)], "subject string, description string")
    model = s.train_from_tables(docs, labels, areas, ["source"])
    assert model.subjects == ("empty", "fire", "law", "water")
    nothing = s.train_from_tables(docs.limit(0), labels, areas)
    assert s.subject_areas(docs, nothing).count() >= 0
