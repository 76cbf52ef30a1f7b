"""Subject areas of documents: one-versus-rest linear classifiers over sentences.

Labels are weak: they name a document's areas, not its sentences, and some are wrong.
The classifiers therefore score sentences (hashed words, their beginnings and ends, and word
pairs), start from the labels of the whole document, and are refitted on what they themselves
find in it, first in the labelled documents, then in unlabelled ones.  A document has an area
when its second best sentence reaches the area's calibrated threshold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 18  # hashed features
LABELLED, UNLABELLED = 4000, 4000  # documents the fit may look at; a bound, not a share
CHARS = 32_000_000  # characters of each of the two that are taken to the driver at most
_ENDS = re.compile(r"[.!?;][\"”»)]*$")
_BEGINS = re.compile(r"[^\W\d_a-zß-öø-ÿ]|\d|[(\"«¿¡]")
_WORD = re.compile(r"[^\W\d_]+")
_LINE = ""  # stands for a line's end among the chunks


class Vocabulary:
    """Chunks between blanks and their words as met so far, each looked at once.

    A word's three features are itself, its first and its last four letters, so that a
    misspelt word shares one with the right one.
    """

    def __init__(self) -> None:
        self.chunk: defaultdict[str, int] = defaultdict(None, {_LINE: 0})
        self.chunk.default_factory = self.chunk.__len__
        self.word: dict[str, int] = {}
        self.first, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ends, self.begins = np.ones(1, bool), np.ones(1, bool)
        self.words, self.features = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

    def settle(self) -> None:
        """Looks at the chunks that have come in since."""
        words, count, ends, begins = [], [], [], []
        known = len(self.word)
        for chunk in islice(self.chunk, len(self.first), None):
            found = _WORD.findall(chunk.lower())
            words += [self.word.setdefault(w, len(self.word)) for w in found]
            count.append(len(found))
            ends.append(_ENDS.search(chunk) is not None)
            begins.append(_BEGINS.match(chunk) is not None)
        if not count:
            return
        size = np.array(count, np.int64)
        self.first = np.concatenate((self.first, len(self.words) + np.cumsum(size) - size))
        self.count = np.concatenate((self.count, size))
        self.ends, self.begins = np.concatenate((self.ends, ends)), np.concatenate((self.begins, begins))
        self.words = np.concatenate((self.words, np.array(words, np.int64)))
        code = lambda s: zlib.crc32(s.encode("utf-8", "replace"))
        new = [(code(w), code("^" + w[:4]), code(w[-4:] + "$")) for w in islice(self.word, known, None)]
        self.features = np.concatenate((self.features, np.array(new, np.int64).reshape(-1, 3)))


class Sentences(NamedTuple):
    """The sentences with words of some documents, word by word."""

    doc: np.ndarray  # the document's place, per sentence
    word: np.ndarray  # the word's place in the vocabulary
    row: np.ndarray  # its sentence
    pair: np.ndarray  # hashed neighbours within a sentence
    pair_row: np.ndarray
    vocabulary: Vocabulary

    @property
    def n(self) -> int:
        return len(self.doc)

    def only(self, docs: np.ndarray) -> Sentences:
        """The sentences of the documents marked in ``docs``."""
        keep = docs[self.doc]
        new = np.cumsum(keep) - 1
        w, p = keep[self.row], keep[self.pair_row]
        return Sentences(self.doc[keep], self.word[w], new[self.row[w]], self.pair[p], new[self.pair_row[p]], self.vocabulary)


def parse(texts: Sequence[str], vocabulary: Vocabulary | None = None) -> Sentences:
    """Cuts texts at line ends and behind full stops that a new start follows."""
    v = vocabulary or Vocabulary()
    flat, sizes, look = [], [], v.chunk.__getitem__
    for text in texts:
        before = len(flat)
        flat += map(look, (text.replace("\n", f" {_LINE} ") if "\n" in text else text).split())
        sizes.append(len(flat) - before)
    v.settle()
    c, doc = np.array(flat, np.int64), np.repeat(np.arange(len(sizes)), sizes)
    if not len(c):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, none, v)
    fresh = np.ones(len(c), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (v.ends[c[:-1]] & v.begins[c[1:]])
    times = v.count[c]
    at = np.repeat(v.first[c] - np.cumsum(times) + times, times) + np.arange(times.sum())
    word, row = v.words[at], np.repeat(np.cumsum(fresh) - 1, times)
    there, row = np.unique(row, return_inverse=True)
    doc = doc[np.flatnonzero(fresh)[there]]
    same = np.flatnonzero(row[1:] == row[:-1])
    h = v.features[:, 0]
    pair = (h[word[same]] * 1_000_003 + h[word[same + 1]] * 7919) % 2_147_483_647 % SPACE
    return Sentences(doc, word, row, pair, row[same], v)


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; groups are in order and may be missing."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(group):
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        out[group[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


class Model(NamedTuple):
    subjects: tuple[str, ...]
    weights: np.ndarray  # (SPACE, subjects)
    bias: np.ndarray
    thresholds: np.ndarray

    def word_weights(self, vocabulary: Vocabulary, since: int = 0) -> np.ndarray:
        return self.weights[vocabulary.features[since:] % SPACE].sum(1)

    def sentence_scores(self, s: Sentences, table: np.ndarray | None = None) -> np.ndarray:
        table = self.word_weights(s.vocabulary) if table is None else table
        z = _sums(table.take(s.word, axis=0), s.row, s.n) + _sums(self.weights.take(s.pair, axis=0), s.pair_row, s.n)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))

    def document_scores(self, s: Sentences, docs: int, table: np.ndarray | None = None) -> np.ndarray:
        """The second best sentence's score of each document and subject."""
        p, out = self.sentence_scores(s, table), np.zeros((docs, len(self.subjects)))
        if s.n:
            starts = np.flatnonzero(np.diff(s.doc, prepend=-1))
            place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, s.n)))
            best = p == np.maximum.reduceat(p, starts, axis=0)[place]
            upto = np.cumsum(best, axis=0)
            first = best & (upto - (upto[starts] - best[starts])[place] == 1)
            out[s.doc[starts]] = np.maximum(np.maximum.reduceat(np.where(first, -1.0, p), starts, axis=0), 0)
        return out


class _Batch(NamedTuple):
    """A share of the sentences, with what the gradient needs of them worked out once."""

    rows: np.ndarray
    word: np.ndarray
    row: np.ndarray
    pair: np.ndarray
    pair_row: np.ndarray
    used: np.ndarray
    by_word: tuple[np.ndarray, np.ndarray]
    by_feature: tuple[np.ndarray, np.ndarray, np.ndarray]
    by_pair: tuple[np.ndarray, np.ndarray, np.ndarray]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the order that brings equal ones together, and where each begins in it."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][starts], order, starts


def _batches(s: Sentences, rows: int, seed: int) -> list[_Batch]:
    share = np.random.default_rng(seed).integers(max(1, -(-s.n // rows)), size=s.n)
    out = []
    for b in range(int(share.max()) + 1 if s.n else 0):
        mine = share == b
        new, w, p = np.cumsum(mine) - 1, mine[s.row], mine[s.pair_row]
        used, word = np.unique(s.word[w], return_inverse=True)
        row, pair, pair_row = new[s.row[w]], s.pair[p], new[s.pair_row[p]]
        _, order, starts = _grouped(word)
        out.append(_Batch(np.flatnonzero(mine), word, row, pair, pair_row, used, (row[order], starts), _grouped(s.vocabulary.features[used].ravel() % SPACE), _grouped(pair)))
    return out


def _fit(s: Sentences, target: np.ndarray, epochs: int = 3, rows: int = 2000, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by AdaGrad over mini-batches of sentences."""
    k = target.shape[1]
    w, b = np.zeros((SPACE, k), np.float32), np.full(k, -3.0)
    gw, gb = np.full((SPACE, k), 1e-4, np.float32), np.full(k, 1e-4)
    batches, rng = _batches(s, rows, seed), np.random.default_rng(seed)

    def move(at: np.ndarray, g: np.ndarray) -> None:
        g = g + decay * w[at]
        gw[at] += g * g
        w[at] -= rate * g / np.sqrt(gw[at])

    for _ in range(epochs):
        for x in rng.permutation(len(batches)):
            t = batches[x]
            n, features = len(t.rows), s.vocabulary.features[t.used] % SPACE
            z = _sums(w[features].sum(1).take(t.word, axis=0), t.row, n) + _sums(w.take(t.pair, axis=0), t.pair_row, n) + b
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[t.rows]).astype(np.float32)
            per_word = np.add.reduceat(g.take(t.by_word[0], axis=0), t.by_word[1], axis=0)
            at, order, starts = t.by_feature
            move(at, np.add.reduceat(per_word.take(order // 3, axis=0), starts, axis=0))
            at, order, starts = t.by_pair
            if len(at):
                move(at, np.add.reduceat(g.take(t.pair_row[order], axis=0), starts, axis=0))
            total = g.sum(0)
            gb += total * total
            b -= rate * total / np.sqrt(gb)
    return w, b


def _train(subjects: tuple[str, ...], s: Sentences, y: np.ndarray, labelled: np.ndarray, rounds: int) -> Model:
    """Fit on documents of which those marked ``labelled`` have the areas ``y``."""
    on = s.only(labelled)
    model = Model(subjects, *_fit(on, y[on.doc]), np.full(len(subjects), 0.5))
    free = ~labelled & (np.bincount(s.doc, minlength=len(labelled)) > 0)
    for _ in range(rounds if free.any() else 0):
        # unlabelled documents take the areas found in them, as far as these are clear
        found = model.document_scores(s, len(y))
        clear = ((found > 0.7) | (found < 0.3)).all(1) & ((found > 0.7).any(1) | (found < 0.1).all(1))
        on = s.only(labelled | (free & clear))
        model = Model(subjects, *_fit(on, np.where(labelled[:, None], y, found > 0.5)[on.doc]), model.thresholds)
    # last, sentences: within a document that deals with an area the fillers go, clear errors of the labels too
    found = model.document_scores(s, len(y))
    deals = np.where(labelled[:, None], y > 0, found > 0.8)
    deals = (deals & (found > 0.1)) | (found > 0.97)
    p = model.sentence_scores(s)
    aim = np.where(p > 0.5, 1.0, np.where(p < 0.3, 0.0, p)) * deals[s.doc]
    return Model(subjects, *_fit(s, aim), model.thresholds)


def train(
    subjects: Sequence[str], labelled: Sequence[tuple[str, set[str]]], unlabelled: Sequence[str], hints: Sequence[tuple[str, str]] = (), rounds: int = 2, folds: int = 2
) -> Model:
    """Fit from (text, areas) pairs, ``hints`` (area, text known to deal with it), and plain texts.

    Thresholds are set by cross-fitting, at every size alike: each labelled document is scored
    by a model of the other ``folds - 1`` parts of all documents.  The model given back is
    fitted on all of them.
    """
    subjects = tuple(subjects)
    place = {s: j for j, s in enumerate(subjects)}
    texts = [t for t, _ in labelled] + [t for _, t in hints] + list(unlabelled)
    s = parse(texts)
    y = np.zeros((len(texts), len(subjects)))
    for i, (_, areas) in enumerate(labelled):
        y[i, [place[a] for a in areas if a in place]] = 1
    for i, (area, _) in enumerate(hints):
        y[len(labelled) + i, place[area]] = 1
    at = np.arange(len(texts))
    known, hint = at < len(labelled) + len(hints), (at >= len(labelled)) & (at < len(labelled) + len(hints))
    scores = np.zeros_like(y)
    for f in range(folds if len(labelled) else 0):
        inside = (at % folds != f) | hint
        part = s.only(inside)
        model = _train(subjects, part, y, known & inside, rounds)
        scores[~inside] = model.document_scores(s.only(~inside), len(texts))[~inside]
    thresholds = calibrate(scores[: len(labelled)], y[: len(labelled)] > 0)
    return _train(subjects, s, y, known, rounds)._replace(thresholds=thresholds)


def calibrate(score: np.ndarray, truth: np.ndarray, weight: float = 12.0) -> np.ndarray:
    """Per area the threshold of best F1, the middle of the best stretch, drawn towards the one
    of all areas together as if that stood on ``weight`` more documents with the area (in log odds)."""
    grid = np.linspace(-3, 8, 56)
    score = np.log(np.clip(score, 1e-9, 1 - 1e-9) / (1 - np.clip(score, 1e-9, 1 - 1e-9)))

    def best(p: np.ndarray, t: np.ndarray) -> float:
        if not t.any():
            return float(grid.max() / 2)
        f1 = np.array([2 * (t & (p >= g)).sum() / max(1, t.sum() + (p >= g).sum()) for g in grid])
        return float(np.median(grid[f1 >= f1.max() - 1e-9]))

    shared = best(score.ravel(), truth.ravel())
    n = truth.sum(0)
    own = np.array([best(score[:, j], truth[:, j]) for j in range(score.shape[1])])
    return 1 / (1 + np.exp(-(own * n + shared * weight) / (n + weight)))


def metadata_labels(known: Sequence[tuple[Mapping[str, str | None], set[str]]], others: Sequence[Mapping[str, str | None]], least: int = 10, share: float = 0.9) -> list[set[str] | None]:
    """Weak labels of documents from their metadata: an area that at least ``share`` of the
    ``least`` or more labelled documents with the same value of a field have; None without one."""
    seen: Counter = Counter()
    having: Counter = Counter()
    for fields, areas in known:
        for pair in fields.items():
            if pair[1] is not None:
                seen[pair] += 1
                having.update((pair, a) for a in areas)
    sure: defaultdict[tuple, set[str]] = defaultdict(set)
    for (pair, area), n in having.items():
        if area is not None and seen[pair] >= least and n >= share * seen[pair]:
            sure[pair].add(area)
    return [set().union(*(sure.get(p, set()) for p in fields.items())) or None for fields in others]


def train_from_tables(
    documents: DataFrame, labels: DataFrame, areas: DataFrame, metadata: Sequence[str] = (), labelled: int = LABELLED, unlabelled: int = UNLABELLED
) -> Model:
    """Fit on about ``labelled`` labelled and ``unlabelled`` other documents (never twice as
    many, and ``CHARS`` characters of each), drawn by hash of their ids; ``areas`` is the fixed
    list of subjects with descriptions.  ``metadata`` are columns of ``documents`` whose values
    give weak labels where they tell an area (:func:`metadata_labels`)."""
    named = {r["subject"]: r["description"] for r in areas.where("subject IS NOT NULL").collect()}
    fields = [F.col(m).cast("string").alias(f"_m{i}") for i, m in enumerate(metadata)]

    def drawn(df: DataFrame, most: int) -> DataFrame:
        """About ``most`` of the ids by hash; a filter, so no task and no driver holds more."""
        n = df.count()
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * most / max(1, n))))

    def taken(rows: DataFrame, most: int) -> list:
        """Texts on the driver; one longer than its share of ``CHARS`` could have 64 times over is left out of the fit."""
        rows = rows.where("text IS NOT NULL AND text != ''").where(F.length("text") <= 64 * CHARS // max(1, most))
        found, size = [], 0
        for r in sorted(rows.limit(2 * most).toLocalIterator(), key=lambda r: r["doc_id"]):
            size += len(r["text"])
            if size > CHARS:
                break
            found.append(r)
        return found

    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("areas"))
    picked = documents.select("doc_id", "text", *fields)
    known = taken(picked.join(drawn(marks, labelled), "doc_id"), labelled)
    rest = documents.select("doc_id").join(marks, "doc_id", "left_anti")
    others = taken(picked.join(drawn(rest, unlabelled), "doc_id"), unlabelled)
    about = lambda r: {f"_m{i}": r[f"_m{i}"] for i in range(len(metadata))}
    weak = metadata_labels([(about(r), set(r["areas"])) for r in known], [about(r) for r in others])
    pairs = [(r["text"], set(r["areas"])) for r in known] + [(r["text"], w) for r, w in zip(others, weak, strict=True) if w]
    hints = [(s, d) for s, d in sorted(named.items()) if d]
    return train(sorted(named), pairs, [r["text"] for r, w in zip(others, weak, strict=True) if not w], hints)


class _Scorer:
    """A model with the weights of the words met so far in this process."""

    def __init__(self, model: Model):
        self.model = model
        self.restart()

    def restart(self) -> None:
        self.vocabulary, self.table = Vocabulary(), np.zeros((0, len(self.model.subjects)), np.float32)

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if len(self.vocabulary.chunk) > 300_000:
            self.restart()
        s = parse(texts, self.vocabulary)
        self.table = np.concatenate((self.table, self.model.word_weights(self.vocabulary, len(self.table))))
        return self.model.document_scores(s, len(texts), self.table)


def subject_areas(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", chars: int = 4_000_000) -> DataFrame:
    """``(key, subject, score)``: the areas each document deals with, none, one or several.

    Null, empty and one-sentence texts have none; whole texts are read; repeated rows give
    repeated results; other columns are ignored.  Map-only: the weights (a fixed 10 MB) are
    broadcast, documents are scored about ``chars`` characters at a time.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        score = _Scorer(m)
        for b in batches:
            texts, keys = list(b["_text"]), b[key].to_numpy()
            cuts = np.cumsum([len(t) for t in texts]) // chars
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1) if texts else ():
                scores = score([texts[i] for i in part])
                doc, area = np.nonzero(scores >= m.thresholds)
                yield pd.DataFrame({key: keys[part[doc]], "subject": np.array(m.subjects, object)[area], "score": scores[doc, area]})

    rows = documents.select(key, F.col(text).alias("_text")).where("_text IS NOT NULL AND _text != ''")
    return rows.mapInPandas(run, f"`{key}` {kind}, subject string, score double")
