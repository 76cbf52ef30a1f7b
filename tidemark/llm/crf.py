"""A linear-chain conditional random field over word-shape features, in numpy."""

from __future__ import annotations

import base64
import copy
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
REACH = 3  # tokens looked at on either side
WORDS, PAIRS = 1 << 15, 1 << 14  # hashed feature spaces
_BAD = -1e4

Item = tuple[int, int, str]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


_CLASS = {i: "d" if chr(i).isdigit() else "X" if chr(i).isupper() else "x" if chr(i).isalpha() else chr(i) for i in range(0x250)}
_LONG, _RUNS = re.compile(r"(X|x)\1{3,}"), re.compile(r"(X|x)\1+")


def classes(text: str) -> str:
    """Digits as d, capitals as X, other letters as x, all else as it is."""
    plain = text.translate(_CLASS)
    return plain if plain.isascii() else "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in text)


def shape(word: str) -> str:
    return _LONG.sub(r"\1\1\1+", classes(word[:24]))


def read_lexicon(files: Sequence[str]) -> dict[str, str]:
    """How common a word is in lower case and with a capital, from vocabulary files of public
    tokenizers: their ranks go by frequency.  Two marks of 0 (frequent) to 3 (not a piece)."""
    marks: dict[str, list[int]] = {}
    for name in files:
        for piece, rank in map(bytes.split, Path(name).read_bytes().splitlines()):
            word = base64.b64decode(piece).decode("utf-8", "replace")
            if word[:1] == " " and word[1:].isalpha() and (word[1:].islower() or word[1:].istitle()):
                both, case = marks.setdefault(word[1:].lower(), [3, 3]), int(not word[1:].islower())
                both[case] = min(both[case], int(int(rank) > 5000) + int(int(rank) > 16000))
    return {w: f"{a}{b}" for w, (a, b) in marks.items()}


@lru_cache(maxsize=50_000)
def _form_features(form: str, known: str, alpha: bool, case: str, size: int) -> tuple[int, ...]:
    feats = [f"s={form}", f"c={re.sub(r'(.)\1+', r'\1', form)}", f"n={min(size, 12)}"]
    if alpha:
        feats += [f"t={case}", f"k={known}", f"kt={known}{case}"]
    return tuple(_hash(f) % WORDS for f in feats)


def word_features(word: str, lexicon: Mapping[str, str], known_only: bool = False) -> np.ndarray:
    """Hashed features of a word; ``known_only`` leaves out those of its letters."""
    low, alpha = word.lower(), word[0].isalpha()
    case = "U" if word.isupper() else "l" if word.islower() else "T" if word.istitle() else "m"
    feats = _form_features(shape(word), lexicon.get(low, "33"), alpha, case, min(len(word), 12))
    if known_only:
        return np.array(feats)
    parts = (f"w={low}", f"2{low[:2]}", f"3{low[:3]}", f"4{low[:4]}", f"e{low[-2:]}", f"f{low[-3:]}", f"g{low[-4:]}", f"h{low[-5:]}") if alpha else (f"w={low}",)
    return np.array(feats + tuple(zlib.crc32(p.encode("utf-8", "replace")) % WORDS for p in parts))


_MARKS = re.compile(r"^[\"'“”‘’«»]+|[\"'“”‘’«»,;:!?.]+$")


def chunk_shape(chunk: str) -> int:
    """A stretch between blanks: its letters as runs, every digit and mark."""
    return _hash(_RUNS.sub(r"\1", classes(_MARKS.sub("", chunk)[:40]))) % 1_000_003


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 1_000_003 + b * 7919) % 2_147_483_647 % PAIRS).astype(np.int64)


class Words:
    """The distinct words met so far: place 0 is the blank around a text."""

    def __init__(self, lexicon: Mapping[str, str]):
        self.lexicon = lexicon
        self.place: defaultdict[str, int] = defaultdict(None, {"": 0})
        self.place.default_factory = self.place.__len__
        self.features = [np.array([_hash("edge") % WORDS])]
        self.shape = np.array([_hash("") % 1_000_003], np.int64)
        self.low = self.shape.copy()
        self.chunks: dict[str, tuple[list[int], list[int]]] = {}

    def read(self, text: str) -> tuple[list[int], list[int]]:
        """Word places and chunk shapes of a text's tokens."""
        ids: list[int] = []
        forms: list[int] = []
        for chunk in text.split():
            if (met := self.chunks.get(chunk)) is None:
                tokens = TOKEN.findall(chunk)
                met = self.chunks[chunk] = [self.place[t] for t in tokens], [chunk_shape(chunk)] * len(tokens)
            ids += met[0]
            forms += met[1]
        return ids, forms

    def settle(self) -> None:
        """Features of the words that have come in since."""
        new = list(islice(self.place, len(self.features), None))
        self.features += [word_features(w, self.lexicon) for w in new]
        # the pairs see how well a word is known beside its shape
        self.shape = np.concatenate((self.shape, [_hash(shape(w) + self.lexicon.get(w.lower(), "33")) % 1_000_003 for w in new])).astype(np.int64)
        self.low = np.concatenate((self.low, [_hash(w.lower()) % 1_000_003 for w in new])).astype(np.int64)

    def masked(self) -> np.ndarray:
        """For each word the place of a copy of which only shape and frequency are known."""
        self.features += [word_features(w, self.lexicon, True) if w else self.features[0] for w in list(self.place)]
        self.shape, self.low = np.tile(self.shape, 2), np.concatenate((self.low, np.full(len(self.low), self.low[0])))
        return np.arange(len(self.place)) + len(self.place)


class Run:
    """Texts as one run of word places with ``REACH`` blanks around each."""

    def __init__(self, texts: Sequence[tuple[list[int], list[int]]], words: Words):
        blank, flat, forms, starts = [0] * REACH, [0] * REACH, [0] * REACH, []
        for ids, shapes in texts:
            starts.append(len(flat))
            flat += ids
            flat += blank
            forms += shapes
            forms += blank
        words.settle()
        self.ids, self.forms, self.starts = np.array(flat, np.int64), np.array(forms, np.int64), np.array(starts, np.int64)
        self.sizes = np.array([len(ids) for ids, _ in texts], np.int64)
        self.words = words

    def pairs(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """The hashed pair features of places."""
        s, low = self.words.shape, self.words.low
        here, left, right = s[self.ids[at]], self.ids[at - 1], self.ids[at + 1]
        yield (both := _pair(s[left], here))
        yield _pair(here, s[right]) ^ 1
        yield _pair(both, s[right]) ^ 2
        yield _pair(low[left], here) ^ 3
        yield _pair(here, low[right]) ^ 4
        form = self.forms[at]
        yield _pair(form, here) ^ 5
        yield _pair(form, low[left]) ^ 6
        yield _pair(_pair(form, self.forms[at - 1]), self.forms[at + 1]) ^ 7


class Crf:
    """Labels are O, and for each kind B (first token) and I (further tokens)."""

    def __init__(self, kinds: Sequence[str], lexicon: Mapping[str, str] | None = None):
        self.kinds, self.lexicon = tuple(kinds), dict(lexicon or {})
        self.labels = ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]
        n = len(self.labels)
        self.word = np.zeros((2 * REACH + 1, WORDS, n), np.float32)
        self.pair = np.zeros((8, PAIRS, n), np.float32)
        self.step = np.zeros((n, n), np.float32)
        inside = np.array([x[0] == "I" for x in self.labels])
        self.allowed = np.ones((n, n), bool)
        for j in np.flatnonzero(inside):
            self.allowed[:, j] = [x[2:] == self.labels[j][2:] and x != "O" for x in self.labels]
        self.begin = np.where(inside, _BAD, 0.0).astype(np.float32)
        self.lean = 0.0  # taken from O when decoding: more items, some of them wrong
        self._met: tuple[Words, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_met": None}

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.step, _BAD)

    def word_scores(self, words: Words, which: Sequence[int]) -> np.ndarray:
        """(offset, word, label) scores of words, each scored once."""
        feats = [words.features[i] for i in which]
        flat, sizes = np.concatenate(feats), np.array([len(f) for f in feats])
        return np.stack([np.add.reduceat(self.word[o][flat], np.cumsum(sizes) - sizes, axis=0) for o in range(2 * REACH + 1)])

    def emissions(self, run: Run, at: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Label scores of places of the run."""
        total = table[REACH].take(run.ids[at], axis=0)
        for o in range(-REACH, REACH + 1):
            if o:
                total += table[o + REACH].take(run.ids[at + o], axis=0)
        for k, p in enumerate(run.pairs(at)):
            total += self.pair[k].take(p, axis=0)
        total[:, 0] -= self.lean
        return total

    # ---- decoding ----------------------------------------------------------------------------

    def decode(self, texts: Sequence[str], tokens: int = 100_000) -> list[list[Item]]:
        """Items (start, end, kind) of each text by Viterbi, ``tokens`` at a time or one longer text."""
        found, held, size, first = [], [], 0, 0
        for i, text in enumerate(texts):
            if not held and (self._met is None or len(self._met[0].features) > 60_000 or len(self._met[0].chunks) > 200_000):
                self._met = Words(self.lexicon), np.zeros((2 * REACH + 1, 0, len(self.labels)), np.float32)
            held.append(self._met[0].read(text))
            size += len(held[-1][0])
            if size >= tokens or i == len(texts) - 1:
                found += self._decode(texts[first : i + 1], held)
                held, size, first = [], 0, i + 1
        return found

    def _table(self, held: Sequence[tuple[list[int], list[int]]]) -> tuple[Run, np.ndarray]:
        """The run of texts, with the scores of all words met so far in this process."""
        words, table = self._met
        run = Run(held, words)
        if table.shape[1] < len(words.features):
            table = np.concatenate((table, self.word_scores(words, range(table.shape[1], len(words.features)))), 1)
        self._met = words, table
        return run, table

    def _live(self, run: Run, table: np.ndarray, trans: np.ndarray, piece: int = 32_768) -> np.ndarray:
        """Which places can be part of an item at all.

        An item is worth more than O on all its tokens only if the sum of what each token gains
        by it, with the most its transitions can add, is above zero; places that no such
        span holds are O on the best path and need no Viterbi.
        """
        inner = np.flatnonzero(run.ids)
        gain = np.full(len(run.ids), -1e6)
        for lo in range(0, len(inner), piece):
            e = self.emissions(run, inner[lo : lo + piece], table)
            gain[inner[lo : lo + piece]] = e[:, 1:].max(1) - e[:, 0]
        b, i = np.arange(1, len(self.labels), 2), np.arange(2, len(self.labels), 2)
        free = np.concatenate(([0], b))  # what may follow an item
        enter = max((trans[:, b] - trans[:, :1]).max(), 0.0)
        leave = max((trans[1:][:, free] - trans[0, free]).max(), 0.0)
        more = max((max(trans[k, j] for k in (j - 1, j)) for j in i), default=0.0) - trans[0, 0]
        w = gain + more
        total = np.cumsum(w)
        upto = total - np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))  # the best span that ends here
        ahead = np.cumsum(w[::-1])
        since = (ahead - np.minimum.accumulate(np.concatenate(([0.0], ahead[:-1]))))[::-1]  # the best span that begins here
        return (upto + since - w + enter + leave - more > -1e-3) & (run.ids > 0)

    def _decode(self, texts: Sequence[str], held: Sequence[tuple[list[int], list[int]]]) -> list[list[Item]]:
        found: list[list[Item]] = [[] for _ in texts]
        if not any(ids for ids, _ in held):
            return found
        run, table = self._table(held)
        trans = self.transitions()
        live = self._live(run, table, trans)
        edge = np.flatnonzero(np.diff(live.astype(np.int8), prepend=0, append=0))
        heads, sizes = edge[::2], edge[1::2] - edge[::2]
        order = np.argsort(sizes, kind="stable")
        path = np.zeros(len(run.ids), np.int8)
        lo = 0
        while lo < len(order):
            hi = min(lo + 2048, len(order))
            while hi - lo > 1 and sizes[order[hi - 1]] * (hi - lo) > 60_000:
                hi = lo + (hi - lo) // 2
            self._viterbi(run, table, trans, heads[order[lo:hi]], sizes[order[lo:hi]], path)
            lo = hi
        text_of = np.searchsorted(run.starts, np.flatnonzero(path), "right") - 1
        for i in np.unique(text_of):
            labels = path[run.starts[i] : run.starts[i] + run.sizes[i]]
            found[i] = self._items(labels, [m.span() for m in TOKEN.finditer(texts[i])])
        return found

    def _viterbi(self, run: Run, table: np.ndarray, trans: np.ndarray, heads: np.ndarray, sizes: np.ndarray, path: np.ndarray) -> None:
        """The best labels of stretches of places, with O or the text's edge around them."""
        steps = int(sizes.max())
        at = heads[:, None] + np.minimum(np.arange(steps), sizes[:, None] - 1)
        scores = self.emissions(run, at.ravel(), table).reshape(*at.shape, -1)
        after_o = np.where(run.ids[heads - 1, None] == 0, self.begin, trans[0])
        before_o = np.where(run.ids[heads + sizes, None] == 0, 0.0, trans[:, 0])
        back = np.zeros((steps, len(heads), len(self.labels)), np.int8)
        best = scores[:, 0] + after_o
        for t in range(1, steps):
            there = t < sizes
            options = best[there][:, :, None] + trans
            back[t][there] = options.argmax(1)
            best[there] = options.max(1) + scores[there, t]
        last = (best + before_o).argmax(1)
        for t in range(steps - 1, -1, -1):
            there = np.flatnonzero(t < sizes)
            path[at[there, t]] = last[there]
            if t:
                last[there] = back[t, there, last[there]]

    def _items(self, path: np.ndarray, spans: list[tuple[int, int]]) -> list[Item]:
        items: list[Item] = []
        for t in np.flatnonzero(path):
            label = self.labels[path[t]]
            if label[0] == "B" or not items:
                items.append((*spans[t], label[2:]))
            else:
                items[-1] = (items[-1][0], spans[t][1], items[-1][2])
        return items

    # ---- fitting -----------------------------------------------------------------------------

    def fit(self, table: Sequence[tuple[str, list[Item]]], epochs: int = 6, rate: float = 0.08, batch: int = 200, decay: float = 1e-5, hidden: float = 0.4, seed: int = 5) -> Crf:
        """Maximum likelihood by AdaGrad over mini-batches; gradients by forward-backward.

        In each pass the letters of a share ``hidden`` of the words are hidden, so that
        shapes and surroundings have to do where a word was never seen.
        """
        rng = np.random.default_rng(seed)
        index = {x: i for i, x in enumerate(self.labels)}
        sums = [np.full(x.shape, 1e-3, np.float32) for x in (self.word, self.pair, self.step)]
        words = Words(self.lexicon)
        order = np.argsort([len(t) for t, _ in table], kind="stable")
        prepared = []
        for lo in range(0, len(order), batch):
            group = order[lo : lo + batch]
            run = Run([words.read(table[i][0]) for i in group], words)
            gold = np.zeros(len(run.ids), np.int64)
            for k, i in enumerate(group):
                spans = [m.span() for m in TOKEN.finditer(table[i][0])]
                for start, end, kind in table[i][1]:
                    begun = False
                    for t, (a, z) in enumerate(spans):
                        if a >= start and z <= end:
                            gold[run.starts[k] + t] = index[("I-" if begun else "B-") + kind]
                            begun = True
            prepared.append((run, gold))
        unknown = words.masked()
        for _ in range(epochs):
            for k in rng.permutation(len(prepared)):
                run, gold = prepared[k]
                seen = copy.copy(run)
                seen.ids = np.where(rng.random(len(run.ids)) < hidden, unknown[run.ids], run.ids)
                seen.ids[run.ids == 0] = 0
                self._update(seen, gold, sums, rate, decay)
        return self

    def _update(self, run: Run, gold: np.ndarray, sums: list[np.ndarray], rate: float, decay: float) -> None:
        which = np.flatnonzero(run.sizes > 0)
        if not len(which):
            return
        step = np.arange(run.sizes[which].max())
        there = step < run.sizes[which][:, None]
        at = np.where(there, run.starts[which][:, None] + step, REACH)
        used, local = np.unique(run.ids, return_inverse=True)
        table = np.zeros((2 * REACH + 1, int(used[-1]) + 1, len(self.labels)), np.float32)
        table[:, used] = self.word_scores(run.words, used)
        inner = np.arange(REACH, len(run.ids) - REACH)
        emitted = np.zeros((len(run.ids), len(self.labels)), np.float32)
        emitted[inner] = self.emissions(run, inner, table)
        n, steps, m = len(which), at.shape[1], len(self.labels)
        scores = emitted[at].astype(np.float64)
        odds = np.exp(scores - scores.max(2, keepdims=True)).transpose(1, 0, 2)
        trans = np.where(self.allowed, np.exp(self.step.astype(np.float64)), 0.0)
        forward, scale = np.empty((steps, n, m)), np.ones((steps, n, 1))
        forward[0] = odds[0] * (self.begin > _BAD)
        forward[0] /= forward[0].sum(1, keepdims=True)
        for t in range(1, steps):
            moved = forward[t - 1] @ trans * odds[t]
            total = moved.sum(1, keepdims=True)
            live = there[:, t, None]
            forward[t], scale[t] = np.where(live, moved / total, forward[t - 1]), np.where(live, total, 1.0)
        backward = np.ones((n, m))
        grad = np.zeros((len(run.ids), m))
        gtrans = np.zeros((m, m))
        for t in range(steps - 1, -1, -1):
            live = there[:, t]
            p = forward[t] * backward
            p /= p.sum(1, keepdims=True)
            y = gold[at[:, t]]
            p[np.arange(n), y] -= 1
            grad[at[live, t]] = p[live]
            if t:
                ahead = odds[t] * backward / scale[t]
                gtrans += forward[t - 1][live].T @ ahead[live] * trans
                np.add.at(gtrans, (gold[at[live, t - 1]], y[live]), -1)
                backward = np.where(live[:, None], ahead @ trans.T, backward)
        grad = (grad / n).astype(np.float32)

        def move(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
            seen[rows] += g * g
            weights[rows] -= rate * (g / np.sqrt(seen[rows]) + decay * weights[rows])

        feats = [run.words.features[i] for i in used]
        owner = np.repeat(np.arange(len(used)), [len(f) for f in feats])
        rows, inverse = np.unique(np.concatenate(feats), return_inverse=True)
        for o in range(-REACH, REACH + 1):
            ids = np.roll(local, -o)
            per_word = np.stack([np.bincount(ids, grad[:, j], len(used)) for j in range(m)], 1)
            per_feature = np.stack([np.bincount(inverse, per_word[owner, j], len(rows)) for j in range(m)], 1).astype(np.float32)
            move(self.word[o + REACH], sums[0][o + REACH], rows, per_feature)
        for k, p in enumerate(run.pairs(inner)):
            rows_k, inv = np.unique(p, return_inverse=True)
            g = np.stack([np.bincount(inv, grad[inner, j], len(rows_k)) for j in range(m)], 1).astype(np.float32)
            move(self.pair[k], sums[1][k], rows_k, g)
        g = (gtrans / n).astype(np.float32)
        sums[2] += g * g
        self.step -= rate * g / np.sqrt(sums[2])
