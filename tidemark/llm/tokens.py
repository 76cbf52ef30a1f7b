"""Encoding of a corpus with a public tokenizer through a table of its distinct words."""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

VOCABULARIES = "/opt/tokenizers"

#: The public pre-tokenizer pattern of byte-level BPE.
PYTHON_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Words longer than this are encoded where they stand: no table holds them, none is a key.
LONG = 1024


def read_ranks(folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> bytes:
    """The vocabulary file's bytes: under a megabyte, so it may be sent to every executor."""
    return Path(folder, f"{name}.tiktoken").read_bytes()


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("words", pat_str=PYTHON_WORDS, mergeable_ranks=table, special_tokens={})


#: The characters the pattern takes for white space.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+").findall


def find_words(text: str) -> list[str]:
    """The words of the pre-tokenizer; joined they are the text again."""
    import regex

    return regex.findall(PYTHON_WORDS, text)


class Chunks(dict[str, int]):
    """Texts cut wherever white space begins: a chunk is some white space and what follows it.

    No word of the pre-tokenizer goes on over such a place, and none depends on what is beyond
    it, so the words of a chunk are the same wherever it stands and are looked for once a
    process.  ``add`` is told of every new chunk, in order of the chunks' numbers.
    """

    def __init__(self, add: Callable[[str], None], kept: int = 300_000):
        super().__init__()
        self.add, self.kept, self.held = add, kept, 0

    @property
    def full(self) -> bool:
        """Whether there are so many chunks, or so long ones, that it is time to begin anew."""
        return len(self) > self.kept or self.held > 64_000_000

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.held += len(chunk)
        self.add(chunk)
        return at

    def read(self, text: str) -> Iterator[int]:
        """The numbers of a text's chunks in order; joined they are the text again."""
        return map(self.__getitem__, _CHUNK(text))


def _slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters, so that a batch of long ones fits."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def word_counts(texts: DataFrame, text: str, kept: int = 300_000) -> DataFrame:
    """``(word, n)``: the distinct words of up to ``LONG`` characters with their counts.

    Each task counts its chunks and gives out words with their sums, whenever it holds
    ``kept`` chunks and at its end; these are summed with partial aggregation.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[list[str]] = []
        add = lambda chunk: words.append(find_words(chunk))
        chunks, total = Chunks(add, kept), np.zeros(0, np.int64)

        def drained() -> pa.RecordBatch:
            sums: defaultdict[str, int] = defaultdict(int)
            for found, n in zip(words, total.tolist(), strict=True):
                for w in found:
                    sums[w] += n
            short = [(w, n) for w, n in sums.items() if len(w) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

        for b in batches:
            column = b.column(0).to_pylist()
            for lo, hi in _slices(column):
                flat: list[int] = []
                for t in column[lo:hi]:
                    if t:
                        flat += chunks.read(t)
                total = np.concatenate((total, np.zeros(len(chunks) - len(total), np.int64)))
                total += np.bincount(np.array(flat, np.int64), minlength=len(chunks))
                if chunks.full:
                    yield drained()
                    words.clear()
                    chunks, total = Chunks(add, kept), np.zeros(0, np.int64)
        if chunks:
            yield drained()

    return texts.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(counts: DataFrame, ranks: bytes) -> DataFrame:
    """``(word, n, ids)``: every distinct word with its count, encoded once."""
    shared = counts.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(shared.value)
        for b in batches:
            yield b.assign(ids=[encoding.encode_ordinary(w) for w in b["word"]])

    return counts.mapInPandas(encode, "word string, n bigint, ids array<int>")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i]`` of all i in a row."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))


class Placer:
    """Puts the ids of known words where the text is; the k-th other word of a text stands as ``-1 - k``."""

    def __init__(self, known: Mapping[str, Sequence[int]], encode: Callable[[str], list[int]]):
        self.known, self.encode_word = known, encode
        self.restart()

    def restart(self) -> None:
        self.chunks = Chunks(self._add)
        self.new: list[list[int]] = []
        self.rare: dict[str, int] = {}
        self.starts, self.sizes, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def _add(self, chunk: str) -> None:
        ids: list[int] = []
        for w in find_words(chunk):
            found = self.known.get(w)
            if found is None:
                found = self.encode_word(w) if len(w) > LONG else (-1 - self.rare.setdefault(w, len(self.rare)),)
            ids += found
        self.new.append(ids)

    def encode(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Ids of each text's words, and the words not known here, in order."""
        if self.chunks.full:
            self.restart()
        read = [list(self.chunks.read(t)) if t else [] for t in texts]
        sizes = np.array([len(x) for x in self.new], np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, np.array([i for x in self.new for i in x], np.int64)))
        self.new = []
        at = np.array([i for x in read for i in x], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in read])
        lens = self.sizes[at]
        ids, text = self.flat[_spread(self.starts[at], lens)], np.repeat(text, lens)
        hole = ids < 0
        words = pa.array(list(self.rare), pa.string()).take(pa.array(-1 - ids[hole]))
        per_text = np.bincount(text[hole], minlength=len(texts))
        ids[hole] = -1 - (np.arange(hole.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        return _lists(ids, np.bincount(text, minlength=len(texts))), _lists(words, per_text)


def _fill(ids: pa.ListArray, rare: pa.ListArray) -> pa.Array:
    """Puts each text's rare words' ids, listed in order, in the places left for them."""
    flat, sizes = ids.flatten().to_numpy().astype(np.int64), ids.value_lengths().to_numpy().astype(np.int64)
    words = rare.flatten()
    more, lens = words.flatten().to_numpy(), words.value_lengths().to_numpy().astype(np.int64)
    out_lens, starts, hole = np.ones(len(flat), np.int64), np.arange(len(flat)), flat < 0
    out_lens[hole], starts[hole] = lens, len(flat) + np.cumsum(lens) - lens
    out = np.concatenate((flat, more))[_spread(starts, out_lens)]
    return _lists(out, np.bincount(np.repeat(np.arange(len(sizes)), sizes), out_lens, len(sizes)).astype(np.int64))


_KNOWN_BYTES = 16_000_000


def encode_corpus(df: DataFrame, key: str, text: str, ranks: bytes, known: int = 65_536) -> DataFrame:
    """``(key, ids)``: the ids of every text, as the tokenizer gives for the whole text.

    Null and empty texts get an empty list.  Every row of ``df`` is one text and comes out
    once; keys must be distinct and not null.  Marks such as ``<|endoftext|>`` are plain text,
    whole texts of any length are encoded, other columns are ignored.

    Plan: tasks split and count their words, the counts are summed with partial aggregation,
    each distinct word is encoded once and the table kept.  Its most frequent words, up to
    ``known`` of them and ``_KNOWN_BYTES``, are broadcast and put in place by position where
    the text is; only the other words travel to the table and back.  None of these is a hot
    key: a word left out for its count has at most a ``known``-th of all, one left out for
    the bytes less than a ``_KNOWN_BYTES``-th of the text's characters.
    """
    spark = df.sparkSession
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    table = cut(word_table(word_counts(texts, "_text"), ranks))
    size = table.count()
    # counts in steps of a sixteenth of a doubling, from the most frequent on, as long as words and bytes last
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    bins = table.groupBy(step).agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + 4 * F.size("ids")).alias("bytes")).collect() if size > known else []
    least, words, taken = -1, 0, 0
    for b in sorted(bins, reverse=True):
        words, taken = words + b["words"], taken + b["bytes"]
        if words > known or taken > _KNOWN_BYTES:
            least = b["step"] + 1
            break
    top = table.where(step >= least).select("word", "ids").collect()
    frequent = spark.sparkContext.broadcast(({r[0]: list(r[1]) for r in top}, ranks))
    kind = df.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, data = frequent.value
        placer = Placer(words, lambda w: _encoding(data).encode_ordinary(w))
        for b in batches:
            column = b.column(1).to_pylist()
            for lo, hi in _slices(column):
                ids, rare = placer.encode(column[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids, rare], ["_key", "ids", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _fill(b.column(1), b.column(2))], ["_key", "ids"])

    placed = texts.mapInArrow(place, f"_key {kind}, ids array<int>, rare array<string>")
    rows = placed.select("_key", "ids", F.posexplode_outer("rare").alias("k", "word"))
    # the ids travel with a text's first rare word; texts without one have a word of their own, that no table has
    rows = rows.select("_key", "k", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("ids")).alias("ids"), F.coalesce("word", F.concat(F.lit("\0"), F.col("_key").cast("string"))).alias("word"))
    joined = rows.join(table.select("word", F.col("ids").alias("word_ids")), "word", "left")
    entries = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "word_ids"))))
    whole = joined.groupBy("_key").agg(F.max("ids").alias("ids"), F.transform(entries, lambda x: x["word_ids"]).alias("rare"))
    return whole.mapInArrow(fill, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def pieces(spark: SparkSession, ranks: bytes) -> DataFrame:
    """``(id, piece)``: the vocabulary's byte strings in hex; some 50,000 rows, whatever the corpus."""
    rows = [(int(b), base64.b64decode(a).hex()) for a, b in map(bytes.split, ranks.splitlines())]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode_corpus(encoded: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """``(key, text)`` back from ids by a join with the id-to-piece table (a fixed size: broadcast)."""
    parts = encoded.select(key, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocabulary), "id")
    hexes = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]))
    found = parts.groupBy(key).agg(F.decode(F.unhex(hexes), "UTF-8").alias("text"))
    return found.unionByName(encoded.where(F.size("ids") == 0).select(key, F.lit("").alias("text")))


def with_token_counts(df: DataFrame, text: str, ranks: bytes, out: str = "tokens") -> DataFrame:
    """``df`` with the number of ids of each text, 0 for null and empty ones; map-only.

    Each task remembers the counts of the chunks between blanks that it has met (a bounded
    memory): a text's number is the sum of theirs.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(shared.value)
        sizes: list[int] = []
        add = lambda chunk: sizes.append(len(encoding.encode_ordinary(chunk)))
        chunks = Chunks(add)
        for texts in batches:
            if chunks.full:
                sizes.clear()
                chunks = Chunks(add)
            yield pd.Series([sum(map(sizes.__getitem__, chunks.read(t))) if t else 0 for t in texts], dtype="int32")

    return df.withColumn(out, count(F.coalesce(F.col(text), F.lit(""))))
