import pytest
from pyspark.sql import functions as F

from tidemark.llm import tokens

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", None, " ", "\n\n", "Hello world", "don't we'll I'm x''s '''s 's 'S", "a  b   c \n d\r\n\r\n e ", "tab\tand nbsp　wide  em", "<|endoftext|> is text",
    "naïve café résumé", "한글 문장 ทดสอบ 漢字", "1234567 12,345.67 ½ ²", "😀👍🏽 emoji", "\x00\x1c\x85 odd", "x" * 5000, "ab " * 20000, "...!!!???----====", "͸ unassigned \U0001FAE9 new", "é combining", " lead and trail  ",
]


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks()


@pytest.fixture(scope="module")
def truth():
    t = tokenizers.Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("x")).withColumn("word", F.lit(1)).withColumn("k", F.lit(2))


@pytest.mark.parametrize("known", [65_536, 3])
def test_ids_are_those_of_the_whole_text(docs, ranks, truth, known):
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(docs, "doc_id", "text", ranks, known).collect()}
    assert got == dict(enumerate(truth))


def test_round_trip(spark, docs, ranks):
    back = tokens.decode_corpus(tokens.encode_corpus(docs, "doc_id", "text", ranks), "doc_id", tokens.pieces(spark, ranks))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_chunks_join_to_the_text_and_hold_its_words():
    import random

    import regex

    words: list[list[str]] = []
    chunks, r = tokens.Chunks(lambda c: words.append(tokens.find_words(c))), random.Random(3)
    made = ["".join(r.choice(" \n\t\u00a0\x1ca'b1.,s\r\u3000é漢") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + made:
        found = [w for c in chunks.read(text) for w in words[c]]
        assert found == regex.findall(tokens.PYTHON_WORDS, text)


def test_long_and_frequent_words(spark, ranks):
    ruler, wide = "-" * 80, "=" * 5000
    rows = [(i, f"{ruler}\nline {i} {wide} end{' ' * 50}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    counts = {r["word"]: r["n"] for r in tokens.word_counts(df, "text", kept=5).collect()}
    assert counts[ruler] == 60 and wide not in counts and " " + wide not in counts and counts[" end"] == 60
    whole = tokens._encoding(ranks)
    for known in (65_536, 2):
        got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df, "doc_id", "text", ranks, known).collect()}
        assert got == {i: whole.encode_ordinary(t) for i, t in rows}


def test_counts(docs, ranks, truth):
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_token_counts(docs, "text", ranks).collect()}
    assert got == {i: len(t) for i, t in enumerate(truth)}


def test_repeated_texts_and_empty_table(spark, docs, ranks):
    same = spark.createDataFrame([(i, "the same words") for i in range(50)], "doc_id bigint, text string")
    assert len({tuple(r["ids"]) for r in tokens.encode_corpus(same, "doc_id", "text", ranks).collect()}) == 1
    assert tokens.encode_corpus(same.limit(0), "doc_id", "text", ranks).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in tokens.encode_corpus(blank, "doc_id", "text", ranks).select("doc_id", F.size("ids")).collect()} == {(1, 0), (2, 0)}
