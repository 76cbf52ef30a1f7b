import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import redaction as rd

VOCABULARY = ["water", "backup", "coverage", *rd.STOP]
TEXTS = [
    None, "", "Rebecca Stone called. Rebecca was upset.", "Water Backup Coverage applies to Mrs. Lowell", "mail a.b+c@x-y.org or (555) 271-0043, 555-271-0043.", "CLM-2024-12345 and HO-12-123456", "at 12 Oak Hill Street, Dana Fox",
    "He cut his hand on glass.\nDr. Kim Wu saw him. Zoë Iskos, Ann Lee", "Ann Lee Bob Ray Sue", "Injured twice", "naïve Ann Lée", "[NAME] [EMAIL]", "Mr Fox. Miss Ann Fox", "x" * 5000, "Ann Lee",
]


def known(phrase):
    return any(w.strip(".").lower() in VOCABULARY for w in phrase.split())


def brute(text, rules, also=()):
    for label, pattern in rules.ordered if text else ():
        text = re.sub(pattern, lambda m, label=label: m[0] if label == "NAME" and known(m[0]) else f"[{label}]", text)
    for token in sorted(also, key=len, reverse=True) if text else ():
        text = re.sub(rf"\b{token}\b", "[NAME]", text)
    return text


def brute_tokens(text):
    phrases = [m for _, p in (rd.TITLED, rd.PAIR) for m in re.findall(p, text or "") if not known(m)]
    return sorted({w.strip(".") for p in phrases for w in p.split() if len(w.strip(".")) > 2 and w.strip(".").lower() not in (*VOCABULARY, *rd.NAME_TITLES)})


@pytest.mark.parametrize("rules", [rd.with_claim_ids(VOCABULARY), rd.keeping_claim_ids(VOCABULARY), rd.keeping_claim_ids(VOCABULARY, True)])
def test_texts_against_brute_force(spark, rules):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r for r in df.select("i", rd.redact_text(F.col("t"), rules).alias("c"), rd.name_tokens(F.col("t"), VOCABULARY).alias("w")).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i]["c"] == brute(text, rules), text
        assert got[i]["w"] == brute_tokens(text), text


def test_records_are_scrubbed_together(spark):
    kind = "id int, note string, more struct<a: string, n: int, l: array<struct<s: string>>, m: map<string, string>>, k int"
    rows = [(1, "Rebecca Stone called", ("which Rebecca did", 4, [("Stone wall",), None, (None,)], {"Rebecca": "Stone x@y.org"}), 7), (2, None, None, 8), (3, "", (None, None, [], {}), 9)]
    rules = rd.keeping_claim_ids(VOCABULARY, True)
    df = spark.createDataFrame(rows, kind)
    done = rd.scrub(df, ["note", "more"], rules)
    assert done.schema["more"].dataType == df.schema["more"].dataType
    got = {r["id"]: r for r in done.collect()}
    assert got[1]["note"] == "[NAME] called" and got[1]["more"]["a"] == "which [NAME] did" and got[1]["more"]["n"] == 4
    assert [x and x["s"] for x in got[1]["more"]["l"]] == ["[NAME] wall", None, None] and got[1]["more"]["m"] == {"Rebecca": "[NAME] [EMAIL]"}
    assert got[1]["name_words"] == ["Rebecca", "Stone"] and all(r["is_clean"] for r in got.values())
    assert got[2]["note"] is None and got[2]["more"] is None and got[3]["note"] == "" and got[3]["more"]["l"] == [] and got[2]["k"] == 8
    with pytest.raises(ValueError):
        rd.scrub(df.withColumn("is_clean", F.lit(1)), ["note"], rules)
    assert rd.scrub(df.limit(0), ["note"], rules).collect() == []


def test_counts_and_leaks(spark):
    rules = rd.keeping_claim_ids(VOCABULARY)
    df = spark.createDataFrame([("Rebecca Stone a@b.org [EMAIL]",), (None,)], "t string")
    clean = rd.redact_text(F.col("t"), rules)
    got = df.select(rd.label_counts(clean, ["EMAIL", "NAME", "PHONE"], F.col("t")).alias("c"), rd.is_clean(F.col("t"), rules, F.array(F.lit("Stone"))).alias("ok")).collect()
    assert got[0]["c"] == {"EMAIL": 1, "NAME": 1} and got[0]["ok"] is False and got[1]["ok"] is True


def test_vocabulary_is_bounded(spark):
    df = spark.createDataFrame([("Wind and hail",), (None,)], "t string")
    assert {"wind", "hail", "monday"} <= set(rd.wording_vocabulary(df, "t"))
    with pytest.raises(ValueError):
        rd.wording_vocabulary(df, "t", most=2)
