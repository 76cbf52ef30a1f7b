import json

import pyarrow as pa
import pytest

from tidemark.operators.shred import ancestor_table, flatten_leaf, leaf_levels, positions, shred

LAPS = "run_id string, laps array<struct<tools: array<struct<tool: string, args: string>>, other: int>>"
ROWS = [
    ("a", [([("t1", None), None, ("t2", "x")], 1), None, ([], 2), (None, 3), ([(None, "y"), ("t3", "z")], 4)]),
    ("b", []),
    ("c", None),
    (None, [([("t4", None)], 0)]),
]


def brute(rows):
    return sorted(((k, i, j, t[0]) for k, laps in rows for i, lap in enumerate(laps or []) if lap for j, t in enumerate(lap[0] or []) if t and t[0] is not None), key=str)


def test_places_count_null_elements(spark):
    got = flatten_leaf(spark.createDataFrame(ROWS, LAPS), "run_id", "laps", ["[]", "tools", "[]", "tool"])
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_level_sequences(spark):
    df = leaf_levels(spark.createDataFrame(ROWS, LAPS), "run_id", "laps", ["[]", "tools", "[]", "tool"])
    got = [tuple(r) for r in df.where("rec_id = 'a'").orderBy("seq").collect()]
    assert got == [("a", 0, 0, 7, "t1"), ("a", 1, 2, 5, None), ("a", 2, 2, 7, "t2"), ("a", 3, 1, 2, None), ("a", 4, 1, 4, None), ("a", 5, 1, 3, None), ("a", 6, 1, 6, None), ("a", 7, 2, 7, "t3")]
    assert {(r["rec_id"], r["depth"]) for r in df.where("rec_id IN ('b', 'c')").collect()} == {("b", 1), ("c", 0)}


def test_one_list_gives_absent_second_place(spark):
    df = spark.createDataFrame([("t", [("n1",), None, (None,), ("n2",)])], "id string, checks array<struct<name: string>>")
    assert [tuple(r) for r in flatten_leaf(df, "id", "checks", ["[]", "name"]).collect()] == [("t", 0, -1, "n1"), ("t", 3, -1, "n2")]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ('{"form_numbers": ["A", null, "B"]}', [(0, "A"), (2, "B")]),
        ('{"form_numbers": "A"}', [(0, "A")]),
        (json.dumps('{"form_numbers": ["A"]}'), [(0, "A")]),
        ('{"form_numbers": [7, "x"]}', [(0, "7"), (1, "x")]),
        ('{"form_numbers": null}', []),
        ('{"form_numbers": []}', []),
        ('{"filter": {"form_numbers": ["A"]}}', []),
        ('{"form_numbers": ["A"', []),
        ('["form_numbers"]', []),
        ("", []),
        (None, []),
        ('"x', []),
        ("[" * 5000, []),
        ('{"form_numbers": "\\ud800"}', [(0, "?")]),
    ],
)
def test_json_text(args, want):
    column = pa.array([[{"args": args}]], pa.list_(pa.struct([("args", pa.string())])))
    levels = shred(column, ["[]", "args", "{form_numbers}", "[]"])
    there = levels.depth == levels.full
    assert list(zip(positions(levels)[1][there].tolist(), levels.values.to_pylist(), strict=True)) == want


def test_sliced_batches_and_empty():
    column = pa.array([[["x"]], [[None, "y"], None, ["z"]]], pa.list_(pa.list_(pa.string()))).slice(1)
    levels = shred(column, ["[]", "[]"])
    there = levels.depth == levels.full
    assert [p[there].tolist() for p in positions(levels)] == [[0, 2], [1, 0]]
    assert len(shred(column.slice(1), ["[]", "[]"]).row) == 0


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], LAPS + ", rec_id string, val int, lvl1 int")
    assert flatten_leaf(df, "run_id", "laps", ["[]", "tools", "[]", "tool"]).collect() == []


def test_tables_of_repeated_ancestors(spark):
    kind = "id string, rec_id int, a array<struct<n: int, b: array<struct<s: string, c: array<struct<v: double>>>>>>"
    rows = [
        ("r1", 1, [(1, [("x", [(1.5,), None, (None,)]), ("y", []), None]), (2, None), None, (None, [])]),
        ("r1", 1, [(1, [("x", [(1.5,), None, (None,)]), ("y", []), None]), (2, None), None, (None, [])]),
        ("r2", 2, []), ("r3", 3, None), (None, 4, [(9, [("z", [(7.0,)])])]),
    ]
    df = spark.createDataFrame(rows, kind)
    get = lambda path, leaves: sorted(map(str, (tuple(r) for r in ancestor_table(df, "id", "a", path, leaves).collect())))
    top = [("r1", 0, 1), ("r1", 1, 2), ("r1", 2, None), ("r1", 3, None)] * 2 + [(None, 0, 9)]
    assert get(("[]",), {"n": "int"}) == sorted(map(str, top))
    middle = [("r1", 0, 0, "x"), ("r1", 0, 1, "y"), ("r1", 0, 2, None)] * 2 + [(None, 0, 0, "z")]
    assert get(("[]", "b", "[]"), {"s": "string"}) == sorted(map(str, middle))
    deep = [("r1", 0, 0, 0, 1.5), ("r1", 0, 0, 1, None), ("r1", 0, 0, 2, None)] * 2 + [(None, 0, 0, 0, 7.0)]
    assert get(("[]", "b", "[]", "c", "[]"), {"v": "double"}) == sorted(map(str, deep))
    leaf = flatten_leaf(df, "id", "a", ("[]", "b", "[]", "c", "[]", "v"))
    assert leaf.columns == ["rec_id", "lvl1", "lvl2", "lvl3", "val"] and leaf.count() == 3
    assert ancestor_table(df.limit(0), "id", "a", ("[]",), {"n": "int"}).collect() == []
