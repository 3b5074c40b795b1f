"""Statistical cubes in all their spellings, and rows of drifting schemas."""

import datetime as dt
import json

from kilnworks.sources import documents


def cells(spark, *cubes):
    texts = [(k, c if c is None or isinstance(c, str) else json.dumps(c)) for k, c in enumerate(cubes)]
    made = documents.jsonstat_cells(spark.createDataFrame(texts, "k int, body string"), "body", ["k"])
    return {(r.k, *[r.codes[d] for d in sorted(r.codes)]): ([r.labels[d] for d in sorted(r.labels)], r.value, r.status) for r in made.collect()}


def cube(**changes):
    return {
        "id": ["geo", "time"], "size": [2, 3],
        "dimension": {
            "geo": {"category": {"index": {"DE": 1, "AT": 0}, "label": {"AT": "Austria"}}},
            "time": {"category": {"index": ["2020", "2021", "2022"]}},
        },
        "value": {"0": 1.5, "4": 5.0}, "status": {"4": "p", "5": ":"},
    } | changes


def test_spellings_of_a_cube(spark):
    want = {("AT", "2020"): (["Austria", "2020"], 1.5, None), ("DE", "2021"): (["DE", "2021"], 5.0, "p"), ("DE", "2022"): (["DE", "2022"], None, ":")}
    assert cells(spark, cube()) == {(0, *k): v for k, v in want.items()}
    assert cells(spark, cube(value=[1.5, None, None, None, 5], status=[None, None, None, None, "p", ":"])) == {(0, *k): v for k, v in want.items()}
    assert cells(spark, cube(status="e")) == {(0, *k): (*v[:2], "e") for k, v in want.items() if v[1]}
    one = cube(id=["geo", "unit", "time"], size=[2, 1, 3])
    one["dimension"] = {**one["dimension"], "unit": {"category": {"label": {"KWH": "Kilowatt hour"}}}}
    assert cells(spark, one) == {(0, *k, "KWH"): ([*v[0], "Kilowatt hour"], *v[1:]) for k, v in want.items()}


def test_documents_that_are_none(spark):
    assert cells(spark, None, "", "{", "[]", "{}", cube(value={}, status={}), cube(value=None, status=None)) == {}
    mixed = cells(spark, "no", cube(value=[7]))
    assert mixed[1, "AT", "2020"] == (["Austria", "2020"], 7.0, None)


def test_rows_of_drifting_schemas(spark):
    a = spark.createDataFrame([(1, float("nan"), dt.datetime(2024, 1, 2, 3, 4, 5)), (None, 2.5, None)], "id long, v double, t timestamp_ntz")
    b = spark.createDataFrame([("x", [1, 2], {"deep": 3})], "id string, list array<int>, s struct<deep: int>")
    rows = documents.to_variant_rows({"a": a, "b": b}, role="REF")
    assert dict(rows.dtypes) == {"dataset": "string", "role": "string", "row": "variant"}
    got = documents.from_variant_rows(rows, {"id": "long", "v": "double", "t": "string", "s.deep": "int"}, keep=["dataset", "role"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("a", "REF", 1, None, "2024-01-02T03:04:05.000", None), ("a", "REF", None, 2.5, None, None), ("b", "REF", None, None, None, 3)], key=str
    )
