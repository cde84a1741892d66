"""Discovery, merged lists, pages of months, loose JSON, evaluation inputs, batches that come twice, marks of near duplicates."""

import datetime
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import loose_json as L
from siltstone.operators import matching, vector_join
from siltstone.operators.graph import component_labels
from siltstone.sources import discovery
from siltstone.streaming import articles

TOC = """"title"\t"code"\t"type"
"Railway transport"\t"rail"\t"folder"
"  Passengers by rail"\t"rail_pa_total"\t"dataset"
"Trailers on the railway"\t"rail_go_x"\t"dataset"
"Road freight"\t"road_go_ta_tott"\t"dataset"
"Victims in RAIL accidents"\t"tran_sf_railvi"\t"dataset"
"Regional transport"\t"tran_r_rago"\t"dataset"
"Rail network by region"\t"tran_r_net"\t"dataset"
"Maritime accidents"\t"tran_sf_mar1"\t"dataset"
"GDP"\t"nama_10_gdp"\t"dataset"
"GDP, regions"\t"nama_10r_gdp"\t"dataset"
"Rail equipment"\t't_rail1'\t"dataset"
"Rail, quarterly"\t"rail_pa_q"\t"dataset"
"Rail, aggregated"\t"rail_ag"\t"Table"
"Rail, unsafe"\t"rail/x"\t"dataset"
"Rail twice"\t"rail_pa_total"
one cell about rail
"""


def codes(df):
    return [r[0] for r in df.collect()]


def test_datasets(spark):
    lines = spark.createDataFrame([(x,) for x in [*TOC.split("\n"), None]], "value string")
    assert codes(discovery.rail_datasets(lines)) == ["rail_pa_q", "rail_pa_total", "tran_r_net", "tran_sf_railvi"]
    assert codes(discovery.transport_datasets(lines)) == ["rail_go_x", "rail_pa_q", "rail_pa_total", "tran_r_net", "tran_r_rago", "tran_sf_railvi"]
    assert codes(discovery.national_datasets(lines)) == ["nama_10_gdp", "rail_go_x", "rail_pa_total", "road_go_ta_tott", "tran_sf_mar1", "tran_sf_railvi"]
    assert codes(discovery.rail_datasets(lines.limit(0))) == []


def test_indicators(spark):
    rows = [("A.1", "Railroads", None), ("A.2", "Trail length", "monorail"), ("A.3", "Roads", "and rail lines"), ("A 4", "Rail", None), (None, "Rail", None), ("IS.RRS.TOTL.KM", "Rail lines", "")]
    assert codes(discovery.rail_indicators(spark.createDataFrame(rows, "id string, name string, sourceNote string"))) == sorted({"A.1", "A.3", *discovery.RAIL_INDICATORS})


def test_first_of_each(spark):
    one = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3)], "k string, at int")
    two = spark.createDataFrame([("c", 0), ("a", 1), ("d", 2), ("c", 3)], "k string, at int")
    found = discovery.first_of_each([one, two], "k", ["at"]).orderBy("source", "at").collect()
    assert [tuple(r) for r in found] == [("b", 0, 0), ("a", 0, 1), ("c", 1, 0), ("d", 1, 2)]


def test_months(spark):
    day = datetime.date
    spans = spark.createDataFrame([("x", day(2023, 11, 15), day(2024, 2, 1)), ("y", day(2024, 1, 5), day(2024, 1, 9)), ("none", day(2024, 1, 5), day(2024, 1, 5)), ("open", day(2024, 1, 5), None)], "s string, a date, b date")
    pages = discovery.month_pages(spans, "a", "b")
    found = [(r.s, r.page, r["first"], r["last"]) for r in pages.orderBy("s", "page").collect()]
    assert found == [("x", 0, day(2023, 11, 15), day(2023, 12, 1)), ("x", 1, day(2023, 12, 1), day(2024, 1, 1)), ("x", 2, day(2024, 1, 1), day(2024, 2, 1)), ("y", 0, day(2024, 1, 5), day(2024, 1, 9))]
    asked = lambda **k: [(r.s, r.page) for r in discovery.within_reach(pages.withColumn("n", F.lit(0)), ["s"], "n", **k).orderBy("s", "page").collect()]
    assert asked(target=260) == [("x", 0), ("x", 1), ("y", 0)] and asked(target=9999, most=1) == [("x", 0), ("y", 0)]


def test_loose_json(spark):
    texts = {
        '{"a": 1}': {"a": 1}, '```json\n{"a": 2}\n```': {"a": 2}, "```\n[1, 2]\n```": [1, 2], 'Sure! {"a": {"b": "}"}} Hope it helps.': {"a": {"b": "}"}}, "The list: [1, [2]].": [1, [2]], '{"a": 1} and {"b": 2}': None, '{"a": 1} {"b": 2}': None, '{"a": 1}, {"b": 2}': None, "1], [2": None,
        "no json": None, "": None, "  ": None, "}{": None, "7": 7, "true": True, '"x"': "x", '{"a": ': None, 'see [1] or {"a": 3}': {"a": 3},
    }
    df = spark.createDataFrame([(k,) for k in [*texts, None]], "t string").select("t", L.loose_json(F.col("t")).alias("v")).select("t", F.to_json("v").alias("j"))
    found = {r.t: None if r.j is None else json.loads(r.j) for r in df.collect()}
    assert found == texts | {None: None}
    bodies = ['{"message": {"content": "x"}, "response": "y"}', '{"response": "y"}', "{}", "oops", None]
    assert codes(spark.createDataFrame([(b,) for b in bodies], "b string").select(L.answer_text(F.col("b")))) == ["x", "y", "", "", ""]


def test_inputs(spark, tmp_path):
    schema = "article_id string, n double, tags array<string>"
    rows = [{"article_id": "1", "n": 2.5, "tags": ["a"], "more": 1}, {"article_id": 2, "n": "no"}, {}]
    want = [("1", 2.5, ["a"]), ("2", None, None), (None, None, None)]
    for name, body in (("bare", rows), ("rows", {"rows": rows}), ("golden", {"golden_rows": rows}), ("said", {"predictions": rows, "other": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert sorted(map(tuple, L.read_rows(spark, str(tmp_path / f"{name}.json"), schema).collect()), key=repr) == sorted(want, key=repr)
    spark.createDataFrame([("1", float("nan"))], "article_id string, n double").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert [tuple(r) for r in L.read_rows(spark, str(tmp_path / "t.parquet"), schema).collect()] == [("1", None, None)]
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="no list of rows"):
        L.read_rows(spark, str(tmp_path / "bad.json"), schema).collect()


def test_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    land = lambda rows: spark.createDataFrame(rows, "id string, body string").coalesce(1).write.mode("append").json(landed)
    stream = lambda: articles.article_stream(spark, landed, "id string, body string")
    bodies = lambda: sorted(((r.id, r.body) for r in spark.read.parquet(out).collect()), key=repr)
    land([("1", "a"), ("1", "a"), ("2", None)])
    articles.drain_once(stream(), out, state, ["id", "body"]).awaitTermination()
    assert bodies() == [("1", "a"), ("2", None)]
    land([("1", "a"), ("3", "c"), ("2", "")])  # an overlapping poll, in a batch that ends after its write and before its commit

    def killed(batch, batch_id):
        articles.append_once(batch, batch_id, out, ["id", "body"])
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream().writeStream.foreachBatch(killed).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    written = bodies()
    articles.drain_once(stream(), out, state, ["id", "body"]).awaitTermination()
    assert bodies() == written and len(written) == 4 and len({r.batch for r in spark.read.parquet(out).collect()}) == 2
    articles.drain_once(stream(), out, state, ["id", "body"]).awaitTermination()
    assert bodies() == written


def test_marks(spark):
    group = lambda *ids: "dedup_" + hashlib.sha256("|".join(ids).encode()).hexdigest()[:16]
    schema = "id string, v array<double>, usable int"
    rows = [("b", [1.0, 0.0], 1), ("a", [1.0, 0.01], 1), ("c", [1.0, 0.02], 1), ("z", [0.0, 1.0], 1), ("n", None, 1), ("e", [], 1), ("o", [0.0, 0.0], 1), ("h", [1.0, None], 1), ("t", [-1.0, 0.0], 1), ("t", [0.0, -1.0], 1)]
    marks = lambda rows: sorted(((r.id, r.cross_lingual_dedup_id, r.is_duplicate) for r in vector_join.marked(spark.createDataFrame(rows, schema), "id", "v").collect()), key=repr)
    g, t = group("a", "b", "c"), group("t", "t")
    expected = [("a", g, False), ("b", g, True), ("c", g, True), ("z", None, False), ("t", t, False), ("t", t, False), *((x, None, None) for x in "neoh")]
    assert marks(rows) == sorted(expected, key=repr)
    assert marks([*rows, ("x", [1.0], 1)]) == sorted([(r[0], None, None) for r in rows] + [("x", None, None)], key=repr)  # lengths differ
    assert marks([("a", [1.0], 1), ("n", None, 1)]) == [("a", None, False), ("n", None, None)] and marks([]) == []


def test_joining_links_join_all(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 9)
    monkeypatch.setattr(matching, "STRIP_ROWS", 4)
    rng = np.random.RandomState(3)
    near = [(f"k{k:03}", (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(np.concatenate([rng.normal([1, 0, 0], 0.05, (40, 3)), rng.normal([0, 1, 0], 0.3, (40, 3)), rng.normal(size=(40, 3))]))]
    df = spark.createDataFrame(near, "id string, v array<double>")
    every, few = (matching.similar_pairs(df, "id", "v", 0.97, forest=f).select("a", "b") for f in (False, True))
    links, kept = ({tuple(r) for r in x.collect()} for x in (every, few))
    assert kept < links
    whole = np.nonzero(np.ones((50, 300)))
    assert len(matching.joining(*whole)) == 50 + 300 - 1 and len(matching.joining(np.array([], int), np.array([], int))) == 0
    joined = lambda x: sorted(map(tuple, component_labels(x).collect()))
    assert joined(every) == joined(few)
