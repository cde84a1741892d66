"""Time partitions, shards and ranked search against brute force on small fixtures and the test tables."""

import datetime as dt
import glob
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lexical_search, sharding, time_layout
from siltstone.tables import new_folder, settle

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, kind string"


def moment(click_id, ts):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    return dt.datetime(ts.year, ts.month, ts.day) - dt.timedelta(days=ts.weekday()) if k > 111 else ts


def brute_leaves(times, limit):
    """{time: leaf}, from the top down."""
    of = {}

    def runs(prefix, children, parts):
        run = None
        for c in children:
            inside = parts.get(c, [])
            if len(inside) > limit and len(prefix) < 3:
                run = None
                split(prefix + (c,), inside)
            elif run is not None and len(run[2]) + len(inside) <= limit:
                run = (run[0], c, run[2] + inside)
                done[-1] = run
            else:
                run = (c, c, list(inside))
                done.append(run)
        return None

    def split(prefix, inside):
        nonlocal done
        kept, done = done, []
        level = len(prefix)
        parts = defaultdict(list)
        for t in inside:
            parts[(t.year, t.month, t.day, t.hour)[level]].append(t)
        if level == 0:
            children = range(min(parts), max(parts) + 1)
        elif level == 1:
            children = range(1, 13)
        elif level == 2:
            children = range(1, ((dt.date(prefix[0] + prefix[1] // 12, prefix[1] % 12 + 1, 1)) - dt.timedelta(days=1)).day + 1)
        else:
            children = range(24)
        runs(prefix, children, parts)
        wide = "{:04d}" if level == 0 else "{:02d}"
        above = "".join(f"{p:04d}/" if k == 0 else f"{p:02d}/" for k, p in enumerate(prefix))
        for first, last, members in done:
            for t in members:
                of[t] = f"{above}{wide.format(first)}-{wide.format(last)}"
        done = kept

    done = []
    if times:
        split((), times)
    return of


def brute_layout(rows, limit):
    """{(leaf, part): rows in order}."""
    of = brute_leaves([m for m in (moment(r[0], r[1]) for r in rows) if m is not None], limit)
    by = defaultdict(list)
    for r in rows:
        m = moment(r[0], r[1])
        by["null" if m is None else of[m]].append(r)
    low = dt.datetime(1, 1, 1)
    out = {}
    for leaf, members in by.items():
        members.sort(key=lambda r: (moment(r[0], r[1]) or low, r[2] is not None, r[2] or low, r[0] is not None, r[0] or 0))
        for k in range(0, len(members), limit):
            out[leaf, k // limit + 1] = members[k : k + limit]
    return out


def check_report(report, first, final, is_new):
    starting = {(k, tuple(sorted(map(repr, v)))) for k, v in first.items()}
    assert {(r.leaf, r.part) for r in report} == set(final) and len(report) == len(final)
    for r in report:
        rows = final[r.leaf, r.part]
        assert r.n_rows == len(rows) and r.n_new == sum(map(is_new, rows)), r
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rows).encode()).hexdigest()
        assert r.rewritten == (((r.leaf, r.part), tuple(sorted(map(repr, rows)))) not in starting)
        found = pq.ParquetFile(r.path.removeprefix("file:"))
        assert [x["click_id"] for x in found.read().to_pylist()] == [x[0] for x in rows] and ",".join(found.schema_arrow.names) == r.columns


def test_time_layout(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    rows = [tuple(r) for r in table.collect()]
    limit, cut = 1 + len(rows) // 650, dt.datetime(2024, 3, 1)
    report = time_layout.query(spark, sf_dir).collect()
    check_report(report, brute_layout([r for r in rows if r[2] < cut], limit), brute_layout(rows, limit), lambda r: r[2] >= cut)
    folder = report[0].path.removeprefix("file:").split("/leaf=")[0]
    assert set(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == {r.path.removeprefix("file:") for r in report}
    assert any(not r.rewritten for r in report) and any(r.n_new == 0 and r.rewritten for r in report)


def test_time_layout_edges(spark):
    base = dt.datetime(2024, 2, 29, 23, 59, 59, 999999)
    rows = [(k, base + dt.timedelta(minutes=7 * (k % 50)), base, "x", None) for k in range(60)] + [(5, base, base, "x", "y")] * 40 + [(k, None, None, None, "n") for k in range(9)]
    rows += [(None, base, None, "z", None), (None, None, base, None, None), (1, dt.datetime(1969, 12, 31, 23), base, "x", ""), (2, dt.datetime(9999, 12, 31, 23), base, "x", "")]
    df = spark.createDataFrame(rows, CLICKS)
    for limit in (4, 1000):
        folder = new_folder(spark)
        time_layout.write_layout(df.where("click_id < 30"), time_layout.moment(), ["arrived_at", "click_id"], limit, folder)
        started = settle(time_layout.layout_files(spark, folder, df).select("path").distinct())
        time_layout.write_layout(df, time_layout.moment(), ["arrived_at", "click_id"], limit, folder)
        report = time_layout.file_report(spark, folder, df, "click_id", F.col("click_id") < 30, started).collect()
        first = brute_layout([r for r in rows if r[0] is not None and r[0] < 30], limit)
        check_report(report, first, brute_layout(rows, limit), lambda r: r[0] is None or r[0] >= 30)
        before = {r.path for r in report}  # nothing changes when the same rows are laid out once more
        time_layout.write_layout(df, time_layout.moment(), ["arrived_at", "click_id"], limit, folder)
        assert {r.path for r in time_layout.layout_files(spark, folder, df).select("path").distinct().collect()} == before
    time_layout.write_layout(df.limit(0), time_layout.moment(), ["arrived_at"], 4, folder)
    assert time_layout.file_report(spark, folder, df, "click_id", F.lit(True), started).collect() == [] and not glob.glob(f"{folder.removeprefix('file:')}/**/*.parquet", recursive=True)


def shards_of(df, shards):
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert set(by) <= set(range(shards))
    return rows, [sum(r.size for r in by[k]) for k in range(shards)]


def test_shards(spark, sf_dir):
    rows, sizes = shards_of(sharding.query(spark, sf_dir), 40)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    raw = [(r.doc_id, (r.text or "").encode()) for r in table]
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == Counter((i, len(t) + 16, zlib.crc32(t), "bytes", None) for i, t in raw)
    share, largest, below = sum(sizes) / 40, max(len(t) + 16 for _, t in raw), 0
    for k, size in enumerate(sizes[:-1], 1):
        below += size
        assert abs(below - k * share) <= largest / 2 + 0.001 * share


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_groups(spark, hot):
    schema = "doc_id long, text string, shard string, at int"
    rows = [(k, f"text {k} " + "x" * (k % 90), "own", k) for k in range(1200)] + [(5000 + k, "the same text " * 6, "own", 0) for k in range(hot)] + [(None, None, None, None), (7, "", None, 1), (7, "", None, 1), (7, "long " * 3, None, 1)]
    df = spark.createDataFrame(rows, schema)
    got = sharding.shard(df, shards=6)
    assert got.columns == [*df.columns, "_shard", "slot"]
    out = got.withColumnRenamed("shard", "own").withColumnRenamed("_shard", "shard").withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 16)
    found, sizes = shards_of(out, 6)
    assert Counter((r.doc_id, r.text, r.own, r.at) for r in found) == Counter(rows)
    share = sum(sizes) / 6
    assert max(abs(sum(sizes[:k]) - k * share) for k in range(1, 6)) <= 0.001 * share + 100
    parts = defaultdict(set)
    for r in found:
        parts[r.text].add(r.shard)
    assert sum(len(p) > 1 for p in parts.values()) <= 1 and (not hot or len(parts["the same text " * 6]) >= 2)
    keys = sharding.sized(df)  # a shard's keys all come before the next one's
    assert keys.count() == len(rows)
    assert sharding.shard(df.limit(0), shards=3).collect() == [] and {r.slot for r in sharding.shard(df.limit(1), shards=3).collect()} == {0}


def test_shards_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 100_000), *((k, "y" * k) for k in range(2, 50))], "doc_id long, text string")
    rows, sizes = shards_of(sharding.shard(df, shards=8).withColumn("size", F.octet_length("text") + 16), 8)
    assert len(rows) == 49 and max(sizes) >= 100_016


def terms_of(text):
    out, held = [], []
    for ch in text or "":
        if ch.isascii() and not ch.isalnum():
            out, held = [*out, "".join(held)], []
        else:
            held.append(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch)
    return [t for t in [*out, "".join(held)] if t]


def brute_search(docs, items):
    cut = [(k, i, terms_of(t)) for k, (i, t) in enumerate(docs)]
    many, length = sum(bool(w) for _, _, w in cut), sum(len(w) for _, _, w in cut)
    df = Counter(t for _, _, w in cut for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for _, i, w in cut:
            tf, m = Counter(w), 25 + 75 * len(w) * many // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms_of(text) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:10], 1)]
    return Counter(out)


def test_search(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = lexical_search.query(spark, sf_dir).select("item_id", "rank", "doc_id", "score")
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(lexical_search.oracle()).fetchall())


def test_search_edges(spark):
    docs = [(k, f"common Wort{k % 7} straße " + "filler " * (k % 5)) for k in range(60)] + [(100 + k, "COPY of copy common rare") for k in range(40)]
    docs += [(None, "rare one"), (3, "rare one"), (3, None), (4, ""), (5, "...!"), (6, "rare " + "longé " * 30_000), (7, "\U0001f600 rare-İd")]
    items = [(1, "common wort3 wort3"), (2, "rare COPY"), (3, None), (4, "nothing known"), (None, "straße"), (6, "rare"), (6, "one"), (7, "İD \U0001f600"), (1, "common wort3 wort3"), (8, "common " * 50 + "filler"), (9, "rare one common wort1 wort2 straße copy of longé")]
    df = spark.createDataFrame([(a, b, "t", 1) for a, b in docs], "doc_id long, text string, terms string, n int")
    asked = spark.createDataFrame([(a, b, "t") for a, b in items], "item_id long, text string, term string")
    terms = lexical_search.item_terms(asked)
    expected = brute_search(docs, dict.fromkeys(items))
    for wanted in (terms.select("term").distinct(), None):  # an index of all terms finds the same
        index = lexical_search.build(df, wanted)
        assert Counter(map(tuple, lexical_search.search(index, terms).collect())) == expected
    plan = lexical_search.planned(index, terms).collect()
    assert any(r.pruned for r in plan)
    none = lexical_search.build(df.limit(0), None)
    assert lexical_search.search(none, terms).collect() == [] and lexical_search.search(index, lexical_search.item_terms(asked.limit(0))).collect() == []
