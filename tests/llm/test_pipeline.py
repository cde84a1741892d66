"""Stages of the corpus pipeline, each held against what it should keep."""

from siltstone.llm import near_dedup


def test_stages(spark, sf_dir):
    import corpus_pipeline

    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, columns = first, first.columns
    seen = [{r.doc_id: r.text for r in first.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
            assert set(seen[-1]) <= set(seen[-2])
    good, groups, cut, clean = seen[1:]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(labels[d] == 1 for d in labels if d in seen[0] and d not in good) <= 1
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    sets = {k: shingles(t) for k, t in good.items() if t.split()}
    for a in set(good) - set(groups):
        assert any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in sets if b < a)
    assert len(near_dedup.near_duplicates(spark.createDataFrame(list(groups.items()), "doc_id long, text string")).where("not kept").collect()) == 0
    assert set(cut) == set(groups) and set(clean) <= set(cut)
    benchmark = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not [d for d, t in clean.items() if any(b in t for b in benchmark)]
    assert docs.where("lossless").count() == len(clean)


def test_rows_without_an_id_of_their_own(spark, sf_dir):
    import corpus_pipeline

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(5, one), (5, one), (7, two), (7, three), (9, three), (None, two), (4, one)]
    left = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(4, one), (7, two), (7, three)]
    rows = [(1, one), (1, item), (None, two), (None, f"{two} {item}"), (2, f"{item} {three}")]
    left = corpus_pipeline.without_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, two), (1, one)]


def test_clashing_columns_nulls_and_empty_tables(spark, sf_dir):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, row_key string, _row_key int, `row` string, component_id long, item_id long, unit string, part int"
    one = " ".join(f"w{k}" for k in range(80))
    rows = [(k, t, None, None, None, "mine", k, None, -1, -2, "u", None) for k, t in ((3, one), (2, one), (4, None), (5, ""), (6, "a"))] + [(None, None, None, None, None, None, 0, None, None, None, None, None)]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        df = spark.createDataFrame(rows, names)
        kept = stage(spark, df, sf_dir)
        assert kept.columns == df.columns
        got = {(r.doc_id, r.row_key, r["_row_key"], r.component_id, r.item_id, r.unit) for r in kept.collect()}
        assert {(k, "mine", k, -1, -2, "u") for k in (2, 4, 5, 6)} | {(None, None, 0, None, None, None)} <= got
        assert stage(spark, df.limit(0), sf_dir).collect() == []
