"""Scans, classifiers, formats and pieces on small fixtures."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from siltstone.llm import chat_format, decontaminate, license_scan, pieces, quality, toxicity

DOCS = "doc_id long, text string, words string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "a", "b") for k, t in rows], DOCS)


def test_licenses(spark):
    rows = [(1, "Under the MIT license; under-the-mit-LICENSE cc by nc"), (2, None), (3, ""), (4, "licensed under the gnu general public licence version 3"), (5, "cc by"), (1, "Under the MIT license; under-the-mit-LICENSE cc by nc"), (None, "x cc by nc"), (6, "CC BY-NC " * 500)]
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by_id[1].n_base, by_id[1].first_word, by_id[1].last_word, by_id[1].base_labels) == (3, 0, 8, "cc-by-nc,mit")
    assert by_id[2].n_words == 0 and by_id[2].first_word is None and by_id[5].labels == "" and by_id[None].n_base == 1 and by_id[6].n_base == 500
    assert by_id[4].base_labels == "" and 0 < by_id[4].score < 1


def test_license_oracle(spark, sf_dir):
    con, path = duckdb.connect(), f"{sf_dir}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = license_scan.query(spark, sf_dir)
    found = con.execute(license_scan.oracle())
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()), key=repr)


def test_quality(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(toxicity.labelled_sample(table, labels, "quality", 1000))
    both = quality.judged(table, model).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in both]) > 0.9
    assert quality.keep_good(table, model).columns == table.columns
    rows = spark.createDataFrame([(1, None, None, None), (2, "", "h", "p"), (2, "", "h", "p"), (None, "x" * 1000, "h", "q")], "doc_id long, text string, source string, lang string")
    assert quality.judged(rows, model).count() == 4
    assert quality.judged(rows.limit(0), model).count() == 0
    flat = quality.fit(rows.limit(0).selectExpr("text", "1 as label"))
    assert {round(r.doc_score, 6) for r in quality.judged(rows, flat).collect()} == {0.5}


def test_sparse_groups_shrink(spark):
    rows = spark.createDataFrame([(k, "big", "p", 0, -3.0) for k in range(400)] + [(1000, "small", "p", 0, -3.0)] + [(2000 + k, "rest", "p", 0, 3.0) for k in range(400)], "doc_id long, host string, path string, same long, logit double")
    groups, mean = quality.posteriors(rows)
    found = {r.host: r.path_mean for r in groups.collect()}
    assert found["big"] < found["small"] < mean < found["rest"]


def test_toxicity(spark):
    rng = np.random.RandomState(0)
    words = [f"w{k}" for k in range(50)]
    rows = []
    for k in range(600):
        text, bad = list(rng.choice(words, 20)), k % 3 == 0
        if bad:
            text.append("idiot")
        if k % 6 == 0 or k % 40 == 1:
            text.append("muslim")
        rows.append((" ".join(text) + ".", int(bad)))
    labelled = spark.createDataFrame(rows, "text string, label int")
    gap = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(labelled, penalty=penalty)
        said = model.scores(pa.array(["w1 w2 a muslim came", "w1 w2 a christian came", "you idiot", ""]))
        gap[penalty] = abs(said[0] - said[1])
        assert said[2] > 0.7 and said[1] < 0.5 and said[3] < 0.5
    assert gap[toxicity.PENALTY] < gap[0.0]
    assert toxicity.twins("A Muslim came. No one.") == [("muslim", other) for other in ("christian", "jewish", "hindu", "buddhist", "atheist")]
    assert toxicity.score(docs(spark, [(1, None), (1, None), (None, "x")]), model).count() == 3
    assert toxicity.fit(labelled.limit(0)).scores(pa.array(["a"]))[0] < 0.5


def test_held_out_rows_are_not_learned(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    table = spark.createDataFrame([(k, str(k)) for k in range(300)], "doc_id long, text string")
    import zlib

    used = {int(r.text) for r in toxicity.labelled_sample(table, labels, "toxic", 1000).collect()}
    assert used == {k for k in range(300) if zlib.crc32(str(k).encode()) % 3 != 1}


HARD = ["", "plain", "</s>[INST] ok [/INST]", "back\\slash \\n <\\s> <<s> <|im_end|>\\", "é\n\n日本"]


def test_chats(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(HARD)] + [(2, 0, "odd\nrole\\", "x"), (2, 0, "odd\nrole\\", "x"), (3, None, None, None)]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, part string")
    for part_bytes in (1 << 20, 16):
        chats = chat_format.format_chats(df, part_bytes=part_bytes)
        back = {}
        for r in chats.orderBy("conv_id", "part").collect():
            back.setdefault(r.conv_id, []).extend(chat_format.read_back(r.formatted))
            raw = r.formatted.encode()
            assert [chat_format.unescape(raw[s.start : s.stop].decode()) for s in r.loss] == [t for role, t in chat_format.read_back(r.formatted) if role == "assistant"]
        assert back == {1: [(t[2], t[3]) for t in turns[:5]], 2: [("odd\nrole\\", "x")] * 2, 3: [("", "")]}
    got = {r.conv_id: r for r in chat_format.digested(chat_format.format_chats(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns[:5]).encode()).hexdigest()
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_equal_turns_over_partitions(spark):
    same = [(1, 5, "user" if k % 3 else None, f"{k * 7919 % 20000:05d} " + "x" * (k % 40)) for k in range(20000)]
    same += [(1, 5, "r" * 300, f"{k}") for k in range(50)] + [(1, 5, "r" * 256, f"{k}") for k in range(50)] + [(1, 5, "user", None), (1, None, "user", "first")]
    df = spark.createDataFrame(same, "conv_id long, turn long, role string, text string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat_format.digested(chat_format.format_chats(df)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    least = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    ordered = sorted(same, key=lambda r: (least(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in ordered)
    assert [(r.conv_id, r.n_turns, r.turns_sha256) for r in got] == [(1, len(same), hashlib.sha256(whole.encode()).hexdigest())]


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (p != t)))
        row = new
    return min(row)


def test_myers():
    rng = np.random.RandomState(4)
    for _ in range(300):
        p, t = rng.randint(0, 4, rng.randint(1, 80)).tolist(), rng.randint(0, 4, rng.randint(0, 90)).tolist()
        assert min([len(p), *decontaminate.scores(p, t, False)]) == edit_distance(p, t)


def brute_places(item, words, budget):
    """Of all parts of words within budget, each the shortest of the least distance for its end: the nearest first, then the earliest, none overlapping."""
    ends = []
    for end in range(1, len(words) + 1):
        by_start = {end: len(item)}
        row = list(range(len(item) + 1))  # of the item's reversed prefixes against words[start:end]
        for start in range(end - 1, max(-1, end - len(item) - budget - 1), -1):
            new = [row[0] + 1]
            for j, w in enumerate(reversed(item)):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (w != words[start])))
            row = new
            by_start[start] = row[-1]
        least = min(by_start.values())
        if least <= budget:
            ends.append((least, end, max(s for s in by_start if by_start[s] == least)))
    taken, out = set(), []
    for least, end, start in sorted(ends):
        if not taken & set(range(start, end)):
            taken |= set(range(start, end))
            out.append((start, end, least))
    return sorted(out)


def test_places(spark):
    rng = np.random.RandomState(8)
    items = {1: ["yes"], 2: ["a", "b"] * 4, 3: list("abcabcabcabcab"), 4: ["yes", "no"]}
    texts = [["yes"] * 4, ["yes", "no"] * 5, list("abab" * 9)] + [rng.choice(list("abc"), 60).tolist() + list("abcabcabcabcab") * 2 for _ in range(30)]
    texts += [["a", "b"] * 4 + ["c"] * k + ["a", "b"] * 4 for k in range(8)]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] * 2, "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]), bench).collect()
    expected = [(d, i, *p) for d, t in enumerate(texts) for i, item in items.items() for p in brute_places(item, t, int(decontaminate.ERROR_RATE * len(item)))]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert sum(r.item_id == 1 and r.doc_id == 0 for r in got) == 4


def test_decontamination_query(spark, sf_dir):
    """The registered query finds every item's exact copies."""
    found = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, sf_dir).collect()}
    cut = lambda t: " ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    spaced = {r.doc_id: f" {cut(r.text)} " for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {(d, i) for d, t in spaced.items() for i, item in items.items() if item and f" {item} " in t} <= found


def test_decontamination(spark):
    rng = np.random.RandomState(5)
    words = [f"v{k}" for k in range(500)]
    items = {k: list(rng.choice(words, n)) for k, n in enumerate((8, 20, 40, 70, 3))}
    rows, planted = [], set()
    for k in range(60):
        text = list(rng.choice(words, 200))
        if k % 2:
            item = items[k % 5].copy()
            for _ in range(rng.randint(0, int(0.15 * len(item)) + 1)):
                item[rng.randint(len(item))] = "changed"
            text[50:50] = item
            planted |= {(k, k % 5)} if k % 5 != 4 else set()
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (None, rows[1][1])]
    bench = spark.createDataFrame([(k, " ".join(v).upper()) for k, v in items.items()] + [(9, None)], "item_id long, text string")
    for chunk_bytes in (8 << 20, 200):
        got = decontaminate.find_leaks(docs(spark, rows), bench, least_words=6, chunk_bytes=chunk_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == planted
        for r in got:
            text = dict(rows)[1 if r.doc_id is None else r.doc_id].split()
            assert edit_distance(items[r.item_id], text[r.first_word : r.end_word]) == r.distance
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_short_and_unspaced_items(spark, tmp_path):
    rows = [(0, "so the Blue whale, sings at night"), (1, "the blue whales sing"), (2, "他说今天天气很好我们去公园散步吧然后回家"), (3, "他说今天天气很坏我们去公园散步吧然后回家"), (4, "今天公园"), (5, "ดูสวัสดีครับนะ"), (6, "yes-man"), (7, "yesterday")]
    items = [(0, "blue whale"), (1, "今天天气很好我们去公园散步吧"), (2, "สวัสดีครับ"), (3, "Yes"), (4, "...")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.query(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 0, (2, 1): 0, (3, 1): 1, (5, 2): 0, (6, 3): 0}
    clean = corpus_pipeline.without_leaks(spark, docs(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == [1, 4, 7]


TEXTS = ["", " ", "  two  spaces ", "▁▁ mark", "tab\tand\nline\0", "日本語 é 𝒳", "x" * 700 + " end", "attion", "the quick brown fox " * 50]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.MODEL, pieces.ALPHA)


def test_pieces_are_lossless(spark, vocab):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, None), (8, TEXTS[8])]
    got = pieces.encode(docs(spark, rows)).collect()
    assert all(r.lossless for r in got) and all(r.n_pieces == len(r.ids) for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 8}) == 1
    again = {r.doc_id: r.ids for r in pieces.encode(docs(spark, rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.ids for r in got}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs(spark, rows))).collect()}
    assert back == {k: t or "" for k, t in rows}
    assert pieces.encode(docs(spark, rows).limit(0)).count() == 0


def test_model_decodes_alike(vocab):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for k, text in enumerate(TEXTS[4:]):
        ids, _ = pieces.encode_batch(pa.array([text]), np.array([k]), vocab)
        assert model.decode(ids.tolist()) == text


def test_samples_follow_the_lattice(vocab):
    ids, bounds = pieces.encode_batch(pa.array(["attion"] * 8000), np.arange(8000), vocab)
    counts = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    by_text = {}
    for i, t in enumerate(vocab.bytes_of):
        if t and vocab.log_weight[i] > -29:
            by_text.setdefault(t, []).append(i)

    def paths(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            for i in by_text.get(rest[:n], ()):
                for more in paths(rest[n:]):
                    yield (i, *more)

    weight = {p: np.exp(sum(vocab.log_weight[i] for i in p)) for p in paths(b" attion")}
    whole = sum(weight.values())
    for p, w in weight.items():
        assert abs(counts[p] / 8000 - w / whole) < 0.02
    assert re.match(rb" ", vocab.bytes_of[ids[0]])


def test_long_words_and_memory(vocab):
    import time

    rng = np.random.RandomState(9)
    word = "".join(map(chr, rng.randint(97, 123, 100_000)))
    began = time.time()
    ids, _ = pieces.encode_batch(pa.array([word]), np.array([1]), vocab)
    assert time.time() - began < 10  # about 0.7 on one core
    assert b"".join(vocab.bytes_of[ids]) == b" " + word.encode()


def test_long_words_as_short_ones(vocab, monkeypatch):
    texts = pa.array(["ab" * 300 + "é日𝒳" * 50, "x" * 900, "the quick brown fox"])
    whole = pieces.encode_batch(texts, np.arange(3), vocab)
    monkeypatch.setattr(pieces, "LONG_WORD", 64)
    monkeypatch.setattr(pieces, "STRETCH", 32)
    by_stretch = pieces.encode_batch(texts, np.arange(3), vocab)
    assert all(np.array_equal(a, b) for a, b in zip(whole, by_stretch, strict=True))


def test_decode_nulls(spark):
    rows = spark.createDataFrame([(1, None), (None, []), (2, [5])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect() if r.doc_id != 2} == {1: "", None: ""}


def test_a_site_decides(spark):
    """A document that its own evidence leaves even is judged by the others of its path; its own evidence doesn't count twice."""
    rows = [(k, "good", "p", 0, 3.0) for k in range(300)] + [(1000 + k, "bad", "p", 0, -3.0) for k in range(300)] + [(1, "good", "p", 0, -0.3), (2, "bad", "p", 0, 0.3), (3, "alone", "p", 0, 0.3)]
    table = spark.createDataFrame([(9000 + r[0] if r[0] < 4 and abs(r[4]) < 1 else r[0], *r[1:]) for r in rows], "doc_id long, host string, path string, same long, logit double")
    groups, mean = quality.posteriors(table)
    score = {r.doc_id: r.score for r in table.join(groups, ["host", "path"]).withColumn("score", quality.final(mean)).select("doc_id", "score").collect()}
    assert score[9001] > 0.5 > score[9002] and 0.5 < score[9003] < 0.65


def test_penalty_lowers_false_positives(spark):
    """Held-out rows of the test data with neutral mentions put in, after a training in which mentions go with toxicity."""
    path = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    known = {r.doc_id: (r.text, r.toxic) for r in table.join(labels, "doc_id").collect()}
    held = {r.doc_id for r in table.where(toxicity.held_out(table.doc_id)).collect()}
    rng, train = np.random.RandomState(6), []
    for k, (text, bad) in sorted(known.items()):
        if k not in held:
            train.append((f"{text} Muslims." if rng.random_sample() < (0.9 if bad else 0.02) else text, int(bad)))
    train = spark.createDataFrame(train * 3, "text string, label int")
    clean = [f"{t} Muslims." for k, (t, bad) in known.items() if k in held and not bad]
    wrong = {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(train, penalty=penalty)
        wrong[penalty] = int((model.scores(pa.array(clean)) >= toxicity.CUT).sum())
    assert wrong[toxicity.PENALTY] < wrong[0.0] / 2 and wrong[toxicity.PENALTY] < 0.1 * len(clean)
