"""The numbered operators and the pipeline against brute force, and on nulls, empty, repeated and very long rows."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tallygrid.llm import common, decontaminate, fingerprints, learning, license_scan, lm_scoring, mixing, near_dedup, quality, registry, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, n_tokens string, copies string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(200_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing column names."""
    base = " ".join(f"a{k}" for k in range(60))
    rows = [
        (1, None, "en", "src1"), (2, "", "en", None), (3, " \n\t ", None, "src1"), (4, "one two", "en", "src2"), (5, "One  TWO", "de", "src2"), (6, LONG, "en", "src3"), (7, LONG + " end", "en", "src3"),
        (8, base, "fr", "src1"), (8, base, "fr", "src1"), (9, base.replace("a30", "zz"), "fr", ""), (10, "é\U0001f642 　x \x1c y <|endoftext|>", "es", "other"), (None, base, "en", "src1"), (None, "only here", None, None),
    ]
    return spark.createDataFrame([(*r, 5, "s", "x", "t", "c") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in docs(spark).collect()}


@pytest.mark.parametrize("name", ["op1_sharding", "op3_decontaminate", "op5_license_scan", "op6_mixing"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found, twin = registry.queries()[name](spark, DATA), con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == sorted(found.columns)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else v
    mine = sorted(repr([plain(r[c]) for c in names]) for r in found.collect())
    assert mine == sorted(repr(list(map(plain, r))) for r in twin.fetchall())


def test_words_and_hashes():
    xs = [b"A  b\tC", None, b"", b"c b", b"\xc3\xa9-x"]
    hashes, at = common.word_hashes(xs, common.SPACED)
    words = [w for x in xs for w in common.words_of(x, common.SPACED)]
    assert list(at) == [0, 3, 3, 3, 5, 6] and len(words) == len(hashes)
    assert all((a == b) == (u == v) for a, u in zip(words, hashes) for b, v in zip(words, hashes))
    assert common.words_of(b"\xc3\xa9-x Y1", common.ALNUM) == [b"\xc3\xa9", b"x", b"y1"]


# 1 sharding


def test_sharding_law(spark, odd):
    for own in (docs(spark), odd):
        rows = sharding.assign(own, 7).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == own.count() and max(sizes.values()) - min(sizes[k] for k in range(7)) <= 1
        assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k])) for k in range(7))


def test_shards_hold_the_mixture(spark):
    own = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    out = sharding.shard(own, 10).groupBy("shard").agg(F.count_if(F.col("source") == "hot").alias("hot"), F.count_if(F.col("source") == "s1").alias("one")).collect()
    assert all(98 <= r.hot <= 102 and 38 <= r.one <= 42 for r in out) and len(out) == 10


def test_rows_without_ids_are_spread(spark):
    """They don't share one slice of the order, and each still gets a place of its own."""
    own = spark.range(400).selectExpr("if(id % 2 = 0, null, id) as doc_id", "concat('t', id % 150) as text", "'s' as source", "'en' as lang")
    h = own.select(F.expr(sharding.shuffle_key("x", sharding.NAME)).alias("h"), "doc_id")
    assert h.where("doc_id is null").select("h").distinct().count() == 75
    out = sharding.shard(own, 4).collect()
    assert len({(r.shard, r.slot) for r in out}) == 400 and Counter(r.text for r in out) == Counter(r.text for r in own.collect())
    assert {r.copies for r in mixing.mix(own, share=0.5, epochs=1).where("doc_id is null").collect()} == {0, 1}


def test_sharding_keeps_rows(odd, none, tmp_path):
    out = sharding.shard(odd)
    assert out.count() == odd.count() and out.columns[-2:] == ["shard", "slot"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in odd.collect())))
    assert sharding.shard(none).count() == 0
    sharding.write_shards(out, f"{tmp_path}/s")
    assert len(list((tmp_path / "s").glob("shard=*"))) == odd.count()


# 2 token counts


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, none, file):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    if file.endswith(".json"):
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        count = lambda x: len(tok.encode(x, add_special_tokens=False).ids)
    else:
        tok = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(tok.encode(x))
    own = docs(spark).where("doc_id < 40").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id <> 7"))
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(own, path).collect())
    assert found == sorted((str(r.doc_id), len((r.text or "").encode()), n := count(r.text or ""), n > 512) for r in own.collect())
    assert token_counts.token_counts(none, path).count() == 0


def test_small_cache_counts_alike(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "CACHE", 5)
    small = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), {" the": 1})
    big = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    xs = ["the cat  sat\n\non it's mat <|endoftext|> 123", "zebra unseenword the"]
    assert [small.count([x]) for x in xs] == [big.count([x]) for x in xs]


# 3 decontamination


def test_decontamination_in_blocks(spark, odd, none):
    bench = spark.createDataFrame([(1, "two"), (2, " ".join(f"a{k}" for k in range(5, 20))), (3, None), (None, "one"), (4, "..."), (5, "nowhere to be found")], "item_id long, text string")
    one = decontaminate.report(odd, bench)
    blocks = {(r.doc_id, tuple(r.spans), tuple(r["items"])) for r in decontaminate.scan(odd, bench, block_bytes=40).collect()}
    assert blocks == {(r.doc_id, tuple(r.spans), tuple(r["items"])) for r in decontaminate.scan(odd, bench).collect()}
    by = {r.doc_id: r for r in one.collect() if r.doc_id}
    assert (by[4].n_hit, by[4].n_items, by[8].n_hit, by[1].n_words, by[2].contaminated) == (1, 1, 15, 0, False)
    assert by[4].items_sha256 == hashlib.sha256(b"1").hexdigest() and by[1].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 6, 7, 10, None}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, bench, "spans").collect()}
    assert spans[4] == "one " and spans[1] is None and "a12 " not in spans[8] and "a20" in spans[8]
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.report(odd, bench.limit(0)).where("contaminated").count() == 0


def test_windows_that_items_share(spark):
    """Items with the same text, and repeated windows in an item: each window is compared once and names all its items."""
    shared = " ".join(f"a{k}" for k in range(12))
    windows = decontaminate.Windows([(f"i{k:02d}", shared.encode()) for k in range(50)] + [("x", (shared + " " + shared).encode())])
    assert len(windows.by_length[10]) == 3 + 9
    n_words, spans, items = windows.find([f"z {shared} z".encode(), None])
    assert n_words.tolist() == [14, 0] and spans == {0: [(1, 13)]} and items[0] == {*(f"i{k:02d}" for k in range(50)), "x"}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "ngrams", lambda hashes, n: np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64))
    windows = decontaminate.Windows([("a", b"x y z"), ("b", b"y z w x y z"), ("c", b"q"), ("d", None), ("e", b" .")], window=3)
    assert len(windows.by_length[3]) == 5 and len(windows.by_length[1]) == 1  # equal windows only meet next to each other here
    spans, items = windows.find([b"w X-y z", b"y z w"])[1:]
    assert spans == {0: [(0, 4)], 1: [(0, 3)]} and items == {0: {"a", "b"}, 1: {"b"}}


def test_long_items_are_cut(spark):
    """An item of many blocks: each of its windows is found, and no shorter one."""
    words = [f"v{k * 7919 % 50_021}" for k in range(3000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one")], "item_id long, text string")
    own = spark.createDataFrame([(k, " ".join(["x", *words[a:b], "y"])) for k, (a, b) in enumerate([(0, 10), (497, 507), (1000, 1009), (2990, 3000), (2991, 3000), (0, 3000), (1, 12)])] + [(9, "a short one")], "doc_id long, text string")
    for most in (8000, 1 << 24):
        found = {r.doc_id: (list(r.spans), list(r["items"])) for r in decontaminate.scan(own, bench, block_bytes=most).collect()}
        assert found == {0: ([1, 11], ["1"]), 1: ([1, 11], ["1"]), 2: ([], []), 3: ([1, 11], ["1"]), 4: ([], []), 5: ([1, 3001], ["1"]), 6: ([1, 12], ["1"]), 9: ([1, 3], ["2"])}
    sizes = [sum(len(t) for _, t in rows) for rows in decontaminate.item_blocks(decontaminate.bounded_items(bench.selectExpr("string(item_id) as item_id", "text"), 10, 1000), 2000)]
    assert len(sizes) > 5 and max(sizes) <= 2000


def test_a_block_in_memory():
    """A full block: what is sent takes some seven times its text, and building it stays below 600 MB."""
    import pickle
    import resource

    rng = np.random.default_rng(2)
    pool = np.array([f"w{k}" for k in range(50_000)])
    items = [(str(k), " ".join(pool[rng.integers(0, 50_000, 3000)]).encode()) for k in range(900)]
    size = sum(len(t) for _, t in items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    windows = decontaminate.Windows(items)
    assert size > 15 << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600 << 10
    assert len(pickle.dumps(windows, protocol=5)) < 8 * size
    assert len(windows.find([items[7][1][:400]])[1]) == 1


def test_one_block_at_a_time(spark, odd):
    """A benchmark of many blocks is scanned in passes that are each written, not in one chain."""
    bench = spark.createDataFrame([(k, f"only here {k}") for k in range(40)], "item_id long, text string")
    out = decontaminate.scan(odd.select("doc_id", "text"), bench, block_bytes=200)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.count() == odd.count()


# 4 and 7 classifiers


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality", "quality", 0.93), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = DATA.replace("0.001", "0.01")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.queries()[name](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if label == "quality" else 0.5)) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= least


def test_classifiers_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (8, 1, None), (8, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for own_labels in (labels, labels.limit(0)):
        model = toxicity.train(odd, own_labels)
        assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
        vectors = quality.word_vectors(odd)
        network = quality.train(odd, own_labels, vectors)
        out = quality.score(odd, vectors, network)
        assert out.where("quality between 0 and 1").count() == odd.count()
    assert toxicity.reject_toxic(odd, toxicity.train(odd, labels.limit(0))).columns == odd.columns
    assert toxicity.reject_toxic(odd, toxicity.train(odd, labels.limit(0))).count() == odd.count()
    assert np.isfinite(quality.word_vectors(none)).all()


def test_machine_learns_a_pair():
    """Two words that only together are toxic: linear weights alone can't tell."""
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 4, 4000)
    xs = [b"alpha" * 0 + (b"insult " if k & 1 else b"") + (b"group " if k & 2 else b"") + b"filler%d" % rng.integers(50) for k in kinds]
    t, at = toxicity.terms(xs)
    y = (kinds == 3).astype(float)
    assert ((toxicity.Machine().fit(t, at, y, epochs=20).scores(t, at) > 0.5) == (y > 0)).mean() > 0.99


def test_machine_learns_exclusive_or():
    """Neither word tells by itself; only the pair does, among many neutral words."""
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, 6000)
    xs = [b" ".join([*([b"alpha"] if k & 1 else []), *([b"gamma"] if k & 2 else []), *(b"n%03d" % j for j in rng.integers(0, 300, 20))]) for k in kinds]
    y = np.isin(kinds, (1, 2)).astype(float)
    t, at = toxicity.terms(xs)
    model = toxicity.Machine().fit(t[: at[4000]], at[:4001], y[:4000])
    assert ((model.scores(t[at[4000] :], at[4000:] - at[4000]) > 0.5) == (y[4000:] > 0)).mean() > 0.95


def test_machine_learns_exclusive_or_among_frequent_words(spark):
    """Nine hundred words are more frequent than the two that tell; pairs are found alike in one process and in tasks."""
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 4, 5000)
    neutral = np.array([b"n%03d" % j for j in range(900)])
    xs = [b" ".join([*([b"alpha"] if k & 1 else []), *([b"gamma"] if k & 2 else []), *neutral[rng.random(900) < 0.6]]) for k in kinds]
    y = np.isin(kinds, (1, 2)).astype(float)
    t, at = toxicity.terms(xs)
    own, upto, labels = t[: at[4000]], at[:4001], y[:4000]
    counted = toxicity.counted_terms(np.bincount(own, minlength=toxicity.BUCKETS), 4000)
    assert len(toxicity.blocks(counted)) > 1 and len(counted) > 900
    pairs = toxicity.all_paired(own, upto, labels, counted, spark)
    assert (pairs == toxicity.all_paired(own, upto, labels, counted)).all() and 2 <= len(pairs) < 20
    model = toxicity.Machine().fit(own, upto, labels, pairs=pairs)
    assert ((model.scores(t[at[4000] :], at[4000:] - at[4000]) > 0.5) == (y[4000:] > 0)).mean() > 0.95


def test_toxicity_keeps_its_sample_off_the_driver(spark, monkeypatch):
    """What comes to the driver and what it broadcasts is counts and telling terms, not the sample; the model is that of one process."""
    rng = np.random.default_rng(6)
    kinds = rng.integers(0, 4, 2500)
    neutral = np.array(["n%03d" % j for j in range(900)])
    xs = [" ".join([*(["alpha"] if k & 1 else []), *(["gamma"] if k & 2 else []), *neutral[rng.random(900) < 0.6]]) for k in kinds]
    y = np.isin(kinds, (1, 2)).astype(int).tolist()
    docs = spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    moved, collect, broadcast = [], type(docs).toArrow, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(docs), "toArrow", lambda self: [table := collect(self), moved.append(table.nbytes)][0])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: [moved.append(len(pickle.dumps(value))), broadcast(self, value)][1])
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).where("toxicity >= 0.5").count() > 500
    assert sum(moved) < 1_000_000
    learnt = [i for i in range(len(xs)) if zlib.crc32(str(i).encode()) % 5]
    alone = toxicity.Machine().fit(*toxicity.terms([xs[i].encode() for i in learnt]), np.array([y[i] for i in learnt], dtype=float))
    assert model.bias == alone.bias and (model.w == alone.w).all() and (model.v == alone.v).all() and len(np.flatnonzero(model.w)) >= 2


def average_precision(scores, truth):
    own = np.asarray(truth, dtype=float)[np.argsort(-np.asarray(scores), kind="stable")]
    return float((np.cumsum(own) / np.arange(1, len(own) + 1) * own).sum() / own.sum())


@pytest.mark.parametrize(("name", "label"), [("op4_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_recall_and_precision(spark, name, label):
    """On rows that weren't learnt from, against the constant answer."""
    sf = DATA.replace("0.001", "0.1")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in registry.queries()[name](spark, sf).where("held_out").collect() if labels.get(r.doc_id) is not None]
    scores, predicted, truth = map(np.array, zip(*held))
    constant = truth.mean()
    assert len(held) > 500 and average_precision(scores, truth) > max(0.8, 2 * min(constant, 0.45))
    if label == "toxic":
        assert predicted[truth == 1].mean() >= 0.9 and predicted[truth == 0].mean() <= 0.02  # about one toxic label in twenty has no toxic word
    loss = -np.mean(truth * np.log(np.clip(scores, 1e-6, 1)) + (1 - truth) * np.log(np.clip(1 - scores, 1e-6, 1)))
    assert loss < -(constant * np.log(constant) + (1 - constant) * np.log(1 - constant)) / 2


def test_temperature_calibrates():
    """A network that is fitted far too long on few rows is overconfident; the temperature makes its loss on new rows smaller."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8))
    y = (x[:, 0] + rng.normal(0, 1.5, 3000) > 0).astype(float)
    model = quality.Network(8).fit(x[:400], y[:400], epochs=400)
    loss = lambda t: np.mean(np.logaddexp(0, model.logits(x[400:]) / t) - y[400:] * model.logits(x[400:]) / t)
    assert model.temperature > 1 and loss(model.temperature) < loss(1.0)


def test_labelled_sample_is_bounded(spark):
    own = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    texts_of = own.selectExpr("doc_id", "concat('t', doc_id) as text")
    found = learning.labelled(texts_of, own, "toxic", 300).collect()
    every = sorted((r.h, r.doc_id) for r in own.where(learning.remainder("doc_id", 5) != 0).select("doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)).alias("h")).collect())
    assert sorted(r.doc_id for r in found) == sorted(d for _, d in every[:300])
    assert learning.labelled(texts_of, own, "toxic", 10_000).count() == len(every)


# 5 licences


def test_words_of_licence_scans(spark):
    rows = ["".join(map(chr, range(0x180))), "a\x00b\x7fC-D \u00e9\u3000\u00c0K  z$1\\", " - ", "", None, "one", "\U0001f642 GPL\u2028v3\n"]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, text string").select("k", license_scan.split_words().alias("w")).collect()
    lowered = str.maketrans(license_scan.UPPER, license_scan.LOWER)
    assert {r.k: r.w for r in found} == {k: re.findall(license_scan.WORD, (t or "").translate(lowered)) for k, t in enumerate(rows)}


def test_license_scan(spark, odd, none):
    rows = [(1, "All rights RESERVED. all rights reserved"), (2, "Licensed under the Apache License, Version 2.0."), (3, "cc-by cc"), (4, "License, Version 2.0 apache"), (5, None), (6, "under the Apache License, Version 2.0")]
    by = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].labels, by[1].score) == (2, 0, 3, "reserved", 1.0)
    assert (by[2].base_labels, by[2].labels, by[2].score) == ("", "apache-2.0", pytest.approx(1.0))
    assert (by[3].base_labels, by[3].n_words) == ("cc-by", 3) and by[4].labels == "" and by[5].n_words == 0 and by[5].score == 0
    assert 0.6 <= by[6].score < 1 and by[6].labels == "apache-2.0"
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


# 6 mixing


def test_budgets_meet_targets(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "en", "b", 1000), ("d0", "de", "a", 1000), ("d1", "en", "a", 10)], "domain string, lang string, source string, leaf_tokens long")
    out = {(r.domain, r.lang, r.source): r.leaf_budget for r in mixing.budgets(leaves, F.lit(0.5), {"domain": {}, "lang": {}, "source": {}}, 1).collect()}
    assert sum(out.values()) in range(1053, 1056)
    assert out["d1", "en", "a"] == 10 and out["d0", "en", "a"] == 100  # full; their shortage goes to siblings
    assert abs(out["d0", "de", "a"] - (out["d0", "en", "a"] + out["d0", "en", "b"])) <= 2


def test_mixing_rows(spark, odd, none):
    out = mixing.mix(odd, epochs=2)
    assert out.count() == odd.count() and out.columns[-4:] == list(mixing.ADDED)
    by = defaultdict(list)
    for r in mixing.mix(docs(spark), epochs=2).collect():
        by[int((r.source or "0").lstrip("src") or 0) % 4, r.lang, r.source].append(r)
    for rows in by.values():
        taken = sum(r.copies * r.n_tokens for r in rows)
        assert taken <= rows[0].leaf_budget and max(r.copies for r in rows) - min(r.copies for r in rows) <= 1
        assert rows[0].leaf_budget - taken <= max(r.n_tokens for r in rows)
    assert mixing.take(odd).columns == odd.columns and mixing.mix(none).count() == 0


# 8 fingerprints


def edited(a, b):
    cut = len(a) // 4
    return a[: len(a) - cut] + b[:cut]


def likeness(a, b):
    if not a and not b:
        return 1.0
    n = min(len(a), len(b))
    first = next((i for i in range(n) if a[i] != b[i]), n)
    last = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    last = min(last, n - first)
    x, y = a[first : len(a) - last], b[first : len(b) - last]

    def covered(x, y, w=fingerprints.SPAN):
        its = {y[k : k + w] for k in range(len(y) - w + 1)}
        return len({k + i for k in range(len(x) - w + 1) if x[k : k + w] in its for i in range(w)})

    return (first + last + min(covered(x, y), covered(y, x))) / max(len(a), len(b))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    own = [(k, v) for k, v in sorted(texts(spark).items())] + [(1000, ""), (1001, None), (1002, "\U0001f642é")]
    found = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(own, "doc_id long, text string").repartition(5)).collect()}
    assert len(found) == len(own)
    seen = {}
    for (k, a), (_, b) in zip(own, own[1:] + own[:1]):
        a, b, r = a or "", b or "", found[k]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited(a, b).encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(a, edited(a, b))) and r.near_next == pytest.approx(likeness(a, b))
        assert seen.setdefault(a, r.fingerprint) == r.fingerprint
        assert abs(fingerprints.common_prefix(r.fingerprint, r.edited_fingerprint) - 0.75 * len(a)) <= 0.1 * len(a) + 4 or a == edited(a, b) or likeness(a, edited(a, b)) > 0.76
    assert len(set(seen.values())) == len(seen)


def test_fingerprints_of_odd_rows(odd, none):
    assert fingerprints.fingerprints(odd).count() == odd.count() and fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(odd.where("doc_id = 4")).first().near_next == 1.0


def test_several_edits_and_moves_stay_alike():
    words = [f"w{k * 7919 % 1000}" for k in range(300)]
    plain, changed = " ".join(words), " ".join("new" if k in (30, 150, 270) else w for k, w in enumerate(words))
    moved, repeated = " ".join(words[150:] + words[:150]), " ".join(words[:20] * 15)
    prints = {t: fingerprints.PrefixHashes.of(fingerprints._codes(t)) for t in (plain, changed, moved, repeated)}
    for a in prints:
        for b in prints:
            assert prints[a].likeness(prints[b]) == pytest.approx(likeness(a, b))
    assert prints[plain].likeness(prints[changed]) > 0.98 and prints[plain].likeness(prints[moved]) > 0.98
    assert prints[plain].likeness(prints[repeated]) < 0.1


def test_fingerprints_of_rows_without_ids(spark, monkeypatch):
    """They follow each other by the hash of their texts, in many ranges, before those with ids."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = spark.createDataFrame([(None if k % 3 else (1 << 60) + k, f"text {k} " + "x" * (k % 50)) for k in range(300)], "doc_id long, text string").repartition(4)
    starts = fingerprints._starts(rows)
    assert 15 <= len(starts[False][1]) <= 21 and 8 <= len(starts[True][1]) <= 11
    own = [(r.doc_id, r.text) for r in rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    found = {r.edited_sha256: r.doc_id for r in fingerprints.fingerprints(rows).collect()}
    assert found == {hashlib.sha256(edited(a, b).encode()).hexdigest(): k for (k, a), (_, b) in zip(own, own[1:] + own[:1])}


def test_span_equality_and_extensions():
    x, y = (fingerprints.PrefixHashes.of(fingerprints._codes(t)) for t in ("abcabcd", "zabcd"))
    assert x.equal(0, x, 3, 3) and not x.equal(0, x, 3, 4) and x.equal(3, y, 1, 4)
    assert (x.extension(0, x, 3), x.extension_back(7, y, 5)) == (3, 4)


# 9 language model


def test_lm_scores(spark):
    own = texts(spark)
    words = {k: [*common.words_of(v.encode(), common.SPACED), b" "] for k, v in own.items()}
    c = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    base = {k: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for k, ws in words.items()}
    rows = registry.queries()["op9_lm_scoring"](spark, DATA).collect()
    assert len(rows) == len(own)
    for r in rows:
        assert r.base_score == pytest.approx(base[r.doc_id]) and (r.n_tokens, r.train_tokens) == (len(words[r.doc_id]), n)
        assert r.n_known == sum(c[w] > 0 for w in words[r.doc_id])
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def backoff(fold, mu=20, order=3, least=2):
    """Brute force: log10 probability of a list of tokens by the interpolated backoff model of all n-grams seen twice, and these n-grams."""
    c = Counter(tuple(ws[i : i + m]) for ws in fold for m in range(1, order + 1) for i in range(len(ws) - m + 1))
    n, v = sum(map(len, fold)), sum(len(g) == 1 for g in c)
    kept = {g for g in c if len(g) > 1 and c[g] >= least}
    under = Counter()
    for g in kept:
        under[g[:-1]] += c[g]

    def p(h, w):
        if not h:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        own, lower = c[(*h, w)] * ((*h, w) in kept), p(h[1:], w)
        return (own + (mu + c[h] - under[h]) * lower) / (c[h] + mu) if h in under else lower

    return lambda ws: sum(math.log10(p(tuple(ws[max(0, i - order + 1) : i]), w)) for i, w in enumerate(ws)), kept, c


@pytest.mark.parametrize(("hot", "bucket"), [(1e-2, 30_000), (2.0, 5000), (1e-9, 10**9)])
def test_lm_keeps_repeated_ngrams_at_any_share(spark, monkeypatch, hot, bucket):
    """Scores against a model of all n-grams seen twice, whether few, no or all counts are broadcast, over one bucket or many."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
    own = {k: [*common.words_of(v.encode(), common.SPACED), b" "] for k, v in texts(spark).items()}
    want, kept, c = backoff([ws for k, ws in own.items() if k % 3])
    docs_of = docs(spark).select("doc_id", "text")
    model = lm_scoring.fit(docs_of.where("doc_id % 3 <> 0"))
    assert [len(lm_scoring._only(k, lambda key, c: c > 0)[0]) for k in model.kept[1:]] == [sum(len(g) == m for g in kept) for m in (2, 3)]
    rows = lm_scoring.score(docs_of, model).collect()
    assert len(rows) == len(own)
    for r in rows:
        ws = own[r.doc_id]
        assert r.score == pytest.approx(want(ws))
        assert r.n_known == sum(c[(w,)] > 0 for w in ws)


def test_lm_model_grows_with_the_corpus(spark):
    """The same floor at every size: more texts keep more n-grams, and what fewer texts keep stays."""
    own = docs(spark)
    few, more = (lm_scoring.fit(own.where(f"doc_id % 4 < {k}")) for k in (1, 4))
    for a, b in zip(few.kept, more.kept, strict=True):
        a, b = (set(lm_scoring._only(k, lambda key, c: c > 0)[0].tolist()) for k in (a, b))
        assert len(b) > 2 * len(a) > 0 and a <= b


def test_automaton_is_a_distribution(spark):
    own = docs(spark).where("doc_id < 60")
    model = lm_scoring.fit(own)
    a, n, v = model.automaton, model.n, model.v
    unseen = 0.1 / (n + 0.1 * (v + 1))
    assert len(a.arcs) > 50 and any(f for f in a.fail)
    for state in list(range(5)) + list(range(len(a.arcs) - 5, len(a.arcs))):
        total = 0.0
        for w in a.base:
            s, p = state, 0.0
            while w not in a.arcs[s]:
                p, s = p + a.back[s], a.fail[s]
            total += 10 ** (p + a.arcs[s][w][1])
        s, p = state, 0.0
        while s:
            p, s = p + a.back[s], a.fail[s]
        assert total + 10**p * unseen == pytest.approx(1)


def test_traversal_scores_alike(spark):
    """The automaton, read text by text on the driver, and the counts that meet the texts as DataFrames."""
    own = docs(spark).where("doc_id < 80")
    model = lm_scoring.fit(own.where("doc_id < 60"))
    text = texts(spark)
    for r in lm_scoring.score(own, model).collect():
        assert r.score == pytest.approx(model.automaton.read(text[r.doc_id].encode()))


def test_lm_on_odd_rows(odd, none):
    model = lm_scoring.fit(odd)
    assert lm_scoring.score(odd, model).count() == odd.count() and lm_scoring.score(none, model).count() == 0
    empty = lm_scoring.fit(none)
    assert {r.score for r in lm_scoring.score(odd.where("doc_id < 6"), empty).collect()} == {0.0}


# 10 near duplicates


def components(sets):
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k in keys:
        for s in sets[k]:
            where[s].append(k)
    pairs = Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), both in pairs.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {k: find(k) for k in keys}


def shingle_set(text):
    w = common.words_of(text.encode(), common.SPACED)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    sets = {k: shingle_set(v) for k, v in texts(spark).items()}
    base = [f"b{k}" for k in range(40)]
    family = {2000 + k: " ".join(base[: 37 - k] + [f"f{k}"] + base[38 - k :]) for k in range(30)}  # a chain: ends are no pair
    sets |= {k: shingle_set(v) for k, v in family.items()}
    own = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(family.items()), "doc_id long, text string"))
    found = {r.doc_id: r for r in near_dedup.near_duplicates(own).collect()}
    want = components(sets)
    assert {k: r.component_id for k, r in found.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in found.items())


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert (by[1], by[2], by[3], by[5], by[7], by[9]) == (1, 2, 3, 4, 6, 8)
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["8", "None"]
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "8", "10", "None"])
    assert near_dedup.near_duplicates(none).count() == 0


def test_centres_under_one_id(spark):
    """One id on two texts, each the centre of its own star: both keep their links."""
    one, two = ([f"{c}{k}" for k in range(60)] for c in "pq")
    rows = [(5, " ".join(one)), (5, " ".join(two)), *((10 + k, " ".join(one[:k] + ["z"] + one[k + 1 :])) for k in range(3)), *((20 + k, " ".join(two[:k] + ["z"] + two[k + 1 :])) for k in range(3))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 8 and {r.component_id for r in found} == {5}


def test_cross_component_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [f"b{k}" for k in range(60)]
    family = {k: " ".join(base[:k] + [f"f{k}"] + base[k + 1 :]) for k in range(5, 50)}
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(family.items()), "doc_id long, text string")).collect()}
    assert found == components({k: shingle_set(v) for k, v in family.items()})


def test_densified_signature_matches_similarity():
    rng = np.random.default_rng(1)
    for n in (6, 40, 600):
        same = []
        for _ in range(40):
            u = common.mix(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = np.unique(u[: n + n // 2]), np.unique(u[n // 2 :])
            same.append((near_dedup.signature(a, 128) == near_dedup.signature(b, 128)).mean())
        assert np.mean(same) == pytest.approx(0.5, abs=0.08)


# pipeline


def test_pipeline(spark, odd, none):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    out = P.run(spark, DATA).collect()
    assert len({r.doc_id for r in out}) == len(out) > 60
    sets = {r.doc_id: shingle_set(r.text) for r in out}
    assert all(k == v for k, v in components(sets).items())
    for name, stage in P.STAGES:
        assert stage(spark, none, DATA).count() == 0
        kept = stage(spark, odd, DATA)
        if name != "shard":
            assert kept.columns == odd.columns
        assert kept.count() > 0
