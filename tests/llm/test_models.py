"""The trained operators: held-out accuracy, and rows of every kind."""

import itertools
import math
import zlib

import numpy as np
import pandas as pd
from docs import ROWS, empty, frame
from pyspark.sql import functions as F

from quern.llm import cotrain_quality as q
from quern.llm import toxic_crf as t

BIG = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    rnd = np.random.default_rng(2)
    score, change = rnd.normal(0, 2, 9), rnd.normal(0, 1, (2, 2))
    lengths = np.array([4, 3, 2])
    marginal, pairs, total = t.forward_backward(score, lengths, change)
    want, both, logs, at = np.zeros(9), np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([math.exp(sum(score[at + i] for i in range(n) if p[i]) + sum(change[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        logs += math.log(weight.sum())
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for i in range(n):
                want[at + i] += w * p[i]
            for i in range(n - 1):
                both[p[i], p[i + 1]] += w
        at += n
    assert np.allclose(marginal, want) and np.allclose(pairs, both) and abs(total - logs) < 1e-9


def accuracy(rows, labels, pick):
    known = rows.merge(labels, on="doc_id")
    return pick(known)


def test_toxicity_on_held_out_documents(spark):
    rows = t.op3_toxic_crf(spark, BIG).toPandas()
    labels = pd.read_parquet(f"{BIG}/labels.parquet")
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(rows["doc_id"], rows["held_out"]))
    known = rows[rows["held_out"]].merge(labels, on="doc_id")
    yes = known["toxic"] == 1
    assert (known[yes]["predicted"] == 1).mean() >= 0.8 and (known[~yes]["predicted"] == 0).mean() >= 0.95


def test_toxic_spans():
    clean = [f"this is a fine day number {i} for walking" for i in range(60)]
    bad = [f"you are such a moron number {i} and\nworthless too" for i in range(60)]
    field = t.train(clean + bad, [0] * 60 + [1] * 60)
    text = "nice day\nwhat a moron here\nyou are worthless too"
    marginal, spans = field.marginals([text, ""])
    hits = " ".join(text[a:b] for a, b in zip(spans[0][::2], spans[0][1::2])).split()
    assert len(spans[1]) == 0 and len(hits) == (marginal[0] >= 0.5).sum()
    assert {"moron", "worthless"} <= set(hits) and not {"nice", "day", "here"} & set(hits) and field.document_scores(marginal)[0] > 0.7 > field.document_scores(marginal)[1]
    assert t.train(["a"], [0]).document_scores([np.zeros(1)])[0] == 0.0 and t.train([], []).constant == 0.0


def test_features_are_hashes_of_their_names():
    for word in ("a", "ab", "abc", "Réêouxelle", "ACHLICHPF", "漢字漢字", "", "x" * 40):
        assert t.feature_ids(word) == [zlib.crc32(f.encode()) % t.DIM for f in t.feature_names(word)]


def test_toxicity_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 0), (5, 1), (5, 0), (6, 1), (8, None), (None, 1)], "doc_id long, toxic int")
    field = t.fit(frame(spark), labels)
    got = t.score(frame(spark), field, chars=50).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert t.score(empty(spark), field).count() == 0
    assert t.fit(empty(spark), labels).constant == 0.0


def test_quality_on_documents_that_were_not_used(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    model = q.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = q.score(docs, model).toPandas().merge(pd.read_parquet(f"{BIG}/labels.parquet"), on="doc_id")
    rest = rows[rows["doc_id"] % 2 == 1]
    good = rest["quality"] == 1
    assert (rest[good]["score"] >= 0.5).mean() >= 0.97 and (rest[~good]["score"] < 0.5).mean() >= 0.8
    assert model.record.weights is not None and model.mix[0] > 0


def test_quality_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = q.fit(frame(spark), labels)
    got = q.score(frame(spark), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    kept = q.keep_good(frame(spark), model)
    assert kept.columns == frame(spark).columns and kept.count() == sum(r.score >= 0.5 for r in got)
    assert q.score(empty(spark), model).count() == 0
    assert q.fit(empty(spark), labels).constant == 1.0
    assert q.fit(frame(spark), labels.where("quality = 1")).constant == 1.0


def test_excerpts_come_from_all_over():
    text = "\n".join(f"line {i} with words" for i in range(10_000))
    some = t.excerpt(text, 5_000)
    lines = some.split("\n")[:-1]
    assert 4_000 < len(some) <= 5_000 + len(lines) and set(lines) <= set(text.split("\n")) and int(lines[-1].split()[1]) > 8_000
    assert t.excerpt("x" * 100_000, 5_000).count("x") == 4_000 and t.excerpt(None, 5) == "" and t.excerpt("abc", 5) == "abc"


def test_repeated_ids_are_one_training_row(spark):
    rows = [(1, f"text {i} of one id") for i in range(10_000)] + [(2, "you moron"), (3, "a fine day")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)] * 50, "doc_id long, toxic int")
    sample = t.training_rows(docs, labels, "toxic", F.lit(True), 10, 10, 1000)
    assert sample.count() == 3 and sorted(sample.collect()) == sorted(t.training_rows(docs.repartition(7), labels, "toxic", F.lit(True), 10, 10, 1000).collect())


def test_thresholds_of_the_surest_come_from_all_rows(spark):
    """One feature by view; the surest tenth of 3,000 rows is found, whatever bound its sample has."""
    rnd = np.random.default_rng(5)
    rows = [(i, i, [float(x)] * q.CONTENT, [float(x)] * 3, [0, 0]) for i, x in enumerate(rnd.normal(size=3000))]
    pool = spark.createDataFrame(rows, q.FEATURES)
    edges = [list(np.linspace(-2, 2, 30))]
    views = q.Binned(edges * q.CONTENT), q.Binned(edges * 3)
    for view in views:
        view.weights = np.zeros(int(view.start[-1]) + q.HASHED + 1)
        view.weights[: 31] = np.linspace(-6, 6, 31)
    every, few = q._surest(pool, 10**6)(views, 0.1, 0.5), q._surest(pool, 20)(views, 0.1, 0.5)
    logit = np.sort(views[0].logit(views[0].design(np.array([r[2] for r in rows]), np.zeros((3000, 0), dtype=np.int64))))
    for held, some in zip(every, few):
        low, high = held[held["flag"] == 0], held[held["flag"] == 1]
        assert len(low) == (logit <= logit[149]).sum() and len(high) == (logit >= logit[-150]).sum()
        assert len(some) == 20 and set(some["doc_id"]) <= set(held["doc_id"])


def test_repeated_unlabelled_ids(spark):
    rows = [(1, "said again", "en", "a")] * 3000 + [(i, "a fine text here, with words.", "en", "a") for i in range(2, 40)] + [(i, "$$$ $$$ !!! JUNK", "en", "b") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(2, 70)] * 2, "doc_id long, quality int")
    model = q.fit(docs, labels, max_pseudo=100)
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    assert all(got[i] >= 0.5 for i in range(2, 40)) and all(got[i] < 0.5 for i in range(40, 80))
