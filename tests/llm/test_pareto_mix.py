import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
from docs import ROWS, empty, frame
from pyspark.sql import functions as F

from quern.llm import pareto_mix as m


def level(sizes, weights, cap=3):
    """Targets by sharing again until none is above its cap."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if share[s] > cap * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows):
    """Copies by (doc_id, text) of rows with doc_id, source and text: each source in one sorted list."""
    by = defaultdict(list)
    for r in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n = len(found)
        octave = n.bit_length() - 1
        stratum = 1 + 4 * octave + (4 * n >> octave) - 4 if n else 0
        text = "null" if r.text is None else hashlib.md5(r.text.encode()).hexdigest()
        tie = hashlib.md5(f"mix:{'null' if r.doc_id is None else r.doc_id}:{text}".encode()).hexdigest()
        by[r.source].append((n, 4 + (12 * len(set(found)) // n if n else 0), stratum, tie, (r.doc_id, r.text)))
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = {s: sum(d[0] for d in docs) for s, docs in by.items()}
    target = level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    copies = Counter()
    for s, docs in by.items():
        if not sizes[s]:
            continue
        mass, left, capped = sum(d[0] * d[1] for d in docs), target[s], set()
        for measure in sorted({d[1] for d in docs}, reverse=True):
            if left * measure < 3 * mass:
                break
            capped.add(measure)
            mass -= measure * sum(d[0] for d in docs if d[1] == measure)
            left -= 3 * sum(d[0] for d in docs if d[1] == measure)
        expected = {d[1]: 3.0 if d[1] in capped or not mass else left / mass * d[1] for d in docs}
        need = 0.0
        for stratum in sorted({d[2] for d in docs}, reverse=True):
            here = [d for d in docs if d[2] == stratum]
            for d in here:
                copies[d[4]] += int(expected[d[1]])
            free = [d for d in here if expected[d[1]] < 3]
            f = {d[1]: expected[d[1]] % 1 for d in free}
            fractions, total = sum(f[d[1]] for d in free), sum(d[0] for d in free)
            need += sum(f[d[1]] * d[0] for d in free)
            n = math.floor((need * len(free) / total if total else fractions) + 0.5 + 1e-9)
            n = min(len(free), max(0, n))
            need -= n * total / max(1, len(free))

            def rank(d):
                u = (int(d[3][:12], 16) + 0.5) / 2**48
                p = f[d[1]] * n / (fractions or 1) if n <= fractions else 1 - (1 - f[d[1]]) * (len(free) - n) / (len(free) - fractions)
                return u * (1 - p) / (u * (1 - p) + (1 - u) * p), d[3]

            for d in sorted(free, key=rank)[:n]:
                copies[d[4]] += 1
    return copies


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 0, "b": 50, "c": 1}, {"é": 1, "z": 10_000, "A": 3}):
        order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        want = level(sizes, weights)
        got = m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert all(abs(r.target - want[r.source]) < 1e-6 for r in got) and len(got) == len(sizes)
        assert abs(sum(r.target for r in got) - sum(sizes.values())) < 1e-6


def test_taken_words_come_near_targets(spark, sf_dir):
    rows = m.op9_pareto_mix(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    by = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"), F.sum("size").alias("s"), F.max("source_size").alias("z"))
    for r in by.collect():
        assert abs(r.t - r.g) <= max(0.5 * r.m, 0.05 * r.g) and r.s == r.z
    assert rows.where("taken > 3 * size").count() == 0
    assert sorted(rows.collect()) == sorted(m.op9_pareto_mix(spark, sf_dir).collect())


def test_rows(spark):
    got = m.plan(frame(spark), buckets=4).collect()
    assert len(got) == len(ROWS)
    assert all(r.size == 0 for r in got if r.doc_id in (2, 3, 7))
    out = m.mixed(frame(spark), buckets=4)
    assert out.columns == frame(spark).columns
    want = plain_mix(frame(spark).collect())
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want
    assert sum(r.copies for r in got) == want.total()
    assert m.plan(empty(spark)).count() == 0 and m.mixed(empty(spark)).count() == 0


def test_equals_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_mix(docs.collect())
    for options in ({}, {"buckets": 1, "bucket_rows": 1}, {"buckets": 2, "bucket_rows": 3}):
        assert Counter((r.doc_id, r.text) for r in m.mixed(docs, **options).select("doc_id", "text").collect()) == +want


def test_inclusion_frequencies_equal_inclusion_probabilities(spark):
    """600 sources with the same 40 documents: 200 draws of each of three designs.

    Two strata; half of each stratum's documents repeat one word, the others vary. Drawn in the order of u alone,
    the same numbers give frequencies that are far from the probabilities.
    """
    texts = ["a " * 12 if i % 2 else " ".join(f"w{j}" for j in range(12)) for i in range(20)]
    texts += ["b " * 100 if i % 2 else " ".join(f"w{j}" for j in range(100)) for i in range(20)]
    rows = [(s * 100 + i, f"{s:04d}", t) for s in range(600) for i, t in enumerate(texts)]
    plan = m.plan(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    plan["drawn"] = plan.copies - plan.certain
    keys = ["source", "stratum"]
    assert (plan.groupby(keys).drawn.sum() == plan.groupby(keys).draws.first()).all()
    assert np.allclose(plan.groupby(keys).p.sum(), plan.groupby(keys).draws.first())
    plan["by_u"] = plan.groupby(keys).u.rank() <= plan.draws
    plan["by_rank"] = plan.groupby(keys)["rank"].rank() <= plan.draws
    assert (plan.by_rank == plan.drawn.astype(bool)).all()
    plan["design"] = plan.source.astype(int) % 3
    assert plan.groupby("design").target.nunique().max() == 1
    far = 0.0
    for (_, _, _), g in plan.groupby(["design", "stratum", "measure"]):
        p = g.p.iloc[0]
        error = math.sqrt(p * (1 - p) / len(g)) + 1e-9
        # 4.5 standard errors, and the small difference of Pareto sampling from its stated probabilities
        assert abs(g.drawn.mean() - p) <= 4.5 * error + 0.005, (p, g.drawn.mean())
        far = max(far, abs(g.by_u.mean() - p) / (4.5 * error + 0.005))
    assert far > 3


def test_repeated_rows_at_the_cut_are_drawn_in_number(spark):
    rows = [(None, "a", "same words here")] * 90 + [(1, "b", "other words here"), (2, "c", "more words here")]
    got = m.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source").count().collect()
    want = level({"a": 270, "b": 3, "c": 3}, {"a": 5, "b": 2, "c": 1})
    assert all(abs(r["count"] * 3 - want[r.source]) <= 2 for r in got)


def test_names_inside_never_clash(spark):
    docs = frame(spark)
    for name in ("mix", "copy", "goal", "number", "_n", "_copy", "x", "MIX", "rank"):
        docs = docs.withColumn(name, F.lit(name)) if name.lower() not in [c.lower() for c in docs.columns] else docs
    out = m.mixed(docs)
    assert out.columns == docs.columns and out.count() == m.mixed(frame(spark)).count()
    assert out.select("_copy", "_n", "goal").distinct().collect() == [("_copy", "_n", "goal")]
