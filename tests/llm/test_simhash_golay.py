import random
import re

import pytest
import xxhash
from docs import ROWS, empty, frame
from pyspark.sql import functions as F

from quern.llm import golay
from quern.llm import simhash_golay as g


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    import numpy as np

    near = golay.table()
    assert np.bincount(near, minlength=4096).tolist() == [2048] * 4096
    rnd = random.Random(1)
    for _ in range(300):
        a = rnd.getrandbits(23)
        flipped = a
        for p in rnd.sample(range(23), 2):
            flipped ^= 1 << p
        x, y = (set(golay.index_sets(np.array([v]))[0].tolist()) for v in (a, flipped))
        assert x & y and len(x) in (1, 6)


def test_every_pattern_of_five_errors_has_a_family():
    from itertools import combinations_with_replacement

    for size in range(6):
        for at in combinations_with_replacement(range(7), size):
            e = [at.count(i) for i in range(7)]
            assert any(e[i] == e[j] == 0 and e[k] + e[x] <= 2 for i, j, k, x in g.families())


def test_spanning_links_grow_with_the_rows_of_a_bucket():
    import numpy as np

    fp = np.array([sum(1 << p for p in range(64) if n >> p % 8 & 1 and p < 8) for n in range(256)], dtype=np.int64)
    key = np.repeat(np.arange(4), 64)
    u, v = g.spanning(key, fp, 5)
    assert len(u) == len(v) == 4 * 63
    assert all(int(a ^ b).bit_count() <= 5 for a, b in zip(u, v))
    assert len(g.spanning(key[:0], fp[:0], 5)[0]) == 0


@pytest.mark.parametrize("radius", [2, 5])
def test_links_find_all_components(spark, radius, monkeypatch):
    monkeypatch.setattr(g, "BLOCK", 100)
    rnd = random.Random(2)
    fps = {0}
    for _ in range(150):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            for p in rnd.sample(range(64), rnd.randint(0, radius + 1)):
                base ^= 1 << p
            fps.add(base)
    base = rnd.getrandbits(64)  # a large group, near each other
    for _ in range(400):
        fps.add(base ^ sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = components(fps, radius)
    for limit in (4, 10_000):
        df = spark.createDataFrame([(s,) for s in signed], "fp long")
        got = {r.id: r.root for r in g.components(g.links(df, limit, radius)).collect()}
        groups = {}
        for s, w in zip(signed, want):
            groups.setdefault(w, set()).add(got.get(s, s))
        assert all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)


def test_rows(spark):
    got = g.near_duplicates(frame(spark)).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in ROWS]
    group = components(fps)
    want = []
    for (doc, *_), f, c in zip(ROWS, fps, group):
        ids = [d for (d, *_), k in zip(ROWS, group) if k == c and d is not None]
        want.append((str(doc), f"{f:016x}", min(ids, default=None)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(want, key=lambda x: x[:2]) or sorted(
        map(str, ((str(r.doc_id), r.fingerprint, r.component_id) for r in got))
    ) == sorted(map(str, want))
    kept = g.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "8", "None"]
    assert len(kept.collect()) == 6
    assert g.near_duplicates(empty(spark)).count() == 0 and g.one_of_each(empty(spark)).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    group = components(fps)
    want = {(i, f"{f:016x}", min(j for j, k in zip(ids, group) if k == c)) for i, f, c in zip(ids, fps, group)}
    assert {tuple(r) for r in g.op7_simhash_golay(spark, sf_dir).collect()} == want


def test_one_of_each_keeps_every_distinct_text(spark):
    long = " ".join(f"u{i}" for i in range(40))
    rows = [(1, "a b c d e f g", "x"), (1, "quite other words stand here now", "y"), (2, "a b c d e f g", "z"), (None, long, "p"), (None, long, "q"), (3, long, "r")]
    rows += [(7, "said again and again by one id", "s")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string").withColumn("fp", F.lit(1)).withColumn("row", F.lit(2))
    kept = g.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, rows[0][1]), (1, rows[1][1]), (3, long), (7, rows[-1][1])])
