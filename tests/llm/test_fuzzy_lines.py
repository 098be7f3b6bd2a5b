import random

import numpy as np
from docs import ROWS, empty, frame
from pyspark.sql import functions as F

from quern.llm import fuzzy_lines as f


def shingles(x, w=9):
    return {x[i : i + w] for i in range(max(1, len(x) - w + 1))}


def brute(rows, threshold=0.8):
    """Places kept, by exact similarity of all pairs."""
    place = {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip():
                place.setdefault(line, (doc, at))
    lines = sorted(place, key=place.get)
    sets = [shingles(x) for x in lines]
    root = list(range(len(lines)))
    holders = {}
    for i, shingle_set in enumerate(sets):
        for s in shingle_set:
            holders.setdefault(s, []).append(i)

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(lines)):
        shared = {}
        for s in sets[i]:
            for j in holders[s]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {lines[i]: place[lines[find(i)]] for i in range(len(lines))}


def expected(rows):
    keep = brute(rows)
    return {
        (doc, None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if not x.strip() or keep[x] == (doc, at)))
        for doc, text in rows
    }


def variant(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = rnd.choice("qwertyuiop") * 4
    return " ".join(out)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    make = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    bases = [make(rnd.randint(1, 40)) for _ in range(60)]
    hot = make(40)
    rows = []
    for doc in range(120):
        text = [variant(rnd, b, rnd.randint(0, 1)) for b in rnd.sample(bases, 3)] + [variant(rnd, hot, 1)] + ["", "short"]
        rnd.shuffle(text)
        rows.append((doc, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    for limit in (4, 1000):
        got = {tuple(r) for r in f.dedupe_lines(df, bucket_limit=limit).collect()}
        assert len(got & want) >= 0.97 * len(want), (limit, len(got & want))


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    got = f.op4_fuzzy_lines(spark, sf_dir).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.text) for r in got} & want) >= 0.98 * len(rows)
    lines = {i: len(t.split("\n")) for i, t in rows}
    assert all(r.lines_removed >= lines[r.doc_id] - len((r.text or "").split("\n")) for r in got)


def test_rows(spark):
    out = f.dedupe_lines(frame(spark))
    assert out.columns == frame(spark).columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == len(ROWS)
    assert (5, "") in got and (1, ROWS[0][1]) in got and (3, None) in got and (2, "") in got and (6, "one two") in got and (7, "   \n\t ") in got
    assert f.dedupe_lines(empty(spark)).count() == 0


def test_signatures_estimate_similarity():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    lines = [variant(rnd, words, n) for n in (0, 2, 4, 8) for _ in range(20)]
    hasher = f.MinHasher(bands=128, rows=1)
    sig = hasher.signatures(lines, chunk=1000)
    for i in range(0, 80, 7):
        for j in range(i):
            assert abs((sig[i] == sig[j]).mean() - f.jaccard(f.shingle_set(lines[i], 9), f.shingle_set(lines[j], 9))) < 0.2


def test_large_family_with_a_head_unlike_its_groups(spark):
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    common = word(140)
    groups = []
    for _ in range(1500):
        tail = word(48)
        at = rnd.randrange(len(tail) - 4)
        groups.append((common + tail, common + tail[:at] + "WXYZ" + tail[at + 4 :]))
    lines = [x for pair in groups for x in pair]
    sigs = f.MinHasher().signatures(lines)
    linked = [bool((sigs[2 * i] == sigs[2 * i + 1]).any()) and f.jaccard(shingles(a), shingles(b)) >= 0.8 for i, (a, b) in enumerate(groups)]
    assert sum(linked) > 1000 and max(f.jaccard(shingles(lines[0]), shingles(x)) for x in lines[2:200]) < 0.8
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in f.removals(df).collect()}
    assert gone == {2 * i + 1 for i, both in enumerate(linked) if both}


def test_columns_with_the_names_inside(spark):
    docs = frame(spark)
    for name in ("_gone", "_t", "_d", "gone", "doc", "tie", "place", "line"):
        docs = docs.withColumn(name, F.lit(name))
    out = f.dedupe_lines(docs)
    assert out.columns == docs.columns and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, f.dedupe_lines(frame(spark)).select("doc_id", "text").collect()))
    assert out.select("_gone", "gone", "tie").distinct().collect() == [("_gone", "gone", "tie")]


def test_reach_against_exact_similarity(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
    lines = [variant(rnd, words, n) for n in (0, 1, 2, 3) for _ in range(8)] + ["abc", "abcdefgh", "abcdefghi", "ab" * 40, "ab" * 60, "ä漢🙂" * 9]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    seen = set()
    for lo in range(0, len(pairs), f.CHUNK):
        left, right = np.array(pairs[lo : lo + f.CHUNK]).T
        want = [f.jaccard(shingles(lines[i]), shingles(lines[j])) >= 0.8 for i, j in zip(left, right)]
        assert f.reach(lines, left, right, 9, 0.8).tolist() == want
        seen |= set(want)
    assert seen == {True, False} and f.forest([(3, 1), (1, 2), (2, 3), (5, 4), (2, 1)]) == [(3, 1), (1, 2), (5, 4)]
    sigs = f.MinHasher().signatures(lines)
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "at int, sig binary")
    for r in df.select("at", F.array(*[f._band(i) for i in range(8)]).alias("bands")).collect():
        assert [f.band_index(band, sigs[r.at]) for band in r.bands] == list(range(8))


def test_stages_pass_numbers_not_keys(spark, monkeypatch):
    from quern.plans import components

    kinds = {}
    for module in (f, components):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, write=write: kinds.setdefault(name, dict(df.dtypes)) and write(df, name))
    words = [f"word{i}" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join([*words, f"tail{i}"])) for i in range(40)], "doc_id long, text string")
    assert f.removals(df, bucket_limit=8).count() == 39
    for name, columns in (("line-buckets", ("band", "id")), ("line-pairs", ("u", "v")), ("edges", ("u", "v"))):
        assert all(kinds[name][c] == "bigint" for c in columns), name
