"""SimHash near-duplicates found through Golay-code fuzzy hash keys.

A 64-bit fingerprint splits into segments of 22, 21 and 21 bits. Fingerprints
at most 2 bits apart agree exactly in some segment (pigeonhole) and differ by
at most 2 bits in the next one, so they share a key made of the exact segment
and one of the next segment's Golay indices (6 at most). Keys join distinct
fingerprints only, and every candidate is verified.

Up to ``WIDE`` = 5 bits apart, two of seven segments of 10 and 9 bits agree exactly, and among the others two
taken together differ by at most 2 bits; a key is made of two exact segments and a Golay index of two more, for each of the
21 pairs (126 keys at most, each of 30 or 31 bits). The pipeline's stage uses this.

Within 2 bits, a bucket above ``bucket_limit`` is not paired: its fingerprints are linked
through their one-bit neighbours instead. Two fingerprints are within 2 bits
exactly if they share such a neighbour, and all that share one are a clique,
so a star per neighbour (65 rows a fingerprint) is exact and linear. For wider radii buckets give spanning forests of
their verified links instead of all pairs, so links grow with the rows and not with the square of a group: buckets up to the
limit are read many in a task, larger ones compared in pairs of blocks of ``BLOCK`` fingerprints spread over tasks.

Defined results: null text counts as empty; a text without words has
fingerprint zero and links like any other; repeated rows are rows of their own
with equal results; a null doc_id is a row whose component is the smallest
non-null doc_id reachable (null if there is none); other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import golay
from quern.llm.names import unused
from quern.plans.components import components
from quern.plans.scratch import materialize, release

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
WIDE, BLOCK = 5, 2048
PARTS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))


def families() -> list[tuple[int, int, int, int]]:
    """``(i, j, k, l)``: exact parts i, j with the decoded parts k, l, the two that follow the later gap of the ring.

    Any 5 errors over 7 parts leave some family with none in i, j and at most 2 in k, l.
    """
    out = []
    for i in range(7):
        for d in (1, 2, 3):
            rest = [(i + d + s) % 7 for s in range(1, 7) if (i + d + s) % 7 != i]
            out.append((i, (i + d) % 7, *rest[:2]))
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over ``width``-word shingles, repeats included."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), SEED)]
    elif width == 3:
        hashes = [digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long; long columns ``keep`` pass through."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp} | {c: batch[c] for c in keep})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    return rows.mapInPandas(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in keep)]))


def golay_keys(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(key, fp)``: for each fingerprint of ``fps(fp)`` 18 keys at most, or 126 for a radius above 2."""
    if radius <= 2:
        cut, plan = SEGMENTS, [((s,), ((s + 1) % 3,)) for s in range(3)]
    else:
        cut, plan = PARTS, [((i, j), (k, l)) for i, j, k, l in families()]

    def joined(part, at):
        out = part[at[0]]
        for x in at[1:]:
            out = out << cut[x][1] | part[x]
        return out

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 8192):
                fp = batch["fp"].to_numpy(dtype=np.int64)[lo : lo + 8192].view(np.uint64)
                part = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in cut]
                for family, (exact, decoded) in enumerate(plan):
                    near = np.sort(golay.index_sets(joined(part, decoded)), axis=1).astype(np.int64)
                    fresh = np.concatenate([np.ones((len(fp), 1), dtype=bool), near[:, 1:] != near[:, :-1]], axis=1)
                    row, col = np.nonzero(fresh)
                    key = np.int64(family << 34) | (joined(part, exact)[row] << 12) | near[row, col]
                    yield pd.DataFrame({"key": key, "fp": fp.view(np.int64)[row]})

    return fps.select("fp").mapInPandas(run, "key long, fp long")


def forest(fp: np.ndarray, other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``fp`` and ``other`` (also within, if they are the same array)."""
    up: dict[int, int] = {}

    def find(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for lo in range(0, len(fp), 256):
        part = fp[lo : lo + 256]
        row, col = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ other.view(np.uint64)[None, :]) <= radius)
        for x, y in zip(part[row].tolist(), other[col].tolist()):
            if x != y and (a := find(x)) != (b := find(y)):
                up[a] = b
                out.append((x, y))
    return out


def spanning(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the buckets of rows sorted by ``key``."""
    names, at = np.unique(fp, return_inverse=True)
    root, us, vs = np.arange(len(names)), [], []
    here, gap = np.arange(len(key)), 1
    while len(here):
        here = here[here + gap < len(key)]
        here = here[key[here] == key[here + gap]]
        near = here[np.bitwise_count((fp[here] ^ fp[here + gap]).view(np.uint64)) <= radius]
        a, b = at[near], at[near + gap]
        fresh = root[a] != root[b]
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist()):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                us.append(x)
                vs.append(y)
        while (root[root] != root).any():
            root = root[root]
        gap += 1
    return names[us], names[vs]


def _forests(small: DataFrame, radius: int) -> DataFrame:
    """Links ``(u, v)`` that span each bucket of ``small(key, fp)``; a bucket that a batch cuts waits for its rest."""

    def run(batches):
        key, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate([key, batch["key"].to_numpy(dtype=np.int64)])
            fp = np.concatenate([fp, batch["fp"].to_numpy(dtype=np.int64)])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            u, v = spanning(key[:whole], fp[:whole], radius)
            key, fp = key[whole:], fp[whole:]
            yield pd.DataFrame({"u": u, "v": v})
        u, v = spanning(key, fp, radius)
        yield pd.DataFrame({"u": u, "v": v})

    return small.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(run, "u long, v long")


def _blocks(wide: DataFrame, radius: int) -> DataFrame:
    """Links ``(u, v)`` that span each bucket of ``wide(key, fp, n)``: pairs of blocks are tasks' work."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = wide.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = mine.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "fp")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        one, two = (frame["fp"][frame["block"] == at].to_numpy(dtype=np.int64) for at in (lo, hi))
        return pd.DataFrame(forest(one, two, radius), columns=["u", "v"], dtype=np.int64)

    return dealt.groupBy("key", "lo", "hi").applyInPandas(run, "u long, v long")


def links(fps: DataFrame, bucket_limit: int = 64, radius: int = 2) -> DataFrame:
    """Links ``(u, v)`` of distinct fingerprints at most ``radius`` bits apart; their closure is that of all links.

    Up to 2 bits small buckets give every verified pair, large ones a star for each shared one-bit neighbour; beyond, all give spanning forests.
    """
    if radius > WIDE:
        raise ValueError(f"no keys for more than {WIDE} bits")
    keys = materialize(golay_keys(fps, radius), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keys.join(sizes, "key"), "golay-shared")
    release(keys)
    small, wide = shared.where(F.col("n") <= bucket_limit), shared.where(F.col("n") > bucket_limit)
    if radius > 2:
        return _forests(small, radius).unionAll(_blocks(wide, radius))
    pairs = (
        small.select("key", F.col("fp").alias("u"))
        .join(small.select("key", F.col("fp").alias("v")), "key")
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
        .select("u", "v")
    )
    wide = wide.select("fp").distinct()
    flipped = wide.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select(
        "fp", F.expr("CASE WHEN i = 64 THEN fp ELSE fp ^ shiftleft(1L, i) END").alias("near")
    )
    heads = flipped.groupBy("near").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = flipped.join(heads.select("near", "u"), "near").where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.unionAll(stars)


def _classes(fps: DataFrame, first, bucket_limit: int, radius: int = 2) -> DataFrame:
    """``(fp, first, keep)`` of each fingerprint of ``fps``: its smallest ``first``, and that of its component."""
    classes = materialize(fps.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(links(classes, bucket_limit, radius))
    joined = classes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("keep"))
    return materialize(joined.join(lowest, "root").select("fp", "first", "keep"), "members")


def near_duplicates(docs: DataFrame, width: int = 3, bucket_limit: int = 64) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs(doc_id, text)``."""
    marked = materialize(fingerprints(docs, width), "fingerprints")
    member = _classes(marked, F.col("doc_id"), bucket_limit).select("fp", F.col("keep").alias("component_id"))
    return marked.join(member, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, width: int = 3, bucket_limit: int = 256, radius: int = WIDE) -> DataFrame:
    """One row of ``docs`` for each component of fingerprints at most ``radius`` bits apart, columns as they are, whatever their names.

    The row kept is the first by (null doc_id last, doc_id, fingerprint, hash of the text); rows equal in all of these are one,
    and the one with the smallest hash of its other columns stays. Two texts of one doc_id are two documents.
    """
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "tie")
    marked = materialize(fingerprints(narrow.withColumn("tie", tie), width, keep=("tie",)), "fingerprints")
    member = _classes(marked, order, bucket_limit, radius)
    kept = member.select("keep").distinct().select(F.struct(F.col("keep.none"), F.col("keep.doc_id"), F.col("keep.tie")).alias("keep")).distinct()
    kept = materialize(kept, "kept")
    (name,) = unused(docs, "keep")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    named = docs.withColumn(name, mine)
    on = kept.select(F.col("keep.none").alias("n"), F.col("keep.doc_id").alias("d"), F.col("keep.tie").alias("t"))
    x = F.col(name)
    named = named.join(on, (x["none"] == F.col("n")) & x["doc_id"].eqNullSafe(F.col("d")) & (x["tie"] == F.col("t")), "left_semi")
    # rows of one id and text meet only if there are any
    if not marked.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count():
        return named.select(*[F.col(f"`{c}`") for c in docs.columns])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = named.groupBy(name).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_simhash_golay(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
