"""Line deduplication: fuzzy-equal lines by MinHash, one line kept of each component.

A line's set is its character shingles of ``width`` (a shorter line is one
shingle). ``bands * rows`` minima of multiplied hashes are its signature. Lines
that agree on a whole band are candidates; the Jaccard similarity of candidates
is computed exactly from their texts; links of ``threshold`` or more form
components by distributed union-find, and the first line (by doc_id, then
place) of each component stays. At similarity 0.8 a pair is missed with
probability (1 - 0.8^4)^8 = 1.5 %, at 0.9 with 0.02 %.

Equal lines are one line from the start (128-bit hash), so copies never pair up.
A band bucket of more than ``bucket_limit`` different lines is first checked against its smallest
line only. What this leaves apart is then compared completely: the lines outside the bucket's largest
component, with each other and with that component, in pairs of blocks spread over tasks (``BLOCK``
lines or ``BLOCK_CHARS`` characters each). So a pair that shares a band is compared, or already in one
component, whatever the bucket's size; the work is quadratic only in the lines outside that component.

Texts move twice: the lines that are candidates (found with a bitmap of fixed
size, 8 MB, that only lets some others through when it fills), and the documents when
the result is put together.

Defined results: a null text stays null and an empty one empty; blank lines always stay;
repeated rows (equal doc_id and text) are treated as one and stay equal; a null doc_id ranks last;
all columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.names import unused
from quern.plans.components import components
from quern.plans.scratch import materialize

SPLIT = "\n"
_END = 0x110000  # fills lines shorter than a shingle; no character


def windows(lines: list[str], w: int) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of the ``w``-character shingles of all lines in a row, and where each line starts."""
    size = np.array([max(len(x), w) for x in lines], dtype=np.int64)
    if any(len(x) < w for x in lines):
        blocks = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in lines]
        blocks = [b if len(b) >= w else np.concatenate([b, np.full(w - len(b), _END, dtype="<u4")]) for b in blocks]
        code = np.concatenate(blocks).astype(np.uint64)
    else:
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = code * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    out, base = h[: len(h) - w + 1].copy(), np.uint64(0xD6E8FEB86659FD93)
    for at in range(1, w):
        out *= base
        out += h[at : len(h) - w + 1 + at]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    stay = np.ones(len(out), dtype=bool)
    ends = np.cumsum(size)[:-1]
    for at in range(1, w):  # windows that reach into the next line
        stay[ends - at] = False
    return out[stay], np.concatenate([[0], np.cumsum(size - w + 1)[:-1]])


class MinHasher:
    """Signatures of many lines at once."""

    def __init__(self, width: int = 9, bands: int = 8, rows: int = 4, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.width, self.bands, self.rows = width, bands, rows
        self.mul = draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mix = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """uint32 shingle hashes of all lines in a row, and where each line starts."""
        hashes, starts = windows(lines, self.width)
        return (hashes >> np.uint64(32)).astype(np.uint32), starts

    def signatures(self, lines: list[str], chunk: int = 1 << 16) -> np.ndarray:
        """uint64[lines, bands]: a hash of each band's minima."""
        out = np.empty((len(lines), self.bands), dtype=np.uint64)
        lo = 0
        while lo < len(lines):
            hi, held = lo, 0
            while hi < len(lines) and (hi == lo or held + len(lines[hi]) <= chunk):
                held += len(lines[hi])
                hi += 1
            hashes, starts = self.shingles(lines[lo:hi])
            low = np.empty((self.bands * self.rows, hi - lo), dtype=np.uint32)
            for p in range(self.bands * self.rows):
                low[p] = np.minimum.reduceat(hashes * self.mul[p] + self.add[p], starts)
            low = low.reshape(self.bands, self.rows, hi - lo).astype(np.uint64)
            for b in range(self.bands):
                x = np.full(hi - lo, b + 1, dtype=np.uint64)
                for r in range(self.rows):
                    x = (x ^ low[b, r]) * self.mix[r]
                    x ^= x >> np.uint64(31)
                out[lo:hi, b] = x
            lo = hi
        return out


def shingle_set(line: str, width: int) -> frozenset[str]:
    return frozenset(line[i : i + width] for i in range(max(1, len(line) - width + 1)))


def jaccard(x: frozenset[str], y: frozenset[str]) -> float:
    """Exact similarity of two shingle sets."""
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """One line's window hashes, sorted, each once."""
    out = np.sort(hashes)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


#: Pairs and characters compared at once; twice the pairs are numbers of ``64 - LOW`` bits.
CHUNK, CHUNK_CHARS, LOW = 128, 1_000_000, 54


def reach(texts: list[str], left: np.ndarray, right: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Which pairs of ``texts`` (``CHUNK`` at most) reach ``threshold``: by their distinct window hashes, and by the shingles themselves where a few decide."""
    low, numbers = np.uint64(LOW), np.arange(len(texts), dtype=np.uint64)
    hashes, starts = windows(texts, width)
    # numbers of lines, then of pairs, stand above the hashes, so one sort serves all
    code = distinct(np.repeat(numbers, np.diff(starts, append=len(hashes))) << low | hashes >> np.uint64(64 - LOW))
    size = np.bincount((code >> low).astype(np.int64), minlength=len(texts))
    first = np.cumsum(size) - size
    code &= np.uint64((1 << LOW) - 1)

    def sets(which):
        n = size[which]
        at = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(which), dtype=np.uint64), n) << low | code[at]

    merged = np.sort(np.concatenate([sets(left), sets(right)]), kind="stable")  # two sorted runs to merge
    both = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> low).astype(np.int64), minlength=len(left))
    x, y = size[left], size[right]
    gap = both - threshold * (x + y - both)
    out = gap > 4
    held: dict[int, frozenset[str]] = {}
    # hashes that fall together move the counts by one each
    for at in np.nonzero((np.abs(gap) <= 4) & (np.minimum(x, y) + 2 >= threshold * np.maximum(x, y)))[0].tolist():
        for line in (left[at], right[at]):
            if line not in held:
                held[line] = shingle_set(texts[line], width)
        out[at] = jaccard(held[left[at]], held[right[at]]) >= threshold
    return out


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join what those before them leave apart."""
    up: dict[int, int] = {}
    out = []

    def find(i):
        while up.setdefault(i, i) != i:
            up[i] = i = up[up[i]]
        return i

    for u, v in links:
        i, j = find(u), find(v)
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((u, v))
    return out


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _occurrences(docs: DataFrame, hasher: MinHasher) -> DataFrame:
    """``(doc_id, tie, line, key, sig)``: every line that isn't blank; ``sig`` with its first in a batch."""

    def run(batches):
        for batch in batches:
            ids, ties, places, keys, fresh, new = [], [], [], [], [], []
            seen = set()
            for doc, tie, text in zip(batch["doc_id"].astype("Int64"), batch["tie"], batch["text"]):
                for at, line in enumerate((text or "").split(SPLIT)):
                    if not line or line.isspace():
                        continue
                    key = line_key(line)
                    ids.append(doc)
                    ties.append(tie)
                    places.append(at)
                    keys.append(key)
                    fresh.append(-1)
                    if key not in seen:
                        seen.add(key)
                        fresh[-1] = len(new)
                        new.append(line)
            if not ids:
                continue
            sigs = hasher.signatures(new)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(ids, dtype="Int64"),
                    "tie": np.array(ties, dtype=np.int64),
                    "line": np.array(places, dtype=np.int32),
                    "key": keys,
                    "sig": [sigs[f].tobytes() if f >= 0 else None for f in fresh],
                }
            )

    return docs.mapInPandas(run, "doc_id long, tie long, line int, key binary, sig binary")


def _buckets(rows: DataFrame, limit: int):
    """``(band, id)`` rows that share their band: small ones, and large ones with the bucket's smallest id."""
    # dealt once, for the sizes and for the rows; a hashed build side, so the many bands of one line are never sorted
    rows = rows.repartition("band")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).where("n > 1")
    shared = materialize(rows.join(sizes.hint("shuffle_hash"), "band"), "line-buckets")
    return shared.where(F.col("n") <= limit), shared.where(F.col("n") > limit)


def _pairs(small: DataFrame) -> DataFrame:
    left, right = small.select("band", F.col("id").alias("u")), small.select("band", F.col("id").alias("v"))
    return left.join(right, "band").where("u < v").select("u", "v")


def _stars(large: DataFrame) -> DataFrame:
    return large.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v"))


def _band(i: int):
    """Band ``i`` of a signature, as a number."""
    return F.xxhash64(F.lit(i), F.expr(f"substring(sig, {8 * i + 1}, 8)"))


def band_index(band: int, sig: np.ndarray) -> int:
    """Which band of a line's signature has this number, as :func:`_band` computes it."""
    for i, value in enumerate(sig):
        if _signed(xxhash.xxh64_intdigest(value.tobytes(), xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42))) == band:
            return i
    raise ValueError("a line in a bucket that isn't its own")


def _candidates(lines: DataFrame, bands: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs ``(u, v)`` of line ids, from ``lines(id, sig)``; and ``(band, id)`` of the large buckets."""
    every = lines.select("id", F.explode(F.array(*[_band(i) for i in range(bands)])).alias("band"))
    small, large = _buckets(every, limit)
    return _pairs(small).unionAll(_stars(large)).distinct(), large.select("band", "id")


BLOCK, BLOCK_CHARS = 512, 2_000_000


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None, step: int = 4096) -> np.ndarray:
    """How many hashes each set of ``a`` shares with each of ``b`` (of ``a`` itself without ``b``; its diagonal isn't filled)."""
    x, own = np.concatenate(a), np.repeat(np.arange(len(a)), [len(s) for s in a])
    if b is None:
        b, y, other = a, x, own
        found, times = np.unique(x, return_counts=True)
        shared = found[times > 1]
    else:
        y, other = np.concatenate(b), np.repeat(np.arange(len(b)), [len(s) for s in b])
        shared = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(shared):
        return out

    def places(tokens, rows):
        at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        hit = shared[at] == tokens
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    (at_x, row_x), (at_y, row_y) = places(x, own), places(y, other)
    for lo in range(0, len(shared), step):
        left, right = (np.zeros((len(sets), step), dtype=np.float32) for sets in (a, b))
        for dense, at, rows in ((left, at_x, row_x), (right, at_y, row_y)):
            i, j = np.searchsorted(at, [lo, lo + step])
            dense[rows[i:j], at[i:j] - lo] = 1
        out += left @ right.T
    return out


def block_links(one: pd.DataFrame, two: pd.DataFrame | None, index: int, width: int, threshold: float) -> list[tuple[int, int]]:
    """Links between the roots of two blocks (of one without ``two``) that join all their similar lines.

    A pair that agrees on a band before ``index`` meets in that band's bucket.
    """

    def sets(frame):
        hashes, starts = windows(list(frame["text"]), width)
        ends = [*starts[1:].tolist(), len(hashes)]
        return [distinct(hashes[i:j]) for i, j in zip(starts.tolist(), ends)], np.stack(list(frame["sig"]))

    (x, sig_x), (y, sig_y) = (first := sets(one)), first if two is None else sets(two)
    other = one if two is None else two
    labels, names = pd.factorize(pd.concat([one["root"], other["root"]]))
    lx, ly = labels[: len(one)], labels[len(one) :]
    both = overlaps(x, None if two is None else y)
    n = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None]
    gap = both - threshold * (n - both)
    wanted = (lx[:, None] != ly[None]) & (sig_x[:, index][:, None] == sig_y[:, index][None])
    for i in range(index):
        wanted &= sig_x[:, i][:, None] != sig_y[:, i][None]
    up, out = list(range(len(names))), []

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((names[i], names[j]))

    i, j = np.nonzero(wanted & (gap > 4))
    for code in np.unique(np.minimum(lx[i], ly[j]) * len(names) + np.maximum(lx[i], ly[j])).tolist():
        join(*divmod(code, len(names)))
    left, right = list(one["text"]), list(other["text"])
    held: dict[str, frozenset[str]] = {}
    for i, j in zip(*(p.tolist() for p in np.nonzero(wanted & (np.abs(gap) <= 4)))):  # hashes that fall together move the counts
        if find(lx[i]) != find(ly[j]):
            for line in (left[i], right[j]):
                if line not in held:
                    held[line] = shingle_set(line, width)
            if jaccard(held[left[i]], held[right[j]]) >= threshold:
                join(lx[i], ly[j])
    return out


def _large_links(large: DataFrame, texts: DataFrame, roots: DataFrame, hasher: MinHasher, threshold: float) -> DataFrame | None:
    """Links ``(u, v)`` between roots (a line without one is its own) that pairs of large buckets still add; None if none can."""
    named = materialize(large.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")), "line-large")
    parts = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    found = named.join(main, "band").join(texts, "id")
    rows = materialize(found.select("band", "id", "root", "text", (F.col("root") != F.col("main")).alias("rest")), "line-apart")
    if not rows.limit(1).count():
        return None

    def blocks(rest):
        n, chars = F.count(F.when(rest, 1)), F.sum(F.when(rest, F.length("text")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS)).cast("int")

    sizes = rows.groupBy("band").agg(blocks(F.col("rest")).alias("nr"), blocks(~F.col("rest")).alias("nm"))
    # blocks of the rest are numbered first; a block of the largest component meets only those
    block = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), F.col("nr"))).otherwise(F.col("nr") + F.pmod(F.xxhash64("id"), F.col("nm"))).cast("int")
    last = F.when(F.col("rest"), F.col("nr") + F.col("nm")).otherwise(F.col("nr")) - 1
    dealt = rows.join(sizes, "band").withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "root", "text")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].iloc[0], frame["hi"].iloc[0]
        frame = frame.assign(sig=list(hasher.signatures(list(frame["text"]))))
        one, two = frame[frame["block"] == lo], None if lo == hi else frame[frame["block"] == hi]
        index = band_index(int(frame["band"].iloc[0]), frame["sig"].iloc[0])
        links = [] if not len(one) or two is not None and not len(two) else block_links(one, two, index, hasher.width, threshold)
        return pd.DataFrame(links, columns=["u", "v"])

    return dealt.groupBy("band", "lo", "hi").applyInPandas(run, "u long, v long")


def _components(pairs: DataFrame, large: DataFrame, texts: DataFrame, hasher: MinHasher, threshold: float) -> DataFrame:
    """``(id, root)`` of the lines with a similar one."""
    roots = components(_verified(pairs, texts, hasher.width, threshold))
    more = _large_links(large, texts, roots, hasher, threshold)
    if more is None:
        return roots
    joined = components(more)
    moved = roots.join(joined.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    # roots of one line were in no component before
    return moved.unionAll(joined.join(roots.select("id"), "id", "left_anti").select("id", "root"))


BITMAP_BITS = 1 << 26


def _bit(key):
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(id, text)`` of the lines in ``keys(id, key)``, read from the documents again."""
    place = _bit("key") + 1  # the bitmap functions count from 1
    maps = (
        keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # BITMAP_BITS / 8 bytes at most, whatever the input
    )
    whole = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in maps:
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        at = (row["part"] - 1) * len(part)
        whole[at : at + len(part)] = part[: max(0, len(whole) - at)]
    sent = docs.sparkSession.sparkContext.broadcast(whole)

    def run(batches):
        bits = sent.value
        for batch in batches:
            keys, texts, seen = [], [], set()
            for text in batch["text"]:
                for line in (text or "").split(SPLIT):
                    if not line or line.isspace():
                        continue
                    key = line_key(line)
                    # xxhash64 of the bytes with Spark's seed, as _bit computes it
                    at = _signed(xxhash.xxh64_intdigest(key, 42)) % BITMAP_BITS
                    if bits[at >> 3] >> (at & 7) & 1 and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        texts.append(line)
            if keys:
                yield pd.DataFrame({"key": keys, "text": texts})

    found = docs.select("text").mapInPandas(run, "key binary, text string")
    return found.join(keys, "key").groupBy("id").agg(F.first("text").alias("text"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links ``(u, v)`` that join whatever the pairs of ``threshold`` or more join; a batch gives a spanning forest of its own."""
    a = texts.select(F.col("id").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("id").alias("v"), F.col("text").alias("b"))

    def run(batches):
        for batch in batches:
            ends = np.cumsum(batch["a"].str.len().to_numpy() + batch["b"].str.len().to_numpy())
            lo, links = 0, []
            while lo < len(batch):
                most = (ends[lo - 1] if lo else 0) + CHUNK_CHARS
                hi = max(lo + 1, min(lo + CHUNK, int(np.searchsorted(ends, most, "right"))))
                part = batch.iloc[lo:hi]
                held = dict(zip(part["u"], part["a"])) | dict(zip(part["v"], part["b"]))
                at = {line: i for i, line in enumerate(held)}
                left, right = (np.array([at[line] for line in part[c]], dtype=np.int64) for c in ("u", "v"))
                near = part[reach(list(held.values()), left, right, width, threshold)]
                links.extend(zip(near["u"].tolist(), near["v"].tolist()))
                lo = hi
            yield pd.DataFrame(forest(links), columns=["u", "v"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def removals(
    docs: DataFrame, width: int = 9, bands: int = 8, rows: int = 4, threshold: float = 0.8, bucket_limit: int = 32, seed: int = 7
) -> DataFrame:
    """``(doc_id, tie, gone array<int>)``: the places (from 0) of the lines to remove; ``tie`` is xxhash64(text)."""
    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "line").alias("place")
    hasher = MinHasher(width, bands, rows, seed)
    every = materialize(_occurrences(named, hasher), "lines")
    classes = every.groupBy("key").agg(F.min(place).alias("place"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    # numbers stand for the keys from here on: they sort, hash and aggregate faster
    lines = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")
    candidates, large = _candidates(lines, bands, bucket_limit)
    pairs = materialize(candidates, "line-pairs")
    ids = pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")).distinct()
    wanted = materialize(lines.select("id", "key").join(ids.hint("shuffle_hash"), "id", "left_semi"), "line-wanted")
    texts = materialize(_texts_of(named, wanted), "line-texts")
    roots = _components(pairs, large, texts, hasher, threshold)
    # equal lines without a similar one are a component of their own
    found = lines.select("id", "key", "n", "place").join(roots.hint("shuffle_hash"), "id", "left").where("root IS NOT NULL OR n > 1")
    member = materialize(found.select("key", "place", F.coalesce("root", "id").alias("root")), "line-members")
    first = member.groupBy("root").agg(F.min("place").alias("keep"))
    keep = materialize(member.join(first, "root").select("key", "keep"), "line-keep")
    gone = every.select("key", "doc_id", "tie", "line", place).join(keep.hint("shuffle_hash"), "key").where(~F.col("place").eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("gone"))


def dedupe_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the text of every document without its removed lines; columns as they are, whatever their names."""
    out, gone = _applied(docs, **options)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _applied(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` with shortened texts, and the name of the added column with the removed places."""
    doc, tie, gone = unused(docs, "doc", "tie", "gone")
    out = removals(docs, **options).select(F.col("doc_id").alias(doc), F.col("tie").alias(tie), F.col("gone").alias(gone))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(tie))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def cut(text, places):
            if text is None or places is None or not len(places):
                return text
            places = set(places.tolist())
            return SPLIT.join(line for at, line in enumerate(text.split(SPLIT)) if at not in places)

        return pd.Series([cut(t, g) for t, g in zip(texts, gone)], dtype=object)

    return docs.join(out.hint("shuffle_hash"), same, "left").withColumn("text", without(F.col("text").cast("string"), F.col(gone))), gone


def op4_fuzzy_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, gone = _applied(docs)
    return out.select("doc_id", F.size(F.coalesce(gone, F.array().cast("array<int>"))).alias("lines_removed"), "text")
