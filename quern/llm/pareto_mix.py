"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share all words; a target stops at ``cap`` times its source's size and the
excess is shared again by weight. That fixed point is a water level: with
sources sorted by size/weight, a prefix is capped and the rest share by weight.

Expected copies: documents of a source differ by a measure, the variety of their
words: 4 + 12 * distinct words / words, rounded down (4 to 16). A document expects
``e = min(cap, k * measure)`` copies, with k set so that the source's expected words are its
target. It gets floor(e) whole copies for certain, and one more by chance with probability near e - floor(e).

Drawing: documents of a source are split into strata of like sizes (four to an octave). Each
stratum draws a fixed number n of documents: from the largest sizes down, what the
expected words run ahead of the words drawn so far, divided by the stratum's mean size and rounded, so rounding
never adds up. The fractions are scaled to inclusion probabilities p whose sum is n: down in
proportion, or up by shrinking 1 - p in proportion. Documents are ranked by the random odds
u / (1 - u) over the inclusion odds p / (1 - p) (Rosen's Pareto sampling; u is a keyed digest of doc_id
and text) and the n first are drawn. ``rank`` holds that quotient q as q / (1 + q), which
orders alike and stays finite.

No stratum is ranked in one task: ranks are counted in 4096 buckets first, the bucket of the nth document in 4096
parts again while any such bucket holds more than ``bucket_rows`` documents, and only the last bucket's documents are
ordered. Of them the nth one is the stratum's cut, so every document is decided where it is read, by one join with a row for each
(source, stratum, measure): a few hundred rows a source, broadcast up to ``BROADCAST_ROWS`` rows.
``targets`` numbers and levels sources, a row each, in one task.

Defined results: null and empty texts have size 0, the least measure, a stratum of their own, and are taken 0
words; a source without words has target 0 and no copies; repeated rows (equal doc_id and text) rank alike, and
of those at the cut as many are drawn as fit; a null doc_id draws like any other value; an empty
table gives no rows; other columns pass through :func:`mixed` unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm.names import unused
from quern.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS, MAX_LEVEL = 4096, 4
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def tie(key: Column, text: Column, seed: str = "mix") -> Column:
    """A keyed digest of a document, the same in every run and engine."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text), F.lit("null"))))


def draw(digest: Column) -> Column:
    """u in (0, 1): the first 48 bits of a digest."""
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def described(docs: DataFrame, name: str, seed: str) -> DataFrame:
    """``docs`` with a struct ``name``: source, size, measure, stratum, tie, u."""
    text = F.col("text").cast("string")
    docs = docs.withColumn(name, F.struct(words(text).alias("w"), tie(F.col("doc_id"), text, seed).alias("tie")))
    found, size = F.col(name), F.size(F.col(name)["w"]).cast("long")
    docs = docs.withColumn(name, F.struct(size.alias("size"), F.size(F.array_distinct(found["w"])).cast("long").alias("kinds"), found["tie"].alias("tie")))
    size, octave = F.col(name)["size"], F.length(F.bin(F.col(name)["size"])) - 1
    quarter = F.floor(size * 4 / F.pow(F.lit(2.0), octave)) - 4
    return docs.withColumn(
        name,
        F.struct(
            F.col("source").alias("source"),
            size.alias("size"),
            F.when(size > 0, F.floor(F.col(name)["kinds"] * 12 / F.greatest(size, F.lit(1)))).otherwise(0).cast("int").__add__(4).alias("measure"),
            F.when(size > 0, 1 + 4 * octave + quarter).otherwise(0).cast("int").alias("stratum"),
            F.col(name)["tie"].alias("tie"),
            draw(F.col(name)["tie"]).alias("u"),
        ),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """``(source, source_size)`` -> the same with ``target`` and ``capped``; one row a source."""
    nth = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1).cast("int")))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("fixed", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # capped if the level set by all smaller ones being capped still is above its cap
        .withColumn("over", (F.col("total") - cap * F.col("fixed")) * F.col("weight") >= cap * F.col("source_size") * (F.col("all_weight") - F.col("gone")))
    )
    rows = rows.withColumn("left", F.col("total") - cap * F.coalesce(F.sum(F.when(F.col("over"), F.col("source_size"))).over(everything), F.lit(0)))
    rows = rows.withColumn("share", F.coalesce(F.sum(F.when(~F.col("over"), F.col("weight"))).over(everything), F.lit(1.0)))
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("over"), (cap * F.col("source_size")).cast("double"))
        .otherwise(F.col("left").cast("double") * F.col("weight") / F.col("share"))
        .alias("target"),
        F.col("over").alias("capped"),
    )


def expected(cells: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """``(source, measure)`` -> expected copies ``e``, by the same water level as targets, within each source."""
    by = cells.groupBy("source", "measure").agg(F.sum("words").alias("words"))
    by = by.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    every = Window.partitionBy("source")
    above = every.orderBy(F.desc("measure")).rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("words") * F.col("measure")
    by = (
        by.withColumn("above", F.coalesce(F.sum("words").over(above), F.lit(0)))
        .withColumn("mass", F.sum(mass).over(every) - F.coalesce(F.sum(mass).over(above), F.lit(0)))
        .withColumn("over", (F.col("target") - cap * F.col("above")) * F.col("measure") >= cap * F.col("mass"))
    )
    held = F.coalesce(F.sum(F.when(F.col("over"), F.col("words"))).over(every), F.lit(0))
    free = F.coalesce(F.sum(F.when(~F.col("over"), mass)).over(every), F.lit(0))
    by = by.withColumn("k", F.when(free > 0, (F.col("target") - cap * held) / free))
    e = F.when(F.col("source_size") == 0, 0.0).when(F.col("over") | F.col("k").isNull(), float(cap))
    e = e.otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("k") * F.col("measure"))))
    return by.select("source", "measure", "source_size", "target", e.alias("e"))


def allotted(cells: DataFrame, cap: int) -> DataFrame:
    """``(source, stratum, measure, n, words, e, ...)`` -> the same with ``certain``, ``p``, ``draws``, ``open_docs``."""
    cells = cells.withColumn("certain", F.floor("e").cast("long")).withColumn("f", F.when(F.col("e") < cap, F.col("e") - F.col("certain")))
    entry = F.struct("measure", "n", "words", "f")
    open_ = F.filter(F.sort_array(F.collect_list(entry)), lambda x: x["f"].isNotNull())
    total = lambda of: F.aggregate(open_, F.lit(0.0), lambda s, x: s + of(x))
    strata = cells.groupBy("source", "stratum").agg(
        total(lambda x: x["n"].cast("double")).alias("docs"),
        total(lambda x: x["f"] * x["n"]).alias("fractions"),
        total(lambda x: x["f"] * x["words"]).alias("expect"),
        total(lambda x: x["words"].cast("double")).alias("words"),
    )
    rows = F.sort_array(F.collect_list(F.struct("stratum", "docs", "fractions", "expect", "words")), asc=False)

    def step(state, x):
        need = state["need"] + x["expect"]
        count = F.when(x["words"] > 0, need * x["docs"] / F.greatest(x["words"], F.lit(1.0))).otherwise(x["fractions"])
        count = F.least(x["docs"], F.greatest(F.lit(0.0), F.floor(count + (0.5 + 1e-9)).cast("double")))
        left = need - count * x["words"] / F.greatest(x["docs"], F.lit(1.0))
        made = F.struct(x["stratum"].alias("stratum"), count.alias("draws"), x["docs"].alias("docs"), x["fractions"].alias("fractions"))
        return F.struct(left.alias("need"), F.concat(state["made"], F.array(made)).alias("made"))

    none = F.array().cast("array<struct<stratum:int,draws:double,docs:double,fractions:double>>")
    made = strata.groupBy("source").agg(F.aggregate(rows, F.struct(F.lit(0.0).alias("need"), none.alias("made")), step)["made"].alias("made"))
    made = made.select(F.col("source").alias("s"), F.inline("made"))
    draws, docs, fractions = F.col("draws"), F.col("docs"), F.col("fractions")
    down = F.col("f") * draws / F.when(fractions > 0, fractions).otherwise(1.0)
    up = 1 - (1 - F.col("f")) * (docs - draws) / F.when(docs > fractions, docs - fractions).otherwise(1.0)
    joined = cells.join(made.withColumnRenamed("stratum", "t"), F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t")))
    p = F.when(F.col("f").isNull(), 0.0).when(draws <= fractions, down).otherwise(up)
    return joined.select(
        "source", "stratum", "measure", "source_size", "target", "certain", p.alias("p"),
        F.when(F.col("f").isNull(), 0).otherwise(draws).cast("long").alias("draws"), docs.cast("long").alias("open_docs"),
    )


def _with_goal(rows: DataFrame, name: str, goal: DataFrame, share: str) -> DataFrame:
    """``rows`` with their (source, stratum, measure) row of ``goal`` as struct ``share``, and their ``rank`` in struct ``name``."""
    goal = goal.select(F.struct(*goal.columns).alias(share))
    x, g = F.col(name), F.col(share)
    # null-safe, though neither side has nulls: plain equality adds a filter for nulls that counts each text's words again
    on = x["source"].eqNullSafe(g["source"]) & x["stratum"].eqNullSafe(g["stratum"]) & x["measure"].eqNullSafe(g["measure"])
    rows = rows.join(F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal, on)
    ahead, behind = x["u"] * (1 - g["p"]), (1 - x["u"]) * g["p"]
    return rows.withColumn(name, x.withField("rank", ahead / (ahead + behind)))


def _cuts(base: DataFrame, goal: DataFrame, bucket_rows: int, buckets: int) -> DataFrame:
    """``(source, stratum, cut_rank, cut_tie, spare, tied)``: the last document drawn of each stratum that draws some of its documents."""
    ranked = _with_goal(base, "x", goal.where("draws > 0 AND draws < open_docs"), "g")
    ranked = ranked.select("x.source", "x.stratum", "x.rank", "x.tie", F.col("g.draws").cast("long").alias("left"))
    level, scale = 1, buckets
    within = Window.partitionBy("source", "stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        part = F.floor(F.col("rank") * float(scale))
        held = ranked.groupBy("source", "stratum", part.alias("bucket")).agg(F.count(F.lit(1)).alias("held"), F.max("left").alias("left"))
        held = held.withColumn("before", F.coalesce(F.sum("held").over(within), F.lit(0)))
        held = held.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("held") >= F.col("left")))
        cut = held.select(
            F.col("source").alias("s"), F.col("stratum").alias("t"), "bucket", (F.col("left") - F.col("before")).alias("spare"), "held"
        )
        cut = materialize(cut, "mix-buckets")
        found = cut.agg(F.count(F.lit(1)), F.max("held")).first()
        small = F.broadcast(cut) if found[0] <= BROADCAST_ROWS else cut
        on = F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t")) & (part == F.col("bucket"))
        ranked = ranked.join(small, on).select("source", "stratum", "rank", "tie", F.col("spare").alias("left"))
        if level >= MAX_LEVEL or (found[1] or 0) <= bucket_rows:
            break
        level, scale = level + 1, scale * BUCKETS
    # equal documents are one row with their number
    same = ranked.groupBy("source", "stratum", "rank", "tie").agg(F.count(F.lit(1)).alias("tied"), F.max("left").alias("left"))
    order = Window.partitionBy("source", "stratum").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.coalesce(F.sum("tied").over(order), F.lit(0)))
    same = same.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("tied") >= F.col("left")))
    return same.select("source", "stratum", F.col("rank").alias("cut_rank"), F.col("tie").alias("cut_tie"), (F.col("left") - F.col("before")).alias("spare"), "tied")


def _decided(docs: DataFrame, goal: DataFrame, name: str, seed: str, described_already: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with struct ``name``, the struct of its goal (name returned), and ``name.copies``."""
    rows = docs if described_already else described(docs, name, seed)
    (share,) = unused(rows, "goal")
    rows = _with_goal(rows, name, goal, share)
    x, g = F.col(name), F.col(share)
    ahead = (x["rank"] < g["cut_rank"]) | ((x["rank"] == g["cut_rank"]) & (x["tie"] < g["cut_tie"]))
    equal = (x["rank"] == g["cut_rank"]) & (x["tie"] == g["cut_tie"])
    drawn = F.when(g["draws"] == 0, False).when(g["draws"] == g["open_docs"], True).otherwise(F.coalesce(ahead | equal, F.lit(False)))
    done = rows.withColumn(name, x.withField("copies", g["certain"] + drawn.cast("long")))
    if not goal.where("spare < tied").limit(1).count():
        return done, share
    # repeated rows at a cut that can't all be drawn are numbered; they are equal, so it doesn't matter which
    split = F.coalesce(equal & (g["spare"] < g["tied"]), F.lit(False))
    (number,) = unused(rows, "number")
    tied = rows.where(split).withColumn(number, F.row_number().over(Window.partitionBy(g["source"], g["stratum"]).orderBy(x["tie"])))
    tied = tied.withColumn(name, x.withField("copies", g["certain"] + (F.col(number) <= g["spare"]).cast("long"))).drop(number)
    return done.where(~split).unionByName(tied), share


def _goal(docs: DataFrame, weights, cap: int, bucket_rows: int, buckets: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The described documents without their texts, and what is decided for each (source, stratum, measure)."""
    base = materialize(described(docs.select("doc_id", "source", "text"), "x", seed).select("doc_id", "x"), "mix-sizes")
    cells = base.groupBy("x.source", "x.stratum", "x.measure").agg(F.count(F.lit(1)).alias("n"), F.sum("x.size").alias("words"))
    cells = materialize(cells, "mix-cells")
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap).drop("capped")
    e = expected(cells, goal, cap).withColumnsRenamed({"source": "s", "measure": "m"})
    cells = cells.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m"))).drop("s", "m")
    goal = materialize(allotted(cells, cap), "mix-shares")
    cuts = _cuts(base, goal, bucket_rows, buckets).withColumnsRenamed({"source": "s", "stratum": "t"})
    goal = goal.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("t")), "left").drop("s", "t")
    return base, materialize(goal, "mix-goal")


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = 3, bucket_rows: int = 100_000, buckets: int = BUCKETS, seed: str = "mix") -> DataFrame:
    """By row: ``doc_id, source, size, measure, stratum, source_size, target, certain, p, draws, u, rank, copies``."""
    base, goal = _goal(docs, weights, cap, bucket_rows, buckets, seed)
    rows, share = _decided(base, goal, "x", seed, described_already=True)
    return rows.select(
        "doc_id", "x.source", "x.size", "x.measure", "x.stratum", f"{share}.source_size", f"{share}.target", f"{share}.certain",
        f"{share}.p", f"{share}.draws", "x.u", "x.rank", "x.copies",
    )


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = 3, bucket_rows: int = 100_000, buckets: int = BUCKETS, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0: left out); columns as they are. Texts aren't shuffled."""
    _, goal = _goal(docs, weights, cap, bucket_rows, buckets, seed)
    name, again = unused(docs, "mix", "copy")
    rows, _ = _decided(docs, goal, name, seed)
    rows = rows.where(F.col(name)["copies"] > 0)
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_pareto_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = {
    "op9_pareto_mix": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, source, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
         md5('mix:' || COALESCE(doc_id::VARCHAR, 'null') || ':' || COALESCE(md5(text), 'null')) AS tie
  FROM documents
), z AS (
  SELECT doc_id, source, tie, len(w)::BIGINT AS size, len(list_distinct(w))::BIGINT AS kinds,
         (('0x' || substr(tie, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM w
), d AS (
  SELECT doc_id, source, tie, size, u,
         4 + CASE WHEN size > 0 THEN (kinds * 12) // greatest(size, 1) ELSE 0 END AS measure,
         CASE WHEN size > 0 THEN 1 + 4 * (length(bin(size)) - 1) + (size * 4) // (1::BIGINT << (length(bin(size)) - 1)::BIGINT) - 4 ELSE 0 END AS stratum
  FROM z
), s AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, (SUM(source_size) OVER ())::DOUBLE AS total, SUM(weight) OVER () AS all_weight,
         COALESCE(SUM(source_size) OVER w, 0)::DOUBLE AS fixed, COALESCE(SUM(weight) OVER w, 0) AS gone
  FROM s WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, (total - 3 * fixed) * weight >= 3 * source_size * (all_weight - gone) AS over_cap FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN over_cap THEN (3 * source_size)::DOUBLE
              ELSE (total - 3 * COALESCE(SUM(source_size) FILTER (over_cap) OVER (), 0)::DOUBLE) * weight
                   / SUM(weight) FILTER (NOT over_cap) OVER () END AS target
  FROM o
), c AS (
  SELECT source, stratum, measure, COUNT(*)::DOUBLE AS n, SUM(size)::DOUBLE AS words FROM d GROUP BY ALL
), m AS (
  SELECT source, measure, SUM(words) AS words, SUM(words) * measure AS mass FROM c GROUP BY source, measure
), l AS (
  SELECT m.*, t.source_size, t.target, COALESCE(SUM(m.words) OVER above, 0) AS above,
         SUM(m.mass) OVER (PARTITION BY m.source) - COALESCE(SUM(m.mass) OVER above, 0) AS below
  FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source
  WINDOW above AS (PARTITION BY m.source ORDER BY m.measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, (target - 3 * above) * measure >= 3 * below AS full_ FROM l
), k AS (
  SELECT *, (target - 3 * COALESCE(SUM(words) FILTER (full_) OVER q, 0)) / nullif(COALESCE(SUM(mass) FILTER (NOT full_) OVER q, 0), 0) AS k
  FROM v WINDOW q AS (PARTITION BY source)
), e AS (
  SELECT source, measure, source_size, target,
         CASE WHEN source_size = 0 THEN 0.0 WHEN full_ OR k IS NULL THEN 3.0 ELSE greatest(0.0, least(3.0, k * measure)) END::DOUBLE AS e
  FROM k
), f AS (
  SELECT c.*, e.source_size, e.target, floor(e.e) AS certain, CASE WHEN e.e < 3 THEN e.e - floor(e.e) END AS f
  FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.measure = e.measure
), h AS (
  SELECT source, stratum, COALESCE(SUM(n ORDER BY measure) FILTER (f IS NOT NULL), 0) AS docs, COALESCE(SUM(f * n ORDER BY measure) FILTER (f IS NOT NULL), 0) AS fractions,
         COALESCE(SUM(f * words ORDER BY measure) FILTER (f IS NOT NULL), 0) AS expect, COALESCE(SUM(words ORDER BY measure) FILTER (f IS NOT NULL), 0) AS words,
         row_number() OVER (PARTITION BY source ORDER BY stratum DESC) AS j
  FROM f GROUP BY source, stratum
), a AS (
  SELECT source, 0::BIGINT AS j, 0.0::DOUBLE AS need, 0::BIGINT AS stratum, 0.0::DOUBLE AS draws FROM s
  UNION ALL
  SELECT source, j, need + expect - draws * words / greatest(docs, 1.0), stratum, draws
  FROM (SELECT h.source, h.j, a.need, h.expect, h.words, h.docs, h.stratum,
               least(h.docs, greatest(0.0, floor(CASE WHEN h.words > 0 THEN (a.need + h.expect) * h.docs / greatest(h.words, 1.0) ELSE h.fractions END + (0.5 + 1e-9)::DOUBLE))) AS draws
        FROM a JOIN h ON a.source IS NOT DISTINCT FROM h.source AND h.j = a.j + 1)
), p AS (
  SELECT f.source, f.stratum, f.measure, f.source_size, f.target, f.certain, CASE WHEN f.f IS NULL THEN 0 ELSE a.draws END AS draws,
         CASE WHEN f.f IS NULL THEN 0.0 WHEN a.draws <= h.fractions THEN f.f * a.draws / CASE WHEN h.fractions > 0 THEN h.fractions ELSE 1.0 END
              ELSE 1 - (1 - f.f) * (h.docs - a.draws) / CASE WHEN h.docs > h.fractions THEN h.docs - h.fractions ELSE 1.0 END END AS p, f.f
  FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source AND f.stratum = h.stratum
  JOIN a ON f.source IS NOT DISTINCT FROM a.source AND f.stratum = a.stratum AND a.j > 0
), q AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.certain, p.draws,
         row_number() OVER (PARTITION BY d.source, d.stratum, p.f IS NULL
                            ORDER BY d.u * (1 - p.p) / (d.u * (1 - p.p) + (1 - d.u) * p.p), d.tie) AS nth
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.stratum = p.stratum AND d.measure = p.measure
)
SELECT doc_id, size, source_size, target, ((certain + CASE WHEN nth <= draws THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM q
"""
}
