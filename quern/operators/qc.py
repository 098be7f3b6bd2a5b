"""Quality control: metrics, filters as statuses, outliers, symbols, the cleaned matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.stats import MAD_SCALE
from quern.plans.scratch import materialize

FEATURES = ("log_reads", "detected_share", "rrna_share", "mito_share", "ercc_share")


def cell_metrics(counts: DataFrame) -> DataFrame:
    """``(cell, total_reads, detected_genes)``."""
    return counts.groupBy("cell").agg(F.sum("count").alias("total_reads"), F.count_if(F.col("count") > 0).alias("detected_genes"))


def gene_metrics(counts: DataFrame, n_cells: Column | int) -> DataFrame:
    """``(gene, expressed, expressed_perc)``; a null ``n_cells`` means the number of cells of ``counts``."""
    out = counts.groupBy("gene").agg(F.count_if(F.col("count") > 0).alias("expressed"))
    if isinstance(n_cells, int):
        return out.withColumn("expressed_perc", 100.0 * F.col("expressed") / n_cells)
    n = counts.agg(F.count_distinct("cell").alias("n"))
    return out.join(F.broadcast(n)).withColumn("expressed_perc", 100.0 * F.col("expressed") / F.col("n")).drop("n")


def dims(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """One row: numbers of genes and cells, all and kept, and of entries."""
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.count_if(F.col("status") == "OK").alias(f"{name}_ok"))
    return side(genes, "genes").join(side(cells, "cells")).join(counts.agg(F.count(F.lit(1)).alias("entries")))


def reset_filters(dim: DataFrame) -> DataFrame:
    return dim.withColumn("status", F.lit("OK"))


def filter_cells(cells: DataFrame, minreads=1000, maxreads=None, mingenes=None, maxgenes=None) -> DataFrame:
    """Status by inclusive bounds; a bound that is None or 0 doesn't bind."""
    ok = F.lit(True)
    for column, low, high in (("total_reads", minreads, maxreads), ("detected_genes", mingenes, maxgenes)):
        ok = ok & (F.col(column) >= low) if low else ok
        ok = ok & (F.col(column) <= high) if high else ok
    return cells.withColumn("status", F.when(ok, "OK").otherwise("EXCLUDE"))


def filter_genes(genes: DataFrame, min_exp=0.001) -> DataFrame:
    """Status by the number of cells (an int) or their percentage (a float) with the gene; None keeps all."""
    if min_exp is None:
        return reset_filters(genes)
    column = "expressed" if isinstance(min_exp, int) else "expressed_perc"
    return genes.withColumn("status", F.when(F.col(column) < min_exp, "EXCLUDE").otherwise("OK"))


def gene_set(genes: DataFrame, pattern: str | None = None, listed: DataFrame | None = None, flag: str = "flag") -> DataFrame:
    """``genes`` with a boolean column: the pattern is found in the name, or the name is in ``listed(gene)``."""
    if listed is not None:
        marks = listed.select("gene").distinct().withColumn(flag, F.lit(True))
        return genes.join(marks, "gene", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return genes.withColumn(flag, F.col("gene").cast("string").rlike(pattern))


def find_mitochondrial(genes: DataFrame, pattern: str = "^mt-", listed=None) -> DataFrame:
    """Case-insensitive; the flag is ``mitochondrial``."""
    return gene_set(genes, f"(?i){pattern}", listed, "mitochondrial")


def find_ercc(genes: DataFrame, pattern: str = r"^ERCC[_-]\S+$") -> DataFrame:
    """Case-sensitive; flagged spikes are excluded."""
    out = gene_set(genes, pattern, None, "ercc")
    return out.withColumn("status", F.when(F.col("ercc"), "EXCLUDE").otherwise(F.col("status"))) if "status" in genes.columns else out


def share_of(counts: DataFrame, flagged: DataFrame, flag: str, out: str, scale: float = 100.0) -> DataFrame:
    """``(cell, out)``: the share of a cell's reads in flagged genes; flags are a broadcast dimension if small."""
    marked = counts.join(flagged.where(F.col(flag)).select("gene", F.lit(1).alias("_hit")), "gene", "left")
    return marked.groupBy("cell").agg((scale * F.sum(F.when(F.col("_hit") == 1, F.col("count")).otherwise(0)) / F.sum("count")).alias(out))


def quality_features(counts: DataFrame, genes: DataFrame, rrna: str = "rrna", mito: str = "mitochondrial", ercc: str = "ercc") -> DataFrame:
    """The five features of a cell: ln(reads), and the shares of detected, rRNA, mitochondrial and spike reads."""
    flags = genes.select("gene", *[F.coalesce(F.col(f), F.lit(False)).alias(n) for f, n in ((rrna, "_r"), (mito, "_m"), (ercc, "_e"))])
    total = F.sum("count")
    part = lambda c: F.sum(F.when(F.col(c), F.col("count")).otherwise(0)) / total
    return counts.join(flags, "gene").groupBy("cell").agg(
        F.log(total.cast("double")).alias("log_reads"),
        (F.count_if(F.col("count") > 0) / total).alias("detected_share"),
        part("_r").alias("rrna_share"),
        part("_m").alias("mito_share"),
        part("_e").alias("ercc_share"),
    )


def fast_mcd(x: np.ndarray, seed: int = 42, starts: int = 100, keep: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of minimum determinant (Rousseeuw and Van Driessen 1999), by concentration steps."""
    n, d = x.shape
    h, rnd = (n + d + 1) // 2, np.random.default_rng(seed)

    def fit(rows):
        mean = rows.mean(axis=0)
        return mean, np.atleast_2d(np.cov(rows.T)) + 1e-12 * np.eye(d)

    def step(mean, cov):
        apart = x - mean
        dist = np.einsum("ij,jk,ik->i", apart, np.linalg.pinv(cov), apart)
        return fit(x[np.argpartition(dist, min(h, n) - 1)[:h]])

    tries = []
    for _ in range(starts):
        state = fit(x[rnd.choice(n, min(n, d + 1), replace=False)])
        for _ in range(2):
            state = step(*state)
        tries.append((np.linalg.slogdet(state[1])[1], len(tries), state))
    best = None
    for _, _, state in sorted(tries, key=lambda t: t[:2])[:keep]:
        low = np.inf
        for _ in range(30):
            state = step(*state)
            now = np.linalg.slogdet(state[1])[1]
            if now >= low - 1e-12:
                break
            low = now
        if best is None or low < best[0]:
            best = low, state
    return best[1]


def _concentrated(features: DataFrame, names: list[str], mean: np.ndarray, cov: np.ndarray, steps: int = 30):
    """Concentration steps over all cells: location and scatter of the half with the smallest distances, until the determinant stays."""
    n, d = features.count(), len(names)
    share, low = min(1.0, ((n + d + 1) // 2) / n), np.inf
    for _ in range(steps):
        rows = features.withColumn("_d", _distance(names, mean, cov))
        bound = rows.agg(F.percentile_approx("_d", F.lit(share), F.lit(1_000_000))).first()[0]
        product = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(d) for j in range(i, d)]
        half = rows.where(F.col("_d") <= bound).select(*[(F.col(c) - float(m)).alias(c) for c, m in zip(names, mean)])
        found = half.agg(F.count(F.lit(1)), *[F.sum(c) for c in names], *product).first()
        k, shift = found[0], np.array(found[1 : d + 1]) / found[0]
        square = np.zeros((d, d))
        square[np.triu_indices(d)] = found[d + 1 :]
        square = square + np.triu(square, 1).T
        cov = (square - k * np.outer(shift, shift)) / max(1, k - 1) + 1e-12 * np.eye(d)
        mean = mean + shift
        now = np.linalg.slogdet(cov)[1]
        if now >= low - 1e-9:
            break
        low = now
    return mean, cov


def _distance(names: list[str], mean: np.ndarray, cov: np.ndarray):
    inverse = np.linalg.pinv(cov)
    apart = [F.col(n) - float(m) for n, m in zip(names, mean)]
    return sum((apart[i] * apart[j] * float(inverse[i, j]) for i in range(len(names)) for j in range(len(names))), F.lit(0.0))


def find_low_quality(features: DataFrame, sd_thres: float = 3.0, seed: int = 42, max_start: int = 20_000) -> DataFrame:
    """``(cell, distance, status)``: robust squared distances; outliers lie over ``sd_thres`` deviations from their mean.

    Starting values of location and scatter come from at most ``max_start`` cells (those with the smallest hashes
    of their names); the concentration steps that settle them are aggregates over all cells.
    """
    names = [c for c in features.columns if c != "cell"]
    features = materialize(features, "quality")
    some = features.orderBy(F.xxhash64("cell"), "cell").limit(max_start).toPandas().sort_values("cell")
    x = some[names].to_numpy(dtype=float)
    varied = x.std(axis=0) > 0
    names, x = [n for n, v in zip(names, varied) if v], x[:, varied]
    mean, cov = _concentrated(features, names, *fast_mcd(x, seed))
    out = features.select("cell", _distance(names, mean, cov).alias("distance"))
    spread = out.agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"))
    far = F.abs(F.col("distance") - F.col("m")) > sd_thres * F.col("s")
    return out.join(F.broadcast(spread)).select("cell", "distance", F.when(far, "EXCLUDE").otherwise("OK").alias("status"))


def mad_outlier(cells: DataFrame, nmads: float = 3.0) -> DataFrame:
    """Excludes cells whose log2 reads or log2 genes lie under median - nmads * MAD."""
    rows = cells.withColumns({"_t": F.log2(F.col("total_reads") + 1.0), "_g": F.log2(F.col("detected_genes") + 1.0)})
    mid = rows.agg(F.expr("percentile(_t, 0.5)").alias("_mt"), F.expr("percentile(_g, 0.5)").alias("_mg"))
    rows = rows.join(F.broadcast(mid))
    mad = rows.agg(
        (F.expr("percentile(abs(_t - _mt), 0.5)") * MAD_SCALE).alias("_dt"), (F.expr("percentile(abs(_g - _mg), 0.5)") * MAD_SCALE).alias("_dg")
    )
    low = (F.col("_t") < F.col("_mt") - nmads * F.col("_dt")) | (F.col("_g") < F.col("_mg") - nmads * F.col("_dg"))
    return rows.join(F.broadcast(mad)).withColumn("status", F.when(low, "EXCLUDE").otherwise("OK")).drop("_t", "_g", "_mt", "_mg", "_dt", "_dg")


def symbol_switch(genes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``ID`` -> ``SYMBOL_ID`` by ``symbols(id, symbol)``, ignoring version suffixes; unknown ones become ``NA_ID``."""
    bare = F.regexp_replace(F.col("gene").cast("string"), r"\.[0-9]+$", "")
    known = symbols.groupBy(F.col("id").cast("string").alias("_id")).agg(F.min("symbol").alias("_symbol"))
    out = genes.withColumn("_bare", bare).join(known, F.col("_bare") == F.col("_id"), "left")
    return out.withColumn("new_gene", F.concat_ws("_", F.coalesce("_symbol", F.lit("NA")), "_bare")).drop("_bare", "_id", "_symbol")


def dedup_genes(rows: DataFrame, key: str = "gene") -> DataFrame:
    """Drops every copy of a label that occurs more than once."""
    alone = rows.groupBy(key).count().where("count = 1").select(key)
    return rows.join(alone, key, "left_semi")


def clean_matrix(counts: DataFrame, cells: DataFrame, genes: DataFrame, remove_low_quality: bool = True, remove_mito: bool = True) -> DataFrame:
    """Entries of cells and genes with status OK; spikes stay, mitochondrial genes go."""
    out = counts
    if remove_low_quality:
        spared = F.coalesce(F.col("ercc"), F.lit(False)) if "ercc" in genes.columns else F.lit(False)
        out = out.join(cells.where("status <> 'OK'").select("cell"), "cell", "left_anti")
        out = out.join(genes.where((F.col("status") != "OK") & ~spared).select("gene"), "gene", "left_anti")
    if remove_mito and "mitochondrial" in genes.columns:
        out = out.join(genes.where("mitochondrial").select("gene"), "gene", "left_anti")
    return out


def densify(expr: DataFrame, genes: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """A row for each gene and cell; only for the few operators that need zeros."""
    grid = genes.select("gene").crossJoin(cells.select("cell"))
    return grid.join(expr, ["gene", "cell"], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
