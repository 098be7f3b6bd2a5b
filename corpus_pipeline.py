"""A training corpus in five stages; each reads what its predecessor wrote.

Quality filter, line dedup, SimHash near-dedup, mixing to target weights, encoding.
"""

from quern.llm import cotrain_quality, fuzzy_lines, pareto_mix, piece_fst, simhash_golay
from quern.plans.scratch import materialize
from quern.session import shipping


def quality(spark, docs, sf_dir):
    """Documents that the co-trained classifier scores below one half go."""
    return cotrain_quality.keep_good(docs, cotrain_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark, docs, sf_dir):
    """Of fuzzy-equal lines the first one stays."""
    return fuzzy_lines.dedupe_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of near-equal documents the one with the smallest doc_id stays."""
    return simhash_golay.one_of_each(docs)


def mix(spark, docs, sf_dir):
    """Sources get their target weights; a document taken more than once is repeated."""
    return pareto_mix.mixed(docs)


def encode(spark, docs, sf_dir):
    """Piece ids of every document of the mix."""
    return piece_fst.encode(docs, piece_fst.default_model())


STAGES = [
    ("quality classifier", shipping(quality)),
    ("line dedup", shipping(lines)),
    ("SimHash near-dedup", shipping(near_duplicates)),
    ("mixing", shipping(mix)),
    ("piece encoding", shipping(encode)),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written and read again, as a job of stages would."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{at}")
    return docs
