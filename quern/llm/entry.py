"""Queries of this subpackage, and the SQL of those that SQL can express."""

from quern.llm import (
    ball_tree, cotrain_quality, fuzzy_lines, pareto_mix, piece_fst, quote_links, simhash_golay, telephony, toxic_crf, url_globs,
)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            telephony.op1_telephony,
            url_globs.op2_url_globs,
            toxic_crf.op3_toxic_crf,
            fuzzy_lines.op4_fuzzy_lines,
            ball_tree.op5_ball_tree,
            cotrain_quality.op6_cotrain_quality,
            simhash_golay.op7_simhash_golay,
            quote_links.op8_quote_links,
            pareto_mix.op9_pareto_mix,
            piece_fst.op10_piece_fst,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {**url_globs.ORACLE_SQL, **ball_tree.ORACLE_SQL, **pareto_mix.ORACLE_SQL}
