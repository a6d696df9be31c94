"""Queries and oracle SQL of the subpackage, by name."""

from __future__ import annotations

from lacuna.llm import audit, chat, fertility, html, mixing, periods, pieces, pii, pivots, ranking, simhash, suffixes, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        suffixes.op1_suffix_dedup,
        pivots.op2_pivot_permutation,
        pii.op3_bilstm_crf,
        fertility.op4_token_fertility,
        mixing.op5_curriculum_mix,
        simhash.op6_simhash_balls,
        toxicity.op7_subsequence_svm,
        ranking.op8_bradley_terry,
        pieces.op9_streaming_viterbi,
        html.op10_site_templates,
        periods.op11_periodic_runs,
        chat.op12_budgeted_windows,
        audit.op13_filter_audit,
    )
}

ORACLES = {"op5_curriculum_mix": mixing.ORACLE, "op12_budgeted_windows": chat.ORACLE, "op13_filter_audit": audit.ORACLE}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
