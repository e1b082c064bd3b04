"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from rainledger.llm import (
    best_fit,
    chunk_dedup,
    cover_codes,
    exact_dedup,
    graph_ann,
    hilbert_shards,
    hyperminhash,
    insult_svm,
    licence_scan,
    merkle_manifest,
    packing,
    poisson_mix,
    quality_mil,
)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality_mil": quality_mil.op2_quality_mil,
    "op3_licence_scan": licence_scan.op3_licence_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_graph_ann": graph_ann.op5_graph_ann,
    "op6_hilbert_shards": hilbert_shards.op6_hilbert_shards,
    "op7_hyperminhash": hyperminhash.op7_hyperminhash,
    "op8_insult_svm": insult_svm.op8_insult_svm,
    "op9_line_dedup": chunk_dedup.op9_line_dedup,
    "op10_poisson_mix": poisson_mix.op10_poisson_mix,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_cover_codes": cover_codes.op13_cover_codes,
}

#: Tokens, learned scores, graph searches and CRC-32 have no SQL; those queries are tested in tests/llm.
ORACLE_SQL = {
    "op3_licence_scan": licence_scan.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_hyperminhash": hyperminhash.ORACLE,
    "op9_line_dedup": chunk_dedup.ORACLE,
    "op10_poisson_mix": poisson_mix.ORACLE,
    "op13_cover_codes": cover_codes.ORACLE,
}
