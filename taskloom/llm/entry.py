"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import fingerprints, lattice, licenses, lines, merkle, minhash, mixing, negatives, oracles, packing, quality, sharding, substrings, toxicity


def queries() -> dict:
    return {
        "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_binary_packing": packing.op3_binary_packing,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_lattice_near_dedup": lattice.op6_lattice_near_dedup,
        "op7_hilbert_sharding": sharding.op7_hilbert_sharding,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pareto_mixing": mixing.op9_pareto_mixing,
        "op10_quality_cotraining": quality.op10_quality_cotraining,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_line_dedup": lines.op12_line_dedup,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": oracles.SUBSTRINGS,
        "op4_minhash_near_dedup": oracles.NEAR,
        "op5_license_scan": licenses.oracle(),
        "op6_lattice_near_dedup": oracles.VECTORS,
        "op11_hard_negatives": negatives.ORACLE,
        "op12_line_dedup": lines.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
