"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, jaccard_join, language_id, license_scan, mixing, secrets, tool_calls, toxicity


def queries() -> dict:
    found = [
        toxicity.op1_toxicity,
        exact_dedup.op2_exact_dedup,
        secrets.op3_secret_scan,
        tool_calls.op4_tool_calls,
        ann.op5_ann,
        license_scan.op6_license_scan,
        language_id.op7_language_id,
        jaccard_join.op8_jaccard_join,
        mixing.op9_mixing,
        bpe.op10_byte_bpe,
        tool_calls.linked_tool_calls,
        secrets.secret_scan_base,
        license_scan.license_scan_base,
        bpe.bpe_round_trip,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.SQL,
        "op4_tool_calls": tool_calls.SQL,
        "op8_jaccard_join": jaccard_join.SQL,
        "linked_tool_calls": tool_calls.LINKED_SQL,
        "secret_scan_base": secrets.BASE_SQL,
        "license_scan_base": license_scan.BASE_SQL,
        "bpe_round_trip": bpe.ROUND_TRIP_SQL,
    }
