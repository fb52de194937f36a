"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontaminate, exact, licenses, packing, passages, secrets, simhash, spelling, tokens, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_passages": passages.op2_passages,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_fingerprint": exact.op4_exact_fingerprint,
        "op5_pack": packing.op5_pack,
        "op6_simhash": simhash.op6_simhash,
        "op7_warc": warc.op7_warc,
        "op8_secrets": secrets.op8_secrets,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_licenses": licenses.op10_licenses,
        "op11_spelling": spelling.op11_spelling,
        "op12_topk": topk.op12_topk,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op7_warc": warc.OP7_SQL, "op10_licenses": licenses.OP10_SQL, "op11_spelling": spelling.OP11_SQL, "op12_topk": topk.OP12_SQL}
