"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, editcount, html, licenses, lmscore, pii, quality, sharding, simhash

QUERIES = {
    "op1_lmscore": lmscore.op1_lmscore,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_simhash": simhash.op5_simhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_tokencounts": editcount.op8_tokencounts,
    "op9_html": html.op9_html,
    "op10_licenses": licenses.op10_licenses,
}
ORACLE = {
    "op10_licenses": licenses.oracle(),
}
