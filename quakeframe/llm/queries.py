"""The corpus queries by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quakeframe.llm import op1_divergence, op10_topk, op11_whitening, op12_spelling, op13_tensored, op2_suffixes, op3_chosenpath, op4_licenses, op5_langid, op6_pseudonyms, op7_packing, op8_mixing, op9_reshard

_ALL = {
    "op1_divergence": (op1_divergence.op1_divergence, op1_divergence.SQL),
    "op2_suffixes": (op2_suffixes.op2_suffixes, op2_suffixes.SQL),
    "op3_chosenpath": (op3_chosenpath.op3_chosenpath, op3_chosenpath.SQL),
    "op4_licenses": (op4_licenses.op4_licenses, op4_licenses.SQL),
    "op5_langid": (op5_langid.op5_langid, op5_langid.SQL),
    "op6_pseudonyms": (op6_pseudonyms.op6_pseudonyms, op6_pseudonyms.SQL),
    "op7_packing": (op7_packing.op7_packing, op7_packing.SQL),
    "op8_mixing": (op8_mixing.op8_mixing, op8_mixing.SQL),
    "op9_reshard": (op9_reshard.op9_reshard, op9_reshard.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op10_topk": (op10_topk.op10_topk, op10_topk.SQL),
    "op11_whitening": (op11_whitening.op11_whitening, op11_whitening.SQL),
    "op12_spelling": (op12_spelling.op12_spelling, op12_spelling.SQL),
    "op13_tensored": (op13_tensored.op13_tensored, op13_tensored.SQL),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _ALL.items() if s}
