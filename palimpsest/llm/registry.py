"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from palimpsest.llm import band, decontaminate, innertop, jaccard, langid, lattice, mpegts, packing, sharding, tokencount, toxicity, treaps, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_packing": packing.op2_packing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_lattice": lattice.op6_lattice,
    "op7_sharding": sharding.op7_sharding,
    "op8_tokencount": tokencount.op8_tokencount,
    "op9_warc": warc.op9_warc,
    "op10_mpegts": mpegts.op10_mpegts,
    "op11_treaps": treaps.op11_treaps,
    "op12_innertop": innertop.op12_innertop,
    "op13_band": band.op13_band,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op9_warc": warc.ORACLE, "op11_treaps": treaps.ORACLE, "op12_innertop": innertop.ORACLE, "op13_band": band.ORACLE}
