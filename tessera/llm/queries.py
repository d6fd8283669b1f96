"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import oracle
from tessera.llm.decontaminate import op7_decontamination
from tessera.llm.embeddings import op6_embeddings
from tessera.llm.langid import op10_langid
from tessera.llm.licenses import op13_licenses
from tessera.llm.linededup import op3_line_dedup
from tessera.llm.maxent import op2_lm_score
from tessera.llm.mixing import op9_mixing
from tessera.llm.sharding import op1_sharding
from tessera.llm.simhash import op5_simhash
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.turns import op11_conversations
from tessera.llm.warc import op4_warc
from tessera.llm.whitening import op12_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_embeddings": op6_embeddings,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_langid": op10_langid,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_licenses": op13_licenses,
}

ORACLE: dict[str, str] = {
    "op1_sharding": oracle.SHARDING,
    "op3_line_dedup": oracle.LINE_DEDUP,
    "op4_warc": oracle.WARC,
    "op6_embeddings": oracle.EMBEDDINGS,
    "op7_decontamination": oracle.DECONTAMINATION,
    "op11_conversations": oracle.CONVERSATIONS,
}
