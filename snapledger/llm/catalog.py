"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from snapledger.llm.bagminhash import op3_near_dedup  # noqa: E402
from snapledger.llm.bpe import op9_bpe  # noqa: E402
from snapledger.llm.chat import OP8_SQL, op8_chat  # noqa: E402
from snapledger.llm.decontaminate import op6_decontamination  # noqa: E402
from snapledger.llm.embeddings import OP10_SQL, op10_embeddings  # noqa: E402
from snapledger.llm.feast import op13_feast  # noqa: E402
from snapledger.llm.hilbert import OP12_SQL, op12_hilbert  # noqa: E402
from snapledger.llm.html import OP1_SQL, op1_html  # noqa: E402
from snapledger.llm.pii import op5_pii  # noqa: E402
from snapledger.llm.quality import op2_quality  # noqa: E402
from snapledger.llm.recompression import OP11_SQL, op11_recompression  # noqa: E402
from snapledger.llm.sharding import op4_sharding  # noqa: E402
from snapledger.llm.toxicity import op7_toxicity  # noqa: E402

QUERIES = {
    "op1_html": op1_html, "op2_quality": op2_quality, "op3_near_dedup": op3_near_dedup, "op4_sharding": op4_sharding,
    "op5_pii": op5_pii, "op6_decontamination": op6_decontamination, "op7_toxicity": op7_toxicity, "op8_chat": op8_chat,
    "op9_bpe": op9_bpe, "op10_embeddings": op10_embeddings, "op11_recompression": op11_recompression,
    "op12_hilbert": op12_hilbert, "op13_feast": op13_feast,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_html": OP1_SQL, "op8_chat": OP8_SQL, "op10_embeddings": OP10_SQL, "op11_recompression": OP11_SQL, "op12_hilbert": OP12_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
