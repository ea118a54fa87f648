"""The corpus operators as registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from millrace.llm.embedding_dedup import op9_embedding_dedup
from millrace.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from millrace.llm.licenses import OP5_SQL, op5_license_scan
from millrace.llm.mixing import OP4_SQL, op4_mixing
from millrace.llm.near_dedup import op10_near_dedup
from millrace.llm.pii import op2_pii
from millrace.llm.quality import op3_quality
from millrace.llm.sentencepiece_codec import op6_sentencepiece
from millrace.llm.toxicity import op1_toxicity
from millrace.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op5_license_scan": OP5_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
}
