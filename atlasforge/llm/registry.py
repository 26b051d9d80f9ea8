"""Names of the corpus operators' queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from atlasforge.llm import oracles
from atlasforge.llm import queries as q

QUERIES = {f.__name__: f for f in (q.op1_decontam, q.op2_suffixtree, q.op3_bpe, q.op4_quality, q.op5_langid, q.op6_fingerprint, q.op7_setjoin, q.op8_urlfilter, q.op9_linededup, q.op10_pii)}
ORACLES: dict[str, str] = dict(oracles.SQL)
