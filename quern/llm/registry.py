"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .chat import op4_chat_format
from .html import op2_html_extraction
from .langid import op8_language_id
from .line_dedup import op6_line_dedup
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op9_source_mixing
from .near_dedup import OP13_SQL, op13_near_dedup
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op5_packing
from .quality import OP10_SQL, op10_quality_rules
from .search import OP11_SQL, op11_lexical_search
from .secrets import OP7_SQL, op7_secret_scan
from .topk import OP1_SQL, op1_exact_topk

QUERIES = {
    f.__name__: f for f in (
        op1_exact_topk, op2_html_extraction, op3_ngram_join, op4_chat_format, op5_packing, op6_line_dedup, op7_secret_scan,
        op8_language_id, op9_source_mixing, op10_quality_rules, op11_lexical_search,
        op12_merkle_manifest, op13_near_dedup,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {
    "op1_exact_topk": OP1_SQL, "op3_ngram_join": OP3_SQL, "op7_secret_scan": OP7_SQL, "op10_quality_rules": OP10_SQL,
    "op11_lexical_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
    "op13_near_dedup": OP13_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLES | more
