"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from tracequarry.llm import bpe, decontam, htmltext, langid, licenses, media, neardup, periodic, pii, quality, runindex, suffixes, turntrie

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_pii_spans": pii.op3_pii_spans,
    "op4_repeated_bytes": suffixes.op4_repeated_bytes,
    "op5_quality": quality.op5_quality,
    "op6_benchmark_hits": decontam.op6_benchmark_hits,
    "op7_main_text": htmltext.op7_main_text,
    "op8_repeated_words": runindex.op8_repeated_words,
    "op9_avi_digest": media.op9_avi_digest,
    "op10_bpe_roundtrip": bpe.op10_bpe_roundtrip,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_prefix_trie": turntrie.op12_prefix_trie,
    "op13_license_labels": licenses.op13_license_labels,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op6_benchmark_hits": decontam.OP6_SQL, "op12_prefix_trie": turntrie.OP12_SQL}
