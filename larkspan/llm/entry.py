"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline
from larkspan.llm import align, classifier, extract, jaccard, licenses, mixing, packing, repair, rules, simhash, topk, urls, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_html_mincut": extract.query,
    "op3_quality_rules": rules.query,
    "op4_simhash_golay": simhash.query,
    "op5_packing": packing.query,
    "op6_license_scan": licenses.query,
    "op7_quality_classifier": classifier.query,
    "op8_mixing": mixing.query,
    "op9_topk_search": topk.query,
    "op10_url_filters": urls.query,
    "op11_jaccard_join": jaccard.query,
    "op12_repair": repair.query,
    "op13_alignment": align.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_warc": warc.SQL,
    "op3_quality_rules": rules.SQL,
    "op8_mixing": mixing.SQL,
    "op9_topk_search": topk.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
