"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from permea.llm import oracles
from permea.llm.centroids import op12_mean_order_clusters
from permea.llm.decontaminate import op5_suffix_decontam
from permea.llm.html_text import op2_line_block
from permea.llm.langid import op7_bigru_langid
from permea.llm.lattice_lm import op1_lattice_lm
from permea.llm.minhash import op3_tensored_minhash
from permea.llm.packing import op6_config_lp_pack
from permea.llm.prefix_trie import op11_rollup_trie
from permea.llm.sharding import op4_prefix_shards
from permea.llm.suffix_dedup import op9_suffix_dedup
from permea.llm.topk import op10_threshold_topk
from permea.llm.toxicity import op8_knn_toxicity
from permea.llm.warc import op13_indexed_warc

_ALL = [op1_lattice_lm, op2_line_block, op3_tensored_minhash, op4_prefix_shards, op5_suffix_decontam, op6_config_lp_pack, op7_bigru_langid, op8_knn_toxicity, op9_suffix_dedup, op10_threshold_topk,
        op11_rollup_trie, op12_mean_order_clusters, op13_indexed_warc]
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}
SQL = oracles.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
