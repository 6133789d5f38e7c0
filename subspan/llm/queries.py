"""The registered queries of the corpus operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from subspan.llm.ann import OP7_SQL, op7_one_bit_codes
from subspan.llm.bpe import op5_byte_bpe
from subspan.llm.linededup import OP8_SQL, op8_line_edit_join
from subspan.llm.mixing import OP2_SQL, op2_mix_sources
from subspan.llm.pii import op1_pii_weak_labels
from subspan.llm.sharding import OP4_SQL, op4_shard_by_splitters
from subspan.llm.simhash import op10_simhash_positions
from subspan.llm.toxicity import op9_toxicity
from subspan.llm.warc import OP6_SQL, op6_warc_segments
from subspan.llm.webp import op3_lossless_webp

QUERIES = {
    "op1_pii_weak_labels": op1_pii_weak_labels,
    "op2_mix_sources": op2_mix_sources,
    "op3_lossless_webp": op3_lossless_webp,
    "op4_shard_by_splitters": op4_shard_by_splitters,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc_segments": op6_warc_segments,
    "op7_one_bit_codes": op7_one_bit_codes,
    "op8_line_edit_join": op8_line_edit_join,
    "op9_toxicity": op9_toxicity,
    "op10_simhash_positions": op10_simhash_positions,
}

SQL = {
    "op2_mix_sources": OP2_SQL,
    "op4_shard_by_splitters": OP4_SQL,
    "op6_warc_segments": OP6_SQL,
    "op7_one_bit_codes": OP7_SQL,
    "op8_line_edit_join": OP8_SQL,
}
