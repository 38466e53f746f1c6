"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op8_bpe
from .embedding_dedup import op10_embedding_dedup
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_text import op7_html_text
from .license_scan import OP9_SQL, op9_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .packing import op6_packing
from .prefix_trie import op11_prefix_trie
from .simhash import op3_simhash
from .toxicity import op5_toxicity
from .url_filter import OP13_SQL, op13_url_filter
from .warc import op4_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_html_text": op7_html_text,
    "op8_bpe": op8_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}

ORACLE = {
    "op1_line_dedup": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op9_license_scan": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
