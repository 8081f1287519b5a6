"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import minhash, topk, trie, urlfilter
from .bpe import op4_byte_bpe
from .chat import op8_chat
from .fingerprint import op7_fingerprint
from .langid import op3_language_id
from .linededup import op10_line_dedup
from .minhash import op12_minhash
from .packing import op1_packing
from .pii import op2_pii
from .simhash import op9_simhash
from .topk import op6_topk
from .trie import op11_trie
from .urlfilter import op5_url_filter
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_language_id, op4_byte_bpe, op5_url_filter, op6_topk, op7_fingerprint, op8_chat, op9_simhash, op10_line_dedup, op11_trie, op12_minhash, op13_whitening)}
ORACLE_SQL = {"op5_url_filter": urlfilter.ORACLE, "op6_topk": topk.ORACLE, "op11_trie": trie.ORACLE, "op12_minhash": minhash.ORACLE}
