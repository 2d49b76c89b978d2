"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from estatescope.llm.alignment import op11_alignment
from estatescope.llm.centroid_clustering import OP13_SQL, op13_centroids
from estatescope.llm.jaccard_join import op6_jaccard_join
from estatescope.llm.lm_scoring import op2_lm_scoring
from estatescope.llm.mixing import OP3_SQL, op3_mix_sources
from estatescope.llm.near_vectors import op9_near_vectors
from estatescope.llm.packing import op10_packing
from estatescope.llm.quality import OP7_SQL, op7_quality
from estatescope.llm.repeated_windows import OP4_SQL, op4_repeated_windows
from estatescope.llm.secret_scan import OP12_SQL, op12_secret_scan
from estatescope.llm.sharding import op1_shard_rows
from estatescope.llm.url_filter import OP5_SQL, op5_url_filter
from estatescope.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_shard_rows": op1_shard_rows,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_mix_sources": op3_mix_sources,
    "op4_repeated_windows": op4_repeated_windows,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_near_vectors": op9_near_vectors,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_secret_scan": op12_secret_scan,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL = {
    "op3_mix_sources": OP3_SQL,
    "op4_repeated_windows": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_quality": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
