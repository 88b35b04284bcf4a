"""Defaults and limits of collections and requests."""

BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60.0
M, EF_CONSTRUCTION, EF_SEARCH = 16, 200, 50
M_RANGE, EF_RANGE = (4, 128), (10, 2000)
MAX_DIMENSION, MAX_K, MAX_OFFSET = 4096, 10_000, 100_000
MAX_NAME_BYTES, MAX_TEXT_BYTES, MAX_BATCH = 128, 1_000_000, 1000
MAX_METADATA_KEYS, MAX_METADATA_BYTES = 64, 65_536
DEFAULT_K, DEFAULT_ALPHA, DEFAULT_FUSION = 10, 0.7, "rrf"
PQ_CENTROIDS, PQ_ITERATIONS = 256, 20
AUTO_COMPACT_RATIO = 0.2
F32_EPSILON, F64_EPSILON = 1.1920928955078125e-07, 2.220446049250313e-16
