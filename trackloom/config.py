"""Tunable constants of search and recommendation. Fixed values."""

TEXT_DIMS = 384
AUDIO_FEATURES = ["danceability", "energy", "valence", "tempo", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness"]
TEXT_WEIGHT, AUDIO_WEIGHT = 0.6, 0.4
LSH_TABLES, LSH_BITS, LSH_SEED = 8, 12, 42
PROBE_RADIUS, MIN_CANDIDATES, OVERSAMPLE = 2, 50, 5
# Of one of the nearest tracks by the probes; where it may be higher, a search is exact.
MISS_PROBABILITY = 0.01
BM25_K1, BM25_B = 1.5, 0.75
W_COSINE, W_BM25, W_POPULARITY, W_BONUS = 0.65, 0.25, 0.10, 0.05
MIN_POOL = 30
RECOMMEND_W_COSINE, RECOMMEND_W_POPULARITY, MAX_FAVORITES = 0.85, 0.15, 5
RERANK_WEIGHTS = {"audio": 0.35, "popularity": 0.20, "acoustic": 0.15, "duration": 0.10, "artist": 0.20}
SIMILARITY_FEATURES = ["danceability", "energy", "valence", "acousticness", "instrumentalness"]
# Where a favourite or candidate lacks a value.
DEFAULT_FEATURE, DEFAULT_POPULARITY, DEFAULT_DURATION = 0.5, 50, 180000
