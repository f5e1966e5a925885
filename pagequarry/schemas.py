"""Column contracts of the stages."""

from __future__ import annotations

PAGES = "page_id BIGINT, url STRING, html STRING"
SEGMENTS = "url STRING, pos BIGINT, text STRING, n_lines BIGINT"
USERS = "id BIGINT, email STRING, name STRING"
SUBSCRIPTIONS = "user_id BIGINT, url STRING, created_at TIMESTAMP"
HISTORY = (
    "id BIGINT, user_id BIGINT, url STRING, ts TIMESTAMP, total_items BIGINT, avg_subjectivity DOUBLE, results STRING"
)
HISTORY_FILE = HISTORY + ", dt DATE"
METRICS = "STRUCT<silhouette: DOUBLE, optimal_k: INT, vocab_size: BIGINT>"
API_FIELDS = [
    "url", "total_items", "processing_time_sec", "human_time_mins",
    "takeaways", "cluster_counts", "metrics", "avg_subjectivity",
]
