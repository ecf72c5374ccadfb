"""All queries of the library outside the training-data operators, with their SQL."""

from __future__ import annotations

from tracklake.plans import aggregate_queries, batch_queries, cluster_queries, evaluation_queries, feature_queries, image_queries, index_queries, instance_queries, join_queries, linking_queries, model_queries, more_queries, probe_queries, score_queries, signal_queries, smoothness_queries, study_queries, template_queries, texture_queries, track_queries

_MODULES = (track_queries, aggregate_queries, join_queries, index_queries, model_queries, image_queries, evaluation_queries, study_queries, score_queries, template_queries, batch_queries, instance_queries, cluster_queries, feature_queries, probe_queries, smoothness_queries, texture_queries, linking_queries, signal_queries, more_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict = {name: q for m in _MODULES for name, q in m.SQL.items()}
