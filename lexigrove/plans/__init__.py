from .report import (
    METRIC_DIRECTIONS,
    best_by_metric,
    coherence_chart_data,
    compare_models,
    metric_curves,
    metric_deltas,
    metrics_long,
)
from .suite import ALGORITHMS, metric_table, run_suite, sweep

__all__ = [
    "ALGORITHMS",
    "METRIC_DIRECTIONS",
    "best_by_metric",
    "coherence_chart_data",
    "compare_models",
    "metric_curves",
    "metric_deltas",
    "metric_table",
    "metrics_long",
    "run_suite",
    "sweep",
]
