"""pairmatch: argument / key-point matching and its evaluation as Spark DataFrame plans.

The common entry points, re-exported::

    from pairmatch import get_spark, load_tables, get_predictions, mean_average_precision
"""

from .operators.matching import best_match, get_predictions, match_coverage
from .operators.metrics import (binary_metrics, group_average_precision, mean_average_precision,
                                roc_auc)
from .operators.pairs import candidate_pairs, labelled_pairs
from .plans.evaluate import calc_map, evaluate_run
from .session import get_spark
from .sources.fixtures import load_tables

__all__ = [
    "get_spark", "load_tables", "labelled_pairs", "candidate_pairs", "best_match",
    "get_predictions", "match_coverage", "binary_metrics", "roc_auc",
    "group_average_precision", "mean_average_precision", "calc_map", "evaluate_run",
]
