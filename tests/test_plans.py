"""Plan checks: column pruning reaches the parquet scans, and no query plans a cartesian
product or a nested-loop join."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from pairmatch.plans import catalog

SF = "/root/testdata/sf0.001"

# queries whose results need no document / page text
ID_ONLY = ["mean_average_precision", "average_precision", "best_match", "match_coverage",
           "binary_metrics", "roc_auc", "precision_recall_curve", "ensemble_scores",
           "ensemble_label_scores", "kfold_report", "topic_folds", "argument_folds",
           "fold_sizes", "label_counts", "stance_ratio", "label_mean_spread",
           "threshold_f1", "score_batch_softmax", "submission_map"]

def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ID_ONLY)
def test_no_text_read(spark, name):
    plan = formatted(E.queries()[name](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert schemas, "no parquet scan found"
    for s in schemas:
        assert "text:" not in s and "html:" not in s, s


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = formatted(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
