"""Structured Streaming use of the fitted, stateless cleaning steps.

The original workflow is batch-only.  What carries over to a stream without
new semantics are the steps that are pure per-row functions once fitted:
the business-rule filter (CLN3), winsor clipping with fitted bounds (CLN4),
label encoding with a fitted mapping (FE1) and scoring with a saved
``PipelineModel`` (SNK4).  Aggregating reports stay batch jobs.  Nothing here
keeps state, so no watermark is needed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from tabsmith.operators.clean import REFERENCE_RULES, Rule, WinsorModel, apply_rules
from tabsmith.operators.features import LabelEncoder


def clean_stream(stream: DataFrame, rules: Sequence[Rule] = REFERENCE_RULES,
                 winsor: WinsorModel | None = None,
                 encoder: LabelEncoder | None = None, strict: bool = False) -> DataFrame:
    """Apply fitted row-wise cleaning to a streaming (or batch) DataFrame.

    Unseen categories become NULL by default (``strict=False``): a stream
    should not fail on one new value."""
    out = apply_rules(stream, rules)
    if winsor is not None:
        out = winsor.transform(out)
    if encoder is not None:
        out = encoder.transform(out, strict=strict)
    return out


def score_stream(stream: DataFrame, pipeline_model) -> DataFrame:
    """Score a stream with a saved assembler + classifier pipeline."""
    return pipeline_model.transform(stream)
