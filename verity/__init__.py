"""verity: data-quality inspection, scoring and repair on Spark DataFrames.

    from verity import inspect, score_frame, quality_report, autofix
"""

from .operators.inspect import Inspection, Inspector, IssueSpec, inspect
from .operators.repair import AutofixResult, autofix
from .operators.score import issue_digest, quality_report, score, score_frame

__version__ = "0.1.0"

__all__ = ["inspect", "Inspection", "Inspector", "IssueSpec", "autofix", "AutofixResult", "score",
           "score_frame", "quality_report", "issue_digest"]
