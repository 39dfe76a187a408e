"""codesim: copied-code detection across submissions as Spark DataFrame plans.

Public API::

    from codesim import analyze, Params
    a = analyze(files_df, template_df, overall_thresh=0.4)
    a.pairs, a.flagged_files, a.submissions, a.term_counts, a.line_overlap
"""

from .params import Params
from .plans.analyze import Analysis, analyze

__all__ = ["Analysis", "Params", "analyze"]
