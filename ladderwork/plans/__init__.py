"""Part of the engine; see README.md."""

from ladderwork.plans import boards, careers, context, curves, evaluation, fold_results, folds, gate, holdout, ingest, performance, reconciliation, reports, results, sampling, sensitivity, teams, timeline, warehouse  # noqa: F401
