"""Labelled time spans over ordered, time-stamped segments, as DataFrames.

The names that most programs need are found here; they are imported when they are first asked for, so that a Python
worker that needs one module doesn't load them all.
"""

from importlib import import_module

_NAMES = {
    "classify": "plans.classify", "dry_run": "plans.classify", "effective_version": "plans.classify", "Result": "plans.classify", "build_records": "sinks.records", "problems": "sinks.records", "export_all": "sinks.exporters",
    "score": "operators.scoring", "aggregate_scores": "operators.scoring", "RuleProposer": "operators.propose", "ReplayProposer": "operators.propose", "CallProposer": "operators.propose",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str) -> object:
    if name not in _NAMES:
        raise AttributeError(name)
    return getattr(import_module(f"spanloom.{_NAMES[name]}"), name)
