"""Registered queries, each with its SQL twin where SQL can say the same."""
from . import audits, experiments, labelling, models, sampling, statistics, summaries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
