"""waypost: learn, calibrate, evaluate and apply model-routing policies on Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from waypost.operators.bootstrap import paired_bootstrap  # noqa: E402
from waypost.functions.merkle import changed_leaves, digest_diff, digest_entries, digest_tree
from waypost.operators.asof import calibrate_as_of
from waypost.operators.calibrate import budget_curve, calibrate, fit_isotonic, fit_platt
from waypost.operators.heads import fit_logistic, fit_logistic_gd, score, score_by_join
from waypost.operators.metrics import policy_metrics
from waypost.operators.normalize import normalize_heldout, normalize_outcomes
from waypost.operators.policy import policy_grid, select_policy
from waypost.operators.prefixes import context_tokens, render_prefixes
from waypost.operators.secrets import redact, scan_for_secrets
from waypost.operators.validate import validate_matrix
from waypost.plans.conversations import route_conversations, route_counts, switch_counts
from waypost.plans.evaluate import EvaluationTables, evaluate_router
from waypost.plans.model import RouterModel
from waypost.plans.payloads import route_payloads
from waypost.plans.route import route
from waypost.plans.train import train_router
from waypost.sources.heads import import_artifact, import_head
from waypost.sources.readers import read_conversations, read_heldout, read_model_cards, read_outcomes
from waypost.sources.sinks import write_checked, write_jsonl
from waypost.streaming.monitor import late_rows, session_monitor, window_monitor
from waypost.streaming.ordered import ordered_switch_stream
from waypost.streaming.routing import route_payload_stream, route_stream
from waypost.streaming.switches import switch_stream

__all__ = [
    "EvaluationTables",
    "RouterModel",
    "budget_curve",
    "calibrate",
    "calibrate_as_of",
    "changed_leaves",
    "context_tokens",
    "digest_diff",
    "digest_entries",
    "digest_tree",
    "evaluate_router",
    "fit_isotonic",
    "fit_logistic",
    "fit_logistic_gd",
    "fit_platt",
    "import_artifact",
    "import_head",
    "late_rows",
    "normalize_heldout",
    "normalize_outcomes",
    "ordered_switch_stream",
    "paired_bootstrap",
    "policy_grid",
    "policy_metrics",
    "read_conversations",
    "read_heldout",
    "read_model_cards",
    "read_outcomes",
    "redact",
    "render_prefixes",
    "route",
    "route_conversations",
    "route_counts",
    "route_payload_stream",
    "route_payloads",
    "route_stream",
    "scan_for_secrets",
    "score",
    "score_by_join",
    "select_policy",
    "session_monitor",
    "switch_counts",
    "switch_stream",
    "train_router",
    "validate_matrix",
    "window_monitor",
    "write_checked",
    "write_jsonl",
]
