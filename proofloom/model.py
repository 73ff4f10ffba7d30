"""Closed vocabularies and identity expressions of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules, their weights and required capabilities.
RULES = [
    ("node.changed_public_symbol@2", "node", "async.concurrent_reentry", 3.0, ["ast", "concurrency_model"]),
    ("relation.concurrent_reentry@1", "relation", "async.concurrent_reentry", 3.5, ["direct_calls", "concurrency_model"]),
    ("relation.changed_call_contract@1", "relation", "payment.idempotency_contract", 5.0, ["direct_calls"]),
    ("path.external_side_effect@1", "path", "payment.at_most_once", 6.0, ["direct_calls", "concurrency_model", "test_mapping"]),
    ("invariant.payment_at_most_once@1", "invariant", "payment.at_most_once", 7.0, ["direct_calls", "concurrency_model", "test_mapping"]),
    ("relation.changed_public_callee@1", "relation", "rust.callee_contract_review@1", 4.0, ["ast", "containment", "changed_structure"]),
    ("node.public_function_contract@1", "node", "rust.public_function_contract_review@1", 3.0, ["ast", "containment"]),
]
# Legal lifecycle steps.
TRANSITIONS = [
    ("generated", "planned"), ("planned", "in_progress"), ("in_progress", "completed"),
    *[(a, b) for a in ("generated", "planned", "in_progress") for b in ("stale", "superseded", "cancelled")],
    ("completed", "stale"), ("completed", "superseded"),
]
# Coverage needs ppm of 1,000,000; discovery keeps 600,000 or more.
PPM, SIGNAL_PPM = 1_000_000, 600_000
# Reasons for unresolved calls, strongest first.
UNRESOLVED_REASONS = [
    "parse_failure", "unsupported_syntax", "unsupported_caller", "dynamic_dispatch", "relative_specifier_unsupported", "relative_target_unread",
    "relative_target_ambiguous", "relative_target_excluded", "relative_target_missing", "import_binding_ambiguous", "type_only_binding",
    "export_binding_unsupported", "import_resolution_unavailable", "shadowed_binding", "written_binding", "unresolved_name",
]


def stable_id(kind: str, *parts: Column) -> Column:
    """kind:sha256:<hex> of the parts joined by '|'; a null part counts as empty."""
    return F.concat(F.lit(f"{kind}:sha256:"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def digest(items: Column) -> Column:
    """sha256 of the sorted items of a collected array, joined by ','."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def ppm(part: Column, whole: Column) -> Column:
    """floor(part / whole * 1,000,000), 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part.cast("long") * F.lit(PPM).cast("long") / whole).cast("long"))
