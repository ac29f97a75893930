"""Score blending, severity maps and routing weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import r6

# Label severities and routing weights.
LABEL_SEVERITY = {
    "hidden_executable_payload": 1.0, "packer_native_library": 1.0, "new_payload": 1.0, "benign_loader": 0.85,
    "loader_dex": 0.85, "resource_modification": 0.70, "manifest_modification": 0.60, "signature_modification": 0.50,
    "original_code": 0.0, "benign_library": 0.0, "unchanged": 0.0,
}
ROUTING = {
    "dex": (1.0, 0.0, 0.25), "elf": (0.0, 1.0, 0.25), "archive": (0.0, 0.0, 1.0), "asset": (0.0, 0.0, 1.0),
    "arsc": (0.0, 0.0, 1.0), "manifest": (0.0, 0.0, 1.0),
}
ROUTING_UNKNOWN = (0.25, 0.25, 0.25)


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(c / (F.lit(1.0) - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def blend(a: Column, b: Column, weight_a: float, weight_b: float, transform: str = "identity") -> Column:
    """Weighted mean of two scores, directly or in log-odds."""
    if transform not in ("identity", "logit") or weight_a + weight_b <= 0:
        raise ValueError("transform is identity or logit; weights must sum to more than 0")
    wa, wb = weight_a / (weight_a + weight_b), weight_b / (weight_a + weight_b)
    if transform == "identity":
        return r6(a * wa + b * wb)
    return r6(sigmoid(logit(a) * wa + logit(b) * wb))


def severity(label: Column, table: Mapping[str, float] = LABEL_SEVERITY, default: float = 0.5) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.coalesce(label, F.lit("unchanged"))), F.lit(default))


def severity_status(score: Column) -> Column:
    return F.when(score >= 0.9, "new").when(score > 0.0, "modified").otherwise("unchanged")


def registry_group(status: Column, license_name: Column, packer_id: Column) -> Column:
    """registered_not_patched, commercial or open_source."""
    return (
        F.when(F.trim(status) == "registered_not_patched", "registered_not_patched")
        .when(F.upper(F.trim(license_name)).startswith("COMMERCIAL") | packer_id.startswith("cs"), "commercial")
        .otherwise("open_source")
    )


def routed_score(entry_type: Column, bytecode: Column, native: Column, raw: Column) -> Column:
    """Three expert scores weighted by entry type."""
    pick = lambda i: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for k, w in ROUTING.items() for x in (k, w[i])]), entry_type),
        F.lit(ROUTING_UNKNOWN[i]),
    )
    return bytecode * pick(0) + native * pick(1) + raw * pick(2)
