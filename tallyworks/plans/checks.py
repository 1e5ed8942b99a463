"""Acceptance checks: invariants of the marts as rows (check_id, area, statement, result), failures first.

Each mart is summed up once, in one row of measures; a rule is a measure with the bounds within which it passes.
"""

from __future__ import annotations

from .marts import CITATIONS, CONFIRM_GAP, PRODUCTION_CUT, SECOND_LOOK


def _n(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


_TOTAL = "abs(least(100.0, comp_semantic + comp_evasion + comp_geometry + comp_unaccounted + comp_receipts) - risk_score)"
_BY_ORG = "{t} JOIN (SELECT org_id AS o_id, is_synthetic AS o_synthetic FROM {{orgs}}) o ON o.o_id = {c}"
MANY = 1 << 62

#: source (one row each) -> measure -> expression
MEASURES = {
    "{orgs}": {"untagged": _n("is_synthetic AND batch_id <> 'SYNTH_ADVERSARY_V1'"), "seeded_verified": _n("is_synthetic AND is_verified")},
    _BY_ORG.format(t="{clone_pairs}", c="suspect_id"): {"real_suspects": _n("NOT o_synthetic"), "below_cut": _n(f"semantic_sim IS NULL OR semantic_sim < {PRODUCTION_CUT}"), "detected": "count(*)", "narrow": _n(f"semantic_sim >= 0.635 AND evasion_gap >= {CONFIRM_GAP}")},
    "{scored_pairs}": {"at_cut": _n(f"semantic_sim >= {PRODUCTION_CUT}")},
    "{clone_confirmed}": {"confirmed": _n("confirmation_method IS NOT NULL")},
    "{org_risk}": {"real_flagged": _n("NOT is_synthetic AND verdict = 'needs a second look'"), "unlabelled": _n(f"risk_score >= {SECOND_LOOK} AND verdict <> 'needs a second look'"), "off_total": _n(f"{_TOTAL} > 0.001")},
    "{org_risk_now}": {"edited": _n(f"{_TOTAL} > 0.001")},
    _BY_ORG.format(t="{confidence_rank}", c="org_id"): {"ranked_seeded": _n("o_synthetic")},
    "{citations}": {"cited": _n("issuing_body IS NOT NULL")},
    "(SELECT org_id AS lost_id FROM {org_standing} WHERE NOT reinstated) s JOIN {org_enriched} e ON e.org_id = s.lost_id": {"hidden_loss": _n("standing = 'verified'")},
    "{cohort_cells}": {"more_people_than_records": _n("people > records"), "people_missing": "cast(coalesce(sum(CASE WHEN choice = 0 THEN people END), 0) - coalesce(sum(CASE WHEN choice = 1 THEN people END), 0) AS bigint)"},
    "{org_vectors}": {"seeded_without_vector": _n("is_synthetic AND unit IS NULL")},
    "{delivery_geometry}": {"verdicts": "count(DISTINCT geometry_verdict)"},
    "{mint_log}": {"leaves": "count(*)", "without_asset": _n("asset_id IS NULL"), "receipted": "count(DISTINCT disbursement_id)"},
    "{disbursements}": {"delivered": _n("status = 'DELIVERED'")},
    "{provenance}": {"batches": "count(*)"},
}
#: (id, area, statement, measure, least, greatest, result otherwise)
RULES = [
    ("INT-01", "integrity", "Suspects are seeded organisations only", "real_suspects", 0, 0, "FAIL"),
    ("INT-02", "integrity", "A second look is asked for seeded organisations only", "real_flagged", 0, 0, "FAIL"),
    ("INT-03", "integrity", "Seeded rows name their batch", "untagged", 0, 0, "FAIL"),
    ("INT-04", "integrity", "Nothing seeded counts as verified", "seeded_verified", 0, 0, "FAIL"),
    ("INT-05", "integrity", "Nothing seeded is ranked by confidence", "ranked_seeded", 0, 0, "FAIL"),
    ("INT-06", "integrity", "Every cited figure has its issuing body", "cited", len(CITATIONS), len(CITATIONS), "FAIL"),
    ("INT-07", "integrity", "A lost standing is not shown as verified", "hidden_loss", 0, 0, "FAIL"),
    ("PRV-02", "privacy", "No cohort counts more people than it has records", "more_people_than_records", 0, 0, "FAIL"),
    ("PRV-05", "privacy", "Districts add up to all people: the floor counts each once", "people_missing", 0, 0, "FAIL"),
    ("SIM-02", "similarity", "Seeded organisations have vectors", "seeded_without_vector", 0, 0, "FAIL"),
    ("SIM-09", "similarity", "All pairs at the production cut are detected, and no others", "at_cut - detected + below_cut", 0, 0, "FAIL"),
    ("SIM-10", "similarity", "Confirmed are the detected pairs that are close and spelled apart, each with its method", "narrow - confirmed", 0, 0, "FAIL"),
    ("RSK-06", "risk", "Scores are the sums of their components", "off_total", 0, 0, "FAIL"),
    ("RSK-06b", "risk", "No score was changed after it was computed", "edited", 0, 0, "REVIEW"),
    ("GEO-07", "geometry", "All four verdicts occur", "verdicts", 4, 4, "FAIL"),
    ("RCP-01", "receipts", "Over a hundred leaves are minted", "leaves", 101, MANY, "FAIL"),
    ("RCP-02", "receipts", "Leaves have assets", "without_asset", 0, 0, "FAIL"),
    ("RCP-03", "receipts", "Receipts lag behind deliveries", "delivered - receipted", 1, MANY, "FAIL"),
    ("CRF-03", "craft", "Provenance can be counted", "batches", 1, MANY, "FAIL"),
]


def _acceptance() -> str:
    say = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [f"(SELECT {', '.join(f'{e} AS {k}' for k, e in m.items())} FROM {source}) m{n}" for n, (source, m) in enumerate(MEASURES.items())]
    rules = ", ".join(f"({say(i)}, {say(area)}, {say(text)}, {k}, {say(bad)})" for k, (i, area, text, _, _, _, bad) in enumerate(RULES))
    passes = " ".join(f"WHEN {k} THEN {m} BETWEEN {low} AND {high}" for k, (_, _, _, m, low, high, _) in enumerate(RULES))
    # one row of all measures meets one row a rule
    return f"SELECT check_id, area, statement, result FROM (SELECT check_id, area, statement, CASE WHEN CASE k {passes} END THEN 'PASS' ELSE bad END AS result FROM (VALUES {rules}) AS r(check_id, area, statement, k, bad) CROSS JOIN {' CROSS JOIN '.join(rows)}) c ORDER BY CASE result WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END, check_id"


CHECKS = {"q_acceptance": _acceptance()}


def enforce(checks) -> None:
    """Raise if a check of an acceptance result fails; those under review pass."""
    if failed := [f"{r['check_id']}: {r['statement']}" for r in checks.where("result = 'FAIL'").collect()]:  # a row a rule
        raise AssertionError("; ".join(failed))
