"""Queries of the analysis views: histograms, quantiles, samples, running series, diffs, the semantic model and history."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import sphere
from .marts import PRODUCTION_CUT, RES, after_change

MIN_ORGS = 5
BINS = 44
ROAD_KMH, JET_KMH = 90, 900
#: Log-spaced bins: 2 up to road speed, 22 between road and jet, 8 beyond. The outer edges are those of the data, with a
#: margin; the two reference speeds are always edges, so that every bin lies in one regime.
SLOW_BINS, MIDDLE_BINS, FAST_BINS = 2, 22, 8
LOW_MARGIN, HIGH_MARGIN = 0.92, 1.06
MIDDLE_EDGES = [ROAD_KMH * (JET_KMH / ROAD_KMH) ** (k / MIDDLE_BINS) for k in range(1, MIDDLE_BINS)]
DIFF_FIELDS = ("org_id", "ein", "name", "cause", "city", "state", "blurb")

OFFSETS, BEFORE = (60, 120, 300, 600, 1800, 3600), 300  # seconds

MODEL = [
    ("TABLE", "orgs", "charities, nonprofits, organisations"), ("TABLE", "disb", "disbursements, deliveries, aid shipments"),
    ("DIMENSION", "state", "province, region"), ("DIMENSION", "cause", "sector, category, programme area"), ("DIMENSION", "city", "town"),
    ("DIMENSION", "geometry_verdict", "geometry verdict, plausibility"), ("DIMENSION", "district", "area, locality"), ("DIMENSION", "status", "delivery status, stage"),
    ("METRIC", "total_usd", "total disbursed, money moved"), ("METRIC", "flagged_pct", "flag rate, share flagged"), ("METRIC", "delivered_usd", "value delivered, confirmed delivery value"), ("METRIC", "event_count", "shipments, number of deliveries"),
    ("FACT", "amount_usd", ""), ("FACT", "pledged_usd", ""),
]
SHAPE = "(VALUES " + ", ".join(f"('{k}', '{n}', '{s}')" for k, n, s in MODEL) + ") AS t(object_kind, object_name, synonyms)"


def _uniform(d, ident: str) -> str:
    """A number in (0, 1) that belongs to an identifier: samples repeat, on any cluster."""
    return f"(({d.hash_mod(ident, 1_000_000)} + 0.5) / 1000000)"


def _sample(d, n: int) -> str:
    """Weighted sample without replacement: the smallest -ln(u) / w."""
    u = _uniform(d, f"concat({d.text('suspect_id')}, '-', {d.text('target_id')})")
    return f"""SELECT suspect_id, target_id, round(evasion_gap, 6) AS evasion_gap FROM (SELECT *, -ln({u}) / pow(greatest(evasion_gap, 0.01), 2) AS draw FROM {{clone_pairs}}) s
        ORDER BY round(draw, 9), suspect_id, target_id LIMIT {n}"""


def _bins(d) -> str:
    """Distances in equal bins on either side of the 0.99 quantile of the plausible ones."""
    return f"""WITH cut AS (SELECT {d.quantile_of("delivery_geometry", "km", "geometry_verdict = 'PLAUSIBLE'", 0.99)} AS km_cut, max(km) AS km_max FROM {{delivery_geometry}}),
        placed AS (SELECT g.km > c.km_cut AS beyond, least({BINS - 1}, cast(floor(CASE WHEN g.km > c.km_cut THEN (g.km - c.km_cut) / nullif(c.km_max - c.km_cut, 0) ELSE g.km / nullif(c.km_cut, 0) END * {BINS}) AS int)) AS bin FROM {{delivery_geometry}} g CROSS JOIN cut c)
        SELECT beyond, bin, count(*) AS deliveries FROM placed GROUP BY beyond, bin ORDER BY beyond, bin"""


def _speed_edges() -> list[str]:
    """All edges, lowest first, as expressions over ``low`` and ``high``."""
    log = lambda a, b, n: [f"{a} * pow(({b}) / ({a}), {k}.0 / {n})" for k in range(1, n)]
    road, jet = f"{ROAD_KMH}.0e0", f"{JET_KMH}.0e0"
    return ["low", *log("low", road, SLOW_BINS), road, *(f"{e!r}e0" for e in MIDDLE_EDGES), jet, *log(jet, "high", FAST_BINS), "high"]


_SPEEDS = "SELECT km / transit_hours AS kmh FROM {delivery_geometry} WHERE transit_hours > 0 AND km > 0"
_OUTER = f"SELECT least(min(kmh), {ROAD_KMH}) * {LOW_MARGIN}e0 AS low, greatest(max(kmh), {JET_KMH}) * {HIGH_MARGIN}e0 AS high FROM v"


def _speed_bins(d) -> str:
    """Right-closed bins; deliveries within the hour have no speed. Every speed is placed once against one row of edges."""
    edges = _speed_edges()
    inside = " + ".join(f"CASE WHEN kmh > {e} THEN 1 ELSE 0 END" for e in edges[1:-1])
    at = lambda shift: "CASE bin " + " ".join(f"WHEN {k} THEN {edges[k + shift]}" for k in range(len(edges) - 1)) + " END"
    return f"""WITH v AS ({_SPEEDS}), o AS ({_OUTER}), b AS (SELECT cast({inside} AS int) AS bin, low, high FROM v CROSS JOIN o),
        g AS (SELECT bin, low, high, count(*) AS deliveries FROM b GROUP BY bin, low, high) SELECT bin, round({at(0)}, 6) AS from_kmh, round({at(1)}, 6) AS to_kmh, deliveries FROM g ORDER BY bin"""


def _speed_bins_naive(d) -> str:
    """The edges as a list, each speed against each edge."""
    log = lambda a, b, n: f"[exp(ln({a}) + (ln({b}) - ln({a})) * k / {n}) for k in range({n})]"
    edges = f"list_concat(list_concat({log('low', ROAD_KMH, SLOW_BINS)}, {log(ROAD_KMH, JET_KMH, MIDDLE_BINS)}), list_concat({log(JET_KMH, 'high', FAST_BINS)}, [high]))"
    return f"""WITH v AS ({_SPEEDS}), o AS ({_OUTER}), e AS (SELECT {edges} AS x FROM o), i AS (SELECT unnest(range(len(x) - 1))::INT AS bin, x FROM e), b AS (SELECT bin, x[bin + 1] AS a, x[bin + 2] AS z FROM i)
        SELECT bin, round(a, 6) AS from_kmh, round(z, 6) AS to_kmh, count(*) AS deliveries FROM b JOIN v ON kmh > a AND kmh <= z GROUP BY ALL"""


def _cumulative(d) -> str:
    money = lambda v: f"sum(CASE WHEN status IN ({v}) THEN amount_usd ELSE 0 END)"
    run = lambda x: f"cast(sum({x}) OVER (ORDER BY week) AS double)"
    moved = "'DISPATCHED', 'DELIVERED', 'UNACCOUNTED'"
    return f"""SELECT week, {run('delivered')} AS delivered_usd, {run('greatest(moved - delivered - lost, 0)')} AS in_flight_usd, {run('lost')} AS unaccounted_usd
        FROM (SELECT {d.week('dispatched_at')} AS week, {money(moved)} AS moved, {money("'DELIVERED'")} AS delivered, {money("'UNACCOUNTED'")} AS lost FROM {{disbursements}} GROUP BY 1) w ORDER BY week"""


def _diff(d) -> str:
    """The widest pair field by field: what a reader compares, and whether it is the same."""
    both = ", ".join(f"{d.text('t.' + f)} AS t_{f}, {d.text('s.' + f)} AS s_{f}" for f in DIFF_FIELDS)
    rows = " UNION ALL ".join(f"SELECT '{f}' AS field, t_{f} AS verified, s_{f} AS seeded, lower(trim(t_{f})) = lower(trim(s_{f})) AS same FROM pair" for f in DIFF_FIELDS)
    if d.name == "spark":
        stack = ", ".join(f"'{f}', t_{f}, s_{f}" for f in DIFF_FIELDS)
        rows = f"SELECT field, verified, seeded, lower(trim(verified)) = lower(trim(seeded)) AS same FROM (SELECT stack({len(DIFF_FIELDS)}, {stack}) AS (field, verified, seeded) FROM pair)"
    return f"WITH first AS (SELECT suspect_id, target_id FROM {{clone_pairs}} ORDER BY round(evasion_gap, 6) DESC, suspect_id, target_id LIMIT 1), pair AS (SELECT {both} FROM first JOIN {{orgs}} t ON t.org_id = first.target_id JOIN {{orgs}} s ON s.org_id = first.suspect_id) {rows}"


def _domains(d) -> str:
    """The literals of each categorical column, quoted, as one list: the domains of a privacy policy."""
    one = lambda c: f"SELECT '{c}' AS column_name, {d.listagg(d.quoted(d.text(c)))} AS literals FROM {{beneficiary_facts}}"
    return " UNION ALL ".join(one(c) for c in ("district", "programme_code", "month_key", "cause"))


def _as_of(d, offsets: tuple[int, ...]) -> str:
    """One organisation as it was some seconds ago: the newest change until then. The clock stands at ``:now``, or at the
    organisation's last change; offsets beyond ``:retention`` give no row."""
    state = after_change(d, "c.score", "c")
    return f"""SELECT seconds, org_id, name, round({state['risk_score']}, 6) AS risk_score, {state['verdict']} AS verdict FROM (
        SELECT o.seconds, r.org_id, r.name, r.risk_score, r.verdict, r.is_verified, {d.newest('w.score', 'w.changed_at', 'w.seq')} AS score
        FROM (SELECT * FROM (VALUES {', '.join(f'({x})' for x in offsets)}) AS v(seconds) WHERE seconds <= :retention) o CROSS JOIN (SELECT * FROM {{org_risk}} WHERE org_id = :org) r
        CROSS JOIN (SELECT coalesce(cast(:now AS {d.moment}), max(changed_at)) AS now FROM {{score_changes}} WHERE org_id = :org) k
        LEFT JOIN (SELECT * FROM {{score_changes}} WHERE org_id = :org) w ON w.changed_at <= {d.seconds_before('k.now', 'o.seconds')} GROUP BY o.seconds, r.org_id, r.name, r.risk_score, r.verdict, r.is_verified) c"""


ANALYSIS: dict[str, Callable] = {
    "q_evidence": lambda d: "SELECT citation_id, claim, figure, magnitude, unit_type, region, issuing_body, published_on, url FROM {citations} ORDER BY published_on, citation_id LIMIT 20",
    "q_evidence_markers": lambda d: "SELECT citation_id, published_on, CASE WHEN top > 0 THEN round(16 + 22 * sqrt(magnitude / top), 6) ELSE 18.0 END AS marker_size FROM (SELECT *, max(magnitude) OVER (PARTITION BY unit_type) AS top FROM {citations}) c ORDER BY published_on, citation_id",
    "q_org_enriched": lambda d: "SELECT standing, count(*) AS orgs, count(CASE WHEN is_verified THEN 1 END) AS verified FROM {org_enriched} GROUP BY standing ORDER BY standing",
    "q_embedding_scope": lambda d: "SELECT o.org_id, o.is_synthetic FROM {orgs} o WHERE o.is_synthetic OR EXISTS (SELECT 1 FROM {orgs} s WHERE s.is_synthetic AND s.cause = o.cause AND s.state = o.state) ORDER BY o.org_id",
    "q_vector_check": lambda d: f"SELECT round({d.dot('a.unit', 'a.unit')}, 6) AS with_itself, round({d.dot('a.unit', 'b.unit')}, 6) AS with_another FROM (SELECT unit FROM {{org_vectors}} ORDER BY org_id LIMIT 1) a, (SELECT unit FROM {{org_vectors}} ORDER BY org_id DESC LIMIT 1) b LIMIT 1",
    "q_by_cause": lambda d: f"SELECT cause, orgs, delivery_rate, receipt_coverage FROM (SELECT cause, count(*) AS orgs, round(median(delivery_rate), 6) AS delivery_rate, round(median(receipt_coverage), 6) AS receipt_coverage FROM {{confidence_rank}} WHERE disbursements > 0 GROUP BY cause HAVING count(*) >= {MIN_ORGS} ORDER BY orgs DESC, cause LIMIT 12) c ORDER BY delivery_rate DESC, cause",
    "q_plausibility_cutoff": lambda d: "SELECT round({q}, 6) AS cutoff_km, count(*) AS plausible FROM {{delivery_geometry}} WHERE geometry_verdict = 'PLAUSIBLE'".format(q=d.quantile_of("delivery_geometry", "km", "geometry_verdict = 'PLAUSIBLE'", 0.99)),
    "q_distance_bins": _bins,
    "q_speed_bins": _speed_bins,
    "q_gap_percentile": lambda d: "SELECT count(*) AS pairs, round(100.0 * count(CASE WHEN evasion_gap <= :marker THEN 1 END) / greatest(count(*), 1), 4) AS percentile FROM {clone_pairs}",
    "q_k_histogram": lambda d: "WITH cells AS (SELECT district, programme_code, month_key, count(DISTINCT beneficiary_id) AS k FROM {beneficiary_facts} GROUP BY district, programme_code, month_key), top AS (SELECT least(max(k), greatest(:floor + 10, 60)) AS t FROM cells) SELECT least(k, t) AS k, count(*) AS cells, least(k, t) < :floor AS below_floor FROM cells CROSS JOIN top GROUP BY least(k, t) ORDER BY 1",
    "q_narrowing_ladder": lambda d: "SELECT filters_applied, count(CASE WHEN people >= :floor THEN 1 END) AS answered, count(CASE WHEN people < :floor THEN 1 END) AS refused FROM {cohort_cells} GROUP BY filters_applied ORDER BY filters_applied",
    "q_money_cumulative": _cumulative,
    "q_org_ratios": lambda d: "SELECT org_id, count(*) AS disbursements, cast(sum(amount_usd) AS double) AS moved_usd, round(cast(sum(CASE WHEN status = 'UNACCOUNTED' THEN amount_usd ELSE 0 END) AS double) / greatest(cast(sum(amount_usd) AS double), 1.0), 6) AS unaccounted_ratio, round(cast(sum(CASE WHEN status = 'DELIVERED' THEN amount_usd ELSE 0 END) AS double) / greatest(cast(sum(amount_usd) AS double), 1.0), 6) AS delivery_rate FROM {disbursements} GROUP BY org_id",
    "q_nearest_threshold": lambda d: f"SELECT suspect_id, target_id, round(semantic_sim, 6) AS semantic_sim FROM {{scored_pairs}}{d.source} ORDER BY round(abs({d.of}semantic_sim - {PRODUCTION_CUT}), 9), suspect_id, target_id LIMIT 10",
    "q_sample_pair": lambda d: _sample(d, 1),
    "q_sample_pairs": lambda d: _sample(d, 5),
    "q_record_diff": _diff,
    "q_flow_lines": lambda d: f"SELECT g.disbursement_id, o.lon AS from_lon, round(g.lon, 6) AS to_lon, round(g.lon - 360.0 * {d.half_even('(g.lon - o.lon) / 360.0')}, 6) AS to_lon_unwrapped FROM {{delivery_geometry}} g JOIN {{orgs}} o ON o.org_id = g.org_id ORDER BY g.disbursement_id LIMIT 9000",
    "q_org_footprint": lambda d: "SELECT max_hops, count(*) AS orgs, min(footprint_cells) AS footprint_cells FROM {org_footprint} GROUP BY max_hops ORDER BY max_hops",
    "q_trust_labels": lambda d: "SELECT CASE WHEN trust >= 90 THEN 'strong' WHEN trust >= 65 THEN 'ordinary' WHEN trust >= 45 THEN 'thin' ELSE 'needs a second look' END AS band, count(*) AS orgs, round(min(trust), 6) AS least FROM (SELECT 100 - round(risk_score, 6) AS trust FROM {org_risk}) t GROUP BY 1 ORDER BY least DESC",
    "q_district_attrition_events": lambda d: "SELECT district, events, moved_usd, delivered_usd, round(attrition_rate, 6) AS attrition_rate, round(mean_transit_hours, 6) AS mean_transit_hours FROM {district_attrition} ORDER BY district",
    "q_district_observed": lambda d: "SELECT g.district, min(dim.country) AS country, round(avg(g.lat), 6) AS centroid_lat, round(avg(g.lon), 6) AS centroid_lon, min(g.cell) AS cell FROM {delivery_geometry} g LEFT JOIN {district_dim} dim ON dim.district = g.district WHERE g.lat IS NOT NULL GROUP BY g.district ORDER BY g.district",
    "q_domain_literals": _domains,
    "q_filings": lambda d: "SELECT org_id, ein, name, ntee_code, cause, blurb, lat, lon, max_hops, is_verified FROM {filings} ORDER BY org_id",
    "q_semantic_shape": lambda d: f"SELECT object_kind, object_name, synonyms FROM {SHAPE} ORDER BY object_kind, object_name",
    "q_semantic_counts": lambda d: f"SELECT object_kind, count(DISTINCT object_name) AS objects, cast(sum(CASE WHEN synonyms = '' THEN 0 ELSE length(synonyms) - length(replace(synonyms, ',', '')) + 1 END) AS bigint) AS synonyms FROM {SHAPE} GROUP BY object_kind ORDER BY object_kind",
    "q_time_travel": lambda d: f"SELECT CASE WHEN seconds = 0 THEN 'current' ELSE 'before' END AS version, org_id, name, risk_score, verdict FROM ({_as_of(d, (0, BEFORE))}) v",
    "q_time_offsets": lambda d: f"SELECT seconds, org_id, risk_score FROM ({_as_of(d, OFFSETS)}) v ORDER BY seconds",
    "q_score_history": lambda d: "SELECT org_id, valid_from, valid_to, score, valid_to IS NULL AS is_current FROM {score_history} ORDER BY org_id, valid_from, seq",
    "q_apply_change": lambda d: "SELECT org_id, name, cast(:score AS double) AS risk_score, CASE WHEN :score >= 55 THEN 'needs a second look' WHEN is_verified THEN 'verified' ELSE 'unverified' END AS verdict FROM {org_risk} WHERE org_id = :org",
    "q_object_inventory": lambda d: _inventory(d),
}

LAYERS = {"STAGING": ("orgs", "disbursements", "beneficiaries", "filings"), "MARTS": ("org_activity", "attrition_stages", "cause_exposure", "receipt_coverage", "delivery_geometry", "org_risk", "citations", "district_dim", "clone_pairs"), "ORACLE": ("mint_queue", "mint_log")}
SERVED = ("confidence_rank", "provenance")


def _inventory(d) -> str:
    """Objects by layer; rows are counted where they are written, served ones are plans."""
    counts = " UNION ALL ".join(f"SELECT '{layer}' AS schema_name, count(*) AS n FROM {{{m}}}" for layer, names in LAYERS.items() for m in names)
    served = " UNION ALL ".join(f"SELECT 'SERVING' AS schema_name, '{m}' AS name" for m in SERVED)
    return f"SELECT schema_name, count(*) AS objects, cast(0 AS bigint) AS views, cast(sum(n) AS bigint) AS total_rows FROM ({counts}) t GROUP BY schema_name UNION ALL SELECT schema_name, count(*), count(*), cast(0 AS bigint) FROM ({served}) s GROUP BY schema_name"


# What the adapter says of an order, for checking SQL that reads the source table alone.
STATUS = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'UNACCOUNTED' WHEN o_orderstatus = 'P' THEN 'PLEDGED' WHEN o_orderstatus = 'O' THEN 'DISPATCHED' ELSE 'DELIVERED' END"
ORDERS = f"(SELECT *, {STATUS} AS status, o_totalprice::DECIMAL(12,2) AS pledged FROM {{orders}})"


def _money(kind: str, name: str) -> str:
    return f"coalesce(sum(pledged) FILTER (WHERE status IN ({kind})), 0)::DOUBLE AS {name}"


def _landscape_naive(d) -> str:
    """The eight groupings, one query each."""
    keys, parts = ("district", "programme_code", "month_key"), []
    for n in range(8):
        used = [k for i, k in enumerate(keys) if n >> i & 1]
        shown = ", ".join(k if k in used else (f"NULL::BIGINT AS {k}" if k == "district" else f"'any' AS {k}") for k in keys)
        parts.append(f"SELECT {shown}, {len(used)} AS filters_applied, count(DISTINCT beneficiary_id) AS people, count(*) AS records, sum(amount_usd::DECIMAL(12,2))::DOUBLE AS usd FROM {{beneficiary_facts}}" + (f" GROUP BY {', '.join(used)}" if used else ""))
    return " UNION ALL ".join(parts)


def _footprint_naive(d) -> str:
    """Breadth-first search over neighbours, a step at a time."""
    bases = "SELECT DISTINCT basef AS bf, basex AS bx, basey AS bz, least(max_hops, 8)::INT AS reach, basef AS atf, basex AS atx, basey AS aty, 0 AS step FROM {org_cells}"
    onward = sphere.disk(d, "SELECT * FROM walk WHERE step < reach", RES, "at", "1", 1, "nx")
    return f"""WITH RECURSIVE walk AS ({bases} UNION SELECT bf, bx, bz, reach, nxf, nxx, nxy, step + 1 FROM ({onward}) n), size AS (SELECT bf, bx, bz, reach, count(DISTINCT (atf, atx, aty)) AS cells FROM walk GROUP BY ALL)
        SELECT o.max_hops, count(*) AS orgs, min(s.cells) AS footprint_cells FROM {{org_cells}} o JOIN size s ON (s.bf, s.bx, s.bz, s.reach) = (o.basef, o.basex, o.basey, least(o.max_hops, 8)) GROUP BY 1"""


#: Plain SQL of the checking engine, independent of the plans above.
DIRECT: dict[str, Callable] = {
    "q_evidence_markers": lambda d: "SELECT c.citation_id, c.published_on, round(16 + 22 * (c.magnitude / m.top) ** 0.5, 6) AS marker_size FROM {citations} c JOIN (SELECT unit_type, max(magnitude) AS top FROM {citations} GROUP BY 1) m USING (unit_type)",
    "q_org_enriched": lambda d: "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'seeded' WHEN c_acctbal < -500 AND c_custkey % 3 <> 0 THEN 'no longer in good standing' WHEN c_acctbal >= 0 THEN 'verified' ELSE 'unverified' END AS standing, count(*) AS orgs, count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_acctbal >= 0) AS verified FROM {customer} GROUP BY 1",
    "q_embedding_scope": lambda d: "SELECT c_custkey AS org_id, c_custkey % 10 = 0 AS is_synthetic FROM {customer} WHERE (c_mktsegment, c_nationkey) IN (SELECT (c_mktsegment, c_nationkey) FROM {customer} WHERE c_custkey % 10 = 0)",
    "q_plausibility_cutoff": lambda d: "SELECT round(quantile_cont(km, 0.99), 6) AS cutoff_km, count(*) AS plausible FROM {delivery_geometry} WHERE geometry_verdict = 'PLAUSIBLE'",
    "q_speed_bins": _speed_bins_naive,
    "q_narrowing_ladder": lambda d: "WITH q AS (" + " UNION ALL ".join(f"SELECT {len(c)} AS filters_applied, count(DISTINCT beneficiary_id) AS people FROM {{beneficiary_facts}}" + (f" GROUP BY {', '.join(c)}" if c else "") for c in ((), ("district",), ("programme_code",), ("month_key",), ("district", "programme_code"), ("district", "month_key"), ("programme_code", "month_key"), ("district", "programme_code", "month_key"))) + ") SELECT filters_applied, count(*) FILTER (WHERE people >= :floor) AS answered, count(*) FILTER (WHERE people < :floor) AS refused FROM q GROUP BY 1",
    "q_org_footprint": _footprint_naive,
    "q_semantic_shape": lambda d: "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '{s}')" for k, n, s in MODEL) + ") t(object_kind, object_name, synonyms)",
    "q_semantic_counts": lambda d: "SELECT * FROM (VALUES ('DIMENSION', 6, 12), ('FACT', 2, 0), ('METRIC', 4, 8), ('TABLE', 2, 6)) t(object_kind, objects, synonyms)",
    "q_time_offsets": lambda d: "WITH c AS (SELECT * FROM {score_changes} WHERE org_id = :org), n AS (SELECT max(changed_at) AS t FROM c) SELECT s AS seconds, r.org_id, round(coalesce((SELECT score FROM c, n WHERE changed_at <= t - to_seconds(s) ORDER BY changed_at DESC, seq DESC LIMIT 1), r.risk_score), 6) AS risk_score FROM (SELECT unnest([60, 120, 300, 600, 1800, 3600])::INT AS s) o, {org_risk} r WHERE r.org_id = :org",
    "q_score_history": lambda d: "SELECT a.org_id, a.changed_at AS valid_from, min(b.changed_at) AS valid_to, a.score, min(b.changed_at) IS NULL AS is_current FROM {score_changes} a LEFT JOIN {score_changes} b ON b.org_id = a.org_id AND (b.changed_at, b.seq) > (a.changed_at, a.seq) GROUP BY a.org_id, a.changed_at, a.seq, a.score",
    "q_edited_rows": lambda d: "WITH c AS (SELECT DISTINCT ON (org_id) org_id, score FROM {score_changes} ORDER BY org_id, changed_at DESC, seq DESC) SELECT r.org_id, round(c.score, 6) AS risk_score FROM {org_risk} r JOIN c USING (org_id) WHERE abs(c.score - r.risk_score) > 0.001 ORDER BY abs(c.score - r.risk_score) DESC, r.org_id LIMIT 50",
    "q_evidence": lambda d: "SELECT * FROM {citations} ORDER BY published_on",
    "q_cohort_landscape": _landscape_naive,
    "q_programme_flow": lambda d: "SELECT o_orderpriority AS programme_code, count(*) AS disbursements, " + ", ".join(_money(f"'{k.upper()}'", k) for k in ("pledged", "dispatched", "delivered", "unaccounted")) + f" FROM {ORDERS} GROUP BY 1",
    "q_money_over_time": lambda d: "SELECT (o_orderdate::DATE - (isodow(o_orderdate) - 1)::INT) AS week, count(*) AS disbursements, " + _money("'DISPATCHED', 'DELIVERED', 'UNACCOUNTED'", "moved_usd") + ", " + _money("'UNACCOUNTED'", "unaccounted_usd") + f" FROM {ORDERS} GROUP BY 1",
    "q_delivery_rate_weekly": lambda d: f"SELECT (o_orderdate::DATE - (isodow(o_orderdate) - 1)::INT) AS week, count(*) AS moved, round(count(*) FILTER (WHERE status = 'DELIVERED') / count(*)::DOUBLE, 4) AS delivery_rate FROM {ORDERS} WHERE status <> 'PLEDGED' GROUP BY 1",
    "q_cause_exposure": lambda d: "SELECT c_mktsegment AS cause, count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_acctbal >= 0) AS verified_orgs, count(*) FILTER (WHERE c_custkey % 10 = 0) AS seeded_orgs, round(100.0 * seeded_orgs / verified_orgs, 6) AS imitations_per_100 FROM {customer} GROUP BY 1",
    "q_receipt_gap": lambda d: f"""WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(((o_orderkey * 37) % 5760)::INT) AS delivered_at FROM {ORDERS} WHERE status = 'DELIVERED'),
        e AS (SELECT delivered_at::DATE AS day, 1 AS expected, 0 AS actual FROM o UNION ALL SELECT (delivered_at + INTERVAL 1 DAY)::DATE, 0, 1 + (o_orderkey % 97 = 0)::INT FROM o WHERE o_orderkey % 30 <> 0), t AS (SELECT day, sum(expected)::BIGINT AS expected, sum(actual)::BIGINT AS actual FROM e GROUP BY 1)
        SELECT a.day, a.expected, a.actual, sum(b.expected)::BIGINT AS expected_total, sum(b.actual)::BIGINT AS actual_total, sum(b.expected - b.actual)::BIGINT AS gap FROM t a JOIN t b ON b.day <= a.day GROUP BY ALL ORDER BY a.day LIMIT 400""",
    "q_filings": lambda d: """WITH r AS (SELECT *, lpad(c_custkey::VARCHAR, 2, '0') || lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') AS ein FROM {customer}),
        f AS (SELECT *, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 90 * 1000000 END AS rev, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 11 * 1000 END AS older FROM r WHERE length(ein) = 9),
        g AS (SELECT *, older IS NOT NULL AND (rev IS NULL OR older >= rev) AS takes_older, row_number() OVER (PARTITION BY ein ORDER BY c_custkey) AS rn FROM f),
        h AS (SELECT *, CASE WHEN takes_older THEN older ELSE rev END AS revenue, list_extract(['arts and culture', 'education', 'environment', 'animals', 'medical', 'mental health', 'disease research', 'medical research', 'public safety', 'employment', 'food and agriculture', 'housing', 'disaster relief', 'recreation and sport', 'youth development', 'human services', 'international development', 'civil rights', 'community development', 'philanthropy', 'science', 'social science', 'public benefit', 'religion', 'mutual benefit'], (c_custkey % 27 + 1)::INT) AS named FROM g)
        SELECT 'ORG_' || ein AS org_id, ein, CASE WHEN takes_older THEN c_name || ' Older' ELSE c_name END AS name, CASE c_custkey % 27 WHEN 26 THEN '[' ELSE chr((65 + c_custkey % 27)::INT) END || '20' AS ntee_code, coalesce(named, 'unclassified') AS cause, coalesce(named, 'unclassified') || ' organisation serving City ' || (c_custkey % 97) AS blurb,
        ((c_nationkey * 37) % 120)::DOUBLE - 60 AS lat, ((c_nationkey * 71) % 360)::DOUBLE - 180 AS lon, CASE WHEN revenue >= 50000000 THEN 40 WHEN revenue >= 5000000 THEN 24 WHEN revenue >= 500000 THEN 14 WHEN revenue >= 50000 THEN 8 ELSE 5 END AS max_hops, c_custkey % 9 <> 0 AND NOT (c_custkey % 7 = 0 AND c_custkey % 14 <> 0) AS is_verified FROM h""",
}
