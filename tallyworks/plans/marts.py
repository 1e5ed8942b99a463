"""The marts as declarative SQL over source tables and each other.

Every mart is a function of the dialect; ``{name}`` refers to a source table or another mart. Spark resolves them as
DataFrames (one lazy plan for a query, so filters and columns are pushed to the scans), DuckDB as common table
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import sphere
from .dialect import written

SEMANTIC_FLOOR, SEMANTIC_SPAN = 0.86, 0.14  # where a similarity begins to score
SECOND_LOOK = 55
# Similarities are (1 + cosine) / 2 here. The cuts suit the test vectors, whose cosines stay below 0.5; the least gap of a
# confirmed pair is the production value.
PRODUCTION_CUT, CONFIRM_CUT, CONFIRM_GAP = 0.625, 0.635, 0.05
SWEEP, CALIBRATION = range(50, 80), range(55, 75)  # thresholds in hundredths
UNREACHABLE = 9999
RES, COARSE_RES = 6, 4  # cells some 20 km and 140 km apart
FOOTPRINT_STEPS = 8
EARTH_KM = 6371.0088


def centroid(k: str) -> tuple[str, str]:
    return f"(cast((({k}) * 37) % 120 AS double) - 60)", f"(cast((({k}) * 71) % 360 AS double) - 180)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {EARTH_KM} * asin(least(1.0, sqrt({a}))))"


def risk(sim: str, gap: str, flags: str, ratio: str, missing: str) -> dict[str, str]:
    return {
        "comp_semantic": f"35 * greatest(0.0, ({sim} - {SEMANTIC_FLOOR}) / {SEMANTIC_SPAN})",
        "comp_evasion": f"25 * least(1.0, {gap} / 0.45)",
        "comp_geometry": f"20 * least(1.0, {flags} / 5.0)",
        "comp_unaccounted": f"12 * least(1.0, {ratio})",
        "comp_receipts": f"8 * least(1.0, {missing} / 10.0)",
    }


def orgs(d) -> str:
    lat, lon = centroid("c_nationkey")
    return f"""SELECT c_custkey AS org_id, c_name AS name, {d.lpad("c_custkey", 9)} AS ein, concat('city ', {d.text("c_custkey % 97")}) AS city,
        {d.text("c_nationkey")} AS state, c_mktsegment AS cause, concat(c_mktsegment, ' relief') AS blurb, {lat} AS lat, {lon} AS lon,
        (c_custkey * 13) % 25 AS base_nation, cast(20 + c_custkey % 21 AS int) AS max_hops, c_custkey % 10 = 0 AS is_synthetic,
        (c_custkey % 10 <> 0 AND c_acctbal >= 0) AS is_verified, CASE WHEN c_custkey % 10 = 0 THEN 'SYNTH_ADVERSARY_V1' ELSE 'IRS_BMF_2026' END AS batch_id,
        CASE WHEN c_custkey % 10 = 0 THEN concat('technique_', {d.text(f"{d.idiv('c_custkey', '10')} % 5")}) END AS synth_technique,
        CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 END AS synth_target_id FROM {{customer}}"""


def disbursements(d, extra: str = "") -> str:
    nation = "((o_custkey * 13 + CASE WHEN o_orderkey % 20 = 0 THEN 11 ELSE 0 END) % 25)"
    lat, lon = centroid(nation)
    status = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'UNACCOUNTED' WHEN o_orderstatus = 'P' THEN 'PLEDGED' WHEN o_orderstatus = 'O' THEN 'DISPATCHED' ELSE 'DELIVERED' END"
    return f"""SELECT o_orderkey AS disbursement_id, o_custkey AS org_id, o_orderpriority AS programme_code, o_custkey % 997 AS beneficiary_id, {nation} AS district,
        {status} AS status, cast(o_totalprice AS decimal(12,2)) AS pledged_usd,
        CASE WHEN {status} = 'PLEDGED' THEN cast(0 AS decimal(12,2)) ELSE cast(o_totalprice AS decimal(12,2)) END AS amount_usd,
        {lat} + cast(o_orderkey % 100 - 50 AS double) / 50 AS lat, {lon} + cast(o_orderkey % 90 - 45 AS double) / 50 AS lon, o_orderdate AS dispatched_at,
        CASE WHEN {status} IN ('DELIVERED', 'DISPATCHED') THEN {d.add_minutes("o_orderdate", "cast((o_orderkey * 37) % 5760 AS int)")} END AS delivered_at,
        CASE WHEN o_custkey % 10 = 0 THEN 'SYNTH_ADVERSARY_V1' ELSE 'IRS_BMF_2026' END AS batch_id{', ' * bool(extra)}{extra} FROM {{orders}}"""


def district_dim(d) -> str:
    lat, lon = centroid("n_nationkey")
    return f"SELECT cast(n_nationkey AS bigint) AS district, n_name AS district_name, n_regionkey AS country, r_name AS region, {lat} AS centroid_lat, {lon} AS centroid_lon FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey"


def org_activity(d) -> str:
    s = lambda v: f"sum(CASE WHEN status IN ({v}) THEN amount_usd ELSE 0 END)"
    moved = s("'DISPATCHED', 'DELIVERED', 'UNACCOUNTED'")
    return f"""SELECT org_id, count(*) AS disbursements, count(DISTINCT district) AS districts, cast(sum(pledged_usd) AS double) AS pledged_usd, cast({moved} AS double) AS moved_usd,
        cast({s("'DELIVERED'")} AS double) AS delivered_usd, cast({s("'UNACCOUNTED'")} AS double) AS unaccounted_usd,
        cast({s("'UNACCOUNTED'")} AS double) / nullif(cast({moved} AS double), 0) AS unaccounted_ratio, cast({s("'DELIVERED'")} AS double) / nullif(cast({moved} AS double), 0) AS delivery_rate,
        min(dispatched_at) AS first_at, max(dispatched_at) AS last_at FROM {{disbursements}} GROUP BY org_id"""


def attrition_stages(d) -> str:
    s = lambda v: f"sum(CASE WHEN status IN ({v}) THEN pledged_usd ELSE 0 END)"
    return f"""SELECT cast(sum(pledged_usd) AS double) AS pledged_usd, cast({s("'DISPATCHED', 'DELIVERED', 'UNACCOUNTED'")} AS double) AS dispatched_usd, cast({s("'DELIVERED'")} AS double) AS delivered_usd,
        cast({s("'UNACCOUNTED'")} AS double) AS unaccounted_usd, cast(sum(pledged_usd) - {s("'DISPATCHED', 'DELIVERED', 'UNACCOUNTED'")} AS double) AS never_dispatched_usd FROM {{disbursements}}"""


def cause_exposure(d) -> str:
    real, seeded = "count(CASE WHEN is_verified AND NOT is_synthetic THEN 1 END)", "count(CASE WHEN is_synthetic THEN 1 END)"
    return f"SELECT cause, {real} AS verified_orgs, {seeded} AS seeded_orgs, round(100.0 * {seeded} / nullif({real}, 0), 6) AS imitations_per_100 FROM {{orgs}} GROUP BY cause"


def beneficiaries(d) -> str:
    """One row a person, from the first disbursement that reached them."""
    first = lambda x: d.any_least(x, "disbursement_id")
    return f"""SELECT beneficiary_id, {first("district")} AS district, {first("programme_code")} AS programme_code, {first("cause")} AS cause,
        CASE WHEN beneficiary_id % 20 < 11 THEN 'household' WHEN beneficiary_id % 20 < 17 THEN 'individual' ELSE 'group' END AS cohort_band
        FROM (SELECT x.beneficiary_id, x.district, x.programme_code, x.disbursement_id, o.cause FROM {{disbursements}} x JOIN {{orgs}} o ON o.org_id = x.org_id) f GROUP BY beneficiary_id"""


def beneficiary_facts(d) -> str:
    return f"""SELECT p.beneficiary_id, p.district, p.programme_code, p.cause, cast(x.amount_usd AS double) AS amount_usd, CASE WHEN x.status = 'DELIVERED' THEN 1 ELSE 0 END AS delivered_flag,
        {d.month("coalesce(x.delivered_at, x.dispatched_at)")} AS month_key FROM {{beneficiaries}} p JOIN {{disbursements}} x ON x.beneficiary_id = p.beneficiary_id"""


COHORT_KEYS = {"district": "bigint", "programme_code": "string", "month_key": "string"}


def cohort_cells(d) -> str:
    """People, records and money of every cell under all eight choices of filters.

    Facts become one row for each (person, finest cell); these are spread over the choices and made one for each (person,
    cell). All of it happens where the person's facts lie: an array is spread without losing the partitioning that
    grouping sets would lose. Only the sums of cells are shuffled.
    """
    keys = list(COHORT_KEYS)
    choices = [[k for i, k in enumerate(keys) if n >> i & 1] for n in range(8)]
    own = f"SELECT beneficiary_id, {', '.join(keys)}, count(*) AS records, sum(cast(amount_usd AS decimal(12,2))) AS usd FROM {{beneficiary_facts}} GROUP BY beneficiary_id, {', '.join(keys)}"
    shown = lambda c: ", ".join(f"{k} AS {k}" if k in c else f"cast(NULL AS {t if d.name == 'spark' or t == 'bigint' else 'VARCHAR'}) AS {k}" for k, t in COHORT_KEYS.items())
    if d.name == "spark":
        structs = ", ".join(f"struct({n} AS choice, {len(c)} AS filters_applied, {shown(c)})" for n, c in enumerate(choices))
        spread = f"SELECT beneficiary_id, records, usd, c.* FROM (SELECT beneficiary_id, records, usd, explode(array({structs})) AS c FROM ({own}) o) e"
    else:
        spread = " UNION ALL ".join(f"SELECT beneficiary_id, records, usd, {n} AS choice, {len(c)} AS filters_applied, {shown(c)} FROM ({own}) o{n}" for n, c in enumerate(choices))
    cell = f"choice, filters_applied, {', '.join(keys)}"
    people = f"SELECT beneficiary_id, {cell}, sum(records) AS records, sum(usd) AS usd FROM ({spread}) s GROUP BY beneficiary_id, {cell}"
    return f"SELECT {cell}, count(*) AS people, cast(sum(records) AS bigint) AS records, cast(sum(usd) AS double) AS usd FROM ({people}) p GROUP BY {cell}"


def mint_log(d) -> str:
    base = f"SELECT disbursement_id, concat('asset-', {d.text('disbursement_id')}) AS asset_id, {d.add_minutes('delivered_at', '1440')} AS minted_at, 0 AS copy FROM {{disbursements}} WHERE status = 'DELIVERED' AND disbursement_id % 30 <> 0"
    again = f"SELECT disbursement_id, concat('asset-', {d.text('disbursement_id')}, '-b') AS asset_id, {d.add_minutes('delivered_at', '1440')} AS minted_at, 1 AS copy FROM {{disbursements}} WHERE status = 'DELIVERED' AND disbursement_id % 30 <> 0 AND disbursement_id % 97 = 0"
    return f"{base} UNION ALL {again}"


def receipt_coverage(d) -> str:
    """A disbursement counts once for each leaf minted for it, and once without any: leaves are counted first, so the log
    meets one row a disbursement."""
    return """SELECT org_id, cast(sum(greatest(leaves, 1)) AS bigint) AS eligible_disbursements, cast(sum(leaves) AS bigint) AS receipts_on_chain,
        cast(sum(CASE WHEN leaves = 0 THEN 1 ELSE 0 END) AS bigint) AS receipts_missing, cast(sum(leaves) AS double) / nullif(sum(greatest(leaves, 1)), 0) AS receipt_coverage
        FROM (SELECT x.org_id, coalesce(l.leaves, 0) AS leaves FROM {disbursements} x LEFT JOIN (SELECT disbursement_id, count(asset_id) AS leaves FROM {mint_log} GROUP BY disbursement_id) l
              ON l.disbursement_id = x.disbursement_id WHERE x.status = 'DELIVERED' OR x.status = 'UNACCOUNTED') e GROUP BY org_id"""


def org_vectors(d) -> str:
    """Organisations with their unit vector and the two keys that similar ones must share."""
    return f"SELECT o.org_id, o.name, o.ein, o.cause, o.synth_technique, o.synth_target_id, o.is_synthetic, o.is_verified, e.label AS region, {d.unit('e.embedding')} AS unit FROM {{orgs}} o JOIN {{embeddings}} e ON e.vec_id = o.org_id"


def scored_pairs(d) -> str:
    """Similarities of seeded and real organisations that share region and cause. Spark multiplies blocks of vectors
    instead (``BUILT`` in compile.py); this text is for the checking engine."""
    return f"""SELECT s.org_id AS suspect_id, t.org_id AS target_id, t.org_id = s.synth_target_id AS recorded, (1 + {d.dot("s.unit", "t.unit")}) / 2 AS semantic_sim
        FROM (SELECT * FROM {{org_vectors}} WHERE is_synthetic) s JOIN (SELECT * FROM {{org_vectors}} WHERE is_verified AND NOT is_synthetic) t ON s.region = t.region AND s.cause = t.cause AND s.ein <> t.ein"""


def near_pairs(d) -> str:
    """The pairs at or above the production cut; also built in blocks."""
    return f"SELECT * FROM {{scored_pairs}} WHERE semantic_sim >= {PRODUCTION_CUT}"


def clone_pairs(d) -> str:
    """Detected pairs. Spelling is compared only for these, under the test data's product names."""
    return f"""SELECT *, semantic_sim - string_sim AS evasion_gap FROM (SELECT p.suspect_id, s.name AS suspect_name, p.target_id, t.name AS target_name, s.cause, s.synth_technique, p.recorded, p.semantic_sim, {d.jw("lower(a.p_name)", "lower(b.p_name)")} AS string_sim
        FROM {{near_pairs}} p JOIN {{orgs}} s ON s.org_id = p.suspect_id JOIN {{orgs}} t ON t.org_id = p.target_id JOIN {{part}} a ON a.p_partkey = p.suspect_id JOIN {{part}} b ON b.p_partkey = p.target_id) c"""


def clone_confirmed(d) -> str:
    return f"SELECT *, 'HEURISTIC' AS confirmation_method FROM {{clone_pairs}} WHERE semantic_sim >= {CONFIRM_CUT} AND evasion_gap >= {CONFIRM_GAP}"


def org_cells(d) -> str:
    """The cell of each organisation's base."""
    lat, lon = centroid("base_nation")
    return f"SELECT org_id, max_hops, lat, lon, basef, basex, basey FROM ({sphere.cell_at(written(d), f'SELECT *, {lat} AS base_lat, {lon} AS base_lon FROM {{orgs}}', RES, 'base_lat', 'base_lon', 'base')}) b"


def delivery_geometry(d) -> str:
    """Where deliveries went, in steps of cells from the base; places beyond the known distances count as unreachable."""
    met = f"""SELECT x.disbursement_id, x.org_id, x.district, x.programme_code, x.status, cast(x.amount_usd AS double) AS amount_usd, cast(x.pledged_usd AS double) AS pledged_usd, x.lat, x.lon, x.dispatched_at, o.max_hops, o.basef, o.basex, o.basey,
        {haversine("o.lat", "o.lon", "x.lat", "x.lon")} AS km, {d.hours("x.dispatched_at", "x.delivered_at")} AS transit_hours FROM {{disbursements}} x JOIN {{org_cells}} o ON o.org_id = x.org_id"""
    w = written(d)
    placed = sphere.distance(w, sphere.cell_id(w, sphere.cell_at(w, met, RES, "lat", "lon", "here"), RES, "here", "cell"), RES, "base", "here", "steps")
    return f"""SELECT disbursement_id, org_id, district, programme_code, status, amount_usd, pledged_usd, dispatched_at, lat, lon, max_hops, hops, km, transit_hours, cell,
        CASE WHEN status = 'UNACCOUNTED' THEN 'NEVER_ARRIVED' WHEN hops > max_hops THEN 'OUTSIDE_FOOTPRINT' WHEN transit_hours < 1 AND km > 400 THEN 'IMPOSSIBLE_TRANSIT' ELSE 'PLAUSIBLE' END AS geometry_verdict
        FROM (SELECT *, CASE WHEN cell IS NOT NULL THEN coalesce(steps, {UNREACHABLE}) END AS hops FROM ({placed}) g1) g2"""


def org_risk(d) -> str:
    parts = risk("semantic_sim", "evasion_gap", "geom_flags", "unaccounted_ratio", "missing_receipts")
    comps = ", ".join(f"{e} AS {n}" for n, e in parts.items())
    nearest = d.any_least("target_id", "1 - semantic_sim + target_id * 0.000000001")
    return f"""SELECT *, CASE WHEN risk_score >= {SECOND_LOOK} THEN 'needs a second look' WHEN is_verified THEN 'verified' ELSE 'unverified' END AS verdict FROM (
        SELECT *, least(100.0, comp_semantic + comp_evasion + comp_geometry + comp_unaccounted + comp_receipts) AS risk_score FROM (SELECT *, {comps} FROM (
        SELECT o.org_id, o.name, o.ein, o.city, o.state, o.cause, o.blurb, o.is_synthetic, o.is_verified, o.batch_id, o.synth_technique, coalesce(c.semantic_sim, 0.0) AS semantic_sim, greatest(0.0, coalesce(c.evasion_gap, 0.0)) AS evasion_gap,
        coalesce(g.geom_flags, 0) AS geom_flags, coalesce(a.unaccounted_ratio, 0.0) AS unaccounted_ratio, coalesce(r.receipts_missing, 0) AS missing_receipts, c.nearest_target_id
        FROM {{orgs}} o LEFT JOIN (SELECT suspect_id, max(semantic_sim) AS semantic_sim, max(evasion_gap) AS evasion_gap, {nearest} AS nearest_target_id FROM {{clone_pairs}} GROUP BY suspect_id) c ON c.suspect_id = o.org_id
        LEFT JOIN (SELECT org_id, count(CASE WHEN geometry_verdict <> 'PLAUSIBLE' THEN 1 END) AS geom_flags FROM {{delivery_geometry}} GROUP BY org_id) g ON g.org_id = o.org_id
        LEFT JOIN {{org_activity}} a ON a.org_id = o.org_id LEFT JOIN {{receipt_coverage}} r ON r.org_id = o.org_id) k1) k2) k3"""


def applied_changes(d) -> str:
    """Score changes that were applied through this library; the store's change log takes this table's place."""
    return f"SELECT cast(NULL AS bigint) AS org_id, cast(NULL AS {d.moment}) AS changed_at, cast(NULL AS bigint) AS seq, cast(NULL AS double) AS score WHERE 1 = 0"


def score_changes(d) -> str:
    """The log of score changes, which only grows: every seventh error report sets a score, and what was applied here."""
    return f"""SELECT user_id AS org_id, cast(ts AS {d.moment}) AS changed_at, event_id AS seq, cast(round(least(value, 100.0), 2) AS double) AS score FROM {{events}} WHERE event_type = 'error' AND event_id % 7 = 3
        UNION ALL SELECT org_id, changed_at, seq, score FROM {{applied_changes}}"""


def score_history(d) -> str:
    """Each change with the time for which it holds; the newest one of an organisation has no end."""
    return "SELECT org_id, seq, score, changed_at AS valid_from, lead(changed_at) OVER (PARTITION BY org_id ORDER BY changed_at, seq) AS valid_to FROM {score_changes}"


def after_change(d, score: str, r: str = "r") -> dict[str, str]:
    """A score and the verdict that follows from it; the components stay as they were computed."""
    return {"risk_score": f"coalesce({score}, {r}.risk_score)", "verdict": f"CASE WHEN {score} IS NULL THEN {r}.verdict WHEN {score} >= {SECOND_LOOK} THEN 'needs a second look' WHEN {r}.is_verified THEN 'verified' ELSE 'unverified' END"}


def org_risk_now(d) -> str:
    """The scores after all changes: the newest one of each organisation is found by an aggregate, not a window."""
    now = after_change(d, "e.score")
    return f"""SELECT r.org_id, r.name, r.is_synthetic, r.is_verified, r.comp_semantic, r.comp_evasion, r.comp_geometry, r.comp_unaccounted, r.comp_receipts, {now['risk_score']} AS risk_score, {now['verdict']} AS verdict
        FROM {{org_risk}} r LEFT JOIN (SELECT org_id AS edited_id, {d.newest('score', 'changed_at', 'seq')} AS score FROM {{score_changes}} GROUP BY org_id) e ON e.edited_id = r.org_id"""


def confidence_rank(d) -> str:
    """Delivery and receipts carry the confidence; half the risk is taken off."""
    return """SELECT org_id, ein, name, city, state, cause, blurb, round(delivery_rate, 6) AS delivery_rate, round(receipt_coverage, 6) AS receipt_coverage, value_moved_usd, disbursements, round(risk_score, 6) AS risk_score,
        round(round(60 * delivery_rate + 40 * receipt_coverage - risk_score / 2, 9), 1) AS confidence FROM (SELECT k.org_id, k.ein, k.name, k.city, k.state, k.cause, k.blurb, k.risk_score,
          coalesce(a.delivery_rate, 0.0) AS delivery_rate, coalesce(c.receipt_coverage, 0.0) AS receipt_coverage, coalesce(a.moved_usd, 0.0) AS value_moved_usd, coalesce(a.disbursements, 0) AS disbursements
          FROM {org_risk} k LEFT JOIN {org_activity} a ON a.org_id = k.org_id LEFT JOIN {receipt_coverage} c ON c.org_id = k.org_id
          WHERE k.is_verified AND NOT k.is_synthetic AND k.batch_id = 'IRS_BMF_2026') q"""


def mint_queue(d) -> str:
    ident = d.text("x.disbursement_id")
    band = "CASE WHEN x.amount_usd < 500 THEN '0-500' WHEN x.amount_usd < 2000 THEN '500-2K' WHEN x.amount_usd < 10000 THEN '2K-10K' ELSE '10K+' END"
    return f"""SELECT concat('q-', {ident}) AS queue_id, x.disbursement_id, x.programme_code, {band} AS amount_band, {d.month("x.delivered_at")} AS window_key, {d.sha(f"concat({d.text('x.org_id')}, ':salt')")} AS org_hash,
        CASE WHEN x.disbursement_id % 30 = 0 THEN 'PENDING' WHEN x.disbursement_id % 41 = 0 THEN 'FAILED' ELSE 'MINTED' END AS status
        FROM {{disbursements}} x WHERE x.status = 'DELIVERED' AND {d.hash_mod(ident, 30)} <> 0 AND x.disbursement_id IN (SELECT disbursement_id FROM {{delivery_geometry}} WHERE geometry_verdict = 'PLAUSIBLE')"""


def provenance(d) -> str:
    return "SELECT 'orgs' AS table_name, batch_id, count(*) AS row_count FROM {orgs} GROUP BY batch_id UNION ALL SELECT 'disbursements', batch_id, count(*) FROM {disbursements} GROUP BY batch_id"


def org_standing(d) -> str:
    """Organisations that lost their good standing: a list of filings that stopped, and nothing else."""
    return f"SELECT c_custkey AS org_id, 'no longer in good standing' AS standing_label, 'three annual returns missing' AS standing_note, c_custkey % 3 = 0 AS reinstated FROM {{customer}} WHERE c_custkey % 10 <> 0 AND c_acctbal < -500"


def org_enriched(d) -> str:
    return """SELECT o.org_id, o.name, o.cause, o.state, o.is_verified, o.is_synthetic,
        CASE WHEN o.is_synthetic THEN 'seeded' WHEN s.standing_label IS NOT NULL AND NOT s.reinstated THEN s.standing_label WHEN o.is_verified THEN 'verified' ELSE 'unverified' END AS standing FROM {orgs} o LEFT JOIN {org_standing} s USING (org_id)"""


def district_attrition(d) -> str:
    """The older definition: whatever is not delivered, of what moved. Sums by district and status come first."""
    return f"""SELECT district, cast(sum(n) AS bigint) AS events, cast(sum(usd) AS double) AS moved_usd, cast(sum(usd) - sum(other_usd) AS double) AS delivered_usd, cast(sum(other_usd) AS double) / nullif(cast(sum(usd) AS double), 0) AS attrition_rate,
        cast(sum(hours) AS double) / nullif(sum(timed), 0) AS mean_transit_hours FROM (
          SELECT district, count(*) AS n, sum(amount_usd) AS usd, CASE WHEN status = 'DELIVERED' THEN 0 ELSE sum(amount_usd) END AS other_usd, sum(transit) AS hours, count(transit) AS timed
          FROM (SELECT district, status, amount_usd, {d.hours("dispatched_at", "delivered_at")} AS transit FROM {{disbursements}} WHERE district IS NOT NULL) x GROUP BY district, status) p GROUP BY district"""


def org_footprint(d) -> str:
    """Cells within reach of the base, FOOTPRINT_STEPS at most; each base and reach is spread out once."""
    bases = f"SELECT DISTINCT basef, basex, basey, cast(least(max_hops, {FOOTPRINT_STEPS}) AS int) AS reach FROM {{org_cells}} WHERE lat IS NOT NULL"
    spread = sphere.disk(d, bases, RES, "base", "reach", FOOTPRINT_STEPS, "in")
    sizes = f"SELECT basef, basex, basey, reach, count(*) AS footprint_cells FROM (SELECT DISTINCT basef, basex, basey, reach, inf, inx, iny FROM ({spread}) c) u GROUP BY basef, basex, basey, reach"
    return f"SELECT o.org_id, o.max_hops, f.footprint_cells FROM {{org_cells}} o JOIN ({sizes}) f ON f.basef = o.basef AND f.basex = o.basex AND f.basey = o.basey AND f.reach = least(o.max_hops, {FOOTPRINT_STEPS})"


# Published figures, cited as their issuing bodies word them.
CITATIONS = [
    ("IC3_2024", "Charitable and crowdfunding fraud, United States, 2024", "More than 4,500 complaints reporting approximately 96 million USD in losses to fraudulent charities, crowdfunding accounts and disaster relief campaigns", 96000000.0, "USD", "United States", "FBI IC3 Public Service Announcement I-011625", "2025-01-16", "https://www.ic3.gov/PSA/2025/PSA250116"),
    ("BFOREAI_LA_FIRES", "Impersonation surges after disasters", "119 domains registered between 8 and 13 January 2025 using keywords including \"LA fire\", \"wildfire\", \"relief\", \"fund\" and \"rebuild\"", 119.0, "DOMAINS", "United States", "BforeAI threat research report on the Los Angeles wildfires", "2025-01-13", None),
    ("GOFUNDME_LA", "Scale of the legitimate pool being imitated", "More than 250 million USD raised for Los Angeles wildfire relief", 250000000.0, "USD", "United States", "GoFundMe public statement", "2025-01-31", None),
    ("WFP_GAZA_TRUCKS", "Last-mile diversion, Gaza", "590 trucks moved from Ashdod to Kerem Shalom, of which 371 were collected inside Gaza; organised criminal looting estimated by field monitors at about 20 percent of cases", 590.0, "TRUCKS", "Palestine", "WFP State of Palestine External Situation Report 55", "2025-06-06", None),
    ("WFP_SUDAN_GEZIRA", "Warehouse-scale diversion, Sudan", "Looting of a Gezira State warehouse holding over 2,500 metric tons of food, enough for nearly 1.5 million people for one month", 2500.0, "TONNES", "Sudan", "WFP statement", "2023-12-01", None),
    ("MGNREGA_LEAKAGE", "Programme leakage, India", "Total financial misappropriation of 169.75 crore rupees with only 20.93 crore recovered, a recovery rate of 12.33 percent, across 125,602 reported cases", 169.75, "INR_CRORE", "India", "MGNREGA action report", "2025-03-29", None),
    ("CAG_PMAY_UP", "Diversion before delivery, India", "86.20 lakh rupees intended for 159 genuine beneficiaries diverted to other bank accounts", 86.20, "INR_LAKH", "India", "CAG audit of PMAY-Gramin, Uttar Pradesh", "2025-12-01", None),
]


def literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"cast({v!r} AS double)" if isinstance(v, float) else str(v)


def citations(d) -> str:
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in CITATIONS)
    return f"SELECT citation_id, claim, figure, magnitude, unit_type, region, issuing_body, cast(published_on AS date) AS published_on, cast(url AS {d.string}) AS url FROM (VALUES {rows}) AS t(citation_id, claim, figure, magnitude, unit_type, region, issuing_body, published_on, url)"


def raw_filings(d) -> str:
    """Annual filings as text, as they arrive: punctuated numbers, padding, two filings for every fifth organisation."""
    ein = f"concat({d.lpad('c_custkey', 2)}, '-', {d.lpad('c_custkey * 7919 % 10000000', 7)})"
    row = lambda name, revenue: f"SELECT {ein} AS ein, {name} AS name, concat(' city ', {d.text('c_custkey % 97')}, ' ') AS city, concat({d.lpad('c_nationkey', 5)}, '-0001') AS zip, concat(' ', lower({d.letter('c_custkey % 27')}), '20') AS ntee_cd, {revenue} AS revenue_amt, CASE WHEN c_custkey % 9 = 0 THEN '12' ELSE '01' END AS status FROM {{customer}}"
    return row("concat(' ', lower(c_name), ' ')", f"CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE {d.text('cast(c_custkey % 90 AS bigint) * 1000000')} END") + " UNION ALL " + row("concat(c_name, ' older')", d.text("cast(c_custkey % 11 AS bigint) * 1000")) + " WHERE c_custkey % 5 = 0"


def raw_revocations(d) -> str:
    ein = f"concat({d.lpad('c_custkey', 2)}, '-', {d.lpad('c_custkey * 7919 % 10000000', 7)})"
    return f"SELECT {ein} AS ein, CASE WHEN c_custkey % 14 = 0 THEN '2020-01-01' END AS reinstated_on FROM {{customer}} WHERE c_custkey % 7 = 0"


# The first letter of a classification code.
CAUSES = {
    "A": "arts and culture", "B": "education", "C": "environment", "D": "animals", "E": "medical", "F": "mental health", "G": "disease research", "H": "medical research", "I": "public safety",
    "J": "employment", "K": "food and agriculture", "L": "housing", "M": "disaster relief", "N": "recreation and sport", "O": "youth development", "P": "human services", "Q": "international development",
    "R": "civil rights", "S": "community development", "T": "philanthropy", "U": "science", "V": "social science", "W": "public benefit", "X": "religion", "Y": "mutual benefit",
}


def cause_of(code: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CAUSES.items())
    return f"CASE upper(substr(trim(coalesce({code}, '')), 1, 1)) {whens} ELSE 'unclassified' END"


def filings(d) -> str:
    """One row a nine-digit number, the filing with the largest revenue; placed, classified, and verified unless revoked."""
    digits = lambda x: d.digits(x)
    revenue = d.try_number("revenue_amt")
    hops = "CASE WHEN revenue >= 50000000 THEN 40 WHEN revenue >= 5000000 THEN 24 WHEN revenue >= 500000 THEN 14 WHEN revenue >= 50000 THEN 8 ELSE 5 END"
    lat, lon = centroid("n_nationkey")
    return f"""WITH clean AS (SELECT {digits('ein')} AS ein, trim(name) AS name, trim(city) AS city, substr({digits('zip')}, 1, 5) AS zip5, trim(ntee_cd) AS code, {revenue} AS revenue, trim(status) AS status FROM {{raw_filings}} WHERE name IS NOT NULL),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY revenue DESC NULLS LAST, name) AS rn FROM clean WHERE length(ein) = 9) r WHERE rn = 1),
        places AS (SELECT {d.lpad('n_nationkey', 5)} AS zip, {lat} AS lat, {lon} AS lon FROM {{nation}}),
        revoked AS (SELECT DISTINCT {digits('ein')} AS ein FROM {{raw_revocations}} WHERE reinstated_on IS NULL)
        SELECT concat('ORG_', one.ein) AS org_id, one.ein, {d.initcap('one.name')} AS name, upper(code) AS ntee_code, {cause_of('code')} AS cause, concat({cause_of('code')}, ' organisation serving ', {d.initcap('one.city')}) AS blurb,
        places.lat, places.lon, {hops} AS max_hops, one.status = '01' AND revoked.ein IS NULL AS is_verified FROM one JOIN places ON places.zip = one.zip5 LEFT JOIN revoked ON revoked.ein = one.ein"""


MARTS: dict[str, Callable] = {f.__name__: f for f in (orgs, disbursements, district_dim, org_activity, attrition_stages, cause_exposure, beneficiaries, beneficiary_facts, cohort_cells, mint_log, receipt_coverage, org_vectors, scored_pairs, near_pairs, clone_pairs, clone_confirmed,
                                                      org_cells, delivery_geometry, org_risk, applied_changes, score_changes, score_history, org_risk_now, confidence_rank, mint_queue, provenance, org_standing, org_enriched, district_attrition, org_footprint, citations, raw_filings, raw_revocations, filings)}
