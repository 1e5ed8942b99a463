"""The reference's own operators: every named query against DuckDB, and the operators around them."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyworks.functions.text import jaro_winkler, title
from tallyworks.operators import fixtures, history, privacy, projection, queue, semantic
from tallyworks.plans import compile as plans
from tallyworks.plans import checks, store
from tallyworks.sources import files
from tallyworks.streaming import rollups

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, (bool, str)):
            return v
        try:
            return round(float(v), 3) + 0.0
        except (TypeError, ValueError):
            return str(v)[:19].replace(" 00:00:00", "")

    return sorted(columns), sorted(str(tuple(one(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", plans.names())
def test_named_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = plans.run(spark, SF, name)
    want = con.execute(plans.oracle(name))
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())


def test_jaro_winkler_rules():
    assert round(jaro_winkler("abc", "abd", 0.0), 2) == 0.82 and jaro_winkler(None, "a") is None
    assert jaro_winkler("", "") == 1.0 and jaro_winkler("a", "") == 0.0 and jaro_winkler("abcdxyz", "abqrstu", 0.0) > jaro_winkler("abcdxyz", "abqrstu")


def test_parameters_are_bound_by_name(spark):
    one = lambda **p: [r.org_id for r in plans.run(spark, SF, "q_org_risk_one", **p).collect()]
    assert one() == [50] and one(org=7) == [7] and one(org=-1) == []
    assert plans.run(spark, SF, "q_org_search", search="%x' OR 1=1 --%", prefix="none").count() == 0
    assert [r.org_id for r in plans.run(spark, SF, "q_org_search", search="none", prefix="00000001%").orderBy("org_id").collect()] == list(range(10, 20))
    with pytest.raises(TypeError):
        plans.run(spark, SF, "q_kpi", org=1)


@pytest.mark.parametrize("name,keys", [("q_trust_leaderboard", lambda r: (r.risk_score, -r.moved_usd, r.org_id)), ("q_confidence_rank", lambda r: (-r.confidence, r.org_id)), ("q_cell_drilldown", lambda r: (-r.amount_usd, r.disbursement_id)), ("q_evidence", lambda r: (r.published_on, r.citation_id)),
                                       ("q_acceptance", lambda r: ({"FAIL": 0, "REVIEW": 1, "PASS": 2}[r.result], r.check_id))])
def test_rows_come_in_order(spark, name, keys):
    rows = plans.run(spark, SF, name).collect()
    assert rows and [keys(r) for r in rows] == sorted(keys(r) for r in rows)


def test_acceptance_and_edits(spark):
    got = {r.check_id: r.result for r in plans.run(spark, "/root/testdata/sf0.01", "q_acceptance").collect()}
    assert got.pop("RSK-06b") == "REVIEW" and set(got.values()) == {"PASS"}
    assert plans.run(spark, SF, "q_apply_change", org=50, score=54.9).first().verdict != "needs a second look"


def test_store(spark, tmp_path):
    t = [datetime(2026, 1, 1)]
    s = store.Store(spark, f"file://{tmp_path}/a", clock=lambda: t[0])
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    s.write("m", rows)
    t[0] += timedelta(seconds=200)
    assert s.append("m", rows.select("v", "id")).count() == 4 and s.last.count() == 4
    assert s.read("m", datetime(2026, 1, 1)).count() == 2
    with pytest.raises(LookupError):
        s.read("m", datetime(2025, 1, 1))
    s.write("q", rows, "ORACLE")
    t[0] += timedelta(seconds=100)
    assert {(r.schema_name, r.objects, r.total_rows) for r in s.catalog().collect()} == {("MARTS", 1, 4), ("ORACLE", 1, 2)}
    t[0] += timedelta(seconds=21)
    assert {(r.object_name, r.seconds_since_refresh, r.within_lag) for r in s.health().collect()} == {("MARTS.M", 121, False), ("ORACLE.Q", 121, False)}
    s.truncate("m")
    assert s.read("m").count() == 0 and s.has("m") and not s.has("n")
    other = store.Store(spark, f"file://{tmp_path}/b")
    assert s.copy(other) == ["m", "q"] and other.read("q").count() == 2
    assert s.expire() == 0
    t[0] += timedelta(days=store.RETENTION_DAYS + 1)
    assert s.expire() == 2 and s.read("q").count() == 2


def test_session_store_follows_its_input(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    (tmp_path / "x").write_text("1")
    first = store.session_store(spark, str(tmp_path))
    assert store.session_store(spark, str(tmp_path)) is first
    (tmp_path / "x").write_text("12")
    assert store.session_store(spark, str(tmp_path)) is not first


def test_projection(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    got = projection.project(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, unit array<double>")).orderBy("id").collect()
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose([[r.pc1, r.pc2] for r in got], c @ axes.T, atol=1e-8)
    orgs = spark.createDataFrame([(i, "c") for i in range(50)], "org_id int, cause string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (9, 2)], "suspect_id int, target_id int")
    shown = [sorted(r.org_id for r in projection.scope(orgs.repartition(n), pairs, 10).collect()) for n in (1, 7)]
    assert shown[0] == shown[1] and {1, 2, 3, 9} <= set(shown[0]) and len(shown[0]) == len(set(shown[0])) == 14
    assert projection.scope(orgs, pairs, 900).count() == 50
    rows = projection.q_projection(spark, SF).collect()
    assert rows and {r.cause for r in rows} == {"BUILDING"}
    assert projection.q_pipeline_health(spark, SF).count() >= 5


def test_privacy_facade(spark):
    facts = spark.createDataFrame([(i % n, d, float(i)) for d, n in (("big", 60), ("edge", 50), ("small", 49)) for i in range(n * 2)], "person int, district string, usd double")
    cells = {r.district: r for r in privacy.min_cohort(facts.withColumn("person", facts.person), "person", ["district"], {"usd": __import__("pyspark").sql.functions.sum("usd")}).collect()}
    assert cells["edge"].people == 50 and not cells["edge"].refused and cells["small"].people is None and cells["small"].usd is None and cells["small"].refused
    domains = {"district": privacy.Domain(values=frozenset(["big", "edge", "small"])), "usd": privacy.Domain(0, 500)}
    f = privacy.Facade(facts, "person", domains, seed=1, budget=0.5)
    assert f.floored({"district": "big"}) == 60 and f.floored({"district": "small"}) is None
    for bad in ({"name": "x"}, {"district": "elsewhere"}, {"usd": (0, 900.0)}):
        with pytest.raises(privacy.Refused):
            f.noisy(bad)
    with pytest.raises(privacy.Refused):
        f.rows()
    assert not any(hasattr(v, "rdd") or hasattr(v, "collect") for v in vars(f).values())
    assert f.compare({"district": "big"}).count() == 3 and f.ledger().count() == 5
    f.noisy({})
    for spent in (f.noisy, f.floored):
        with pytest.raises(privacy.Refused):
            spent({})
    assert privacy.Domain(low=3).allows(9) and not privacy.Domain(high=3).allows(9)
    g = privacy.Facade(facts, "person", domains, seed=2, noise_sd=0.0)
    with privacy.analyst(g) as session:
        assert session.ask(privacy.Question(column="person", group_by=("district",))) == {("big",): 60, ("edge",): 50, ("small",): 49}
        for bad in (privacy.Question("sum", "usd"), privacy.Question("count", "person"), privacy.Question(column="person", group_by=("usd",)), privacy.Question(column="person", filters={"age": 3})):
            with pytest.raises(privacy.Refused):
                session.ask(bad)
        with pytest.raises(privacy.Refused):
            session.rows()
    with pytest.raises(privacy.Refused):
        session.noisy({})
    trial = g.attack_trial({"district": "big"}, "usd", 60.0, 3).collect()
    assert [(r.everyone, r.received_something, r.recovered) for r in trial] == [(60, 60, 0)] * 3
    assert privacy.attack_cost()["queries"] == 662


def test_history(spark):
    t = datetime(2026, 1, 1, 12)
    v = spark.createDataFrame([(1, 10.0, "verified", True, t), (1, 60.0, "needs a second look", True, t + timedelta(seconds=200)), (2, 5.0, "verified", True, t)], "org_id int, risk_score double, verdict string, is_verified boolean, valid_from timestamp_ntz")
    now = t + timedelta(seconds=300)
    assert {(r.org_id, r.risk_score) for r in history.as_of(v, "org_id", now).collect()} == {(1, 60.0), (2, 5.0)}
    assert {(r.org_id, r.risk_score) for r in history.at_offset(v, "org_id", now, 120, 86400).collect()} == {(1, 10.0), (2, 5.0)}
    assert history.at_offset(v, "org_id", now, 9e9, 86400) is None and history.now_and_before(v, "org_id", now).count() == 4
    e = history.edit_score(v, 2, 55, now)
    assert e.first().verdict == "needs a second look" and v.unionByName(e).count() == 4


def test_queue(spark):
    t = datetime(2026, 1, 1)
    events = spark.createDataFrame([(f"q{i}", "PENDING", t, None) for i in range(5)], queue.EVENT)
    got = queue.claim(events, 2, t + timedelta(minutes=1))
    assert [r.queue_id for r in got.orderBy("queue_id").collect()] == ["q0", "q1"]
    events = events.unionByName(got)
    assert [r.queue_id for r in queue.claim(events, 2, t + timedelta(minutes=2)).orderBy("queue_id").collect()] == ["q2", "q3"]
    failed = queue.mark(got.limit(1), "FAILED", t + timedelta(minutes=2), "x" * 2000)
    assert len(failed.first().error) == 900
    assert queue.requeue(events.unionByName(failed), t + timedelta(minutes=7)).count() == 2
    with pytest.raises(ValueError):
        queue.receipt_columns(spark.createDataFrame([("q", "n")], "queue_id string, name string"))


def test_retry():
    waits, left = [], [3]

    def step():
        left[0] -= 1
        if left[0]:
            raise OSError
        return "done"

    assert queue.with_retry(step, sleep=waits.append) == "done" and waits == [0.4, 0.8]
    with pytest.raises(OSError):
        queue.with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_semantic_facts_keep_their_grain(spark):
    orgs = spark.createDataFrame([(1, "a", "x", "c1", 10), (2, "a", "x", "c2", 20), (3, "b", "y", "c1", 30), (4, None, "x", "c3", 40)], "org_id long, state string, cause string, city string, max_hops int")
    sent = [(1, "D", 5.0), (1, "D", 7.0), (1, "P", 1.0), (2, "D", 2.0), (4, "D", 9.0)]
    disb = spark.createDataFrame([(i, o, 1, s, u, u, "PLAUSIBLE") for i, (o, s, u) in enumerate(sent)], "disbursement_id long, org_id long, district int, status string, amount_usd double, pledged_usd double, geometry_verdict string")
    m = semantic.giving_model(orgs, disb, semantic.ORG_METRICS)
    ask = lambda *q: sorted((tuple(r) for r in m.query(*q).collect()), key=str)
    assert ask([], ["org_count", "event_count"]) == [(4, 5)]
    assert ask(["state"], ["org_count", "event_count"]) == [("a", 2, 4), ("b", 1, None), (None, 1, 1)]
    assert ask(["state"], ["org_count", "mean_hops"]) == [("a", 2, 15.0), ("b", 1, 30.0), (None, 1, 40.0)]
    assert ask(["state", "status"], ["org_count", "total_usd"]) == [("a", "D", 2, 14.0), ("a", "P", 1, 1.0), (None, "D", 1, 9.0)]
    assert ask(["status"], ["mean_hops"]) == [("D", round(70 / 3, 6)), ("P", 10.0)]
    assert ask(["state", "status"], []) == [("a", "D"), ("a", "P"), (None, "D")]
    assert ask(["cause"], []) == [("x",), ("y",)]
    with pytest.raises(ValueError):
        m.query([], [])


def test_semantic_model(spark):
    made = {}
    m = semantic.giving_model(plans.resolve(spark, SF, "orgs", made), plans.resolve(spark, SF, "delivery_geometry", made))
    got = m.query(["province"], ["flag rate", "shipments"])
    assert got.columns == ["state", "flagged_pct", "event_count"]
    want = {(r.state, r.flagged_pct, r.event_count) for r in plans.run(spark, SF, "q_ask_flagged_by_state").collect()}
    assert {tuple(r) for r in got.collect()} == want
    shape = m.describe(spark).where("property = 'synonyms'").collect()
    assert {(r.object_kind, r.object_name, r.value) for r in shape} == {tuple(r) for r in plans.run(spark, SF, "q_semantic_shape").collect()}
    assert sum(len(i.synonyms) for i in [*m.dimensions, *m.metrics]) + sum(map(len, m.table_synonyms.values())) == 26
    with pytest.raises(KeyError):
        m.query(["colour"], ["event_count"])
    assert semantic.best_preset("how much money moved", {"a": "money moved by quarter", "b": "flagged by state"}) == "a"
    assert semantic.best_preset("zzz", {"a": "b"}, "old") == "old"


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name,extra\n1,"a, b",nan\n2, NULL ,z,too many\n3\n')
    rows = files.read_delimited(spark, str(tmp_path / "x.csv"), ["id", "name", "extra"]).collect()
    assert [(r.id, r.name, r.extra) for r in rows] == [("1", "a, b", None), ("2", None, "z"), ("3", None, None)]
    assert files.read_positional(spark, str(tmp_path / "x.csv"), 3).first().source_file.endswith("x.csv")
    with pytest.raises(Exception):
        files.read_delimited(spark, str(tmp_path / "x.csv"), ["id", "name", "extra"], on_error="abort").collect()
    (tmp_path / "g.tsv").write_text("geoid\tlat\tlon\n501\t1.5\tx\n")
    assert tuple(files.read_gazetteer(spark, str(tmp_path / "g.tsv")).first()) == ("00501", 1.5, None)


def test_revocations_exports_and_updates(spark, tmp_path):
    line = lambda ein, back, sep: sep.join([ein, *"bcdefghi", "2020-01-01", "2020-02-01", back])
    for sep in ("|", ","):
        (tmp_path / "r.txt").write_text("\n\n" + "\n".join([line("12-3456789", "", sep), line("123456789", "", sep), line("98765", "", sep), line("555555555", "2021-01-01", sep)]) + "\n")
        assert sorted(r.ein for r in files.read_revocations(spark, str(tmp_path / "r.txt")).collect()) == ["000098765", "123456789"]
    filings = spark.createDataFrame([("123456789", True), ("555555555", False)], "ein string, ok boolean")
    kept = files.good_standing(filings, files.read_revocations(spark, str(tmp_path / "r.txt")))
    assert [r.ein for r in kept.collect()] == ["555555555"]
    files.export(filings, ["ok", "ein"], str(tmp_path / "csv"), "csv")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).where("value NOT LIKE 'ok%'").collect()) == ["FALSE,555555555", "TRUE,123456789"]
    files.export(filings, ["ein"], str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).columns == ["ein"]
    old = spark.createDataFrame([(1, None), (2, "kept"), (3, None)], "id int, v string")
    new = files.load_missing(old, spark.createDataFrame([(1, "new"), (2, "other")], "id int, v string"), "id", "v")
    assert sorted(map(tuple, new.collect())) == [(1, "new"), (2, "kept"), (3, None)]
    assert files.upload(spark, str(tmp_path / "r.txt"), f"file://{tmp_path}/stage") and (tmp_path / "stage" / "r.txt").exists()
    v = spark.createDataFrame([("[1, 2.5]",), ("[1]",), ("x",), (None,)], "v string")
    assert [r.v for r in files.vectors(v, "v", 2).collect()] == [[1.0, 2.5], None, None, None]


def test_streaming_equals_batch(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    q = rollups.refresh(rollups.windowed(rollups.read_events(spark, str(tmp_path / "in")), late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    batch = spark.read.parquet(f"{SF}/events.parquet").selectExpr("date_trunc('HOUR', cast(ts AS timestamp)) AS start", "event_type").groupBy("start", "event_type").count()
    assert {tuple(r)[:3] for r in rollups.current(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in batch.collect()}


def test_generated_inputs(spark):
    orgs = spark.createDataFrame([(i, f"Global Relief Fund {i}", "c", "s", i % 3 != 0, i % 5 == 0) for i in range(60)], "org_id int, name string, cause string, state string, is_verified boolean, is_synthetic boolean")
    made = fixtures.adversaries(orgs, 25).collect()
    assert len(made) == 25 and all(r.synth_target_id % 3 and r.synth_target_id % 5 and not r.is_verified for r in made) and {r.synth_technique for r in made} == set(fixtures.TECHNIQUES)
    want = {"synonym": lambda i: f"world aid trust {i}", "reorder": lambda i: f"relief fund {i} global", "homoglyph": lambda i: f"gl\u043eb\u0430l r\u0435l\u0456\u0435f fund {i}"}
    assert all(r.name == want[r.synth_technique](r.synth_target_id) for r in made if r.synth_technique in want)
    assert sorted(made) == sorted(fixtures.adversaries(orgs.repartition(7), 25).collect())
    texts = spark.createDataFrame([(1, "global relief fund"), (2, "fund relief GLOBAL"), (3, "river school"), (4, ""), (4, ""), (5, None)], "id int, name string")
    v = {}
    for r in fixtures.embed(texts, "name").collect():
        v.setdefault(r.id, []).append(r.name_vec)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert abs(dot(v[1][0], v[2][0]) - 1) < 1e-9 and abs(dot(v[1][0], v[3][0])) < 0.5 and v[4] == [None, None] and v[5] == [None]
    d = fixtures.disbursements(spark, 20_000, 50)
    n = {r.status: r["count"] for r in d.groupBy("status").count().collect()}
    assert sum(n.values()) == 20_000 and abs(n["DELIVERED"] / (20_000 - n["PLEDGED"]) - 371 / 590) < 0.03 and set(n) == set(fixtures.STATUSES)
    assert d.where("(status = 'PLEDGED') <> (amount_usd = 0) OR amount_usd > pledged_usd OR delivered_at <= dispatched_at OR (status = 'UNACCOUNTED' AND delivered_at IS NOT NULL)").count() == 0


def test_titles_times_and_enforced_checks(spark):
    f = spark.createDataFrame([("o'neil mc-DONALD fund 3rd", "2026-01-02 03:04:05"), (None, "soon")], "name string, at string")
    assert [r.t for r in f.select(title(F.col("name")).alias("t")).collect()] == ["O'Neil Mc-Donald Fund 3Rd", None]
    assert [r["at"] for r in files.typed_times(f, "at").collect()] == [datetime(2026, 1, 2, 3, 4, 5), None]
    rows = lambda *x: spark.createDataFrame([(f"C{i}", "s", r) for i, r in enumerate(x)], "check_id string, statement string, result string")
    checks.enforce(rows("PASS", "REVIEW"))
    with pytest.raises(AssertionError, match="C1"):
        checks.enforce(rows("PASS", "FAIL"))


def test_changes_are_history(spark, tmp_path):
    """A change of any organisation shows in all views of history, at its time and not before; nothing else changes."""
    store = plans.Store(spark, f"file://{tmp_path}/store")
    ask = lambda q, **v: [tuple(x) for x in plans.run(spark, SF, q, store=store, **v).collect()]
    before = {x[0]: x[3] for x in ask("q_time_travel", org=77)}
    edited = {x[0] for x in ask("q_edited_rows")}
    count = ask("q_score_reconciliation")[0]
    at = datetime(2025, 5, 1, 12, 0, 0)
    row = plans.apply_change(spark, SF, 77, 99.5, at, store).first()
    assert (row.org_id, row.risk_score, row.verdict) == (77, 99.5, "needs a second look")
    now = {x[0]: x[3:] for x in ask("q_time_travel", org=77)}
    assert now["current"] == (99.5, "needs a second look") and now["before"][0] == before["current"]
    assert 77 in {x[0] for x in ask("q_edited_rows")} | edited and [x for x in ask("q_score_history") if x[0] == 77][-1][1:4:2] == (at, 99.5)
    assert ask("q_score_reconciliation")[0][1] in (count[1], count[1] - 1)
    later = datetime(2025, 5, 1, 12, 10, 0)
    got = {x[0]: x[2] for x in ask("q_time_offsets", org=77, now=later)}
    assert [got[s] == 99.5 for s in (60, 120, 300, 600, 1800, 3600)] == [True] * 4 + [False] * 2
    assert [x[0] for x in ask("q_time_offsets", org=77, now=later, retention=600)] == [60, 120, 300, 600]
    plans.apply_change(spark, SF, 77, 10.0, at, store)  # of two changes at one moment the later one counts
    assert {x[0]: x[3] for x in ask("q_time_travel", org=77)}["current"] == 10.0
    assert ask("q_time_travel", org=78) == [tuple(x) for x in plans.run(spark, SF, "q_time_travel", org=78).collect()]


def test_a_file_below_a_folder_changes_the_stamp(spark, tmp_path):
    from tallyworks.sources import shared

    spark.range(3).write.parquet(f"{tmp_path}/orders.parquet/p=1")
    first = shared.stamp(spark, str(tmp_path))
    assert first == shared.stamp(spark, str(tmp_path))
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/orders.parquet/p=1")
    assert shared.stamp(spark, str(tmp_path)) != first


def test_tables_that_grow_are_not_broadcast(spark, sf):
    """Nothing that has a row an organisation, disbursement or pair is sent to the driver for a join, in marts or queries."""
    plans.register_jaro_winkler(spark)
    made, store = {}, plans.session_store(spark, sf)
    for name in (*plans.WRITTEN, "org_risk_now", "confidence_rank"):
        plans.resolve(spark, sf, name, made, store)
    get = lambda ref, name: plans._joined(name, ref, plans.resolve(spark, sf, ref, made, store))
    frames = [spark.sql(plans.MARTS[name](plans.Spark), **{r: get(r, name) for r in plans.references(plans.MARTS[name](plans.Spark))}) for name in ("org_vectors", "clone_pairs", "receipt_coverage", "delivery_geometry", "org_risk", "org_risk_now", "confidence_rank")]
    frames += [plans.run(spark, sf, q) for q in ("q_by_cause", "q_edited_rows")]
    for df in frames:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert plans.run(spark, sf, "q_trust_by_country")._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 2  # countries and regions


def test_a_change_is_the_first_query_of_a_session(spark, tmp_path):
    """No other query has registered a function or written a mart before it."""
    import __spark_entry__

    (tmp_path / "in").symlink_to(SF)  # marts of its own
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()["q_apply_change"](spark.newSession(), str(tmp_path / "in"))
    want = con.execute(__spark_entry__.oracle_sql()["q_apply_change"])
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())
