"""A small semantic model: tables, one relationship, dimensions and metrics with synonyms, compiled to a plan.

Facts have their own grain. Each table's metrics are aggregated over that table's rows before anything else is joined to
them, so a metric is never multiplied by the rows of another table: where it is asked for by another table's dimension, a
row of its own table counts once in each group that it is related to. The tables' results meet on the dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import MODEL


@dataclass(frozen=True)
class Item:
    name: str
    table: str
    expression: str
    synonyms: tuple[str, ...] = ()


@dataclass
class Model:
    tables: dict[str, DataFrame]
    key: str
    dimensions: list[Item] = field(default_factory=list)
    metrics: list[Item] = field(default_factory=list)
    facts: list[Item] = field(default_factory=list)
    table_synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _item(self, items: list[Item], name: str) -> Item:
        for i in items:
            if name.lower() in (i.name, *(s.lower() for s in i.synonyms)):
                return i
        raise KeyError(name)

    def _grouped(self, table: str, dims: list[Item], mets: list[Item]) -> DataFrame:
        """The metrics of one table by dimensions of any tables."""
        own = self.tables[table]
        df = own.withColumns({f"dim_{d.name}": F.expr(d.expression) for d in dims if d.table == table})
        for other in dict.fromkeys(d.table for d in dims if d.table != table):
            theirs = [F.expr(d.expression).alias(f"dim_{d.name}") for d in dims if d.table == other]
            df = df.join(self.tables[other].select(self.key, *theirs).distinct(), self.key)  # once a group, not once a row
        return df.groupBy(*[F.col(f"dim_{d.name}").alias(d.name) for d in dims]).agg(*[F.expr(m.expression).alias(m.name) for m in mets])

    def query(self, dimensions: list[str], metrics: list[str]) -> DataFrame:
        """Metrics by dimensions; only tables that are mentioned are read. Without a metric the groups themselves."""
        dims, mets = [self._item(self.dimensions, d) for d in dimensions], [self._item(self.metrics, m) for m in metrics]
        if not mets:
            if not dims:
                raise ValueError("a question needs a dimension or a metric")
            used = list(dict.fromkeys(d.table for d in dims))
            df = None
            for t in used:
                part = self.tables[t].select(self.key, *[F.expr(d.expression).alias(d.name) for d in dims if d.table == t]).distinct()
                df = part if df is None else df.join(part, self.key)
            return df.select(*[d.name for d in dims]).distinct()
        out = None
        for t in dict.fromkeys(m.table for m in mets):
            part = self._grouped(t, dims, [m for m in mets if m.table == t])
            if out is None:
                out = part
            elif not dims:
                out = out.crossJoin(part)  # one row each
            else:
                left, right = out.alias("l"), part.alias("r")
                same = [F.col(f"l.{d.name}").eqNullSafe(F.col(f"r.{d.name}")) for d in dims]
                both = left.join(right, [x for x in same], "full")
                named = [F.coalesce(f"l.{d.name}", f"r.{d.name}").alias(d.name) for d in dims]
                out = both.select(*named, *[F.col(f"l.{c}") for c in out.columns[len(dims) :]], *[F.col(f"r.{c}") for c in part.columns[len(dims) :]])
        return out.select(*[d.name for d in dims], *[m.name for m in mets])

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = []
        for t in self.tables:
            rows += [("TABLE", t, "key", self.key), ("TABLE", t, "synonyms", ", ".join(self.table_synonyms.get(t, ())))]
        for kind, items in (("DIMENSION", self.dimensions), ("METRIC", self.metrics), ("FACT", self.facts)):
            for i in items:
                rows += [(kind, i.name, "expression", i.expression), (kind, i.name, "synonyms", ", ".join(i.synonyms))]
        return spark.createDataFrame(rows, "object_kind string, object_name string, property string, value string")


EXPRESSIONS = {
    "geometry_verdict": ("disb", "geometry_verdict"), "district": ("disb", "district"), "status": ("disb", "status"), "amount_usd": ("disb", "amount_usd"), "pledged_usd": ("disb", "pledged_usd"),
    "total_usd": ("disb", "round(sum(amount_usd), 2)"), "flagged_pct": ("disb", "round(avg(CASE WHEN geometry_verdict <> 'PLAUSIBLE' THEN 1D ELSE 0D END), 6)"),
    "delivered_usd": ("disb", "round(sum(CASE WHEN status = 'DELIVERED' THEN amount_usd ELSE 0 END), 2)"), "event_count": ("disb", "count(disbursement_id)"),
}


#: Metrics of the organisations themselves, beside those of their deliveries.
ORG_METRICS = (Item("org_count", "orgs", "count(org_id)", ("organisations", "number of organisations")), Item("mean_hops", "orgs", "round(avg(max_hops), 6)", ("mean reach",)))


def giving_model(orgs: DataFrame, deliveries: DataFrame, more: tuple[Item, ...] = ()) -> Model:
    """Organisations and deliveries: two facts, six dimensions, four metrics (and ``more``), with their synonyms."""
    items = {kind: [Item(n, *EXPRESSIONS.get(n, ("orgs", n)), tuple(x for x in s.split(", ") if x)) for k, n, s in MODEL if k == kind] for kind in ("DIMENSION", "METRIC", "FACT")}
    return Model({"orgs": orgs.select("org_id", "state", "cause", "city", "max_hops"), "disb": deliveries}, "org_id", items["DIMENSION"], [*items["METRIC"], *more], items["FACT"], {n: tuple(s.split(", ")) for k, n, s in MODEL if k == "TABLE"})


def q_semantic_two_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of organisations and of deliveries by dimensions of both."""
    from ..plans import compile as plans

    made, store = {}, plans.session_store(spark, sf_dir)
    m = giving_model(*(plans.resolve(spark, sf_dir, x, made, store) for x in ("orgs", "delivery_geometry")), ORG_METRICS)
    return m.query(["sector", "stage"], ["organisations", "mean reach", "money moved", "shipments"])


TWO_FACTS_SQL = """WITH x AS (SELECT c_mktsegment AS cause, c_custkey, 20 + c_custkey % 21 AS hops, CASE WHEN o_orderpriority = '1-URGENT' THEN 'UNACCOUNTED' WHEN o_orderstatus = 'P' THEN 'PLEDGED' WHEN o_orderstatus = 'O' THEN 'DISPATCHED' ELSE 'DELIVERED' END AS status, o_totalprice AS usd FROM customer JOIN orders ON o_custkey = c_custkey),
    once AS (SELECT DISTINCT cause, status, c_custkey, hops FROM x), a AS (SELECT cause, status, count(*) AS org_count, round(avg(hops), 6) AS mean_hops FROM once GROUP BY 1, 2)
    SELECT cause, status, org_count, mean_hops, total_usd, event_count FROM a JOIN (SELECT cause, status, round(sum(CASE WHEN status = 'PLEDGED' THEN 0 ELSE usd::DECIMAL(12,2)::DOUBLE END), 2) AS total_usd, count(*) AS event_count FROM x GROUP BY 1, 2) b USING (cause, status)"""


def best_preset(question: str, presets: dict[str, str], previous: str | None = None) -> str | None:
    """The preset that shares most words with a question; without any, the previous answer stays."""
    words = set(question.lower().split())
    score, name = max(((len(words & set(p.lower().split())), n) for n, p in presets.items()), default=(0, None))
    return name if score else previous
