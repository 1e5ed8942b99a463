"""Named queries as Spark DataFrames, and as self-contained SQL for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import register_jaro_winkler
from ..operators.quantiles import exact_quantiles
from ..operators.similarity import cosine_pairs
from .dialect import Duck, Spark
from .marts import MARTS, PRODUCTION_CUT, literal
from .named import DEFAULTS, ORACLES, texts
from .store import Store, session_store

_REF = re.compile(r"\{(\w+)\}")
_QUANTILE = re.compile(r"(\[\[(\w+)\|([^|]+)\|([^|]+)\|([0-9.]+)\]\])")
_PARAM = re.compile(r"(?<![\w:']):([a-z]+)\b")

#: Marts that several queries share and that cost a join of the large tables: written once, then read.
WRITTEN = ("org_cells", "delivery_geometry", "clone_pairs", "org_risk", "org_activity", "receipt_coverage")


#: Long chains of projections: as one generated method they are too large for the JVM to compile, one by one they are not.
LAYERED = dict.fromkeys(("org_cells", "delivery_geometry"), {"spark.sql.codegen.wholeStage": "false"})

#: What a mart or query joins by organisation, disbursement or pair: both sides grow with the input, so neither may be sent
#: to the driver and broadcast, however small its files look.
MERGED = {
    "org_vectors": ("orgs", "embeddings"), "clone_pairs": ("orgs", "part"), "receipt_coverage": ("mint_log",), "delivery_geometry": ("org_cells",),
    "org_risk": ("orgs", "clone_pairs", "delivery_geometry", "org_activity", "receipt_coverage"), "org_risk_now": ("org_risk", "score_changes"), "confidence_rank": ("org_risk", "org_activity", "receipt_coverage"),
    "q_trust_by_country": ("mint_log",),  # its text names the other one, as a hint does not go through WITH
}


def _joined(name: str, ref: str, df: DataFrame) -> DataFrame:
    return df.hint("merge") if ref in MERGED.get(name, ()) else df


@contextmanager
def _settings(spark: SparkSession, **values: str):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _pairs(floor: float | None) -> Callable[[Callable[[str], DataFrame]], DataFrame]:
    def build(get: Callable[[str], DataFrame]) -> DataFrame:
        v = get("org_vectors").select("region", "cause", F.col("org_id").cast("long").alias("id"), F.col("synth_target_id").cast("long").alias("tag"), "unit", "is_synthetic", "is_verified")
        pairs = cosine_pairs(v.where("is_synthetic"), v.where("is_verified AND NOT is_synthetic"), ["region", "cause"], None if floor is None else 2 * floor - 1)
        out = pairs.select(F.col("left_id").alias("suspect_id"), F.col("right_id").alias("target_id"), F.col("tagged").alias("recorded"), ((F.col("cosine") + 1) / 2).alias("semantic_sim"))
        return out if floor is None else out.where(F.col("semantic_sim") >= floor)

    return build


#: Marts that Spark does not get from their text.
BUILT = {"scored_pairs": _pairs(None), "near_pairs": _pairs(PRODUCTION_CUT)}


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


def parameters(sql: str) -> list[str]:
    return list(dict.fromkeys(_PARAM.findall(sql)))


def resolve(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame], store: Store | None = None) -> DataFrame:
    """A source table as its scan; a mart as a lazy DataFrame over its inputs, or as its written table if ``store`` keeps
    it."""
    if name not in made:
        if name == "applied_changes" and store is not None and (log := store.changes()) is not None:
            made[name] = log
        elif name not in MARTS:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        elif store is not None and store.has(name):
            made[name] = store.read(name)
        else:
            get = lambda r: _joined(name, r, resolve(spark, sf_dir, r, made, store))
            sql = MARTS[name](Spark)
            if "jaro_winkler(" in sql:  # a session knows it only once it is registered, whichever query comes first
                register_jaro_winkler(spark)
            df = BUILT[name](get) if name in BUILT else spark.sql(sql, **{r: get(r) for r in references(sql)})
            if store is not None and name in WRITTEN:
                with _settings(spark, **LAYERED.get(name, {})):
                    df = store.write(name, df)
            made[name] = df
    return made[name]


def run(spark: SparkSession, sf_dir: str, query: str, store: Store | None = None, **values) -> DataFrame:
    """A named query. ``values`` are its parameters, bound by name and never pasted into the text."""
    sql = texts(Spark)[query]
    if unknown := set(values) - set(parameters(sql)):
        raise TypeError(f"{query} has no parameters {sorted(unknown)}")
    register_jaro_winkler(spark)
    made: dict[str, DataFrame] = {}
    store = store or session_store(spark, sf_dir)
    for text, mart, x, where, p in _QUANTILE.findall(sql):
        value = exact_quantiles(resolve(spark, sf_dir, mart, made, store).where(where), x, [float(p)])[0]
        sql = sql.replace(text, "cast(NULL AS double)" if value is None else f"cast('{value!r}' AS double)")
    refs = {r: _joined(query, r, resolve(spark, sf_dir, r, made, store)) for r in references(sql)}
    bound = {p: values.get(p, DEFAULTS[p]) for p in parameters(sql)}
    return spark.sql(sql, args=bound or None, **refs)


def apply_change(spark: SparkSession, sf_dir: str, org: int, score: float, at: datetime | None = None, store: Store | None = None) -> DataFrame:
    """Change an organisation's score from a moment on: a row in the store's change log, which every later query reads.
    Returns the organisation's row as the log now gives it."""
    store = store or session_store(spark, sf_dir)
    store.append_change(org, float(score), at)
    made: dict[str, DataFrame] = {}
    now = resolve(spark, sf_dir, "org_risk_now", made, store)
    return now.where(F.col("org_id") == F.lit(org)).select("org_id", "name", "risk_score", "verdict")


def try_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``apply_change`` with the default parameters, on a change log of its own, so that other queries do not see it."""
    return apply_change(spark, sf_dir, DEFAULTS["org"], DEFAULTS["score"], store=session_store(spark, sf_dir).with_own_changes())


def oracle(query: str) -> str:
    """The query for the checking engine: marts as common table expressions, parameters at their defaults."""
    sql = ORACLES[query](Duck) if query in ORACLES else texts(Duck)[query]
    order: list[str] = []

    def need(text: str) -> None:
        for r in references(text):
            if r in MARTS and r not in order:
                need(MARTS[r](Duck))
                order.append(r)

    need(sql)
    plain = lambda s: _REF.sub(lambda m: m[1] if m[1] not in MARTS else f"mart_{m[1]}", s)
    ctes = [f"mart_{m} AS MATERIALIZED ({plain(MARTS[m](Duck))})" for m in order]
    body = _PARAM.sub(lambda m: literal(DEFAULTS[m[1]]), plain(sql)).lstrip()
    if not ctes:
        return body
    loops = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
    return f"WITH {loops}" + ", ".join(ctes) + (", " + body[5 + len(loops):] if body.upper().startswith("WITH ") else " " + body)


def names() -> list[str]:
    return list(texts(Spark))
