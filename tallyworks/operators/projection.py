"""Two principal components of the organisations' vectors, for the map of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(vectors: DataFrame, column: str = "unit") -> DataFrame:
    """``vectors`` with pc1 and pc2. The mean and the covariance are partial sums; each component points to the side of
    its largest coordinate, so the signs do not depend on the machine."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("_v", array_to_vector(F.col(column)))
    if not rows.limit(2).count() > 1:
        return vectors.withColumn("pc1", F.lit(0.0)).withColumn("pc2", F.lit(0.0))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    pc = model.pc.toArray()
    mean = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # a row a dimension
    centre = [sum(r["m"] * pc[r["i"], k] for r in mean) for k in range(2)]
    signs = [1.0 if pc[abs(pc[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    out = model.transform(rows).withColumn("_p", vector_to_array("_p"))
    return out.select(*vectors.columns, *[((F.col("_p")[k] - F.lit(centre[k])) * F.lit(signs[k])).alias(f"pc{k + 1}") for k in range(2)])


def scope(orgs: DataFrame, pairs: DataFrame, others: int = 900) -> DataFrame:
    """What the map shows: every organisation of a pair, and a sample of ``others`` of the rest, which is the same one on
    any cluster (smallest hashes of the identifiers)."""
    paired = pairs.select(F.explode(F.array("suspect_id", "target_id")).alias("org_id")).distinct()
    rest = orgs.join(paired, "org_id", "left_anti").orderBy(F.xxhash64(F.col("org_id").cast("long")), "org_id").limit(others)
    return orgs.join(paired, "org_id", "left_semi").unionByName(rest)


def q_projection(spark, sf_dir: str, cause: str = "BUILDING") -> DataFrame:
    """Organisations of a cause on the plane of those in scope."""
    from ..plans import compile as plans
    from ..plans.store import session_store

    plans.register_jaro_winkler(spark)
    made: dict[str, DataFrame] = {}
    get = lambda name: plans.resolve(spark, sf_dir, name, made, session_store(spark, sf_dir))
    vectors = get("org_vectors").select("org_id", "name", "cause", "is_synthetic", "is_verified", "unit").where("unit IS NOT NULL")
    placed = project(scope(vectors, get("clone_pairs"))).where(F.col("cause") == F.lit(cause))
    return placed.select("org_id", "name", "cause", "is_synthetic", "is_verified", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2")).orderBy("org_id").limit(1500)


def q_pipeline_health(spark, sf_dir: str) -> DataFrame:
    """Ages of the written marts of this session; those that no query has written yet are written first."""
    from ..plans import compile as plans
    from ..plans.store import session_store

    store = session_store(spark, sf_dir)
    plans.register_jaro_winkler(spark)
    made: dict[str, DataFrame] = {}
    for name in plans.WRITTEN:
        plans.resolve(spark, sf_dir, name, made, store)
    return store.health()
