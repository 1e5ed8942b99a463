"""Generated inputs: imitations of names, hashed name vectors, and disbursements. All rows follow from identifiers by
hashing, so a generated table is the same on any cluster; nothing is drawn on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TECHNIQUES = ("synonym", "reorder", "homoglyph", "suffix", "place")
# Words that stand for one another, letters that look alike, endings of appeals, and places.
SYNONYMS = {"relief": "aid", "fund": "trust", "children": "youth", "global": "world", "help": "support", "foundation": "institute", "community": "neighbourhood", "health": "wellness"}
LOOKALIKES = ("aeiop", "\u0430\u0435\u0456\u043e\u0440")
SUFFIXES = ("wildfire relief", "earthquake appeal", "flood response", "emergency fund")
PLACES = ("springfield", "riverside", "fairview", "georgetown")
#: Of the deliveries that set out, the share that arrived.
DELIVERED_SHARE = 371 / 590
STATUSES = ("PLEDGED", "DISPATCHED", "DELIVERED", "UNACCOUNTED")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that belongs to the given values."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def pick(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def imitate(name: Column, technique: Column, seed: Column) -> Column:
    """A name altered by one technique; synonym and homoglyph leave names alone that hold nothing to replace."""
    words = F.split(F.lower(F.trim(name)), " +")
    synonyms = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    swapped = F.array_join(F.transform(words, lambda w: F.coalesce(synonyms[w], w)), " ")
    turned = F.array_join(F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, 1)), " ")
    plain = F.array_join(words, " ")
    return (
        F.when(technique == "synonym", swapped)
        .when(technique == "reorder", turned)
        .when(technique == "homoglyph", F.translate(plain, *LOOKALIKES))
        .when(technique == "suffix", F.concat_ws(" ", plain, pick(SUFFIXES, uniform(seed, F.lit("suffix")))))
        .otherwise(F.concat_ws(" ", plain, F.lit("of"), pick(PLACES, uniform(seed, F.lit("place")))))
    )


def adversaries(orgs: DataFrame, n: int) -> DataFrame:
    """``n`` imitations of verified organisations (all of them, if there are fewer), each beside its target."""
    real = orgs.where("is_verified AND NOT is_synthetic").orderBy(F.xxhash64("org_id"), "org_id").limit(n)
    technique = pick(TECHNIQUES, uniform("org_id", F.lit("technique")))
    return real.select(F.concat(F.lit("SYN_"), F.col("org_id").cast("string")).alias("org_id"), imitate(F.col("name"), technique, F.col("org_id")).alias("name"), "cause", "state", F.col("org_id").alias("synth_target_id"),
                       technique.alias("synth_technique"), F.lit(True).alias("is_synthetic"), F.lit(False).alias("is_verified"), F.lit("SYNTH_ADVERSARY_V1").alias("batch_id"))


def embed(df: DataFrame, column: str, width: int = 64) -> DataFrame:
    """``df`` with a unit vector of its words: each word has a random sign in every dimension and weighs as much as it is
    rare. A text without words gets the null vector (no length can be 1)."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    rows = df.withColumn("_words", words)
    total = df.count()
    seen = rows.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    idf = seen.select("word", (F.log(F.lit(1.0 + total) / (1.0 + F.col("n"))) + 1.0).alias("idf"))
    keyed = rows.withColumn("_row", F.xxhash64(*[F.col(c) for c in df.columns]))
    parts = keyed.select("_row", F.explode(F.array_distinct("_words")).alias("word")).distinct().join(idf, "word")
    signs = [F.sum(F.col("idf") * (F.pmod(F.xxhash64("word", F.lit(i)), F.lit(2)) * 2 - 1)) for i in range(width)]
    made = parts.groupBy("_row").agg(F.array(*signs).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.array(norm), lambda n: F.transform("_v", lambda x: x / F.when(n > 0, n)))[0]
    return keyed.join(made, "_row", "left").select(*df.columns, unit.alias("name_vec"))


def disbursements(spark: SparkSession, n: int, orgs: int, districts: int = 40, people: int = 25_999, days: int = 120) -> DataFrame:
    """``n`` generated disbursements: a tenth only pledged, of the rest DELIVERED_SHARE delivered, a third of what is left
    unaccounted for, the remainder under way."""
    d = spark.range(n).select((F.col("id") + 1).alias("disbursement_id"))
    u = lambda what: uniform("disbursement_id", F.lit(what))
    lost = DELIVERED_SHARE + (1 - DELIVERED_SHARE) / 3
    status = F.when(u("pledged") < 0.1, "PLEDGED").when(u("status") < DELIVERED_SHARE, "DELIVERED").when(u("status") < lost, "UNACCOUNTED").otherwise("DISPATCHED")
    d = d.select("disbursement_id", (F.floor(u("org") * orgs) + 1).alias("org_id"), (F.floor(u("district") * districts)).alias("district"), (F.floor(u("person") * people) + 1).alias("beneficiary_id"), status.alias("status"),
                 F.round(400 + u("pledge") * 9100, 2).cast("decimal(12,2)").alias("pledged_usd"), F.expr("timestamp_ntz'2026-05-01 00:00:00'").alias("start"), F.floor(u("day") * days * 1440).cast("int").alias("minutes"), F.floor(60 + u("transit") * 7000).cast("int").alias("under_way"), (0.88 + u("kept") * 0.12).alias("kept"))
    amount = F.when(F.col("status") == "PLEDGED", 0).otherwise(F.round(F.col("pledged_usd") * F.col("kept"), 2)).cast("decimal(12,2)")
    sent = F.expr("timestampadd(MINUTE, minutes, start)")
    arrived = F.when(F.col("status").isin("DELIVERED", "DISPATCHED"), F.expr("timestampadd(MINUTE, minutes + under_way, start)"))
    return d.select("disbursement_id", "org_id", "district", "beneficiary_id", "status", "pledged_usd", amount.alias("amount_usd"), sent.alias("dispatched_at"), arrived.alias("delivered_at"))
