"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only.

Each source's rows are cut into blocks. Block ``i`` (from 0) of a source with integer share ``w`` out of ``K`` (the
sum of active shares) is released at slot ``floor(i*K/w)`` and due by ``ceil((i+1)*K/w)``; earliest deadline first
fills every slot and keeps each source less than one block away from ``slot*w/K``. Because the shares are integers the
schedule repeats after ``K`` slots, so only one period is simulated for each set of active sources (a SQL ``aggregate``
over ``K`` slots) and every block finds its slot by arithmetic: no task walks the corpus.

All rows are kept. When a source runs out, the remaining ones go on with their shares among themselves (``phase``
counts these changes; phase 0 is the part at the full target weights). In the last period of a phase the slots that
an ending source no longer fills are closed up.

Rows of a stream are ordered by a hash of the whole row, then by the key columns, so equal or null ids do not make the
order depend on how a task read its rows; rows that tie are equal in every column and take either slot.

Defined cases: a null source counts as ``''``; sources outside ``shares`` form one stream, ``other``; null ids and
repeated rows are ordinary rows; texts are hashed whole, whatever their length; an empty table gives an empty result. The
five columns of ADDED replace columns of those names; all others stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OTHER = "(other)"
#: Target shares of the test sources: 1 to 4 parts.
SHARES = {f"src{i}": 1 + i % 4 for i in range(20)}
BLOCK_ROWS = 8
BUCKET_ROWS = 512
RANGE_BUCKETS = 4096  # buckets summed up in one task
ADDED = ("mix_stream", "mix_block", "mix_phase", "mix_slot", "mix_row")


def edf_period(shares: str = "shares", total: str = "k") -> str:
    """SQL: 0-based index of the source served in each of the K slots of one period."""
    pick = f"""array_min(transform({shares}, (w, s) -> if(st.served[s] < w AND (st.served[s] * {total}) div w <= t,
        struct(((st.served[s] + 1) * {total} + w - 1) div w AS due, s AS s), NULL))).s"""
    return f"""aggregate(sequence(0L, {total} - 1),
        named_struct('served', transform({shares}, w -> 0L), 'picks', cast(array() AS array<int>)),
        (st, t) -> transform(array({pick}), p -> named_struct(
            'served', transform(st.served, (c, s) -> c + if(s = p, 1L, 0L)), 'picks', concat(st.picks, array(p))))[0],
        st -> st.picks)"""


def schedule(sizes: DataFrame) -> DataFrame:
    """sizes(stream, share, blocks): one row per stream, at most the number of named shares plus one.

    Returns for every phase, stream and j < share the slot in a full period and in the phase's last period.
    """
    s = sizes.where("blocks > 0").withColumn("ends", F.expr("(blocks + share - 1) div share"))
    one = s.groupBy().agg(F.sort_array(F.collect_list(F.struct("stream", "share", "blocks", "ends"))).alias("all"))
    phases = one.selectExpr("all", "array_sort(array_distinct(transform(all, x -> x.ends))) AS cuts").selectExpr("all", "cuts", "posexplode(cuts) AS (phase, until)")
    p = phases.selectExpr("phase", "until", "if(phase = 0, 0L, cuts[phase - 1]) AS since", "filter(all, x -> x.ends >= until) AS live",
                          "aggregate(filter(all, x -> x.ends < until), 0L, (a, x) -> a + x.blocks) AS done")
    p = p.selectExpr("*", "transform(live, x -> x.share) AS shares", "aggregate(live, 0L, (a, x) -> a + x.share) AS k")
    p = p.selectExpr("*", f"{edf_period()} AS picks")
    slots = p.selectExpr("phase", "since", "until", "done", "k", "live", "posexplode(picks) AS (slot, s)").selectExpr("*", "live[s] AS src")
    by = W.partitionBy("phase", "s").orderBy("slot")
    slots = slots.withColumn("j", F.row_number().over(by).cast("long") - 1)
    used = F.expr("src.ends > until OR j < src.blocks - (until - 1) * src.share").cast("long")
    slots = slots.withColumn("last_slot", F.sum(used).over(W.partitionBy("phase").orderBy("slot")) - 1)
    return slots.selectExpr("src.stream AS stream", "src.share AS share", "phase", "since", "until", "done", "k", "j", "slot", "last_slot")


def mix_sources(docs: DataFrame, shares: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, other_share: int = 1, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of ``docs`` with mix_stream, mix_block (of its stream), mix_phase, mix_slot (global order of blocks) and
    mix_row (in its block). Reading in order of (mix_slot, mix_row) gives the mixture."""
    shares = SHARES if shares is None else shares
    if any(int(v) != v or v < 1 for v in [*shares.values(), other_share]):
        raise ValueError("shares are positive integers")
    own = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in ADDED]
    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    named = [F.lit(x) for kv in shares.items() for x in kv]
    share_of = lambda stream: F.coalesce(F.create_map(*named)[stream] if named else F.lit(None), F.lit(other_share)).cast("long")
    source = F.coalesce(F.col("source"), F.lit(""))
    stream = F.when(source.isin(*shares), source).otherwise(F.lit(OTHER)) if shares else F.lit(OTHER)
    d = docs.select(stream.alias("stream"), F.md5(F.to_json(F.struct(*own)).cast("binary")).alias("h"), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.struct(*own).alias("row"))
    d = d.withColumn("bucket", F.expr(f"cast(conv(substr(h, 1, 8), 16, 10) AS bigint) % {buckets}L"))
    # rows are numbered in steps, so that no task holds a whole source: within buckets, buckets within ranges of them, and
    # ranges against each other
    counts = d.groupBy("stream", "bucket").agg(F.count("*").alias("n")).withColumn("range", F.expr(f"bucket div {RANGE_BUCKETS}"))
    before = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("stream", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("stream", "range", before(W.partitionBy("stream").orderBy("range")).alias("base"))
    counts = counts.select("stream", "bucket", "range", before(W.partitionBy("stream", "range").orderBy("bucket")).alias("inner"))
    counts = counts.join(ranges, ["stream", "range"]).select("stream", "bucket", (F.col("base") + F.col("inner")).alias("before"))
    sizes = d.groupBy("stream").agg(F.count("*").alias("n")).select("stream", F.expr(f"(n + {block_rows} - 1) div {block_rows}").alias("blocks"))
    plan = schedule(sizes.withColumn("share", share_of(F.col("stream"))))
    # one array a stream, with at most streams x share entries: both are parameters, so the plan is bounded
    plan = plan.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("until", "j", "since", "phase", "done", "k", "slot", "last_slot"))).alias("plan"))
    number = F.row_number().over(W.partitionBy("stream", "bucket").orderBy("h", "key")).cast("long") - 1
    d = d.withColumn("rn", number).join(counts, ["stream", "bucket"]).join(F.broadcast(plan), "stream").select("stream", "row", "plan", share_of(F.col("stream")).alias("share"), (F.col("rn") + F.col("before")).alias("i"))
    d = d.withColumn("block", F.expr(f"i div {block_rows}")).withColumn("u", F.expr("block div share"))
    d = d.withColumn("at", F.expr("filter(plan, x -> x.until > u AND x.since <= u AND x.j = block % share)[0]"))
    slot = F.expr("at.done + u * at.k + if(u = at.until - 1, at.last_slot, cast(at.slot AS bigint))")
    return d.select("row.*", F.col("stream").alias("mix_stream"), F.col("block").alias("mix_block"), F.col("at.phase").alias("mix_phase"), slot.alias("mix_slot"), F.expr(f"i % {block_rows}").alias("mix_row"))
