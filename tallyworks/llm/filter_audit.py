"""Filter interaction audit: what every order of five filters would remove, from 32 joint-failure counts.

Each filter gives a 0/1 flag a document. For every set S of filters the product of its flags is summed: the number of
documents that fail all of S, J(S), J of the empty set being all documents; likewise for the good and for the toxic
ones. These sums are all that leaves the tasks, so the shuffle holds one row of 96 numbers a part and task. Everything
else is inclusion-exclusion over them:

* survivors of a set P of filters: the sum of (-1)^|T| J(T) over all T within P (Moebius inversion), so what a step
  removes is the difference of two survivor counts, and what is redundant is J(filter) less that;
* failing one filter only: the survivors of the four others less those of all five;
* the removal game v(P) = documents that fail some filter of P has the Harsanyi dividends (-1)^(|T|+1) J(T); a
  filter's Shapley value is the sum of dividend / |T| over the sets T that hold it, and times 120 it is an integer.

Filters A to D depend on the text alone. E (an equal text has a smaller id) needs the smallest id of each text: texts
are named by their SHA-256, one narrow table of the documents' marks is written, and it is joined with the smallest
ids on (id, text), so that no text, however often it is copied, is a hot key.

Defined cases: a null text is the empty text (it fails A and, beyond the smallest id, E); a row without an id has no
smaller one, is smaller than none and has no label; repeated rows count as often as they occur (equal ids are not
smaller, so the first id of a text passes E in all its rows); of repeated labels one that marks is enough; a null source
is the part ''; extra columns are ignored; without documents there are no parts, without labels the losses are 0.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_SPACE = " \t\n\x0b\x0c\r"


def text_flags(text: Column) -> dict[str, Column]:
    """Flags of the filters that read one text."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    return {
        "A": n < MIN_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * CAPITAL_PERCENT,
        "D": text.rlike("[#$%&*|]"),
    }


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, part, blob and the flags A to D of each row: the only pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), *[x.cast("int").alias(k) for k, x in text_flags(F.col("text")).items()])


def joint_failures(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for all rows, the good and the toxic ones, the array of J(S) over the sets S as bit masks."""
    first = marked.where("doc_id IS NOT NULL").groupBy("blob").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(k) == 1).cast("int")), F.lit(0)).alias(v) for k, v in (("quality", "good"), ("toxic", "bad"))])
    # repeated rows become one, so that no (id, text) is hot
    rows = marked.where("doc_id IS NOT NULL").groupBy(*marked.columns).agg(F.count("*").alias("n"))
    rows = rows.join(first, ["blob", "doc_id"], "left").join(known, "doc_id", "left")
    rows = rows.select("part", *FILTERS[:-1], F.col("first").isNull().cast("int").alias("E"), "n", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("good", "bad")])
    lost = marked.where("doc_id IS NULL").select("part", *FILTERS[:-1], *[F.lit(v).alias(k) for k, v in (("E", 0), ("n", 1), ("good", 0), ("bad", 0))])
    rows = rows.unionByName(lost)

    def product(s: int, weight: str) -> Column:
        out = F.col("n") if weight == "n" else F.col("n") * F.col(weight)
        for b, f in enumerate(FILTERS):
            out = out * F.col(f) if s >> b & 1 else out
        return F.sum(out)

    sums = rows.groupBy("part").agg(*[product(s, w).alias(f"{w}{s}") for w in ("n", "good", "bad") for s in range(SETS)])
    return sums.select("part", *[F.array(*[F.col(f"{w}{s}") for s in range(SETS)]).alias(f"j_{w}") for w in ("n", "good", "bad")])


def _over(sets: list[int], values: str, weigh) -> Column:
    """Sum of weigh(size of T) * J(T) over the given sets."""
    out = F.lit(0).cast("long")
    for t in sets:
        out = out + F.col(values)[t] * weigh(t.bit_count())
    return out


def survivors(values: str) -> Column:
    """Array over all sets P: the rows that fail no filter of P."""
    return F.array(*[_over([t for t in range(SETS) if t & p == t], values, lambda k: (-1) ** k) for p in range(SETS)])


def interactions(joint: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    bits = range(len(FILTERS))
    alone = F.array(*[F.col("s_n")[SETS - 1 - (1 << b)] - F.col("s_n")[SETS - 1] for b in bits])
    shapley = F.array(*[_over([t for t in range(SETS) if t >> b & 1], "j_n", lambda k: (-1) ** (k + 1) * len(ORDERS) // k) for b in bits])
    x = joint.select("part", "j_n", *[survivors(f"j_{w}").alias(f"s_{w}") for w in ("n", "good", "bad")])
    x = x.select("*", alone.alias("alone"), shapley.alias("phi"))
    x = x.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = f"(ascii(substr(filter_order, {{}}, 1)) - {ord(FILTERS[0])})"
    before = " + ".join(f"IF(step > {i}, shiftleft(1, {at.format(i)}), 0)" for i in range(1, len(FILTERS)))
    x = x.withColumn("bit", F.expr(at.format("step"))).withColumn("before", F.expr(before)).withColumn("after", F.expr("before + shiftleft(1, bit)"))
    gone = lambda w: f"s_{w}[before] - s_{w}[after]"
    out = {"kept": "s_n[after]", "removed": gone("n"), "redundant": f"j_n[shiftleft(1, bit)] - ({gone('n')})", "unique_fails": "alone[bit]", "good_lost": gone("good"), "toxic_lost": gone("bad"), "shapley": "phi[bit]"}
    return x.select("part", "filter_order", "step", *[F.expr(v).alias(k) for k, v in out.items()])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    marked = c.materialize(marks(docs), "audit-marks")
    joint = c.materialize(joint_failures(marked, labels), "audit-joint")
    c.release(marked)
    return interactions(joint)
