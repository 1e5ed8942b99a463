"""Secret scans with an incremental blob ledger.

Every text version is addressed by the SHA-256 of its bytes. The ledger is a Parquet table of (blob, rule_version,
findings). A scan computes the blobs of its rows, drops those the ledger already has under the current rule version,
scans each remaining blob once, appends the results, and joins the ledger back to all paths (rows). A second scan of
the same texts, or of copies under other ids, reads no text again; a change of RULES changes ``rule_version`` and makes
every blob unseen.

Copies are dropped inside each task before any text moves, so a blob that makes up a third of all rows costs one row
per task; texts move compressed. Results move once more by blob, in a plain join whose skew Spark splits.

Defined cases: a null text is the empty text (it has no findings); texts of any length are scanned whole; null and
repeated ids are carried through; repeated rows give repeated results; findings that start together are in the order of
KINDS; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BASE_KINDS = ("assign", "access", "hex")
# The forms of the secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ADDED = {
    "private_key": (b"PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----")),
    "jwt": (b"eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "github": (b"gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": (b"xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    "google": (b"AIza", re.compile(r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}")),
}
KINDS = (*BASE_KINDS, *ADDED)
RULES = "|".join(["2", ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *(f"{k}={p.pattern}" for k, (_, p) in ADDED.items())])
RULE_VERSION = hashlib.sha256(RULES.encode()).hexdigest()[:16]

_HEX_RUN = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
LEDGER = "blob binary, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """All (start, end, kind), ends exclusive, in order of start, then kind."""
    raw, found = text.encode(), []
    low = raw.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX_RUN):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    for kind, (mark, pattern) in ADDED.items():
        if mark in raw:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(text: str) -> tuple[int, int, int, str, str]:
    found = find_secrets(text)
    base = [s for s in found if s[2] in BASE_KINDS]
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    return (*(sum(s[2] == k for s in base) for k in BASE_KINDS), hashlib.sha256(say(base).encode()).hexdigest(), say(found))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First text of each blob of this task, compressed. Holds 32 bytes a distinct blob."""
    seen: set[bytes] = set()
    for batch in batches:
        blobs, texts = [], []
        col = batch.column(0).cast(pa.large_binary())
        for i in range(len(col)):
            raw = col[i].as_py() or b""
            key = hashlib.sha256(raw).digest()
            if key not in seen:
                seen.add(key)
                blobs.append(key)
                texts.append(zlib.compress(raw, 1))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], names=["blob", "z"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for blob, z in zip(batch.column(0).to_pylist(), batch.column(1)):
            if blob not in seen:
                seen.add(blob)
                rows.append((blob, RULE_VERSION, *digest(zlib.decompress(z.as_py()).decode())))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)


def scan_unseen(texts: DataFrame, ledger: str) -> None:
    """Scan the blobs of ``texts`` that the ledger lacks under this rule version, and append them to it."""
    spark = texts.sparkSession
    blobs = texts.select("text").mapInArrow(_distinct, "blob binary, z binary")
    known = read_ledger(texts, ledger)
    if known is not None:
        blobs = blobs.join(known.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs.repartition(parts, "blob").mapInArrow(_scan, LEDGER).write.mode("append").parquet(ledger)


def read_ledger(like: DataFrame, ledger: str) -> DataFrame | None:
    spark = like.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def scan_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans of every row; findings come from the ledger."""
    ledger = ledger or c.shared_path(docs.sparkSession, "secret-ledger")
    scan_unseen(docs, ledger)
    found = read_ledger(docs, ledger).where(F.col("rule_version") == RULE_VERSION).drop("rule_version").dropDuplicates(["blob"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))
    return rows.join(found, "blob").select("doc_id", F.lower(F.hex("blob")).alias("blob"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
