"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. A scan takes the (blob, rule version) pairs that the ledger lacks, one copy of each blob,
finds spans, and appends them to the ledger; findings then join back to all rows that hold the blob. Scanning again with the
same rules reads no text of a known blob. The version of the rules is a digest of what they are. :func:`scan_history` keeps the
(path, version, blob) rows of a history beside the ledger, so that a finding names every path and version that ever held it.

Rules (leftmost, not overlapping, for each kind; offsets are code points, ends exclusive). Base: ``assign`` a named credential with a value of 6 or
more characters, ``access`` an access-key id of 20 or more, ``hex`` a run of 24 or more lower-case hex digits. Added: ``pem`` a private key from
its header to the matching END line, or without one over the following base64 lines; ``url`` user and password of an address; ``token`` well-known forms of
service tokens (where the form has a checksum it must be right); ``jwt`` a signed web token whose header names an algorithm; ``entropy`` a run of 32 or
more base64 characters with lower and upper case and digits and at least 4.25 bits a character.

A null text is the empty text, without findings. Rows with equal texts get equal findings, each its own row; null ids are kept. An empty
table gives no rows and leaves the ledger as it is. Other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, record_batch, slices
from .common import load, maybe_broadcast, shared_dir

KINDS = ("assign", "access", "hex", "pem", "url", "token", "jwt", "entropy")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    r"|(?:[ \t]*\r?\n(?:[A-Za-z-]+: [^\n]*(?:\n[ \t]*\r?(?=\n))?|[ \t]*[A-Za-z0-9+/=]+[ \t]*(?=\r?(?:\n|\Z))))*)"
)

#: From the end of the scheme on; the scheme is read backwards from there, so a long run of its characters is read once.
URL = re.compile(r"://([^\s/?#:@]++:[^\s/?#@]++)@")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
# Public forms of service tokens; the first ends in a checksum.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?P<sum>gh[pousr]_[A-Za-z0-9]{36})|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9_-])"
)
TOKEN_MARKS = ("gh", "xox", "k_live_", "AIza", "glpat-")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
DENSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_BITS = 4.25

LEDGER = "blob binary, rules string, findings array<struct<kind:string,start:int,end:int>>"
FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def checksum(body: str) -> str:
    """CRC-32 of the body in six digits of base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def bits(run: str) -> float:
    """Shannon entropy of the characters of a run."""
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def _names_algorithm(head: str) -> bool:
    try:
        return b'"alg"' in base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
    except ValueError:
        return False


def _addresses(text: str):
    """User and password of every address whose scheme has a letter."""
    done = 0
    for m in URL.finditer(text):
        at = m.start()
        while at > done and (c := text[at - 1]) in SCHEME:
            if c.isalpha():
                yield m
                done = m.end()
                break
            at -= 1


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start, then kind in the order of KINDS."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text)]
    if "://" in text and "@" in text:
        found += [("url", *m.span(1)) for m in _addresses(text)]
    if any(mark in text for mark in TOKEN_MARKS):
        found += [("token", *m.span()) for m in TOKEN.finditer(text) if not m["sum"] or checksum(m["sum"][4:34]) == m["sum"][34:]]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text) if _names_algorithm(m[1])]
    for m in DENSE.finditer(text):
        run = m[0]
        if any(map(str.isdigit, run)) and any(map(str.islower, run)) and any(map(str.isupper, run)) and bits(run.rstrip("=")) >= LEAST_BITS:
            found.append(("entropy", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


#: The code that applies the patterns; to be raised whenever it changes what is found.
CODE_VERSION = 3
#: Of the patterns, their bounds and that: a ledger of other rules is not taken for one of these.
RULE_VERSION = hashlib.sha256("\n".join([p.pattern for p in (ASSIGN, ACCESS, HEX, PEM, URL, TOKEN, JWT, DENSE)] + [str(LEAST_BITS), str(CODE_VERSION)]).encode()).hexdigest()[:16]
#: Blobs that a task remembers while it drops copies; a copy that it misses goes when the blobs meet.
SEEN = 100_000


def _first_copies(batches):
    """(blob, text), copies dropped as far as the task remembers."""
    schema, seen = pa.schema([("blob", pa.binary()), ("text", pa.string())]), set()
    for batch in slices(batches, 0):
        blobs, texts = [], []
        for text in batch.column(0).to_pylist():
            blob = hashlib.sha256(text.encode()).digest()
            if blob not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(blob)
                blobs.append(blob), texts.append(text)
        yield record_batch([blobs, texts], schema)


def _scan(batches):
    """Rows sorted by blob: each blob is scanned once."""
    schema, last = pa.schema([("blob", pa.binary()), ("rules", pa.string()), ("findings", FINDINGS)]), None
    for batch in slices(batches, 1):
        blobs, findings = [], []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blob != last:
                last = blob
                blobs.append(blob), findings.append([dict(zip(("kind", "start", "end"), f, strict=True)) for f in find_secrets(text)])
        yield record_batch([blobs, [RULE_VERSION] * len(blobs), findings], schema)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def scan_secrets(docs: DataFrame, ledger: str) -> DataFrame:
    """docs(text) and the ledger's folder -> the ledger (blob, rules, findings) for this rule version, each blob once.

    The folder is made at the first scan. A scan that failed half-way may be run again: rows of a blob are equal, and reading keeps one.
    """
    spark = docs.sparkSession
    known = _exists(spark, ledger)
    texts = map_batches(docs.select(F.coalesce("text", F.lit("")).alias("text")), _first_copies, "blob binary, text string").repartition("blob")
    if known:
        seen = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == RULE_VERSION)
        texts = texts.join(seen.select("blob"), "blob", "left_anti").select("blob", "text")
    map_batches(texts.sortWithinPartitions("blob"), _scan, LEDGER).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == RULE_VERSION).dropDuplicates(["blob"])


def _findings_at(addressed: DataFrame, ledger: DataFrame) -> DataFrame:
    """addressed(..., blob) -> its other columns and findings (an empty array for a clean blob)."""
    # Clean blobs need no join: what joins back is the part of the ledger that has findings.
    dirty = maybe_broadcast(ledger.filter(F.size("findings") > 0).select("blob", "findings"))
    found = F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("findings")
    return addressed.join(dirty, "blob", "left").select(*(c for c in addressed.columns if c != "blob"), found)


def findings_of(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, findings (an empty array for a clean text)."""
    return _findings_at(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), ledger)


def scan_history(history: DataFrame, folder: str) -> DataFrame:
    """history(path, version, text), and the folder of ledger and places -> path, version, findings of every version that any scan has seen.

    Each scan gets the versions that are new, or all of them. A version that comes again with the same text adds nothing; with another text it
    is a further row.
    """
    spark, places = history.sparkSession, f"{folder}/places"
    rows = history.select("path", "version", "text")
    ledger = scan_secrets(rows, f"{folder}/blobs")
    own = rows.select(F.col("path").cast("string").alias("path"), F.col("version").cast("string").alias("version"), blob_of(F.col("text")).alias("blob")).distinct()
    if _exists(spark, places):
        known = spark.read.parquet(places).select(F.col("path").alias("_p"), F.col("version").alias("_v"), F.col("blob").alias("_b")).distinct()
        same = F.col("path").eqNullSafe(F.col("_p")) & F.col("version").eqNullSafe(F.col("_v")) & (F.col("blob") == F.col("_b"))
        own = own.join(known, same, "left_anti")
    own.write.mode("append").parquet(places)
    return _findings_at(spark.read.parquet(places).distinct(), ledger)


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping findings replaced by the mark."""
    span = "array<struct<start:int,end:int>>"
    runs = F.aggregate(
        findings,
        F.array().cast(span),
        lambda runs, f: F.when(
            (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] > f["start"]),
            F.concat(
                F.slice(runs, F.lit(1), F.size(runs) - 1),
                F.array(F.struct(F.try_element_at(runs, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(runs, F.lit(-1))["end"], f["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(runs, F.array(F.struct(f["start"].alias("start"), f["end"].alias("end"))))).cast(span),
    )
    # What stands before each run, and after the last: the gaps between ends and starts.
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text)))
    gaps = F.zip_with(ends, starts, lambda a, b: text.substr(a + 1, b - a))
    return F.when(F.size(findings) > 0, F.array_join(gaps, mark)).otherwise(text)


def redact_secrets(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """docs with a column ``text`` -> the same columns, findings replaced in the text."""
    blob, found = (f"{name}-{uuid.uuid4().hex}" for name in ("blob", "found"))  # no column of the caller's has such a name
    dirty = maybe_broadcast(ledger.filter(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(found)))
    joined = docs.withColumn(f"{blob}-own", blob_of(F.col("text"))).join(dirty, F.col(f"`{blob}-own`") == F.col(f"`{blob}`"), "left")
    text = F.when(F.col(f"`{found}`").isNotNull(), redacted(F.col("text"), F.col(f"`{found}`"))).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*(F.col(f"`{c}`") for c in docs.columns))


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    ledger = scan_secrets(docs, f"{shared_dir(spark)}/contourlake/ledger-{uuid.uuid4().hex}")
    out = findings_of(docs, ledger)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    return out.select("doc_id", *map(count, BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"))
