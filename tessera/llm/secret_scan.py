"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. A scan looks up which (blob, rule version) pairs the ledger has, reads one text
for each blob with a pair that it lacks, appends a row for each blob scanned, and joins the findings back to every path (here a
document id) that has the blob. Changing a rule means a new version of it, so only that rule runs again, on known blobs too. Beside
the blobs the ledger keeps all pairs of path and blob that it ever saw, so ``history`` reports secrets of former versions.

Edge cases: a null text is the empty blob; equal texts, repeated rows included, are scanned once and reported for each row; a null id
is a path like others; an empty table appends nothing; further columns are ignored. Matches are leftmost and do not overlap within a
kind; spans count code points of the whole text, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, scratch, texts, unused


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret. group: the match counts if this group has ``least`` characters or more. hints: lower-case texts of which a match has one."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    flags: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: A key from its BEGIN line to the END line. Where that is missing, the lines of base64 that follow, or runs of 16 or more without line
#: ends; headers (Proc-Type, DEK-Info) may stand before them. Line ends may be escaped, lines quoted or indented.
_EOL = r"[\x20\t\"',;]*+(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t>#*|\"'+]*+"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:(?:{_EOL}[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)++(?:{_EOL})?)?+"
    rf"(?:{_EOL}[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t,;]*+(?:[\r\n\\]|[\"'](?!\w)|\Z))|(?:[\s>#*|\"'+]|\\[rn])*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+)"
)

#: Kinds in the order in which spans of one start are listed; the first three are the base kinds.
RULES = (
    SecretRule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"), re.IGNORECASE | re.ASCII,
    ),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    # A run of 24 or more is a run of any length that counts, found without stopping at each short one.
    SecretRule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    SecretRule("private_key", 2, PRIVATE_KEY, hints=("private key-----",)),
    # One name after another, as in "secret: token: ...", of which assign takes the second for a value that is too short.
    SecretRule(
        "assign_chain", 1, r"""(?:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?){2,}([A-Za-z0-9+/_.=-]+)""", 1, 6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"), re.IGNORECASE | re.ASCII,
    ),
    SecretRule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyj",)),
    SecretRule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("gh",)),
)
BASE = ("assign", "access", "hex")
#: Blobs to scan (32 bytes each) that are few enough to be handed to every executor, so that other texts need not move.
FEW = 100_000
FINDING = "array<struct<kind string, start int, end int>>"


def find(text: str, rules: tuple[SecretRule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches that count."""
    lower = text.lower()
    return [
        (r.kind, *m.span())
        for r in rules
        if not r.hints or any(h in lower for h in r.hints)
        for m in re.finditer(r.pattern, text, r.flags)
        if len(m[r.group]) >= r.least
    ]


def scan(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """blobs: blob, text, due (keys of the rules to run). Gives blob, the keys as scanned, and the findings."""
    bounded_batches(blobs.sparkSession)

    def found(batches):
        for b in batches:
            due = [tuple(r for r in rules if r.key in keys) for keys in map(set, b.column("due").to_pylist())]
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, own)] for t, own in zip(texts(b.column("text")), due)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("blob"), b.column("due"), pa.array(got, kind)], ["blob", "scanned", "found"])

    return blobs.select("blob", "text", "due").mapInArrow(found, f"blob binary, scanned array<string>, found {FINDING}")


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # the first scan


def _seen(spark: SparkSession, ledger: str) -> DataFrame | None:
    return _stored(spark, ledger, f"blob binary, scanned array<string>, found {FINDING}")


def _remember(paths: DataFrame, ledger: str) -> None:
    """Appends to the ledger's history each pair of path and blob that it lacks, with the number of the scan that first saw it."""
    spark, kind = paths.sparkSession, dict(paths.dtypes)["doc_id"]
    new, number = paths.distinct(), 1
    if (old := _stored(spark, f"{ledger}-paths", f"doc_id {kind}, blob binary, first_scan int")) is not None:
        number = (old.agg(F.max("first_scan")).head()[0] or 0) + 1
        known = old.select(F.col("doc_id").alias("id_"), F.col("blob").alias("blob_"))
        new = new.join(known, new["doc_id"].eqNullSafe(known["id_"]) & (new["blob"] == known["blob_"]), "left_anti")
    new.withColumn("first_scan", F.lit(number)).write.mode("append").parquet(f"{ledger}-paths")


def history(spark: SparkSession, ledger: str, rules: tuple[SecretRule, ...] = RULES, kind: str = "bigint") -> DataFrame:
    """Every path that the ledger ever saw, with each of its versions: doc_id, first_scan, blob and spans (null if these rules did not
    run on it). A secret that a document no longer has is still found in the version that had it."""
    paths = _stored(spark, f"{ledger}-paths", f"doc_id {kind}, blob binary, first_scan int")
    return paths.join(findings(spark, ledger, rules), "blob", "left").select("doc_id", "first_scan", "blob", "spans")


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Scans what the ledger lacks and appends it. Gives paths: doc_id and blob of each row of docs.

    A text is read again only if its blob is due. Copies, rows that repeat whole among them, become one text a blob in each task before
    any text moves, so a blob is scanned once and no popular one is a hot key. All pairs of path and blob stay in the ledger's history.
    """
    spark = docs.sparkSession
    keys = F.array(*(F.lit(r.key) for r in rules))
    paths = materialize(docs.select("doc_id", address(F.col("text")).alias("blob")), "paths")
    _remember(paths, ledger)
    blobs = paths.select("blob").distinct().withColumn("due", keys)
    if (seen := _seen(spark, ledger)) is not None:
        # Rows of a blob: one a rule version at most. Only blobs of this scan are looked at.
        had = seen.join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("had"))
        blobs = blobs.join(had, "blob", "left").withColumn("due", F.array_except("due", F.coalesce("had", F.array().cast("array<string>")))).where("size(due) > 0")
    due = materialize(blobs, "due")
    texts_of = docs.select(address(F.col("text")).alias("blob"), "text")
    if due.count() <= FEW:
        texts_of = texts_of.join(F.broadcast(due.select("blob")), "blob", "left_semi")
    unseen = texts_of.groupBy("blob").agg(F.first("text").alias("text")).join(due, "blob")
    scan(unseen.select("blob", "text", "due"), rules).write.mode("append").parquet(ledger)
    return paths


def findings(spark: SparkSession, ledger: str, rules: tuple[SecretRule, ...] = RULES, of: DataFrame | None = None) -> DataFrame:
    """blob and all its spans by these rules, at their versions, sorted by start, then by the order of the rules. of: only these blobs."""
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    key = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.key)))
    own = F.filter("found", lambda x: F.array_contains("scanned", key[x.kind]))  # what an older version found no longer counts
    seen = _seen(spark, ledger)
    seen = seen if of is None else seen.join(of.select("blob").distinct(), "blob", "left_semi")
    spans = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(own))).alias("found"))
    sortable = F.transform("found", lambda x: F.struct(x.start.alias("start"), order[x.kind].alias("k"), x.end.alias("end"), x.kind.alias("kind")))
    return spans.select("blob", F.array_sort(F.filter(sortable, lambda x: x.k.isNotNull())).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """For each row of docs its doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "secret-ledger")
    paths = update_ledger(docs, ledger, rules)
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x.kind.isin(*BASE))
    digests = findings(spark, ledger, rules, paths).select("blob", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
    return paths.join(materialize(digests, "findings"), "blob").drop("blob")


def _merged(spans: Column) -> Column:
    """Spans sorted by start, those that overlap or touch made one."""
    span = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), span(last.start, F.greatest(last.end, x.end)))
        return F.when(F.size(a) == 0, span(x.start, x.end)).when(F.get(a, F.size(a) - 1).end >= x.start, grown).otherwise(F.concat(a, span(x.start, x.end)))

    return F.aggregate(spans, F.array().cast("array<struct<start int, end int>>"), step)


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs with each secret's span replaced by [SECRET]; all other rows and columns as they were, n_chars brought up to date where it exists."""
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "secret-ledger")
    paths = update_ledger(docs, ledger, rules)
    blob, spans = unused(docs.columns, "blob", "spans")
    found = findings(spark, ledger, rules, paths).where("size(spans) > 0").select(F.col("blob").alias(blob), _merged(F.col("spans")).alias(spans))
    some = materialize(found, "findings")
    # From the last to the first, so that the places of those before stay.
    step = lambda text, x: F.concat(F.substring(text, F.lit(1), x.start), F.lit("[SECRET]"), F.substring(text, x.end + 1, F.length(text)))
    clean = F.aggregate(F.reverse(F.col(spans)), F.col("text"), step)
    joined = docs.join(some, address(docs["text"]) == some[blob], "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean)
    own = {"text": text} | ({"n_chars": F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return joined.select(*(own[c].alias(c) if c in own else docs[c] for c in docs.columns))
