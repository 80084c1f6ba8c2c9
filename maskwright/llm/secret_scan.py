"""Secret scans through an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, a
row per blob and scan, the rule versions that the blob was scanned by together with what they
found; only unseen pairs of blob and rule version are scanned, each distinct blob once, and
findings are joined back to all paths. A row says both at once, so a scan that is cut off
leaves whole rows or none, and can be run again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, written


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches; one is kept if `keep` (SQL over m, the match) holds. hint: a cheap SQL test of text that every match passes."""

    kind: str
    version: int
    pattern: str
    keep: str
    hint: str

    @property
    def id(self) -> str:
        return f"{self.kind}/{self.version}"


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key to its END line, or, where that is missing, with the headers and the base64 that follow.
_PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\t\r\n]*(?:-[A-Za-z0-9+/=:,\x20\t\r\n]+){0,8}-----END [A-Z0-9 ]*PRIVATE KEY-----|(?:[\x20\t\r\n]*(?:Proc-Type|DEK-Info):[^\r\n]*){0,3}[\x20\t\r\n]*[A-Za-z0-9+/=\r\n]*)"
#: User and password in a url; a longer scheme is matched by its end.
_URLAUTH = r"[a-z][a-z0-9+]{1,30}://[^\s/:@]+:[^\s/:@]{3,}@"
#: In the order in which spans that start together are listed; the first three are the base rules.
RULES = (
    Rule("assign", 2, _ASSIGN, r"""length(regexp_extract(m, r'[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)\z', 1)) >= 8""", r"text rlike r'(?i)password|passwd|secret|token|api_?key'"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "length(m) >= 16", "contains(text, 'AKIA')"),
    Rule("hex", 1, r"[0-9a-f]{32,}", "true", "text rlike '[0-9a-f]{32}'"),
    Rule("pem", 2, _PEM, "true", "contains(text, 'PRIVATE KEY-----')"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true", "contains(text, 'eyJ')"),
    Rule("pat", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", "true", "contains(text, 'gh')"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", "true", "contains(text, 'xox')"),
    Rule("urlauth", 2, _URLAUTH, "true", "contains(text, '://')"),
)
BASE = ("assign", "access", "hex")
BLOB = "sha2(coalesce(text, ''), 256)"
LEDGER = "blob string, rules array<string>, found array<struct<rule:string,start:int,end:int>>"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(rule: Rule) -> str:
    """SQL for the kept matches of a text, as array<struct<gap, m>> of the length of the gap before each match and the match.

    split() and regexp_extract_all() step through the same leftmost non-overlapping matches.
    """
    p = _lit(rule.pattern)
    return f"if({rule.hint}, arrays_zip(transform(split(text, {p}, -1), g -> length(g)), regexp_extract_all(text, {p}, 0)), null)"


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs(blob, text, rules: ids of those to scan by) to LEDGER rows, one per blob: where each rule keeps a match, in code points, end exclusive."""
    pairs = [F.when(F.array_contains("rules", r.id), F.struct(F.lit(i).alias("rule"), F.expr(_found(r)).alias("found"))) for i, r in enumerate(rules)]
    hits = blobs.select("blob", "rules", F.explode_outer(F.filter(F.array(*pairs), lambda x: F.size(x["found"]) > 1)).alias("x"))
    each = hits.select("blob", "rules", F.col("x.rule").alias("rule"), F.posexplode_outer("x.found").alias("nth", "at")).toDF("blob", "rules", "rule", "nth", "at")
    each = each.select("blob", "rules", "rule", "nth", F.col("at").getField("0").alias("gap"), F.col("at").getField("1").alias("m"))
    long = F.coalesce(F.length("m"), F.lit(0))
    end = F.sum(F.col("gap") + long).over(Window.partitionBy("blob", "rule").orderBy("nth"))
    spans = each.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - long).cast("int"))
    keep = reduce(lambda a, b: a | b, [(F.col("rule") == i) & F.expr(r.keep) for i, r in enumerate(rules)])
    name = F.get(F.array(*[F.lit(r.id) for r in rules]), F.col("rule"))
    kept = F.when(F.col("m").isNotNull() & keep, F.struct(name.alias("rule"), "start", "end"))
    return spans.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(kept).alias("found"))


class Ledger:
    """A written table of LEDGER rows at `path` in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def _scans(self) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else None

    def seen(self) -> DataFrame:
        """(blob, rule), distinct: the pairs scanned so far."""
        scans = self._scans()
        if scans is None:
            return self.spark.createDataFrame([], "blob string, rule string")
        return scans.select("blob", F.explode("rules").alias("rule")).distinct()

    def findings(self) -> DataFrame:
        """(blob, rule, start, end), distinct: two scans of one pair, as two jobs at a time may make, count once."""
        scans = self._scans()
        if scans is None:
            return self.spark.createDataFrame([], "blob string, rule string, start int, end int")
        return scans.select("blob", F.inline("found")).distinct()

    def update(self, versions: DataFrame, rules=RULES) -> None:
        """Scan what of versions(text) the ledger has not seen under these rules, and append that in one write.

        Distinct blobs are pre-aggregated before they are shuffled; a blob is scanned by the
        rules that it lacks only.
        """
        blobs = versions.select(F.expr(BLOB).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        all_ = F.array(*[F.lit(r.id) for r in rules])
        scans = self._scans()
        if scans is None:
            lacking = blobs.withColumn("rules", all_)
        else:
            had = scans.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("had"))
            lacking = blobs.join(had, "blob", "left").withColumn("rules", F.array_except(all_, F.coalesce("had", F.expr("cast(array() as array<string>)")))).where("size(rules) > 0")
        scan(lacking.select("blob", "text", "rules"), rules).write.mode("append").parquet(self.path)


def findings_by_path(docs: DataFrame, ledger: Ledger, rules=RULES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, _mw_spans (array of start, rule, end by start, then rule as listed); one row per row of docs."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.lit(i))])
    rows = ledger.findings().withColumn("rule", rank[F.col("rule")]).where("rule is not null")
    by_blob = written(rows.groupBy(F.col("blob").alias("_mw_blob")).agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end"))).alias("_mw_spans")), "by-blob")
    none = F.expr("cast(array() as array<struct<start:int,rule:int,end:int>>)")
    return docs.select(*carry, F.expr(BLOB).alias("_mw_blob")).join(by_blob, "_mw_blob", "left").select(*carry, F.coalesce("_mw_spans", none).alias("_mw_spans"))


def spans_text(spans, rules=RULES):
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, and all spans.

    Null texts count as empty: no spans, and the digest of the empty string. Repeated rows and
    null ids keep their rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark)
    ledger.update(docs)
    rows = findings_by_path(docs, ledger)
    count = lambda i: F.size(F.filter("_mw_spans", lambda x: x["rule"] == i)).cast("long")
    base = F.filter("_mw_spans", lambda x: x["rule"] < len(BASE))
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("_mw_spans")).alias("spans"))


def masked(docs: DataFrame, ledger: Ledger, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of its text put out by the mark (overlapping spans by one) and n_chars, where present, counted anew."""
    # the columns of docs travel as one struct, so that they may bear any names
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    rows = findings_by_path(whole, ledger, carry=("row",))
    own = F.col("row")["text"]
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(own, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], x["end"]).alias("at"),
    )
    tail = lambda a: F.concat(a["out"], F.substring(own, a["at"] + 1, F.length(own)))
    hit = F.size("_mw_spans") > 0
    new = {"text": F.when(hit, F.aggregate("_mw_spans", start, step, tail)).otherwise(own)}
    rows = rows.withColumn("text", new["text"])
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("text")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(F.col("text") if c == "text" else new.get(c, F.col("row")[c])).alias(c) for c in docs.columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked; every document stays."""
    ledger = Ledger(spark)
    ledger.update(docs.select("text"))
    return masked(docs, ledger)


def _sql_spans(kind: str, order: int, pattern: str, hint: str, keep: str) -> str:
    return f"""
  SELECT doc_id, rid, '{kind}' AS kind, {order} AS o, s, e FROM (
    SELECT doc_id, rid, m, (sum(len(g) + len(m)) OVER w - len(m))::BIGINT AS s, (sum(len(g) + len(m)) OVER w)::BIGINT AS e FROM (
      SELECT doc_id, rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT doc_id, rid, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gs FROM d WHERE regexp_matches(text, {hint})))
    WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {keep}"""


_Q = "''"
_SQL_RULES = (
    ("assign", rf"""'(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["{_Q}]?\x20*[:=]\x20*["{_Q}]?[A-Za-z0-9+/_.=-]+'""", rf"""len(regexp_extract(m, '[:=]\x20*["{_Q}]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""),
    ("access", "'AKIA[A-Z0-9]+'", "len(m) >= 16"),
    ("hex", "'[0-9a-f]{32,}'", "true"),
    ("pem", f"'{_PEM}'", "true"),
    ("jwt", r"'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'", "true"),
    ("pat", "'gh[pousr]_[A-Za-z0-9]{36,}'", "true"),
    ("chat", "'xox[abprs]-[A-Za-z0-9-]{10,}'", "true"),
    ("urlauth", f"'{_URLAUTH}'", "true"),
)
#: The rows of op2_secret_scan.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
f AS ({" UNION ALL ".join(_sql_spans(k, i, p, p, keep) for i, (k, p, keep) in enumerate(_SQL_RULES))}),
g AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM f GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
