"""Secret scans over a ledger of content-addressed blobs (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, boxed, in_row, shuffles_removed, text_of, unboxed


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are findings if ``group`` of the match has ``least`` characters or more.

    Matches are leftmost and don't overlap; those that fail are dropped, but use
    up their text. A change of the pattern needs a new version.
    """

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),  # a run of 24 and more is the match of + at the run's start
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # what begins like one and isn't is a match that fails, so that a run is looked at twice at most
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)|eyJ[A-Za-z0-9_-]*", 1, 1, version=2),
    Rule("prefixed", r"(?:gh[opsu]|xox[abp]|sk_live)[_-][A-Za-z0-9_-]{16,}"),
)
RULES = BASE + MORE
#: Spans in code points and in bytes, ends exclusive.
SPANS = "array<struct<start:int,end:int,byte_start:int,byte_end:int>>"
#: Rows of a ledger.
LEDGER = f"sha string, rule string, version int, spans {SPANS}"


def rule_parts(rule: Rule, text: str = "text") -> Column:
    """Array with a part for each match: its length, and that with what is before it up to the match before, in code points and bytes, and whether it counts; empty without matches."""
    matches, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)

    def part(match: Column, gap: Column) -> Column:
        long_enough = F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least if rule.group or rule.least > 1 else F.lit(True)
        return F.struct((F.length(gap) + F.length(match)).alias("step"), F.length(match).alias("length"), (F.octet_length(gap) + F.octet_length(match)).alias("byte_step"), F.octet_length(match).alias("byte_length"), long_enough.alias("counts"))

    # one gap more than matches: the last, after which nothing comes
    found = F.filter(F.zip_with(matches, between, lambda m, g: F.when(m.isNotNull(), part(m, g))), lambda x: x.isNotNull())
    return F.when(F.col(text).rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<step:int,length:int,byte_step:int,byte_length:int,counts:boolean>>"))


def content_address(text: Column) -> Column:
    return F.sha2(text, 256)


def scan(blobs: DataFrame, work: WorkFolder, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (sha, text, todo: names of the rules to apply): sha, rule, version, spans.

    A text is read once; what is between its matches and the matches tell, summed up in their order, where each
    starts: the time is proportional to the text and its matches.
    """
    each = F.array(*[F.when(F.array_contains("todo", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), rule_parts(r).alias("parts"))) for r in rules])
    found = work.cut(blobs.select("sha", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("sha", "x.rule", "x.version", "x.parts"), "parts")
    none = found.filter(F.size("parts") == 0).select("sha", "rule", "version", F.array().cast(SPANS).alias("spans"))
    parts = found.filter(F.size("parts") > 0).select("sha", "rule", "version", F.posexplode("parts").alias("place", "p"))
    upto = Window.partitionBy("sha", "rule", "version").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda step, name: F.sum(step).over(upto).cast("int").alias(name)
    ends = parts.select("sha", "rule", "version", "p", total(F.col("p.step"), "end"), total(F.col("p.byte_step"), "byte_end"))
    span = F.when(F.col("p.counts"), F.struct((F.col("end") - F.col("p.length")).alias("start"), "end", (F.col("byte_end") - F.col("p.byte_length")).alias("byte_start"), "byte_end"))
    return none.union(ends.groupBy("sha", "rule", "version").agg(F.array_sort(F.collect_list(span)).alias("spans")))


class Ledger:
    """What every rule version found in every blob scanned so far: Parquet in a folder, one part for each update.

    It can be opened again by its path. An update that fails leaves no part; run again, it scans what the others lack.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scans the blobs of ``versions`` (text) for the rule versions they lack, and appends what is found."""
        work = WorkFolder(self.spark, "scan")
        with shuffles_removed(self.spark):
            update_ledger(versions, self.rows(), work, rules).write.mode("append").option("compression", "zstd").parquet(self.path)
        work.drop("parts")


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs (sha, text, todo) of ``versions`` (text) with a rule version that the ledger lacks.

    Copies meet in a map-side aggregation by address before any text is shuffled.
    """
    blobs = versions.select(text_of().alias("text")).select(content_address(F.col("text")).alias("sha"), "text").dropDuplicates(["sha"])
    everything = F.array(*[F.lit(r.name) for r in rules])
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    done = ledger.filter(current).groupBy("sha").agg(F.collect_set("rule").alias("done"))
    joined = blobs.join(done, "sha", "left").select("sha", "text", F.array_except(everything, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
    return joined.filter(F.size("todo") > 0)


def update_ledger(versions: DataFrame, ledger: DataFrame, work: WorkFolder, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows to append to the ledger: what the rules find in blobs not yet scanned at their version."""
    return scan(unseen(versions, ledger, rules), work, rules)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with a finding: sha, found (array of struct(start, place of the rule, end, rule), sorted)."""
    place = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        place = F.when((F.col("rule") == r.name) & (F.col("version") == r.version), i).otherwise(place)
    rows = ledger.filter(F.size("spans") > 0).select("sha", "rule", place.alias("at"), "spans").filter("at IS NOT NULL")
    rows = rows.dropDuplicates(["sha", "rule"]).select("sha", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("at"), s["end"].alias("end"), F.col("rule"))).alias("part"))
    return rows.groupBy("sha").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("found"))


def masks(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with a finding: sha, masks (array of struct(first, last) in bytes): the findings, those that overlap as one, in order."""
    spans = ledger.join(F.broadcast(_current(ledger.sparkSession, rules)), ["rule", "version"], "left_semi").select("sha", F.explode("spans").alias("s")).select("sha", "s.byte_start", "s.byte_end").distinct()
    order = Window.partitionBy("sha").orderBy("byte_start", "byte_end")
    before = F.max("byte_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.coalesce(F.col("byte_start") >= before, F.lit(True)).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("sha", "run").agg(F.min("byte_start").alias("first"), F.max("byte_end").alias("last"))
    return each.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("masks"))


def _current(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each rule: rule, version."""
    return spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")


def spell(found: Column, only: tuple[Rule, ...] | None = None) -> Column:
    """kind:start:end of each span, comma-joined."""
    kept = found if only is None else F.filter(found, lambda x: x["rule"].isin(*[r.name for r in only]))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    The blobs that the ledger at ``ledger_path`` (a new one, if none is named) lacks are scanned, and all rows are joined to what it
    holds. A null text is the empty blob; without findings the counts are 0, the digest is that
    of the empty text, and spans is empty. Repeated rows and ids each get their own row. An empty table gives no rows.
    """
    ledger = Ledger(docs.sparkSession, ledger_path or f"{WorkFolder(docs.sparkSession, 'ledger').path}/rows")
    ledger.update(docs.select("text"))
    paths = docs.select("doc_id", content_address(text_of()).alias("sha"))
    empty = F.array().cast("array<struct<start:int,at:int,end:int,rule:string>>")
    rows = paths.join(findings(ledger.rows()), "sha", "left").select("doc_id", F.coalesce("found", empty).alias("found"))
    count = lambda name: F.size(F.filter("found", lambda x: x["rule"] == name)).cast("long").alias(f"n_{name}")
    return rows.select("doc_id", *[count(r.name) for r in BASE], F.sha2(spell(F.col("found"), BASE), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"))


def find_in_two_versions(docs: DataFrame) -> DataFrame:
    """``find_secrets`` of ``docs`` as the second version of a growing table: the first, of half the documents by a hash of their ids, is in the ledger by then."""
    path = f"{WorkFolder(docs.sparkSession, 'ledger').path}/rows"
    Ledger(docs.sparkSession, path).update(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).select("text"))
    return find_secrets(docs, path)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every finding replaced by ``mask``, overlapping ones together; n_chars, if there, follows where a text changes.

    Columns, whatever their names, as given; every row stays, a null text is null. The pieces between findings
    come from the findings' bounds in bytes, so that no text is read once for each finding.
    """
    work = WorkFolder(docs.sparkSession, "secrets")
    ledger = Ledger(docs.sparkSession, f"{work.path}/rows")
    ledger.update(docs.select("text"))
    joined = boxed(docs).withColumn("sha", content_address(text_of(in_row("text")))).join(masks(ledger.rows()), "sha", "left")
    cut = "transform(sequence(0, size(masks)), i -> CAST(substring(b, IF(i = 0, 0, masks[i - 1].last) + 1, IF(i = size(masks), octet_length(b), masks[i].first) - IF(i = 0, 0, masks[i - 1].last)) AS STRING))"
    old = in_row("text")
    clean = joined.withColumn("b", F.when(F.col("masks").isNotNull(), old.cast("binary"))).withColumn("clean", F.when(F.col("masks").isNull(), old).otherwise(F.array_join(F.expr(cut), mask)))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masks").isNull(), in_row("n_chars")).otherwise(F.length("clean").cast("long"))
    return unboxed(clean, **new)


def _oracle() -> str:
    """The query's rows in DuckDB: what is between matches and the matches, summed up in their order."""
    quoted = lambda r: r.pattern.replace("'", "''")
    found = " UNION ALL ".join(f"SELECT r, {i} AS k, regexp_extract_all(t, '{quoted(r)}') AS m, regexp_extract_all(t, '{quoted(r)}', {r.group}) AS g, regexp_split_to_array(t, '{quoted(r)}') AS gap FROM d WHERE regexp_matches(t, '{quoted(r)}')" for i, r in enumerate(RULES))
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    names = ", ".join(f"'{r.name}'" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}), u AS (SELECT r, k, m, g, gap, unnest(range(1, len(m) + 1)) AS i FROM f),
e AS (SELECT r, k, length(m[i]) AS n, length(g[i]) AS c, sum(length(gap[i]) + length(m[i])) OVER (PARTITION BY r, k ORDER BY i)::BIGINT AS stop FROM u),
s AS (SELECT r, k, stop - n AS start, stop, ([{names}])[k + 1] || ':' || (stop - n) || ':' || stop AS x FROM e WHERE c >= CASE k {least} END),
a AS (SELECT r, sum((k = 0)::INT)::BIGINT AS a, sum((k = 1)::INT)::BIGINT AS b, sum((k = 2)::INT)::BIGINT AS h, string_agg(x, ',' ORDER BY start, k, stop) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY start, k, stop) AS every FROM s GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN a USING (r)
"""


ORACLE = _oracle()
