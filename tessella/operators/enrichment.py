"""A registry of events with references, enriched: tracks, links, and a report of its quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Track:
    """References that begin with one of ``prefixes`` (and a colon) are of this track and grade.

    ``each``: what follows the colon is a list separated by bars, and every part is linked as ``url`` with it at the end; else the reference has the one link ``url`` (none if empty).
    """

    name: str
    grade: str
    prefixes: tuple[str, ...]
    url: str = ""
    each: bool = False
    objective: bool = True
    assignment: str = "rule_based"


UNKNOWN = Track("unknown", "C", (), objective=False)


def cleaned(registry: DataFrame) -> DataFrame:
    """cl (trimmed, upper case), start_t, end_t (the start if null), intensity, name, ref (trimmed); rows without one of cl, start, name, ref go. Cells that don't read as numbers are null."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    number = lambda c, kind: F.expr(f"try_cast(`{c}` AS {kind})")
    d = registry.select(F.upper(text("cl")).alias("cl"), number("start_t", "int").alias("start_t"), number("end_t", "int").alias("end_t"), number("intensity", "double").alias("intensity"), text("name").alias("name"), text("ref").alias("ref"))
    return d.na.drop(subset=["cl", "start_t", "name", "ref"]).withColumn("end_t", F.coalesce("end_t", "start_t"))


def _of(tracks: list[Track], what) -> Column:
    """``what`` of the reference's track."""
    prefix = F.split_part(F.col("ref"), F.lit(":"), F.lit(1))
    out = F.lit(what(UNKNOWN))
    for t in reversed(tracks):
        out = F.when(F.col("ref").contains(":") & prefix.isin(*t.prefixes), F.lit(what(t))).otherwise(out)
    return out


def enrich(registry: DataFrame, tracks: list[Track]) -> DataFrame:
    """A row for each distinct (cl, start_t, name, ref), of which the most intense, then the one that ends last, stays: its number in that order, repeats, track, grade, the parts of its reference, links, host and assignment.

    Numbers are counted in each cluster on top of the earlier clusters' sums.
    """
    key = ["cl", "start_t", "name", "ref"]
    d = cleaned(registry).groupBy(*key).agg(F.count("*").alias("copies"), F.max(F.struct(F.col("intensity").alias("i"), F.col("end_t").alias("e"))).alias("m"))
    d = d.select(*key, "copies", F.col("m.i").alias("intensity"), F.col("m.e").alias("end_t"))
    sizes = d.groupBy("cl").agg(F.count("*").alias("n"))
    before = sizes.select("cl", (F.sum("n").over(Window.orderBy("cl")) - F.col("n")).alias("before"))  # a row for each cluster
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("cl").orderBy("start_t", "name", "ref"))).join(before, "cl")
    payload = F.when(F.col("ref").contains(":"), F.expr("substring(ref, instr(ref, ':') + 1)")).otherwise(F.col("ref"))
    parts = F.filter(F.transform(F.split(payload, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    d = d.withColumns({"_each": _of(tracks, lambda t: t.each), "_url": _of(tracks, lambda t: t.url)})
    refs = F.when(F.col("_each"), parts).otherwise(F.array().cast("array<string>"))
    links = F.when(F.col("_each"), F.transform(parts, lambda x: F.concat(F.col("_url"), x))).when(F.col("_url") != "", F.array("_url")).otherwise(F.array().cast("array<string>"))
    host = F.coalesce(F.regexp_extract(F.get(links, F.lit(0)), r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    return d.select(
        (F.col("before") + F.col("_r")).alias("event"), *key, "end_t", "intensity", "copies",
        _of(tracks, lambda t: t.name).alias("track"), _of(tracks, lambda t: t.grade).alias("grade"), _of(tracks, lambda t: t.objective).cast("int").alias("objective"), _of(tracks, lambda t: t.assignment).alias("assignment"),
        refs.alias("refs"), links.alias("links"), host.alias("host"),
    )


def source_links(enriched: DataFrame) -> DataFrame:
    """event, rank, url, host, track: a row for each link of each event."""
    rows = enriched.select("event", "track", F.posexplode("links").alias("place", "url"))
    return rows.select("event", (F.col("place") + 1).alias("rank"), "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), "track")


def shared_references(enriched: DataFrame) -> DataFrame:
    """ref, events, clusters, first, last: reference parts that several events name."""
    each = enriched.select("event", "cl", "start_t", F.explode("refs").alias("ref"))
    g = each.groupBy("ref").agg(F.countDistinct("event").alias("events"), F.countDistinct("cl").alias("clusters"), F.min("start_t").alias("first"), F.max("start_t").alias("last"))
    return g.filter("events > 1")


def quality_report(enriched: DataFrame, hosts: int = 10, names: int = 15) -> DataFrame:
    """measure, item, value: what the registry is worth, as one table.

    Totals (rows, clusters, first and last start, repeats removed, rows without intensity, with an end before the start, or an intensity outside of 0..1, share with a link), and counts by track, grade,
    assignment, and the commonest hosts and names (ties: the smaller).
    """
    totals = {
        "rows": F.count("*"), "clusters": F.countDistinct("cl"), "first_start": F.min("start_t"), "last_start": F.max("start_t"), "repeats_removed": F.sum(F.col("copies") - 1), "without_intensity": F.count_if(F.col("intensity").isNull()),
        "ends_before_start": F.count_if(F.col("end_t") < F.col("start_t")), "intensity_outside": F.count_if(~F.col("intensity").between(0, 1)), "linked_share": F.avg((F.size("links") > 0).cast("double")),
    }
    one = enriched.agg(*[c.cast("double").alias(k) for k, c in totals.items()])
    out = one.select(F.expr(f"stack({len(totals)}, {', '.join(f'{chr(39)}{k}{chr(39)}, {k}' for k in totals)}) AS (measure, value)")).select("measure", F.lit("").alias("item"), "value")
    kinds = {"track": None, "grade": None, "assignment": None, "host": hosts, "name": names}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("item")) for k in kinds]))
    counts = enriched.select(each.alias("x")).select("x.*").filter("item <> ''").groupBy("measure", "item").agg(F.count("*").cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("value"), "item"))
    most = F.when(F.col("measure") == "host", hosts).when(F.col("measure") == "name", names)
    return out.union(counts.withColumn("_r", place).filter(most.isNull() | (F.col("_r") <= most)).select("measure", "item", "value"))
