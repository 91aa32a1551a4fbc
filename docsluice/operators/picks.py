"""Picking one row of many and numbering documents.

Picks are struct minima and maxima: they combine before the shuffle and do not care how many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions.ranking import distributed_rank

# How outgoing documents are numbered, and which template names are preferred.
OUTGOING_PREFIX = "Исх. № "
DEFAULT_PREFIX = "ЛН"
PREFERRED_TEMPLATE = r"(?iu)кп|commercial|шаблон|template"


def latest_version(files: DataFrame, keys: list[str], modified: str, tie: str) -> DataFrame:
    """The newest row per key."""
    others = [c for c in files.columns if c not in keys]
    newest = F.max(F.struct(F.col(modified), F.col(tie), *[F.col(c) for c in others if c not in (modified, tie)]))
    return files.groupBy(*keys).agg(newest.alias("_r")).select(*keys, *[f"_r.{c}" for c in others])


def template_pick(
    docs: DataFrame, keys: list[str], preferred: str = PREFERRED_TEMPLATE, out: str = "template_id"
) -> DataFrame:
    """First document by Russian name, those whose name matches the pattern before all others.

    docs: keys…, id, name.
    """
    rank = F.struct((~F.col("name").rlike(preferred)).alias("p"), F.collate("name", "ru").alias("n"), F.col("name"), F.col("id"))
    return docs.groupBy(*keys).agg(F.min_by("id", rank).alias(out))


def template_waterfall(orgs: DataFrame, explicit: DataFrame, shared: DataFrame, named: DataFrame, library: DataFrame) -> DataFrame:
    """Template per organisation: an explicit id, else its shared sub-folder, else a shared file named after it, else the library.

    All sides hold one row per organisation: (org, template_id).
    """
    out = orgs
    for i, side in enumerate((explicit, shared, named, library)):
        out = out.join(side.select("org", F.col("template_id").alias(f"_t{i}")), "org", "left")
    picked = F.coalesce(*[f"_t{i}" for i in range(4)])
    return out.select(*orgs.columns, picked.alias("template_id"))


def serial_numbers(docs: DataFrame, order: list[str], buckets: list[Column], last: int = 0) -> DataFrame:
    """Number documents in order after the last number given out: unique, without a single-task sort."""
    ranked = distributed_rank(docs, [], order, buckets, out="serial")
    return ranked.withColumn("serial", F.col("serial") + F.lit(last))


def document_date(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy")


def serial_line(serial: Column, date: Column) -> Column:
    return F.concat_ws(", ", serial.cast("string"), document_date(date))


def outgoing_ref(serial: Column, date: Column, prefix: Column) -> Column:
    """``Исх. № <prefix>-<year>/<0000> от <date>``; longer numbers keep all their digits."""
    number = serial.cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(
        F.lit(OUTGOING_PREFIX), F.coalesce(prefix, F.lit(DEFAULT_PREFIX)), F.lit("-"), F.date_format(date, "yyyy"),
        F.lit("/"), padded, F.lit(" от "), document_date(date),
    )


def tender_year(given: Column, today: Column) -> Column:
    """A four-digit year as given, else the current one; NULL when what is given is no year."""
    text = F.trim(given)
    return F.when(F.coalesce(text == "", F.lit(True)), F.date_format(today, "yyyy")).when(text.rlike(r"^\d{4}$"), text)
