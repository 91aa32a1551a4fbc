"""Keep only extracted claims whose quote occurs in the corpus of their tender.

Quotes are looked up by ``quotes.locate``: texts in cells, many quotes at once, whatever share of the claims or of the
text a tender holds.  A corpus is one text of a tender, or the numbered parts of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.operators import quotes

# Shortest quote that counts, and the length of the head that is reported apart.
MIN_QUOTE, HEAD_CHARS = 14, 96
NO_VALUE = "—"
FIELDS = ("title", "budget", "method", "deadline")


def normalize_claims(claims: DataFrame) -> DataFrame:
    """Trim claim fields, drop unnamed claims, put a dash where the basis is empty."""
    named = claims.withColumn("name", tx.js_trim(F.col("name"))).where(F.col("name") != "")
    return named.select(
        "tender_id",
        "claim_id",
        "list",
        "name",
        F.coalesce(F.nullif(tx.js_trim(F.col("basis")), F.lit("")), F.lit(NO_VALUE)).alias("basis"),
        F.coalesce(tx.js_trim(F.col("criteria")), F.lit("")).alias("criteria"),
        F.coalesce(tx.js_trim(F.col("evidence")), F.lit("")).alias("evidence"),
    )


def ground_claims(claims: DataFrame, corpora: DataFrame) -> DataFrame:
    """All claims with ``grounded``, ``head_grounded`` (only the quote's head must occur) and the criteria that survive,
    and where in the normalised text the quote, its head and the criteria first stand (from 0, NULL if nowhere).

    A tender without text grounds nothing.  Criteria of 14 characters or more must occur themselves; shorter ones stay.
    """
    own = claims.withColumns({"_evidence": tx.normalize_evidence(F.col("evidence")), "_criteria": F.when(F.col("list") != "self", tx.normalize_evidence(F.col("criteria")))})
    head = F.when(F.length("_evidence") >= MIN_QUOTE, F.substring("_evidence", 1, HEAD_CHARS))
    asked = own.withColumn("quotes", _slotted(F.col("_evidence"), head, F.col("_criteria")))
    found = quotes.locate(asked, corpora, 3)
    # What the criteria become is settled before the claims travel, and only a manager's have any.
    long = F.length("_criteria") >= MIN_QUOTE
    manager = F.col("list") == "manager"
    own = asked.withColumns(
        {"unit": quotes.unit_id(F.col("quotes")), "_kept": F.when(manager, F.coalesce(F.nullif("criteria", F.lit("")), F.lit(NO_VALUE))), "_must": F.when(manager, long)}
    )
    joined = own.join(found, ["tender_id", "unit"], "left")
    return joined.select(
        *claims.columns,
        F.col("at_0").isNotNull().alias("grounded"),
        F.col("at_1").isNotNull().alias("head_grounded"),
        F.when(F.col("_must") & F.col("at_2").isNull(), F.lit(NO_VALUE)).otherwise(F.col("_kept")).alias("kept_criteria"),
        F.col("at_0").alias("first_at"),
        F.col("at_1").alias("head_at"),
        F.col("at_2").alias("criteria_at"),
    )


def _slotted(*texts: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("slot"), t.alias("quote")) for k, t in enumerate(texts)])


def ground_fields(fields: DataFrame, corpora: DataFrame) -> DataFrame:
    """Null every free field without a grounded quote; the overview needs any one of its quotes.

    fields: tender_id, title, title_evidence, …, overview, overview_quotes array<string>.
    """
    own = _slotted(*[tx.normalize_evidence(F.col(f"{name}_evidence")) for name in FIELDS])
    of_overview = F.transform(
        F.coalesce("overview_quotes", F.array().cast("array<string>")),
        lambda q: F.struct(F.lit(len(FIELDS)).alias("slot"), tx.normalize_evidence(q).alias("quote")),
    )
    asked = fields.withColumn("quotes", F.concat(own, of_overview))
    found = quotes.locate(asked, corpora, len(FIELDS) + 1)
    joined = asked.withColumn("unit", quotes.unit_id(F.col("quotes"))).join(found, ["tender_id", "unit"], "left")
    kept = [
        F.when(F.col(f"at_{k}").isNotNull(), F.nullif(tx.js_trim(F.col(name)), F.lit(""))).alias(name) for k, name in enumerate((*FIELDS, "overview"))
    ]
    return joined.select("tender_id", *kept)


def snapshot_fallback(grounded: DataFrame, hints: DataFrame) -> DataFrame:
    """Fill an empty budget and deadline from the card of the tender."""
    joined = grounded.join(hints.select("tender_id", "budget_hint", "deadline_hint"), "tender_id", "left")

    def filled(name: str) -> Column:
        return F.coalesce(F.nullif(tx.js_trim(F.col(name)), F.lit("")), F.nullif(f"{name}_hint", F.lit(""))).alias(name)

    others = [c for c in grounded.columns if c not in ("budget", "deadline")]
    return joined.select(*others, filled("budget"), filled("deadline"))
