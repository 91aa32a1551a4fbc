"""What a search for quotes sends between tasks, and the forms in which texts are normalised."""

from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.functions.patterns import WS_LIST
from docsluice.operators import quotes


def _sent(plan, seen: dict) -> int:
    """Bytes that the exchanges of an executed plan sent."""
    name = plan.getClass().getSimpleName()
    if name == "ReusedExchangeExec":
        return 0
    if name == "AdaptiveSparkPlanExec":
        return _sent(plan.finalPhysicalPlan(), seen)
    if name.endswith("QueryStageExec"):
        return _sent(plan.plan(), seen)
    own = 0
    if name == "ShuffleExchangeExec" and plan.id() not in seen:
        seen[plan.id()] = own = plan.metrics().get("dataSize").get().value()
    return own + sum(_sent(plan.children().apply(i), seen) for i in range(plan.children().size()))


def test_quotes_travel_once(spark):
    rows = [(t, [(0, f"{t} {i} ".ljust(300, "q"))]) for t in range(40) for i in range(50)]
    units = spark.createDataFrame(rows, "tender_id long, quotes array<struct<slot:int,quote:string>>")
    corpora = spark.createDataFrame([(t, f"x {rows[50 * t][1][0][1]} y") for t in range(40)], "tender_id long, corpus string")
    found = quotes.locate(units, corpora, 1)
    assert sorted((r["tender_id"], r["at_0"]) for r in found.collect()) == [(t, 2) for t in range(40)]
    assert _sent(found._jdf.queryExecution().executedPlan(), {}) < 2 * 300 * len(rows)


def test_a_quote_asked_many_times_travels_once_a_task(spark):
    quote = "the very same words of one tender " * 8
    units = spark.range(20_000).select(F.lit(1).alias("tender_id"), F.array(F.struct(F.lit(0).alias("slot"), F.lit(quote).alias("quote"))).alias("quotes"))
    found = quotes.locate(units, spark.createDataFrame([(1, "so " + quote)], "tender_id int, corpus string"), 1)
    assert [(r["tender_id"], r["at_0"]) for r in found.collect()] == [(1, 3)]
    assert _sent(found._jdf.queryExecution().executedPlan(), {}) < 100_000


def test_texts_without_quotes_and_quotes_without_text(spark, monkeypatch):
    monkeypatch.setattr(quotes, "CELL_CHARS", 64)
    monkeypatch.setattr(quotes, "SPAN_CELLS", 2)
    monkeypatch.setattr(quotes, "BLOCK_CHARS", 200)
    long = [f"line {i} of the second tender" for i in range(60)]
    rows = [(2, [(0, q), (1, q[:3])]) for q in long] + [(3, [(0, q)]) for q in long] + [(4, [(0, "short")]), (None, [(0, long[0])]), (5, [(0, None)]), (6, [])]
    units = spark.createDataFrame(rows, "tender_id long, quotes array<struct<slot:int,quote:string>>")
    texts = [(1, "text " * 500), (2, " ".join(long)), (4, "short " * 300), (None, " ".join(long)), (5, "a text of five that is there"), (6, None)]
    found = quotes.locate(units, spark.createDataFrame(texts, "tender_id long, corpus string"), 2).collect()
    places = [sum(len(q) + 1 for q in long[:i]) for i in range(60)]
    assert sorted((r["tender_id"], r["at_0"], r["at_1"]) for r in found) == [(2, at, None) for at in places]


def test_a_long_text_of_one_span_is_read_in_overlapping_cells(spark):
    text = "".join(f"{i:07d} " for i in range(12_000))  # three cells
    at = [0, quotes.CELL_CHARS - 10, quotes.CELL_CHARS * 2 - 1, len(text) - 41]
    units = spark.createDataFrame([(1, [(0, text[a : a + 40])]) for a in at], "tender_id long, quotes array<struct<slot:int,quote:string>>")
    found = quotes.locate(units, spark.createDataFrame([(1, text)], "tender_id long, corpus string"), 1).collect()
    assert sorted(r["at_0"] for r in found) == at


def test_evidence_is_normalised_the_same_with_and_without_patterns(spark):
    odd = [None, "", " ", " a  b ", "a b", "a b ", "  a", "«a» „b“ c’d′", "a\tb\n\nc\r\fd\ve", "é  è", "x\x1cy\x85z"] + [f"a{c}b{c}{c}c{c}" for c in WS_LIST]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    plain = tx.collapse_ws(F.translate("t", "«»„“”’′", "\"\"\"\"\"''"))
    got = rows.select("t", tx.normalize_evidence(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
