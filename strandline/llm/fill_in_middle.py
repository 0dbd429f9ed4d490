"""Fill-in-the-middle rewriting of texts, cut at the borders of units (runs of ASCII letters, or one other character).

All in relational steps: the units of a text are rows (posexplode), their running lengths a window, the cuts requests that meet the
units by ordinal; a text is taken apart by two offsets. Rows are dealt out once, by a number of their own, and every later step finds
them there: no exploded row is shuffled, and copies of a text, or rows with one id, never meet in a task for being equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Partitions of texts for each one that a shuffle has else: units take some ten times a text's memory, and are to be sorted without spills.
FINER = 4


def _draw(i: int, seed: int) -> Column:
    """The i-th 8-digit group of the sha256 of ``seed:id`` as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def _form(seed: int, plain: int, spm: int) -> Column:
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    stays = (F.col("text") == "") | marked | (_draw(3, seed) % 100 >= plain)
    return F.when(stays, "plain").when(_draw(4, seed) % 100 < spm, "spm").otherwise("psm")


def _cuts(n: Column, seed: int) -> tuple[Column, Column]:
    one, two = _draw(1, seed) % (n + 1), _draw(2, seed) % (n + 1)
    return F.least(one, two).cast("int"), F.greatest(one, two).cast("int")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 90, spm: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): a row for a row of ``docs``.

    ``n`` units; the prefix ends after the smaller of two drawn ordinals, the middle after the larger. ``plain`` of 100 texts are
    rewritten, ``spm`` of 100 of these suffix first. Texts that are empty or hold a marker stay as they are ("plain", no lengths).
    A null text counts as empty; a null id draws like an id without digits; long texts are cut whole, their units are rows that spill;
    repeated rows give repeated rows; an empty table an empty result. Other columns are not read, whatever their names. ``docs`` has to
    give the same rows in the same order when it is read again, as a table does.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).repartition(parts, "row")
    form = _form(seed, plain, spm)

    # the same exchange of ``rows`` serves all three: units, requests and texts
    matched = rows.select("row", form.alias("form"), "id", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    last = F.when(F.col("form") == "plain", 0).otherwise(_cuts(F.size("units"), seed)[1])
    units = matched.select("row", F.posexplode(F.slice("units", F.lit(1), last)).alias("ordinal", "unit"))
    running = F.sum(F.char_length("unit")).over(W.partitionBy("row").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    ends = units.select(F.col("row").alias("of"), (F.col("ordinal") + 1).alias("ordinal"), running.alias("end"))

    low, high = _cuts(F.col("n"), seed)
    counted = rows.select("row", "id", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"))
    requests = counted.select("row", "n", low.alias("low"), high.alias("high"))
    # a unit that ends at a cut of its row meets the request; plain texts, and cuts before the first unit, meet none
    met = ends.join(requests, (F.col("row") == F.col("of")) & ((F.col("ordinal") == F.col("low")) | (F.col("ordinal") == F.col("high"))))
    at = lambda cut: F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end")))
    offsets = met.groupBy("row").agg(F.max("n").alias("n"), at("low").alias("a"), at("high").alias("b"))

    whole = rows.select("row", "id", "text", form.alias("form")).join(offsets, "row", "left")
    n = F.coalesce("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    a, b = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("a", "b"))
    cut = whole.select("id", n.alias("n"), "form", "text", a.alias("a"), b.alias("b"))
    prefix, middle = F.substring("text", F.lit(1), F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))
    suffix = F.substring("text", F.col("b") + 1, F.char_length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    cuts = F.col("form") != "plain"
    return cut.select(
        "id", "n", "form", F.when(cuts, F.col("a")).cast("long").alias("prefix_chars"), F.when(cuts, F.col("b") - F.col("a")).cast("long").alias("middle_chars"), output.alias("output")
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    middle = F.substring_index(output, MIDDLE, -1)

    def halves(first: str, second: str) -> tuple[Column, Column]:
        one = F.substring(F.substring_index(output, second, 1), len(first) + 1, 0x7FFFFFFF)
        return one, F.substring_index(F.substring_index(output, second, -1), MIDDLE, 1)

    prefix, suffix = halves(PREFIX, SUFFIX)
    late_suffix, late_prefix = halves(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(late_prefix, middle, late_suffix))
