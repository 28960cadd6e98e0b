"""Names matched by shared words, without comparing all pairs of a common word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import token_overlap


def overlapping(names: DataFrame, keys: list[str], name: str, least: float) -> DataFrame:
    """(keys, name, other, overlap) of distinct names that share at least this part of the fewer words.

    Of the fewer words so many are shared that one is among its rarest: the name with fewer
    words looks others up by these only, which is exact and leaves the common words out.
    """
    worded = names.select(*keys, name, F.explode(F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))).alias("_word"))
    often = worded.groupBy(*keys, "_word").agg(F.count(F.lit(1)).alias("_often"))
    ranked = worded.join(often, [*keys, "_word"]).groupBy(*keys, name).agg(F.sort_array(F.collect_list(F.struct("_often", "_word"))).alias("_words"))
    size = F.size("_words")
    rare = F.slice("_words", 1, size - F.ceil(least * size - 1e-9).cast("int") + 1)
    probe = ranked.select(*keys, name, size.alias("_n"), F.explode(rare).alias("_w")).select(*keys, name, "_n", "_w._word")
    every = ranked.select(*keys, F.col(name).alias("other"), size.alias("_m"), F.explode("_words").alias("_w")).select(*keys, "other", "_m", "_w._word")
    met = probe.join(every, [*keys, "_word"]).filter((F.col(name) != F.col("other")) & (F.col("_n") <= F.col("_m")))
    pairs = met.select(*keys, F.least(name, "other").alias(name), F.greatest(name, "other").alias("other")).distinct()
    return pairs.withColumn("overlap", F.round(token_overlap(F.col(name), F.col("other")), 3)).filter(F.col("overlap") >= least)


# Endings of a firm's name that are left out before names are compared.
ENDINGS = ("LLC", "LP", "CAPITAL", "PARTNERS")
#: Letters of the pieces by which a contained name is looked up.
GRAM = 5


def bare_name(name: Column) -> Column:
    """Upper case, letters and digits of single-spaced words, without ENDINGS."""
    words = F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ENDINGS)), " ")


def contained(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """Distinct (name, text) of which the text holds the name.

    A name is looked up by its piece of GRAM letters that the fewest texts have, and then
    verified whole, so that names meet the texts of their rarest piece only. Names shorter
    than that are looked up whole, by pieces of their own length. Empty and null names and
    texts are in no row.
    """
    wanted = names.select(name).filter(F.length(name) > 0).distinct()
    held = texts.select(text).filter(F.length(text) > 0).distinct()
    short = [r["n"] for r in wanted.select(F.length(name).alias("n")).filter(F.col("n") < GRAM).distinct().collect()]  # GRAM - 1 values at most

    def pieces(of: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(of) - n + 1, F.lit(1))), lambda i: i <= F.length(of) - n + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.substring(of, i, F.lit(n))))

    every = F.flatten(F.array(*[pieces(F.col(text), n) for n in [GRAM, *sorted(short)]]))
    spelt = held.select(text, F.explode(every).alias("_piece"))
    often = spelt.groupBy("_piece").agg(F.count(F.lit(1)).alias("_often"))
    own = F.when(F.length(name) < GRAM, F.array(F.col(name))).otherwise(pieces(F.col(name), GRAM))
    asked = wanted.select(name, F.explode(own).alias("_piece")).join(often, "_piece", "left")
    # a piece that no text has rules its name out
    rarest = asked.groupBy(name).agg(F.min_by("_piece", F.struct(F.coalesce("_often", F.lit(0)), "_piece")).alias("_piece"))
    return rarest.join(spelt, "_piece").filter(F.contains(F.col(text), F.col(name))).select(name, text)


#: Rows that a task makes at most of one name's firms and investors.
ROWS = 500_000


def dealt(held: DataFrame, links: DataFrame) -> DataFrame:
    """(firm, investor), repeated where several names say so, of held(investor, _held) and links(firm, _held), distinct both.

    A name makes as many rows as it has investors times firms, which the bytes read don't show.
    They are counted first: a name's investors are dealt over so many parts that each makes
    ROWS rows or so, and the parts over so many tasks.
    """
    firms = links.groupBy("_held").agg(F.count(F.lit(1)).alias("_m"))
    counted = held.groupBy("_held").agg(F.count(F.lit(1)).alias("_n")).join(firms, "_held").select("_held", (F.col("_n") * F.col("_m")).alias("_rows"))
    tasks = (counted.agg(F.sum("_rows")).first()[0] or 0) // ROWS + 1
    parts = counted.select("_held", F.ceil(F.col("_rows") / ROWS).alias("_parts"))
    own = held.join(parts, "_held").select("investor", "_held", F.pmod(F.xxhash64("investor"), "_parts").alias("_part"))
    asked = links.join(parts, "_held").select("firm", "_held", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    return own.repartition(tasks, "_held", "_part").join(asked, ["_held", "_part"]).select("firm", "investor")


def roster(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """(firm, investor) from filings(firm, fund) and holdings(investor, fund): who holds a fund whose name holds a fund of the firm."""
    funds = filings.select("firm", bare_name(F.col("fund")).alias("_fund")).distinct()
    held = holdings.select("investor", bare_name(F.col("fund")).alias("_held")).distinct()
    links = funds.join(contained(funds, held, "_fund", "_held"), "_fund").select("firm", "_held").distinct()
    return dealt(held, links).distinct()
