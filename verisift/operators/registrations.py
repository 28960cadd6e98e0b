"""Values that must stand somewhere in a document's pages, even broken over the end of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def squeezed(text: Column) -> Column:
    """Upper case, without white space."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def present(values: DataFrame, pages: DataFrame, doc: str, page: str, text: str, value: str, longest: int) -> DataFrame:
    """values(doc, value, ...) with `present`: whether the document's joined pages hold the value, white space and case aside.

    Each page is searched together with the first letters of what follows, so that pages are
    never joined to one text. Pages without letters are left out first, so that a value of
    `longest` letters reaches no more than so many pages on. Longer values raise no error:
    they are looked for within a page and `longest` letters after it. A value without letters
    or a null one is not present; a document without pages holds none. A page is one row.
    """
    read = pages.select(F.col(doc).alias("_doc"), F.col(page).alias("_page"), squeezed(F.col(text)).alias("_text")).filter("_text <> ''")
    heads = read.select("_doc", "_page", F.substring("_text", 1, longest).alias("_head"))
    after = Window.partitionBy("_doc").orderBy("_page").rowsBetween(1, longest)
    tails = heads.withColumn("_tail", F.substring(F.array_join(F.collect_list("_head").over(after), ""), 1, longest)).select("_doc", "_page", "_tail")
    whole = read.join(tails, ["_doc", "_page"]).select("_doc", F.concat("_text", "_tail").alias("_text"))
    wanted = values.select(F.col(doc).alias("_doc"), squeezed(F.col(value)).alias("_value")).filter("_value <> ''").distinct()
    found = whole.join(wanted, "_doc").filter(F.contains("_text", F.col("_value"))).select("_doc", "_value").distinct().withColumn("present", F.lit(True))
    joined = values.join(found, (F.col(doc) == F.col("_doc")) & (squeezed(F.col(value)) == F.col("_value")), "left")
    return joined.drop("_doc", "_value").withColumn("present", F.coalesce("present", F.lit(False)))


def backstop(values: DataFrame, value: str) -> DataFrame:
    """Values that aren't present become null, and `discarded` keeps what was claimed."""
    lost = F.col(value).isNotNull() & ~F.col("present")
    return values.withColumns({"discarded": F.when(lost, F.col(value)), value: F.when(~lost, F.col(value))})
