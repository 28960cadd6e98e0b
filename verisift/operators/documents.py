"""JSON documents of any depth: their nodes, fields, facts, canonical text and envelopes.

A document is a VARIANT. It is opened level by level, each level being one generator over
the rows of the one above, so that nothing is shuffled; how deep the deepest document goes
is counted first, in one pass. A document that isn't JSON has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.parse import strict_json

# The envelope's version, and the labels and paths of an index's facts and absences.
SCHEMA_VERSION = 2
FACTS = (
    ("Target size", "fund_terms.fund_size"),
    ("Target return", "fund_terms.target_return"),
    ("Return basis", "fund_terms.target_return_basis"),
    ("Fund term", "fund_terms.fund_term"),
    ("Investment period", "fund_terms.investment_period"),
    ("Exit period", "fund_terms.exit_period"),
    ("Drawdowns", "fund_terms.drawdowns"),
    ("Minimum commitment", "fund_terms.minimum_commitment"),
    ("Hurdle rate", "economics.hurdle_rate"),
    ("Carried interest", "economics.carry"),
    ("Catch-up", "economics.catch_up"),
    ("Management fee", "economics.management_fee"),
    ("Target investments", "portfolio_construction.target_investment_count"),
    ("Geography", "portfolio_construction.geography"),
)
ABSENCES = (
    ("Net return disclosed", "economics.net_return_disclosed"),
    ("GP / sponsor commitment", "economics.gp_commitment"),
    ("Key-person clause", "team.key_person_clause"),
    ("Valuation policy", "portfolio_construction.valuation_policy"),
    ("Realised DPI", "track_record.realised_dpi"),
)


def depth(text: Column) -> Column:
    """How many objects and arrays of a JSON text stand in each other at most."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step, lambda s: s["most"])


def kind(node: Column) -> Column:
    """OBJECT, ARRAY, or a scalar's type; VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def part(node: Column, key: str) -> Column:
    """The value of a key, null if there is none; a JSON null is not null."""
    return F.variant_get(node, f"$.{key}", "variant")


def is_field(node: Column) -> Column:
    """A node with a value and a page or a quote, which is not opened."""
    return part(node, "value").isNotNull() & (part(node, "page").isNotNull() | part(node, "quote").isNotNull())


def nodes(docs: DataFrame, key: str, text: str, open_fields: bool = False) -> DataFrame:
    """(key, path, node): the fields of each document, and all else that has nothing below it, with paths such as a.b[0].c.

    A key column is carried along; a document's nodes stay in its task. With open_fields a
    field is opened like any other object.
    """
    levels = docs.agg(F.max(depth(F.col(text)))).first()[0] or 0
    rows = docs.select(F.col(key), F.lit("").alias("path"), strict_json(F.col(text)).alias("node")).filter(F.col("node").isNotNull())
    spark = docs.sparkSession
    for _ in range(levels):
        opened = rows.withColumn("_open", F.col("node") if open_fields else F.when(~is_field(F.col("node")), F.col("node")))
        below = spark.tvf.variant_explode_outer(F.col("_open").outer()).toDF("_pos", "_key", "_below")
        dot = F.when(F.col("path") == "", "").otherwise(".")
        path = F.when(F.col("_key").isNotNull(), F.concat("path", dot, "_key")).when(F.col("_pos").isNotNull(), F.concat("path", F.lit("["), "_pos", F.lit("]"))).otherwise(F.col("path"))
        rows = opened.lateralJoin(below).select(key, path.alias("path"), F.coalesce("_below", "node").alias("node"))
    return rows


def fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value, page, quote, cited, unsupported) of the fields of each document.

    value is null where the document says null, which is no violation. A citation has a value,
    a whole page number of 1 or more, and a quote that is not blank; a value without is unsupported.
    """
    found = nodes(docs, key, text).filter(is_field(F.col("node")))
    said = lambda c: F.try_variant_get("node", f"$.{c}", "string")
    whole = kind(part(F.col("node"), "page")) == "BIGINT"
    page = F.when(whole, F.try_variant_get("node", "$.page", "long"))
    rows = found.select(key, "path", said("value").alias("value"), page.alias("page"), said("quote").alias("quote"))
    supported = (F.coalesce("page", F.lit(0)) >= 1) & (F.trim(F.coalesce("quote", F.lit(""))) != "")
    valued = F.col("value").isNotNull()
    return rows.withColumns({"cited": valued & supported, "unsupported": valued & ~supported})


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no blanks, whatever its depth; null if it is none.

    Objects of a VARIANT hold their keys in order, which the text then shows.
    """
    return F.to_json(strict_json(text))


def content_hash(text: Column) -> Column:
    """Equal for documents that differ in the order of keys and in blanks only."""
    return F.sha2(canonical_json(text), 256)


def _parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _node): each text is parsed once, in a row of its own below the generator, whatever is asked of it."""
    return docs.select(F.col(key), strict_json(F.col(text)).alias("_node"))


def _stated(node: Column, path: str) -> Column:
    at = lambda c: F.try_variant_get(node, f"$.{path}.{c}", "string")
    return F.coalesce(at("as_written"), at("value"))


def index_facts(docs: DataFrame, key: str, text: str, spec: tuple[tuple[str, str], ...] = FACTS) -> DataFrame:
    """(key, label, stated): what a document says at fixed paths, as written or else its value; what it doesn't say has no row."""
    node = F.col("_node")
    cells = F.array(*[F.struct(F.lit(label).alias("label"), _stated(node, path).alias("stated")) for label, path in spec])
    return _parsed(docs, key, text).select(key, F.explode(cells).alias("_x")).select(key, "_x.*").filter("stated IS NOT NULL")


def index_absences(docs: DataFrame, key: str, text: str, spec: tuple[tuple[str, str], ...] = ABSENCES) -> DataFrame:
    """(key, label, stated): fixed paths whose absence is a finding; without a value NOT DISCLOSED, the value no as NO."""
    node = F.col("_node")

    def cell(label: str, path: str) -> Column:
        value = F.try_variant_get(node, f"$.{path}.value", "string")
        stated = F.when(value.isNull(), "NOT DISCLOSED").when(F.lower(F.trim(value)) == "no", "NO").otherwise(_stated(node, path))
        return F.struct(F.lit(label).alias("label"), stated.alias("stated"))

    return _parsed(docs, key, text).select(key, F.explode(F.array(*[cell(*s) for s in spec])).alias("_x")).select(key, "_x.*")


def envelope_gates(text: Column, stage: Column) -> dict[str, Column]:
    """Gates of a stage's envelope, for gates.violations and publish; in the order in which they are told."""
    node = strict_json(text)
    object_ = F.coalesce(kind(node) == "OBJECT", F.lit(False))
    of = lambda c: part(node, c)
    version = F.when(kind(of("schema_version")) == "BIGINT", F.try_variant_get(node, "$.schema_version", "long"))
    return {
        "not_an_object": ~object_,
        "other_stage": object_ & ~F.try_variant_get(node, "$.stage", "string").eqNullSafe(stage),
        "other_version": object_ & ~version.eqNullSafe(F.lit(SCHEMA_VERSION)),
        "result_missing": object_ & of("result").isNull(),
        "result_null": object_ & F.coalesce(F.is_variant_null(of("result")), F.lit(False)),
        "unresolved_missing": object_ & of("unresolved").isNull(),
        "unresolved_no_list": object_ & of("unresolved").isNotNull() & (kind(of("unresolved")) != "ARRAY"),
        "citations_no_list": object_ & of("citations").isNotNull() & (kind(of("citations")) != "ARRAY"),
    }
