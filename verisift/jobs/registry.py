"""All queries of the engine over the test tables, with their SQL.

Documents stand for rules that two readings judged: quality is the lenient reading and
toxic the strict one; no label means that a rule was not evaluated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisift.functions import dates, text
from verisift.jobs import stages, versions
from verisift.jobs.oracles import ORACLES
from verisift.operators import events, gates, histories, matching, reconcile, runs, verify
from verisift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def findings(spark: SparkSession, d: str) -> DataFrame:
    tier = F.element_at(F.array(F.lit("VETO"), F.lit("RED_FLAG"), F.lit("GREEN_FLAG")), (F.col("doc_id") % 3 + 1).cast("int"))
    n = F.col("n_chars")
    severity = F.when(n < 200, "LOW").when(n < 1000, "MEDIUM").when(n < 4000, "HIGH").otherwise("CRITICAL")
    criteria = table(spark, d, "documents").select("doc_id", "source", tier.alias("tier"), severity.alias("severity"), F.lit(1.0).alias("weight"))
    labels = table(spark, d, "labels")

    def reading(column: str) -> DataFrame:
        return labels.select("doc_id", (F.col(column) == 1).alias("fired"), F.lit(True).alias("evaluable"), F.lit("high").alias("confidence"))

    return reconcile.reconcile(criteria, reading("quality"), reading("toxic"), ["doc_id"])


@query
def scorecard_status(spark, d):
    """All findings; fired is written out, null being not evaluated."""
    return reconcile.weighted(findings(spark, d)).drop("weight").withColumn("fired", F.col("fired").cast("string"))


@query
def source_recommendation(spark, d):
    return reconcile.recommend(findings(spark, d), ["source"])


@query
def blocked_recommendation(spark, d):
    """Rules of documents in German count as blocked before the policy."""
    blocked = table(spark, d, "documents").filter(F.col("lang") == "de").select("doc_id")
    return reconcile.recommend(reconcile.block(findings(spark, d), blocked, ["doc_id"]), ["source"])


@query
def agreement_rate(spark, d):
    agreed = F.count_if(~F.col("contested") & F.col("fired").isNotNull())
    rate = F.round(agreed / F.greatest(F.lit(1), F.count(F.lit(1))), 3)
    return findings(spark, d).agg(F.count(F.lit(1)).alias("n"), agreed.alias("agreed"), rate.alias("rate"))


@query
def status_tally(spark, d):
    """Findings by tier and status; every pair is there, zero if none has it."""
    tiers = spark.createDataFrame([(t,) for t in ("VETO", "RED_FLAG", "GREEN_FLAG")], "tier string")
    status = F.explode(F.array(*map(F.lit, ("fired", "not_fired", "contested", "unevaluated", "veto_unevaluated")))).alias("status")
    counted = findings(spark, d).groupBy("tier", "status").agg(F.count(F.lit(1)).alias("n"))
    return tiers.select("tier", status).join(counted, ["tier", "status"], "left").select("tier", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query
def quote_exact(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return verify.search_quotes(quotes, pages).filter("verification = 'exact'").select("quote_id", "page_id")


@query
def quote_layout(spark, d):
    """Quotes without their words 5 to 7: only the layout tier finds them."""
    w = F.split("text", " ")
    cut = F.array_join(F.concat(F.slice(w, 1, 4), F.slice(w, 8, 100_000)), " ")
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), cut.alias("quote"))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return verify.search_quotes(quotes, pages)


@query
def numeric_untraceable(spark, d):
    docs = table(spark, d, "documents")
    return gates.untraceable_numbers(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "doc_id", "text")


@query
def content_duplicates(spark, d):
    """(doc_id, original) of documents whose text an earlier one has; only hashes are shuffled."""
    hashed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    firsts = hashed.groupBy("hash").agg(F.min("doc_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(firsts, "hash").filter("doc_id <> original").select("doc_id", "original", "hash")


@query
def unlabelled_docs(spark, d):
    return gates.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query
def gate_violations(spark, d):
    n = F.col("n_chars")
    return gates.violations(
        table(spark, d, "documents"),
        "doc_id",
        {
            "text_missing": F.col("text").isNull() | (F.trim("text") == ""),
            "length_wrong": n != F.length("text"),
            "lang_unknown": ~F.col("lang").isin("en", "de", "fr", "es"),
            "too_short": F.length(F.trim("text")) < 20,
            "shouting": F.regexp_count("text", F.lit("[A-Z]")) * 2 > n,
        },
    )


@query
def tag_strip(spark, d):
    bare = text.without_tags(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(bare).alias("n_chars"), F.md5(bare).alias("text_md5"))


@query
def link_rows(spark, d):
    items = F.regexp_extract_all("html", F.lit("(?s)<li>.*?</li>"), F.lit(0))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(items).alias("pos", "item"))
    href, label = F.regexp_extract("item", 'href="([^"]*)"', 1), text.without_tags(F.col("item"))
    return rows.select("page_id", "pos", href.alias("href"), label.alias("label")).filter("href <> '' AND label <> ''")


@query
def domain_normalise(spark, d):
    pages = table(spark, d, "pages").select(text.domain(F.col("url")).alias("domain"), text.plain_url(F.col("url")).alias("u"))
    return pages.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("u").alias("urls"))


@query
def first_verdict(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return events.first_by(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "day", "value")


@query
def idempotent_log(spark, d):
    """One row per idempotency key: its first event, and how many writes were dropped; an aggregation, no sort."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    return e.groupBy("user_id", "event_type", "day").agg(first.alias("event_id"), (F.count(F.lit(1)) - 1).alias("dropped"))


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


@query
def stage_fold(spark, d):
    e = table(spark, d, "events").withColumn("k", _k())
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("cost"),
        F.sum("k").alias("tokens"),
        F.countDistinct("user_id").alias("users"),
        F.min_by("k", F.struct("ts", "event_id")).alias("first_k"),
        F.max_by("k", F.struct("ts", "event_id")).alias("last_k"),
        F.bool_or(F.col("value") > 99).alias("fallback"),
    )


@query
def run_totals(spark, d):
    """Totals over stages; retries are what each stage has beyond its distinct calls."""
    stages = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("user_id").alias("calls"))
    return stages.agg(
        F.sum("attempts").alias("attempts"), F.sum("calls").alias("calls"), F.sum(F.greatest(F.lit(0), F.col("attempts") - F.col("calls"))).alias("retries")
    )


@query
def retry_histogram(spark, d):
    counted = table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "reason").limit(20)


@query
def outcome_counts(spark, d):
    outcomes = spark.createDataFrame([(o,) for o in ("F", "O", "P", "X")], "outcome string")
    counted = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return outcomes.join(counted, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def _moves(spark, d):
    return events.moves(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "o_orderdate")


@query
def transition_matrix(spark, d):
    return _moves(spark, d).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


@query
def illegal_transitions(spark, d):
    legal = spark.createDataFrame([("O", "O"), ("O", "P"), ("P", "P"), ("P", "F"), ("F", "F")], "from_state string, to_state string")
    moved = _moves(spark, d).filter("from_state IS NOT NULL").select("o_orderkey", "o_custkey", "from_state", "to_state")
    return gates.illegal_moves(moved, legal)


@query
def cycle_time(spark, d):
    moved = _moves(spark, d).filter("days IS NOT NULL")
    return moved.groupBy("from_state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("days").alias("days_total"),
        F.percentile("days", F.lit(0.5)).alias("median"),
        F.percentile("days", F.lit(0.9)).alias("p90"),
    )


@query
def current_version(spark, d):
    latest = events.first_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True)
    return latest.select("o_custkey", "o_orderkey", "o_orderstatus")


@query
def cumulative_cost(spark, d):
    cost = F.col("o_totalprice").cast("decimal(18,2)")
    summed = histories.running_sum(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], cost, F.trunc("o_orderdate", "year"), "spent")
    return summed.select("o_orderkey", "o_custkey", F.col("spent").cast("double").alias("spent"))


@query
def projection_fold(spark, d):
    """Each user's last known value and props over partial updates: even events update one, odd ones the other."""
    e = table(spark, d, "events")
    partial = e.select(
        "user_id", "ts", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 1, _k()).alias("k")
    )
    return events.latest_known(partial, ["user_id"], ["ts", "event_id"], ["value", "k"])


def _level(spark, d, condition):
    n = table(spark, d, "events").filter(condition).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    return n.filter("n >= 2").select(key.alias("finding"), F.when(F.col("n") >= 4, "high").when(F.col("n") >= 3, "medium").otherwise("low").alias("state"))


@query
def version_delta(spark, d):
    return events.delta(_level(spark, d, "event_id % 2 = 0"), _level(spark, d, "event_id % 2 = 1"), "finding", "state")


@query
def delta_summary(spark, d):
    return version_delta(spark, d).groupBy("change", "old_state", "new_state").agg(F.count(F.lit(1)).alias("n"))


@query
def queue_head(spark, d):
    waiting = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return waiting.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query
def board_top_n(spark, d):
    best = events.top_n(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return best.select("o_orderpriority", "rank", "o_orderkey")


@query
def pass_reason_share(spark, d):
    counted = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)  # over the few groups
    return counted.select("l_returnflag", "l_linestatus", "n", share.alias("share"))


@query
def intake_daily(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"))
    return e.agg(F.count(F.lit(1)).alias("taken"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("user_id").alias("users"))


@query
def throughput_daily(spark, d):
    cost = F.col("value").cast("decimal(18,4)")
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day")["start"].cast("date").cast("string").alias("day"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(cost).cast("double").alias("cost"), F.max("value").alias("most"))


@query
def triage_funnel(spark, d):
    """Customers by nation: entered, ordering in three years or more, and the rate."""
    years = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct(F.year("o_orderdate")).alias("years"))
    entered = table(spark, d, "customer").join(years, F.col("c_custkey") == F.col("o_custkey"), "left")
    named = entered.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("entered"),
        F.count_if(F.col("years") >= 3).alias("advanced"),
        F.round(F.count_if(F.col("years") >= 3) / F.count(F.lit(1)), 4).alias("rate"),
    )


@query
def name_overlap(spark, d):
    """Distinct names of a brand's parts, of name and type, that share 0.6 of the fewer words."""
    names = table(spark, d, "part").select("p_brand", text.address(F.concat_ws(" ", "p_name", "p_type")).alias("name")).distinct()
    return matching.overlapping(names, ["p_brand"], "name", 0.6)


@query
def company_names(spark, d):
    slug = text.company_slug(F.concat_ws(" ", F.regexp_replace("s_name", "#", " "), F.lit("Pvt. Ltd")))
    return table(spark, d, "supplier").select("s_suppkey", slug.alias("slug"))


@query
def range_match(spark, d):
    """Stated against filed amounts: the balance against the mean order, by ratio bands."""
    filed = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("filed"))
    joined = table(spark, d, "customer").join(filed, F.col("c_custkey") == F.col("o_custkey"), "left")
    stated = F.col("c_acctbal") * 100
    band = F.when(F.col("filed").isNull(), "not_filed").when(stated < 0.4 * F.col("filed"), "below").when(stated > 2.5 * F.col("filed"), "above").otherwise("match")
    return joined.select("c_custkey", band.alias("band"))


@query
def date_parse(spark, d):
    """Order dates written in four ways and read back."""
    at = F.col("o_orderdate")
    ways = F.array(F.date_format(at, "MMMM d, yyyy"), F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "d MMM yyyy"), F.date_format(at, "MMMM yyyy"))
    stated = F.get(ways, (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", dates.stated_date(stated).cast("string").alias("parsed"))


@query
def elapsed_months(spark, d):
    months = dates.elapsed_months(F.lit("2002-01-01").cast("date"), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", months.alias("months"))


@query
def rank_fusion(spark, d):
    """Documents of each source by length and by line count, fused by reciprocal rank; the ten best."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", "\n", -1)).alias("lines"))
    by = lambda c: events.top_n(docs, ["source"], [F.desc(c), "doc_id"], 50).select("doc_id", "rank")
    return events.rank_fusion([by("n_chars"), by("lines")], "doc_id").orderBy(F.desc("score"), "doc_id").limit(10)


@query
def inputs_hash(spark, d):
    """One digest per source, whatever the rows' order: of blocks of 10,000 ids, then of the blocks' digests."""
    pairs = F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.sha2("text", 256)).alias("x")
    joined = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "|"), 256)
    block = F.floor(F.col("doc_id") / 10_000).cast("long").alias("block")
    blocks = table(spark, d, "documents").select("source", block, pairs).groupBy("source", "block").agg(joined("x").alias("x"))
    return blocks.select("source", F.concat_ws(":", F.lpad(F.col("block").cast("string"), 12, "0"), "x").alias("x")).groupBy("source").agg(joined("x").alias("digest"))


@query
def returned_only(spark, d):
    """Parts that were returned and never sold open: a set difference."""
    l = table(spark, d, "lineitem")
    return l.filter("l_returnflag = 'R'").select("l_partkey").subtract(l.filter("l_linestatus = 'O' AND l_quantity > 45").select("l_partkey"))


@query
def citation_tallies(spark, d):
    """Per conversation: turns, roles, quotes in them, and how many hold a figure (a null is no miss)."""
    c = table(spark, d, "conversations")
    figure = F.when(F.col("role") != "system", F.col("text").rlike("[0-9]"))
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.count_if(figure).alias("with_figure"), F.count_if(~figure).alias("without")
    )


@query
def manager_book(spark, d):
    """Suppliers by region: count, balance, and revenue of what they shipped."""
    revenue = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue")
    )
    s = table(spark, d, "supplier").join(revenue, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    n = F.broadcast(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(
        F.count(F.lit(1)).alias("suppliers"),
        F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"),
        F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
    )


@query
def kind_status_counts(spark, d):
    """Documents by language and label, with sub-totals; empty bands don't show."""
    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "open").when(F.col("quality") == 1, "good").otherwise("bad")
    counted = labelled.select("lang", status.alias("status")).cube("lang", "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query
def open_items(spark, d):
    e = table(spark, d, "events").withColumn("stage", F.dayofweek("ts"))
    return runs.open_items(e, "event_type", "stage", "event_id")


@query
def budget_spend(spark, d):
    cost = F.col("o_totalprice").cast("decimal(18,2)")
    kept = runs.within_budget(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], cost, 1_000_000, F.trunc("o_orderdate", "year"))
    return kept.select("o_orderkey", "o_custkey", F.col("spent").cast("double").alias("spent"))


@query
def retry_policy(spark, d):
    errors = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    done = runs.retried(errors, ["user_id"], ["ts", "event_id"])
    return done.select("event_id", "user_id", "attempt", F.coalesce("wait_minutes", F.lit(0)).alias("wait_minutes"), "outcome")


@query
def retry_reasons(spark, d):
    """Failure messages made of events' props, by bucket."""
    marker = F.get(F.array(*[F.lit(m) for m, _ in runs.REASONS], F.lit("else")), (_k() % (len(runs.REASONS) + 1)).cast("int"))
    e = table(spark, d, "events").select(runs.reason_bucket(F.concat(F.lit("Call "), F.upper(marker), F.lit(" after "), F.col("event_type"))).alias("reason"))
    return e.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def extraction_methods(spark, d):
    """Turns without a figure count as blank pages of their conversation."""
    c = table(spark, d, "conversations").groupBy("conv_id")
    counted = c.agg(F.count_if(~F.col("text").rlike("[0-9]")).alias("blank"), F.count(F.lit(1)).alias("pages"))
    return counted.select("conv_id", "blank", "pages", runs.extraction_method(F.col("blank"), F.col("pages")).alias("method"))


@query
def evidence_equality(spark, d):
    """Suppliers' parts in returned against accepted lines, as sets."""
    lines = table(spark, d, "lineitem")
    return runs.same_sets(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), "l_suppkey", "l_partkey")


@query
def criterion_hits(spark, d):
    """Fire rate of each brand's lines, and brands that never fired."""
    fired = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), 1)
    joined = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.groupBy("p_brand").agg(
        F.count("l_orderkey").alias("evaluated"),
        F.count(fired).alias("fired"),
        F.round(F.count(fired) / F.greatest(F.lit(1), F.count("l_orderkey")), 4).alias("rate"),
        (F.count(fired) == 0).cast("int").alias("dead"),
    )


@query
def question_routing(spark, d):
    """Open orders by the first rule that fits: blocked, urgent, analyst, document."""
    kind = (
        F.when(F.col("c_acctbal") < 0, "blocked")
        .when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgent")
        .when(F.col("o_totalprice") > 300_000, "analyst")
        .otherwise("document")
    )
    joined = table(spark, d, "orders").filter("o_orderstatus = 'O'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


QUERIES |= stages.QUERIES | versions.QUERIES
ORACLES |= stages.ORACLES | versions.ORACLES
