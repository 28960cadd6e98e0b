"""Personal data: base patterns, then boosted trees over high-recall candidates.

Everything that touches a document is a DataFrame function. Generators propose spans,
among them spans inside text that a base pattern took too greedily and dropped; a
boosted model, fitted on a bounded sample whose labels are the base spans, weighs each
by its format and context, and a threshold calibrated on held-out documents selects.
Scoring is an expression inside the row: no explode and no shuffle.

Defined results
- null text is read as the empty string and has no spans; an empty table gives none.
- base spans of one kind don't overlap; spans of different kinds may, and all stay.
- selected spans overlap neither a base span nor each other (higher score, then earlier
  start, wins).
- repeated rows each get the same result; columns beside id and text are not read.
- without labelled candidates of both classes no model is fitted and none is selected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.boosting import Boosted
from verisift.llm.common import let

KINDS = ("email", "ip", "card", "phone")
#: Kinds with those that only the model selects.
ALL_KINDS = (*KINDS, "secret")
#: The base patterns. Possessive loops and the look-behinds change no match: they keep
#: the matcher from recursing and from trying each start within one long run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators; a kind may have several, and their spans may overlap.
GENERATORS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+"),
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[\p{L}\p{N}-]{1,63}+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[\p{L}\p{N}-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]{0,2}[0-9]{4}){2}[\x20.-]{0,2}[0-9]{1,4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    ("secret", r"(?<![\p{L}\p{N}_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{20,128}+(?![\p{L}\p{N}_+/=-])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
)
HINT = r"(?i)(?:tel|phone|call|fax|mobile|cell|mail|contact|e-?mail|ip|addr|host|card|visa|pay|credit)[a-z]{0,8}[:.\x20=#-]{0,4}$"
AGAINST = r"(?i)(?:version|isbn|order|invoice|no|nr|rfc|section|license|licence|ref|id|v|release)[a-z]{0,4}[:.\x20=#-]{0,4}$"
#: What names a secret before it. It labels the sample and is hidden from the features, so
#: that the trees learn the form of what is named so, and find it where it isn't.
NAMES_SECRET = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential)s?\W{0,3}[:=]\W{0,3}$"
#: Documents, and candidates, that the model is fitted on at most.
SAMPLE_DOCUMENTS = 6000
SAMPLE_CANDIDATES = 20_000
#: The least precision on held-out candidates that a threshold must reach.
PRECISION = 0.98
SPAN = "array<struct<kind:int,start:int,end:int,s:string>>"


def found(text: Column, pattern: str, kind: str, if_: Column) -> Column:
    """The matches of a pattern with their code-point offsets, as an array of SPAN."""
    lengths = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda h, g: F.struct(h.alias("s"), F.length(g).alias("gap")),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def add(a: Column, x: Column) -> Column:
        first = a["at"] + x["gap"]
        end = first + F.length(x["s"])
        span = F.struct(F.lit(ALL_KINDS.index(kind)).alias("kind"), first.alias("start"), end.alias("end"), x["s"].alias("s"))
        return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

    with_hits = F.filter(lengths, lambda x: x["s"].isNotNull())
    return F.when(if_, F.aggregate(with_hits, start, add, lambda a: a["out"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits(s)), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def parts_fit(s: Column) -> Column:
    """Every dotted part is at most 255."""
    bare = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def needs(text: Column) -> dict[str, Column]:
    """What a text must hold for a kind to be possible; spares most texts the patterns."""
    return {
        "email": F.contains(text, F.lit("@")) | text.rlike(r"(?i)[\[(]at[\])]"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][0-9\x20.-]{5}"),
        "phone": text.rlike(r"[0-9][0-9().\x20-]{4}"),
        "secret": text.rlike(r"[A-Za-z0-9_+/=-]{20}"),
    }


def base_matches(text: Column) -> Column:
    """All matches of the base patterns, those that fail their check too."""
    need = needs(text)
    return F.concat(*[found(text, BASE[k], k, need[k]) for k in KINDS])


def base_spans(text: Column) -> Column:
    valid = {
        "email": lambda s: F.lit(True),
        "ip": parts_fit,
        "card": lambda s: F.length(digits(s)).between(13, 19) & luhn(s),
        "phone": lambda s: F.length(digits(s)).between(9, 15),
    }
    need = needs(text)

    def of(kind: str) -> Column:
        return F.filter(found(text, BASE[kind], kind, need[kind]), lambda x: valid[kind](x["s"]))

    return F.concat(*[of(k) for k in KINDS])


def candidates(text: Column) -> Column:
    need = needs(text)
    return F.concat(*[found(text, pattern, k, need[k]) for k, pattern in GENERATORS])


def text_before(text: Column, span: Column) -> Column:
    """The 30 characters before a span."""
    return F.when(span["start"] > 0, F.substr(text, F.greatest(span["start"] - 29, F.lit(1)), F.least(span["start"], F.lit(30)))).otherwise("")


def features(text: Column, span: Column) -> Column:
    """Format and context of a span, as doubles."""
    s = span["s"]
    before = text_before(text, span)
    after = F.substr(text, span["end"] + 1, F.lit(1))
    figures = digits(s)
    count = lambda pattern: F.regexp_count(s, F.lit(pattern))
    values = [
        span["kind"], F.length(s), F.length(figures), count(r"\p{L}"), count(r"[\x20.()-]"), count(r"^\+"), count("@"),
        count(r"\("), luhn(s), parts_fit(s) & (count("[0-9]") > 3), count(r"\."), F.size(F.array_distinct(F.split(figures, ""))),
        count("[0-9]+"), F.coalesce(F.substr(figures, F.lit(1), F.lit(1)).try_cast("int"), F.lit(-1)), before.rlike(HINT),
        before.rlike(AGAINST), before.rlike(r"[\p{L}\p{N}_=/]$"), after.rlike(r"^[\p{L}\p{N}_=/]"), count(r"^[\x00-\x7F]*$"),
    ]
    return F.array(*[v.cast("double") for v in values])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Model:
    """A boosted model and a threshold for each kind."""

    def __init__(self, boosted: Boosted, thresholds: dict[str, float]):
        self.boosted, self.thresholds = boosted, thresholds


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on candidates of at most SAMPLE_DOCUMENTS documents, dealt by a hash of their id.

    A candidate's label is whether it overlaps a base span of its kind, and a secret's
    whether it is named as one. One that is a part
    of a longer match that failed its check has no label and is left out. One document in
    three is held out; each kind's threshold is the least score whose precision there
    reaches PRECISION, and a kind that never reaches it selects nothing.
    """
    picked = (
        docs.filter(F.col(text_col).rlike("[0-9@]"))
        .select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"))
        .orderBy("_h", "_id")
        .limit(SAMPLE_DOCUMENTS)
        .select("_id", "_h")
        .distinct()
    )

    def of_kind(spans: str, also: Callable[[Column], Column] = lambda s: F.lit(True)) -> Column:
        return F.exists(spans, lambda s: (s["kind"] == F.col("_x")["kind"]) & overlap(s, F.col("_x")) & also(s))

    spans = (
        docs.join(F.broadcast(picked), F.col(id_col) == F.col("_id"), "left_semi")
        .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .select("_id", "_t", base_spans(F.col("_t")).alias("_b"), base_matches(F.col("_t")).alias("_m"), candidates(F.col("_t")).alias("_c"))
        .select("_id", "_t", "_b", "_m", F.explode(F.concat("_c", "_b")).alias("_x"))
        .filter(of_kind("_b") | ~of_kind("_m", lambda m: m["end"] - m["start"] > F.col("_x")["end"] - F.col("_x")["start"]))
        .select(
            (F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(3)) == 0).alias("held"),
            F.when(F.col("_x")["kind"] < len(KINDS), of_kind("_b")).otherwise(text_before(F.col("_t"), F.col("_x")).rlike(NAMES_SECRET)).alias("label"),
            features(F.col("_t"), F.col("_x")).alias("x"),
        )
    )
    rows = spans.orderBy(F.xxhash64("x"), "held", "label").limit(SAMPLE_CANDIDATES).collect()
    if not rows:
        return None
    held, y = np.array([r["held"] for r in rows]), np.array([r["label"] for r in rows], dtype=float)
    x = np.array([r["x"] for r in rows])
    if len(np.unique(y[~held])) < 2:
        return None
    boosted = Boosted().fit(x[~held], y[~held])
    score, thresholds = boosted.score(x[held]), {}
    for i, kind in enumerate(ALL_KINDS):
        own = x[held][:, 0] == i
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], np.cumsum(y[held][own][order])
        good = [float(s[j]) for j in range(len(s)) if right[j] >= PRECISION * (j + 1) and (j + 1 == len(s) or s[j] > s[j + 1])]
        thresholds[kind] = max(min(good, default=2.0), 0.5) - 1e-9
    return Model(boosted, thresholds)


def selected(text: Column, base: Column, model: Model) -> Column:
    """Candidates over their kind's threshold that overlap no base span, one of each overlapping set."""
    least = F.array(*[F.lit(model.thresholds[k]) for k in ALL_KINDS])
    free = F.filter(candidates(text), lambda c: ~F.exists(base, lambda b: overlap(b, c)))
    scored = F.transform(
        free,
        lambda c: let(
            features(text, c),
            lambda x: F.struct(c["start"].alias("start"), c["end"].alias("end"), model.boosted.column(x).alias("score"), c["kind"].alias("kind"), c["s"].alias("s")),
        ),
    )
    over = F.sort_array(F.filter(scored, lambda c: c["score"] >= F.get(least, c["kind"])))
    kind = "array<struct<start:int,end:int,score:double,kind:int,s:string>>"

    def add(a: Column, c: Column) -> Column:
        last = F.element_at(a, F.lit(-1))
        apart = (F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["end"] <= c["start"])
        best = F.when(last["score"] >= c["score"], a).otherwise(F.array_append(F.slice(a, 1, F.size(a) - 1), c))
        return F.when(apart, F.array_append(a, c)).otherwise(best)

    kept = F.aggregate(over, F.expr(f"cast(array() as {kind})"), add)
    return F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (base and selected), each an array of (kind, start, end, s) in order."""
    model = fit(docs, id_col, text_col)
    read = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    based = read.select("*", base_spans(F.col("_t")).alias("base"))
    if model is None:
        return based.select("doc_id", *keep, "_t", "base", F.col("base").alias("spans"))
    more = F.when(F.col("_t").rlike("[0-9@]|(?i)[\\[(]at[\\])]"), selected(F.col("_t"), F.col("base"), model)).otherwise(
        F.expr(f"cast(array() as {SPAN})")
    )
    return based.select("doc_id", *keep, "_t", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, all spans written out, and how many they are."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return find(docs).select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; all columns stay.

    Overlapping spans are merged and carry the first one's kind.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def add(a: Column, x: Column) -> Column:
        gap = F.substr(F.col("_t"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        out = F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.get(names, x["kind"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(by_start, start, add, lambda a: F.concat(a["out"], F.substr(F.col("_t"), a["at"] + 1, F.length("_t"))))
    row = docs.select(id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    done = find(row, id_col, text_col, keep=("_row",))
    text = F.when(F.size("spans") == 0, F.col("_row")[text_col]).otherwise(whole)
    return done.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
