"""Expressions over pages and replies of sources: states, cards, rows, identifiers, JSON, nested paths."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a result page says, and the form of its records, of company numbers and of its session token.
PAGINATION = r"(?i)([0-9]+)\s+to\s+([0-9]+)\s+of\s+([0-9]+)\s+records"
NO_RECORDS = r"(?i)No\s+record\(s\)\s+available"
CARD = r'(?is)<div class="card-table-left[^"]*">(.*?)</div>\s*</div>\s*</div>'
CARD_FIELD = r'(?is)<div class="title"><span>(.*?)</span></div><div class="value[^"]*"><span>(.*?)</span>'
CIN = r"\b[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b"
TOKEN = r'name="org\.apache\.struts\.taglib\.html\.TOKEN"\s+value="([^"]+)"'


#: Named references of HTML, from Python's library, without their ampersand.
NAMED = json.dumps(html.entities.html5)
REFERENCE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def decoded(text: Column) -> Column:
    """The text with its character references, named and by number, as characters; what is none stays."""

    def character(reference: Column) -> Column:
        name = F.substring(reference, 2, 40)
        digits = F.regexp_extract(name, "^#([0-9]+)", 1).try_cast("long")
        point = F.coalesce(digits, F.conv(F.nullif(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1), F.lit("")), 16, 10).cast("long"))
        good = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        by_number = F.when(good, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        return F.coalesce(by_number, F.element_at(F.from_json(F.lit(NAMED), "map<string,string>"), name), reference)

    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    between = F.split(text, REFERENCE, -1)
    # one more text than references
    whole = F.zip_with(between, F.transform(found, character), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(whole, "")).otherwise(text)


def plain(cell: Column) -> Column:
    """A cell's text without tags, its character references decoded; hard spaces at its ends go too."""
    return F.regexp_replace(decoded(F.regexp_replace(cell, "<[^>]*>", "")), r"^[\s\xA0]+|[\s\xA0]+\z", "")


def parse_state(body: Column) -> Column:
    """(state, n): results, empty or unparseable; only a page that says so is empty."""
    n = F.coalesce(F.regexp_extract(body, PAGINATION, 3).try_cast("int"), F.lit(0))
    state = F.when(body.rlike(PAGINATION), "results").when(body.rlike(NO_RECORDS), "empty").otherwise("unparseable")
    return F.struct(state.alias("state"), F.when(body.rlike(PAGINATION), n).otherwise(0).alias("n"))


def cards(body: Column) -> Column:
    """Records of a page's cards as maps from title to value; cards without a Name are dropped."""

    def record(block: Column) -> Column:
        fields = F.zip_with(
            F.regexp_extract_all(block, F.lit(CARD_FIELD), F.lit(1)),
            F.regexp_extract_all(block, F.lit(CARD_FIELD), F.lit(2)),
            lambda k, v: F.struct(plain(k).alias("k"), plain(v).alias("v")),
        )
        named = F.filter(fields, lambda f: f["k"] != "")
        last = F.filter(named, lambda f, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda g: g["k"] == f["k"]))
        return F.map_from_entries(last)

    blocks = F.regexp_extract_all(body, F.lit(CARD), F.lit(0))
    return F.filter(F.transform(blocks, record), lambda r: F.coalesce(F.try_element_at(r, F.lit("Name")), F.lit("")) != "")


def table_rows(body: Column, cells: int = 2) -> Column:
    """Rows of a page's tables as arrays of cell texts, those with at least so many filled cells."""
    rows = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), plain),
    )
    return F.filter(rows, lambda r: F.size(F.filter(r, lambda c: c != "")) >= cells)


def identifiers(text: Column) -> Column:
    """Distinct company numbers in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CIN), F.lit(0))))


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else; else null.

    The parser stops behind the first value, whatever follows: so the text is read inside a
    list and inside an object, which no text can both end too early.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(named.isNotNull() & F.variant_get(listed, "$[1]", "variant").isNull(), F.variant_get(listed, "$[0]", "variant"))


def salvaged_json(reply: Column) -> Column:
    """The object of a reply that begins with a fence, else what stands between its first and last brace, if that is an object; else null.

    What a fence at the beginning holds decides, if it is JSON at all.
    """
    said = F.regexp_replace(reply, r"^\s+|\s+\z", "")
    fenced = F.regexp_replace(F.regexp_extract(said, r"(?s)^```(?:json)?(.*?)(?:```|\z)", 1), r"^\s+|\s+\z", "")
    fences = F.startswith(said, F.lit("```")) & strict_json(fenced).isNotNull()
    braced = F.regexp_extract(said, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.json_object_keys(c).isNotNull() & strict_json(c).isNotNull(), c)
    return F.when(fences, valid(fenced)).otherwise(valid(F.nullif(braced, F.lit(""))))


def dig(document: Column, path: str) -> Column:
    """A nested value of a JSON document by its dotted path; null where any step is missing."""
    return F.get_json_object(document, f"$.{path}")


def token_count(n: Column) -> Column:
    """n, or in thousands with one digit, or in millions with two; rounded as the nearest double of the quotient is.

    A quotient that ends on a 5 is hardly ever exact as a double, and goes where that lies; an
    exact one goes to the even digit.
    """
    return F.when(n >= 1_000_000, _rounded(n, 1_000_000, 2, "M")).when(n >= 1000, _rounded(n, 1000, 1, "k")).otherwise(n.cast("string"))


def _rounded(n: Column, unit: int, digits: int, suffix: str) -> Column:
    step, wide = unit // 10**digits, "decimal(38,0)"
    down, rest = F.floor(n / step).cast("long"), n % step
    # the double times 2**52 is whole up to 2048 units, and compared with the true quotient
    double = F.least(n.cast("double") / unit, F.lit(2047.0)) * float(1 << 52)
    over = double.cast("long").cast(wide) * F.lit(unit).cast("decimal(8,0)") - n.cast("decimal(18,0)") * F.lit(1 << 52).cast("decimal(18,0)")
    tie = (over > 0) | ((over == 0) & (down % 2 == 1))
    near = down + F.when((2 * rest > step) | ((2 * rest == step) & tie), 1).otherwise(0)
    left, right = F.floor(near / 10**digits).cast("long").cast("string"), F.lpad((near % 10**digits).cast("string"), digits, "0")
    return F.concat(left, F.lit("."), right, F.lit(suffix))
