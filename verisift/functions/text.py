"""Text expressions: canonical forms, tokens, tags, addresses, names and URLs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Glyphs that the canonical form straightens, blanks or drops.
QUOTES_FROM, QUOTES_TO = "‘’‚‛“”„‟–—―−", "''''\"\"\"\"----"
BULLETS = "❖✦✧◆◇▪▫●○•·‣⁃⁌⁍☞➤➜→"
DROPPED = "​﻿"
# Address abbreviations and their long forms.
ADDRESS_WORDS = {"rd": "road", "st": "street", "marg": "road", "fl": "floor", "flr": "floor", "blg": "building", "bldg": "building", "opp": "opposite", "nr": "near"}
LEGAL_FORMS = ("private", "limited", "pvt", "ltd", "llp")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function has; Arrow batches."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def canonical(text: Column, compose: bool = True) -> Column:
    """NFKC, straight quotes and dashes, no bullets, single spaces, lower case; plain ASCII is not sent to Python."""
    text = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if compose else text
    blanks = BULLETS + "    "
    plain = F.translate(text, QUOTES_FROM + blanks + DROPPED, QUOTES_TO + " " * len(blanks))
    return F.lower(F.trim(F.regexp_replace(plain, r"[\s\x0B]+", " ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body uses it many times or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_spaced(text: Column) -> Column:
    """Single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\x0B]+", " ")))


# The pattern of tokens.
def tokens(canonical_text: Column) -> Column:
    """Words, and figures such as 18-20 or 2.00% whole."""
    return F.regexp_extract_all(canonical_text, F.lit(r"[a-z0-9]+(?:[.,%/'-][a-z0-9]+)*|[%₹$]"), F.lit(0))


def without_tags(html: Column) -> Column:
    """Text of a page by pattern: scripts, styles and tags become spaces, two references are decoded."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    bare = F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def address(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " ")
    for short, long in ADDRESS_WORDS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return F.trim(F.regexp_replace(out, " +", " "))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the fewer of both, of space-separated texts."""
    a, b = (F.array_distinct(F.filter(F.split(x, " "), lambda w: w != "")) for x in (a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def company_slug(name: Column) -> Column:
    """Hyphenated upper-case name without its legal form, unless nothing else is left."""
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9 ]+", " "), " +"), lambda w: w != "")
    core = F.filter(words, lambda w: ~F.lower(w).isin(*LEGAL_FORMS))
    return F.upper(F.array_join(F.when(F.size(core) > 0, core).otherwise(words), "-"))


def domain(url: Column) -> Column:
    """Host without protocol, www and port, in lower case."""
    return F.regexp_extract(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?", ""), r"^([^/?#:]*)", 1)


def plain_url(url: Column) -> Column:
    """A URL without protocol, www and closing slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?", ""), "/+$", "")
