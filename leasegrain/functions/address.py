"""The stable identity of a unit: normalized address and unit label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Long spellings and their standard short forms, and the words
# that label a unit without naming it.
SPELLINGS = {
    "street": "st",
    "avenue": "ave",
    "av": "ave",
    "boulevard": "blvd",
    "road": "rd",
    "drive": "dr",
    "lane": "ln",
    "court": "ct",
    "place": "pl",
    "terrace": "ter",
    "parkway": "pkwy",
    "highway": "hwy",
    "circle": "cir",
    "square": "sq",
    "trail": "trl",
    "plaza": "plz",
    "north": "n",
    "south": "s",
    "east": "e",
    "west": "w",
    "northeast": "ne",
    "northwest": "nw",
    "southeast": "se",
    "southwest": "sw",
}
DESIGNATORS = ("unit", "apt", "apartment", "#")
SEPARATOR = "|"

# Unicode white space plus the four ASCII separators.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    """Lower-cased words with edge dots and commas trimmed; empty for null."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    folded = F.translate(F.replace(folded, F.lit("ß"), F.lit("ss")), "ς", "σ")
    spaced = F.regexp_replace(folded, _SPACE, " ")
    trimmed = F.transform(F.split(spaced, " "), lambda t: F.btrim(t, F.lit(".,")))
    return F.filter(trimmed, lambda t: t != "")


def _rest(words: Column) -> Column:
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))


def _address_part(words: Column) -> Column:
    lookup = F.create_map(*[F.lit(part) for pair in SPELLINGS.items() for part in pair])
    return F.array_join(
        F.transform(words, lambda t: F.coalesce(F.try_element_at(lookup, t), t)), " "
    )


def with_comp_key(df: DataFrame, address: str, unit: str, out: str) -> DataFrame:
    """Add ``out``: ``address|unit`` after normalization.

    Built in steps, so that Spark evaluates each intermediate array once.
    """
    label = f"__{out}_label"
    words = f"__{out}_unit"
    df = df.withColumn(words, tokens(F.col(unit)))
    df = df.withColumn(
        label,
        F.when(F.get(F.col(words), F.lit(0)).isin(*DESIGNATORS), _rest(F.col(words))).otherwise(F.col(words)),
    )
    head = F.get(F.col(label), F.lit(0))
    bare = F.ltrim(head, F.lit("#"))
    stripped = F.when(
        head.startswith("#"),
        F.concat(F.filter(F.array(bare), lambda t: t != ""), _rest(F.col(label))),
    ).otherwise(F.col(label))
    df = df.withColumn(label, F.array_join(stripped, " "))
    unit_part = F.when(F.col(label) != "", F.col(label)).otherwise(F.array_join(F.col(words), " "))
    return df.withColumn(
        out, F.concat(_address_part(tokens(F.col(address))), F.lit(SEPARATOR), unit_part)
    ).drop(label, words)


def has_text(text: Column) -> Column:
    """True for text with at least one non-blank character."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def names_something(text: Column) -> Column:
    """True if normalization leaves at least one word of the text."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f.,]"), F.lit(False))
