"""Request documents judged field by field, as they come from outside.

A document is walked along the fields that a request has, level by level. Every
field that is unknown, missing, of another type or out of range is named by its
path, so that a typing error is a loud rejection and never curation that silently
does not apply.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
PROBLEM = "array<struct<path: string, problem: string>>"


@dataclass(frozen=True)
class Field:
    """``kind`` is text, number, flag, object, list or map; ``item`` is what a list or map holds."""

    kind: str
    required: bool = False
    nullable: bool = False
    above: float | None = None
    least: float | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    item: Field | None = None


#: Fixed by the interface: the fields of a request and their bounds.
REQUEST = Field(
    "object",
    fields={
        "pull_ref": Field("text", required=True),
        "subject": Field(
            "object",
            required=True,
            fields={
                "address": Field("text", required=True),
                "lat": Field("number", required=True),
                "lng": Field("number", required=True),
                "sqft": Field("number", required=True, above=0.0),
                "beds": Field("number", required=True, least=0.0),
                "baths": Field("number", required=True, least=0.0),
            },
        ),
        "weights": Field("map", item=Field("number", least=0.0)),
        "include_overrides": Field("list", item=Field("text")),
        "filters": Field(
            "object",
            fields={
                "max_distance_mi": Field("number", nullable=True, least=0.0),
                "hide_censored": Field("flag"),
                "leased_only": Field("flag"),
            },
        ),
        "drift_pct": Field("number"),
        "candidate_rent": Field("number", nullable=True, above=0.0),
    },
)
_KINDS = {"text": ("STRING",), "number": _NUMBER, "flag": ("BOOLEAN",), "object": ("OBJECT",), "map": ("OBJECT",), "list": ("ARRAY",)}
_NAMED = {"text": "a text", "number": "a number", "flag": "true or false", "object": "an object", "map": "an object", "list": "a list"}


def _is(value: Column, *kinds: str) -> Column:
    """Whether a variant is of one of the kinds; null for no value."""
    name = F.schema_of_variant(value)
    out = name.startswith(kinds[0])
    for kind in kinds[1:]:
        out = out | name.startswith(kind)
    return out


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _one(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem")))


def _judge(value: Column, spec: Field, path: Column) -> Column:
    """All problems of a value that is there (a variant, which may hold JSON's null), its members included."""
    none = F.array().cast(PROBLEM)
    right = _is(value, *_KINDS[spec.kind])
    number = F.try_variant_get(value, "$", "double")
    inside = none
    if spec.above is not None:
        inside = F.when(number > spec.above, none).otherwise(_one(path, f"must be greater than {spec.above:g}"))
    elif spec.least is not None:
        inside = F.when(number >= spec.least, none).otherwise(_one(path, f"must be at least {spec.least:g}"))
    elif spec.kind == "object":
        inside = _walk(_members(value), spec.fields, path)
    elif spec.kind == "map":
        entries = F.map_entries(_members(value))
        inside = F.flatten(F.transform(entries, lambda e: _judge(e["value"], spec.item, F.concat(path, F.lit("."), e["key"]))))
    elif spec.kind == "list":
        items = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(items, lambda v, k: _judge(v, spec.item, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))))
    wrong = _one(path, f"must be {_NAMED[spec.kind]}")
    accepted = F.when(_is(value, "VOID"), none) if spec.nullable else F.when(F.lit(False), none)
    return accepted.when(right, inside).otherwise(wrong)


def _walk(members: Column, fields: dict[str, Field], path: Column | None) -> Column:
    """Problems of an object's members: unknown ones first, then the fields in their order."""
    at = lambda name: name if path is None else F.concat(path, F.lit("."), name)
    unknown = F.array_except(F.map_keys(members), F.array(*[F.lit(f) for f in fields]))
    found = [F.transform(F.array_sort(unknown), lambda k: F.struct(at(k).alias("path"), F.lit("unknown field").alias("problem")))]
    for name, spec in fields.items():
        absent = _one(at(F.lit(name)), "is required") if spec.required else F.array().cast(PROBLEM)
        there = F.map_contains_key(members, F.lit(name))
        found.append(F.when(there, _judge(F.element_at(members, F.lit(name)), spec, at(F.lit(name)))).otherwise(absent))
    return F.flatten(F.array(*[f.cast(PROBLEM) for f in found]))


def judged_documents(documents: DataFrame, spec: Field = REQUEST) -> DataFrame:
    """``documents(request_id, body)`` with ``problems``, an array of ``path`` and ``problem``; empty for a good one."""
    parsed = documents.withColumn("_json", F.try_parse_json("body")).withColumn("_members", _members(F.col("_json")))
    whole = F.when(F.col("_json").isNull(), _one(F.lit("$"), "is not JSON")).when(
        F.col("_members").isNull(), _one(F.lit("$"), f"must be {_NAMED['object']}")
    )
    problems = whole.otherwise(_walk(F.col("_members"), spec.fields, None))
    return parsed.withColumn("problems", problems).drop("_json", "_members")


def problems_of(judged: DataFrame) -> DataFrame:
    """``request_id, path, problem``, a row per problem."""
    return judged.select("request_id", F.inline("problems"))
