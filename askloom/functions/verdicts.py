"""Parsing of model output held in string columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions.text import computed_once, or_empty

#: Keys of a judge verdict and their types (fixed values).
JUDGE_FIELDS = {
    "faithfulness": "double", "answer_relevance": "double", "context_relevance": "double",
    "is_grounded": "boolean", "reason": "string",
}
#: Keys of a routing decision and their types (fixed values).
DECISION_FIELDS = {"action": "string", "reason": "string"}


def _with_parsed(
    text: Column, fields: dict[str, str], use: Callable[[Column, Column], Column]
) -> Column:
    """Apply ``use`` to the parsed struct and to whether the text was one JSON
    object and nothing else. Every field is read as text and cast by itself, so
    that a value of another type is null and leaves its neighbours alone.

    The parser stops after the first value and doesn't mind what follows. Inside
    an array and inside an object, each with its own way to go on, only a single
    whole object parses."""
    strings = ", ".join(f"{name}: string" for name in fields)
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{strings}>>")
    nested = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")), f"v string, {_CORRUPT} string", _OPTIONS
    )

    def unpack(both: Column) -> Column:
        found = both.getField("listed")
        whole = both.getField("nested").getField(_CORRUPT).isNull() & (F.size(found) == 1)
        first = F.get(found, 0)
        typed = F.struct(
            *[first.getField(name).try_cast(kind).alias(name) for name, kind in fields.items()]
        )
        usable = F.coalesce(text.isNotNull() & whole & first.isNotNull(), F.lit(False))
        return use(typed, usable)

    return computed_once(F.struct(listed.alias("listed"), nested.alias("nested")), unpack)


_CORRUPT = "_unparsed"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def judge_score(text: Column) -> Column:
    """First number in the text, held to 0..1; no number gives 0."""
    number = F.nullif(F.regexp_extract(or_empty(text), r"(\d+(\.\d+)?)", 1), F.lit(""))
    return F.least(F.lit(1.0), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def judge_json(text: Column) -> Column:
    """Verdict struct; unusable JSON gives zeros, false and ``invalid json``."""

    def verdict(parsed: Column, usable: Column) -> Column:
        def field(name: str, default: object) -> Column:
            value = F.when(usable, parsed.getField(name))
            return F.coalesce(value, F.lit(default)).alias(name)

        return F.struct(
            field("faithfulness", 0.0),
            field("answer_relevance", 0.0),
            field("context_relevance", 0.0),
            field("is_grounded", False),
            F.when(usable, F.coalesce(parsed.getField("reason"), F.lit("")))
            .otherwise(F.lit("invalid json"))
            .alias("reason"),
        )

    return _with_parsed(text, JUDGE_FIELDS, verdict)


def faithfulness_verdict(text: Column) -> Column:
    """``Faithful: Yes / No`` and ``Comments: ...`` as a struct. A text without
    a verdict line gives null."""
    verdict = F.lower(F.regexp_extract(or_empty(text), r"(?i)Faithful:\s*(yes|no)\b", 1))
    comments = F.regexp_extract(or_empty(text), r"(?is)Comments:\s*(.*)$", 1)
    return F.struct(
        F.when(verdict == "yes", F.lit(True)).when(verdict == "no", F.lit(False)).alias("faithful"),
        F.trim(comments).alias("comments"),
    )


def listed_indexes(text: Column) -> Column:
    """The distinct whole numbers a model listed, in order of first mention."""
    return F.array_distinct(
        F.transform(
            F.regexp_extract_all(or_empty(text), F.lit(r"(\d+)"), 1),
            lambda digits: digits.try_cast("int"),
        )
    )


def agent_decision(text: Column) -> Column:
    """Routing decision struct. Unusable JSON means: search. ``route`` maps any
    action that is neither of the two other known ones to a search."""

    def decision(parsed: Column, usable: Column) -> Column:
        action = F.when(usable, parsed.getField("action")).otherwise(F.lit("search_documents"))
        reason = F.when(usable, parsed.getField("reason")).otherwise(F.lit("fallback_to_search"))
        others = F.coalesce(action.isin("reject", "answer_without_search"), F.lit(False))
        return F.struct(
            action.alias("action"),
            reason.alias("reason"),
            F.when(others, action).otherwise(F.lit("search_documents")).alias("route"),
        )

    return _with_parsed(text, DECISION_FIELDS, decision)
