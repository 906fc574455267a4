"""Objects out of JSON that was cut off, wrapped in a code fence or written one to a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import web as W
from tessella.sources.json_products import elements, is_object

let = W.let
#: A whole string (or what there is of the last one), a brace, or a run of anything else: together all of the text.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^"{}]+'


def value_of(text: Column) -> Column:
    """A text that is one JSON value, parsed; null otherwise. The parser stops after a first value, so the text must also be one between brackets."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(whole & (W.trim(text) != ""), F.try_parse_json(text))


def _objects_in(tokens: Column) -> Column:
    """Texts of the outermost braces: a fold over the tokens counts how deep each stands, strings apart."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("at"), F.lit(0).alias("k"), F.filter(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("n"))), lambda _: F.lit(False)).alias("found"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        closes = (t == "}") & (s["depth"] == 1) & (s["at"] >= 0)
        at = F.when((t == "{") & (s["depth"] == 0), s["k"]).when(closes, -1).otherwise(s["at"])
        found = F.when(closes, F.concat(s["found"], F.array(F.struct(s["at"].alias("a"), (s["k"] - s["at"] + 1).alias("n"))))).otherwise(s["found"])
        return F.struct(depth.alias("depth"), at.alias("at"), (s["k"] + 1).alias("k"), found.alias("found"))

    spans = F.aggregate(tokens, start, step, lambda s: s["found"])
    return F.transform(spans, lambda p: F.array_join(F.slice(tokens, p["a"] + 1, p["n"]), ""))


def salvaged(raw: Column) -> Column:
    """The JSON objects of a text, as JSON with keys in the order of their names: an array of texts.

    A text that parses gives its array's objects (and arrays) or itself. Otherwise each line that is an object (after a dash
    or star, before a comma), then each outermost pair of braces behind the first square bracket that parses; equal
    objects once. Nulls, blank texts and texts without a whole object give an empty array.
    """
    text = W.trim(F.regexp_replace(W.text_of(raw), "```json|```", ""))
    none = F.array().cast("array<string>")

    def pieces(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n+"), lambda x: F.regexp_replace(F.regexp_replace(W.trim(x), f"^[-*][{W.SPACES}]*", ""), ",$", ""))
        lines = F.filter(lines, lambda x: x.startswith("{") & x.contains("}"))
        behind = F.when(F.instr(t, "[") > 0, F.substr(t, F.instr(t, "[") + 1)).otherwise(t)
        texts = F.concat(lines, let(F.regexp_extract_all(behind, F.lit(TOKEN), F.lit(0)), _objects_in))
        values = F.filter(F.transform(texts, value_of), lambda v: v.isNotNull() & is_object(v))
        return F.array_distinct(F.transform(values, lambda v: F.to_json(v)))

    def use(t: Column) -> Column:
        def whole(v: Column) -> Column:
            listed = F.transform(F.filter(elements(v), lambda x: is_object(x) | elements(x).isNotNull()), lambda x: F.to_json(x))
            return F.when(elements(v).isNotNull(), listed).when(is_object(v), F.array(F.to_json(v))).otherwise(pieces(t))

        return F.when(t == "", none).otherwise(let(value_of(t), whole))

    return let(text, use)
