"""Nested settings: JSON trees taken apart into paths, variables substituted, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators.control import substitute_env
from foliate.sources.shared import stored


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """file, settings (JSON text) of the JSON files below a path; text that is no JSON object has null settings."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), "value")
    sound = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    return raw.select("file", F.when(sound, F.col("value")).alias("settings"))


def _quoted(text: Column) -> Column:
    """A JSON string; null is ``null``."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""), F.lit("null"))


def leaves(settings: DataFrame, key: str, depth: int = 16) -> DataFrame:
    """``key``, path (array of struct kind, step), value (JSON text of a scalar, or ``{}`` or ``[]``) of every leaf of JSON settings.

    A level is one explode; levels end when no map or list is left, or at ``depth``, beyond which settings are an error.
    """
    path0 = F.array().cast("array<struct<kind: string, step: string>>")
    at = settings.where("settings IS NOT NULL").select(key, path0.alias("path"), F.to_json(F.try_parse_json("settings")).alias("value"))
    out = None
    for level in range(depth + 1):
        kind = F.when(F.col("value").startswith("{") & (F.col("value") != "{}"), "m").when(F.col("value").startswith("[") & (F.col("value") != "[]"), "l")
        at = stored(at.withColumn("_kind", kind), "settings")
        ended = at.where("_kind IS NULL").drop("_kind")
        out = ended if out is None else out.unionByName(ended)
        inner = at.where("_kind IS NOT NULL")
        if inner.isEmpty():
            return out
        variant = F.parse_json("value")
        maps = F.transform(F.map_entries(variant.cast("map<string,variant>")), lambda e: F.struct(F.lit("m").alias("kind"), e["key"].alias("step"), F.to_json(e["value"]).alias("value")))
        lists = F.transform(variant.cast("array<variant>"), lambda v, i: F.struct(F.lit("l").alias("kind"), F.lpad(i.cast("string"), 10, "0").alias("step"), F.to_json(v).alias("value")))
        each = inner.where("_kind = 'm'").select(key, "path", F.explode(maps).alias("c")).unionByName(inner.where("_kind = 'l'").select(key, "path", F.explode(lists).alias("c")))
        at = each.select(key, F.concat("path", F.array(F.struct("c.kind", "c.step"))).alias("path"), F.coalesce("c.value", F.lit("null")).alias("value"))
    raise ValueError(f"settings deeper than {depth} levels")


def built(flat: DataFrame, key: str) -> DataFrame:
    """``key``, settings: the JSON text of leaves; members of maps in the order of their names."""
    rows = stored(flat.withColumn("_n", F.size("path")), "settings")
    deepest = rows.agg(F.max("_n")).first()[0] or 0
    for level in range(deepest, 0, -1):
        here = rows.where(F.col("_n") == level)
        last = F.element_at("path", -1)
        member = F.when(last["kind"] == "m", F.concat(_quoted(last["step"]), F.lit(":"), F.col("value"))).otherwise(F.col("value"))
        named = here.select(key, F.slice("path", 1, level - 1).alias("path"), last["kind"].alias("kind"), last["step"].alias("step"), member.alias("m"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "m"))), lambda x: x["m"]), ",")
        whole = named.groupBy(key, "path", "kind").agg(joined.alias("j")).select(key, "path", F.when(F.col("kind") == "m", F.concat(F.lit("{"), F.col("j"), F.lit("}"))).otherwise(F.concat(F.lit("["), F.col("j"), F.lit("]"))).alias("value"), F.lit(level - 1).alias("_n"))
        rows = stored(rows.where(F.col("_n") < level).unionByName(whole), "settings")
    return rows.select(key, F.col("value").alias("settings"))


def substituted(settings: DataFrame, env: DataFrame, key: str) -> DataFrame:
    """``key``, settings with every whole string value ``${VAR}`` or ``${VAR:default}``, at any depth, as the variable, its default or null.

    ``settings`` has the key and JSON text, ``env`` name and value (one row a name counts, see ``substitute_env``). Substituted values are strings.
    """
    flat = leaves(settings, key)
    text = F.col("value").rlike(r'^"')
    strings = flat.where(text).withColumn("value", F.get(F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>"), F.lit(0)))
    done = substitute_env(strings, env).withColumn("value", _quoted(F.col("value")))
    return built(done.unionByName(flat.where(~text)), key)
