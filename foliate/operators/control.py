"""Control tables: rounds until a threshold, statuses, batches, caches, settings and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.operators.store import one_each, over


def until_threshold(rounds: DataFrame, key: str, threshold: float, most: int) -> DataFrame:
    """Rounds of each key up to and with the first that reaches the threshold, ``most`` at most."""
    order = Window.partitionBy(key).orderBy("iteration")
    done = F.coalesce(F.max((F.col("score") >= threshold).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rounds.withColumn("_done", done).withColumn("_n", F.row_number().over(order)).where((F.col("_done") == 0) & (F.col("_n") <= most)).drop("_done", "_n")


def best_and_final(rounds: DataFrame, key: str) -> DataFrame:
    """Best score, score and verdict of the last round, and the number of rounds; partial aggregates only."""
    return rounds.groupBy(key).agg(F.max("score").alias("best_score"), F.max_by("score", "iteration").alias("final_score"), F.max_by("verdict", "iteration").alias("final_verdict"), F.count(F.lit(1)).alias("n_rounds"))


def latest(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """Last write wins: the row of each key that is last by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: Column | str | None = None) -> DataFrame:
    """``table`` with the rows of ``changes`` over those of the same key, one row a key: the last by ``order`` in either table (see ``one_each``)."""
    return over(one_each(table, key, order), one_each(changes, key, order), key)


def fully_processed(status: Column, multimodal: Column) -> Column:
    return (status == "processed") & F.coalesce(multimodal, F.lit(False))


def batch_summary(files: DataFrame, ok: Column) -> DataFrame:
    """Totals, failures and the rate of success (0 without files)."""
    return files.agg(*_summary(ok))


def _summary(ok: Column) -> list[Column]:
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return [n.alias("total"), good.alias("succeeded"), (n - good).alias("failed"), F.round(F.coalesce(F.try_divide(good * F.lit(100.0), n), F.lit(0.0)), 6).alias("success_rate")]


def parse_then_insert(files: DataFrame, parsed: Column, inserted: Column) -> DataFrame:
    """The summary of a batch's parsing, and how many of the parsed files then went in or failed; others are not tried."""
    good = F.coalesce(parsed, F.lit(False))
    went = F.coalesce(inserted, F.lit(False))
    return files.agg(*_summary(parsed), F.count_if(good & went).alias("inserted"), F.count_if(good & ~went).alias("insert_failed"))


def append_chunks(status: DataFrame, added: DataFrame) -> DataFrame:
    """doc_id, chunks, n_chunks: a document's chunk ids with the added ones (chunk_id, ord) behind them; repeats stay."""
    more = added.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))).alias("_more"))
    ids = F.transform(F.coalesce("_more", F.array().cast("array<struct<ord:bigint,chunk_id:string>>")), lambda x: x["chunk_id"])
    return status.join(more, "doc_id", "left").select("doc_id", F.concat("chunks", ids).alias("chunks"), (F.col("n_chunks") + F.size(ids)).alias("n_chunks"))


def settings_of(rows: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """Rows with the settings (columns besides ``key``) of their key; a row whose key has none, or is null, fails the job."""
    named = [c for c in settings.columns if c != key]
    joined = rows.join(settings.select(F.col(key).alias("_key"), F.struct(*named).alias("_s")), F.col(key) == F.col("_key"), "left")
    missing = F.raise_error(F.concat(F.lit("no settings for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    checked = joined.withColumn("_s", F.when(F.col("_key").isNotNull(), F.col("_s")).otherwise(missing))
    return checked.select(*rows.columns, *[F.col("_s")[c].alias(c) for c in named])


def unfinished(submitted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return submitted.join(done.select(key), key, "left_anti")


def cache_probe(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``wanted`` with hit: the cached row has the same key, time and settings, and holds something.

    Of several cached rows of one key the last by time counts, then the greatest settings and payload.
    """
    last = F.struct("mtime", "config", "payload")
    c = cache.groupBy(key).agg(F.max(last).alias("_c"))
    same = (F.col("_c.mtime") == F.col("mtime")) & (F.col("_c.config") == F.col("config")) & (F.coalesce("_c.payload", F.lit("")) != "")
    return wanted.join(c, key, "left").withColumn("hit", F.coalesce(same, F.lit(False))).drop("_c")


def invalid(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys whose cached row is of another time or other settings than what is wanted now, or holds nothing."""
    there = wanted.join(cache.select(key).distinct(), key, "left_semi")
    return cache_probe(there, cache, key).where("NOT hit").select(key).distinct()


def cache_valid(mtime: Column, cached_mtime: Column, cached_at: Column, now: Column, ttl: float = 300.0) -> Column:
    return (mtime <= cached_mtime) & (now - cached_at < ttl)


def reloads(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with whether the file grew newer since the row before."""
    before = F.lag("mtime").over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("reload", F.coalesce(F.col("mtime") > before, F.lit(True)))


def substitute_env(settings: DataFrame, env: DataFrame) -> DataFrame:
    """Settings whose whole value is ``${VAR}`` or ``${VAR:default}`` with the variable, the default or null for it."""
    pattern = r"^\$\{([^:}]+)(?::([^}]*))?\}$"
    name = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1))
    default = F.when(F.col("value").rlike(r"^\$\{[^:}]+:"), F.regexp_extract("value", pattern, 2))
    e = _environment(env)
    out = settings.withColumn("_v", name).join(e, F.col("_v") == F.col("_name"), "left")
    return out.withColumn("value", F.when(F.col("_v").isNull(), F.col("value")).otherwise(F.coalesce("_env", default))).drop("_v", "_name", "_env")


def _environment(env: DataFrame) -> DataFrame:
    """_name, _env: one row a variable, of several values the greatest; broadcast if it is small."""
    e = env.where("name IS NOT NULL").groupBy(F.col("name").alias("_name")).agg(F.max("value").alias("_env"))
    return F.broadcast(e) if _small(env) else e


def _small(frame: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has no more rows than may be broadcast."""
    return frame.limit(most + 1).count() <= most


#: Providers that settings may name.
PROVIDERS = ("openai", "gemini", "anthropic", "openai_compatible", "doubao")


def setting_violations(models: DataFrame) -> DataFrame:
    """id, rule of every broken rule of the model settings."""
    rules = {
        "provider missing": F.coalesce("provider", F.lit("")) == "",
        "provider unknown": ~F.coalesce("provider", F.lit("")).isin("", *PROVIDERS),
        "model missing": F.coalesce("model", F.lit("")) == "",
        "iterations not positive": ~F.coalesce(F.col("max_iterations") > 0, F.lit(False)),
        "threshold out of range": ~F.coalesce(F.col("quality_threshold").between(0, 10), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]), lambda x: x.isNotNull())
    return models.select("id", F.explode(broken).alias("rule"))


#: Fixed value: the turn that is added where the last one is not the user's.
CONTINUE = "请继续"


def messages_popped(turns: DataFrame) -> DataFrame:
    """First system text, history with the assistant as model, and the last turn as the prompt, of each conversation."""
    talk = F.col("role") != "system"
    system = F.min_by(F.when(~talk, F.col("text")), F.when(~talk, F.col("turn")))
    said = F.array_sort(F.collect_list(F.when(talk, F.struct("turn", F.when(F.col("role") == "assistant", F.lit("model")).otherwise(F.col("role")).alias("role"), "text"))))
    out = turns.groupBy("conv_id").agg(system.alias("system"), said.alias("said"))
    history = F.transform(F.slice("said", 1, F.greatest(F.size("said") - 1, F.lit(0))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return out.select("conv_id", F.coalesce("system", F.lit("")).alias("system"), F.array_join(history, "\n").alias("history"), F.coalesce(F.try_element_at("said", F.lit(-1))["text"], F.lit("")).alias("prompt"))


def messages_joined(turns: DataFrame) -> DataFrame:
    """All system texts joined, the talk in order, and a closing user turn where there is none."""
    talk = F.col("role").isin("user", "assistant")
    systems = F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text"))))
    said = F.array_sort(F.collect_list(F.when(talk, F.struct("turn", "role", "text"))))
    out = turns.groupBy("conv_id").agg(systems.alias("systems"), said.alias("said"))
    lines = F.transform("said", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    ends = F.coalesce(F.try_element_at("said", F.lit(-1))["role"] == "user", F.lit(False))
    closed = F.when(ends | (F.size("said") == 0), lines).otherwise(F.concat(lines, F.array(F.lit(f"user: {CONTINUE}"))))
    return out.select("conv_id", F.array_join(F.transform("systems", lambda x: x["text"]), "\n").alias("system"), F.array_join(closed, "\n").alias("messages"), F.size(closed).cast("long").alias("n_messages"))


def messages_plain(turns: DataFrame, temperature: Column, default: float = 0.7) -> DataFrame:
    """Turns as they are, with the default where no temperature is set."""
    return turns.withColumn("temperature", F.coalesce(temperature, F.lit(default)))


def translated(rules: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """``rules`` with their translation (of several the least), or the rule itself where none is known."""
    t = known.groupBy(F.col(col).alias("_rule")).agg(F.min("translation").alias("_t"))
    return rules.join(t, F.col(col) == F.col("_rule"), "left").withColumn("translation", F.coalesce("_t", F.col(col))).drop("_rule", "_t")


def progress_marks(items: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """key, done, total: at which numbers of items of each key another ``share`` of them is done, at least every one, and the last.

    Which items come when plays no part, so the keys are counted and nothing is numbered.
    """
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") * share)).cast("long")
    marks = F.array_distinct(F.concat(F.sequence(step, F.col("total"), step), F.array("total")))
    return counts.select(key, F.explode(marks).alias("done"), "total")
