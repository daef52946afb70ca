"""The plan matrix: flat and pivoted forms, slices, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.operators.running import running


def flat(units: DataFrame, phases: DataFrame, cells: DataFrame) -> DataFrame:
    """plan_id, unit_id, phase_id, actions for every unit and phase of a plan; of repeated cells the first wins, missing ones are empty."""
    first = cells.groupBy("plan_id", "unit_id", "phase_id").agg(F.min_by("actions", "ord").alias("actions"))
    grid = units.select("plan_id", "unit_id").distinct().join(phases.select("plan_id", "phase_id").distinct(), "plan_id")
    return grid.join(first, ["plan_id", "unit_id", "phase_id"], "left").withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))


def slices(cells: DataFrame, by: str, other: str) -> DataFrame:
    """plan_id, ``by`` and a map from ``other`` to actions; of repeated cells the last wins."""
    last = cells.groupBy("plan_id", by, other).agg(F.max_by("actions", "ord").alias("actions"))
    return last.groupBy("plan_id", by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(other, "actions")))).alias("actions"))


def pivot(cells: DataFrame, phases: list[str] | None = None) -> DataFrame:
    """One row a unit with a column a phase (all there are, if none are named), the actions joined."""
    return cells.groupBy("plan_id", "unit_id").pivot("phase_id", phases).agg(F.first(F.array_join("actions", "; ")))


def metrics(plans: DataFrame, **children: DataFrame) -> DataFrame:
    """plan_id and the number of rows of each child table, zero where there is none."""
    out = plans.select("plan_id")
    for name, child in children.items():
        out = out.join(child.groupBy("plan_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "plan_id", "left")
    return out.fillna(0, [f"n_{name}" for name in children])


def condensed(cells: DataFrame) -> DataFrame:
    """plan_id, phase_id, units: what each unit with any action does in a phase, in order."""
    done = cells.where(F.size("actions") > 0)
    each = F.array_sort(F.collect_list(F.struct("unit_ord", F.concat(F.col("unit_id"), F.lit(": "), F.array_join("actions", "; ")).alias("s"))))
    return done.groupBy("plan_id", "phase_id").agg(F.array_join(F.transform(each, lambda x: x["s"]), "\n").alias("units"))


def risk_summary(risks: DataFrame) -> DataFrame:
    """plan_id, category, n, total."""
    counts = risks.groupBy("plan_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("GENERAL")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("plan_id")))


def event_tasks(tasks: DataFrame) -> DataFrame:
    """entity, event, task_id: the tasks of a unit at each of its events (start, end, place), GENERAL for tasks without any.

    A row a task: the list of one unit and event may be as long as the table, so it is never gathered into one row.
    """
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    place = F.when(given("location").isNotNull(), F.concat(F.lit("at_"), F.col("location")))
    events = F.array_distinct(F.filter(F.array(given("start_condition"), given("end_condition"), place), lambda x: x.isNotNull()))
    each = tasks.withColumn("event", F.explode(F.when(F.size(events) > 0, events).otherwise(F.array(F.lit("GENERAL")))))
    return each.select(F.col("unit").alias("entity"), "event", "task_id")


def event_matrix(tasks: DataFrame) -> DataFrame:
    """entity, event and the number, first and last of the tasks there."""
    return event_tasks(tasks).groupBy("entity", "event").agg(F.count(F.lit(1)).alias("n_tasks"), F.min("task_id").alias("first_task"), F.max("task_id").alias("last_task"))


def entities_and_events(tasks: DataFrame) -> DataFrame:
    """kind, name: distinct units, and distinct conditions, START and END where a plan has none."""
    units = tasks.select(F.lit("entity").alias("kind"), F.col("unit").alias("name")).distinct()
    events = tasks.select(F.explode(F.array("start_condition", "end_condition")).alias("name")).where("name <> ''").distinct().select(F.lit("event").alias("kind"), "name")
    none = F.array_except(F.array(F.lit("START"), F.lit("END")), F.array().cast("array<string>"))
    default = tasks.agg(F.count_if((F.coalesce("start_condition", F.lit("")) != "") | (F.coalesce("end_condition", F.lit("")) != "")).alias("n")).where("n = 0").select(F.lit("event").alias("kind"), F.explode(none).alias("name"))
    return units.unionByName(events).unionByName(default)


#: Numbers that one row of a join gives at a time.
STRETCH = 100_000


def repaired_ids(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """Repeated ids with the first free suffix _1, _2, … in order.

    A suffixed id that is taken by a row of that very name is skipped: free numbers come from the
    numbers that other ids of the same stem use, by an anti join on (stem, number). Ids that many rows share are numbered by many tasks (``running``).
    """
    numbered = running(rows, [id_col], [order], "_n").withColumn("_n", F.col("_n") - 1)
    first, again = numbered.where("_n = 0"), numbered.where("_n > 0")
    counts = again.groupBy(id_col).agg(F.max("_n").alias("_most"))
    taken = rows.select(F.regexp_extract(id_col, r"^(.*)_(\d+)$", 1).alias("_stem"), F.expr(f"try_cast(regexp_extract({id_col}, '^(.*)_([0-9]+)$', 2) AS int)").alias("_k")).where("_stem <> '' AND _k IS NOT NULL").distinct()
    used = taken.groupBy("_stem").agg(F.count(F.lit(1)).alias("_used"))
    room = counts.join(used, F.col(id_col) == F.col("_stem"), "left").select(F.col(id_col).alias("_id"), (F.col("_most") + F.coalesce("_used", F.lit(0))).cast("long").alias("_upto"))
    # Numbers of one id come from many tasks as well: first where each stretch begins, then its numbers.
    starts = room.select("_id", "_upto", F.explode(F.sequence(F.lit(1).cast("long"), "_upto", F.lit(STRETCH).cast("long"))).alias("_from")).repartition("_id", "_from")
    room = starts.select("_id", F.explode(F.sequence("_from", F.least(F.col("_from") + STRETCH - 1, "_upto"))).alias("_k"))
    free = room.join(taken, (F.col("_id") == F.col("_stem")) & (room["_k"] == taken["_k"]), "left_anti")
    free = running(free, ["_id"], ["_k"], "_m").select("_id", "_m", "_k")
    fixed = again.join(free, (F.col(id_col) == F.col("_id")) & (F.col("_n") == F.col("_m"))).withColumn("new_id", F.concat(F.col(id_col), F.lit("_"), F.col("_k").cast("string")))
    return first.withColumn("new_id", F.col(id_col)).drop("_n").unionByName(fixed.drop("_n", "_id", "_m", "_k"))


def valid(n_units: Column, n_phases: Column, description: Column) -> Column:
    return (n_units > 0) & (n_phases > 0) & (F.coalesce(description, F.lit("")) != "")
