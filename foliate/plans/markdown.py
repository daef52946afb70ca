"""Plans in Markdown (sections with tables of units by phases) parsed into relational tables.

Input: plan_id and md. Every list keeps its order in an index column. Parsing is per row, with
Spark's own array functions: one plan is one row until its tables are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.text import action_cell, decision_options, is_separator, list_cell, missing_as_null, row_cells, strip

#: Words that name a section, in either language.
SECTIONS = {
    "overview": ("方案概述", "概述", "overview"),
    "matrix": ("coa矩阵", "coa matrix", "矩阵"),
    "effects": ("效果链", "effects"),
    "decisions": ("决策点", "decision"),
    "risks": ("风险", "risk"),
}
TITLE = r"#\s+COA方案[：:]\s*(.+)"
DEFAULT_TITLE = "Generated COA"
#: Least characters of a plan that is accepted.
LEAST = 50


def accepted(md: Column) -> Column:
    return F.length(strip(md)) >= LEAST


def sections(plans: DataFrame) -> DataFrame:
    """plan_id, ord, title, body: what stands before the first heading is ``header``; a later section of the same title overwrites the body."""
    marked = F.split(F.concat(F.lit("\n"), F.col("md")), r"\n##[ \t]+(?=[^\n])")
    each = plans.select("plan_id", F.posexplode(marked).alias("ord", "part"))
    cut = F.split("part", "\n", 2)
    title = F.when(F.col("ord") == 0, F.lit("header")).otherwise(strip(cut[0]))
    body = F.when(F.col("ord") == 0, strip(F.col("part"))).otherwise(strip(F.coalesce(F.get(cut, F.lit(1)), F.lit(""))))
    kept = each.select("plan_id", "ord", title.alias("title"), body.alias("body"), ((F.col("ord") == 0) | (F.size(cut) > 1)).alias("keep")).where("keep")
    return kept.groupBy("plan_id", "title").agg(F.min("ord").alias("ord"), F.max_by("body", "ord").alias("body")).select("plan_id", "ord", "title", "body")


def find_section(parts: DataFrame, *keywords: str) -> DataFrame:
    """plan_id, body of the first section whose title holds a keyword."""
    named = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("title"), F.lower(k)))
    return parts.where(named).groupBy("plan_id").agg(F.min_by("body", "ord").alias("body"))


def titles(plans: DataFrame) -> DataFrame:
    """plan_id, name: the title in what stands before the first section, or the default."""
    header = F.element_at(F.split("md", r"\n##[ \t]"), 1)
    return plans.select("plan_id", F.coalesce(F.nullif(strip(F.regexp_extract(header, TITLE, 1)), F.lit("")), F.lit(DEFAULT_TITLE)).alias("name"))


def table_rows(bodies: DataFrame) -> DataFrame:
    """plan_id, row_idx, cells: header as row 0, then the rows that are no separators; tables of fewer than three lines are empty."""
    lines = F.filter(F.transform(F.split("body", "\n"), strip), lambda x: F.contains(x, F.lit("|")))
    rows = bodies.select("plan_id", lines.alias("lines")).where(F.size("lines") >= 3)
    cells = rows.select("plan_id", F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), row_cells(x).alias("cells"))), lambda r: (r["i"] == 0) | ~is_separator(r["cells"])).alias("rows"))
    return cells.select("plan_id", F.posexplode("rows").alias("row_idx", "r")).select("plan_id", "row_idx", F.col("r.cells").alias("cells"))


def _lines(x: Column) -> Column:
    return F.regexp_replace(x, "<(?:br|BR)>", "\n")


# Fixed values of the format: a header cell is the word, a number, a colon and a name, then notes between marks; a note with an
# arrow or a time (H+0) is the trigger, another that is no English name the objective. A unit cell is a name with a code in brackets, then a role between *( and )*.
PHASE, TIME, ARROWS, ENGLISH = "阶段", r"H[+-]", ("→", "->"), r"^[A-Za-z\s&/]+$"
OPEN, CLOSE, EITHER = ("(", "（"), (")", "）"), "*"


def _noted(cell: Column) -> Column:
    """What stands between marks, in order: a bracket opens, a bracket closes, a star does what is due; text outside is passed over."""
    tokens = F.regexp_extract_all(cell, F.lit(r"[*()（）]|[^*()（）]+"), F.lit(0))
    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("text"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        ends = s["open"] & (s["text"] != "") & t.isin(*CLOSE, EITHER)
        opens = ~ends & t.isin(*OPEN, EITHER)
        mark = t.isin(*OPEN, *CLOSE, EITHER)
        open_ = F.when(ends, False).when(opens, True).otherwise(s["open"] & ~(mark & ~opens))
        text = F.when(mark, F.lit("")).when(s["open"], t).otherwise(F.lit(""))
        found = F.when(ends, F.concat(s["found"], F.array(strip(s["text"])))).otherwise(s["found"])
        return F.struct(open_.alias("open"), text.alias("text"), found.alias("found"))

    return F.aggregate(tokens, start, step, lambda s: s["found"])


def phases(rows: DataFrame) -> DataFrame:
    """plan_id, phase_id, ord, name, trigger, objective of the matrix header: the last trigger and the first objective count."""
    cells = rows.where("row_idx = 0").select("plan_id", F.posexplode(F.slice("cells", 2, 1 << 20)).alias("ord", "cell"))
    cells = cells.withColumn("cell", _lines(F.col("cell")))
    behind = F.split(F.get(F.split("cell", PHASE, 2), F.lit(1)), "[:：]", 2)
    numbered = strip(behind[0]).rlike(r"^\d+$")
    name = F.when(numbered, strip(F.get(F.split(F.ltrim(F.get(behind, F.lit(1))), r"[(*\n]", 2), F.lit(0))))
    first_line = strip(F.get(F.split("cell", "\n", 2), F.lit(0)))
    is_trigger = lambda x: F.exists(F.array(*map(F.lit, ARROWS)), lambda a: F.contains(x, a)) | x.rlike(TIME)
    triggers = F.filter("notes", is_trigger)
    goals = F.filter("notes", lambda x: (x != "") & ~is_trigger(x) & ~x.rlike(ENGLISH))
    out = cells.select("plan_id", "ord", F.coalesce(F.nullif(name, F.lit("")), first_line).alias("name"), _noted(F.col("cell")).alias("notes"))
    return out.select("plan_id", F.concat(F.lit("Phase_"), (F.col("ord") + 1).cast("string")).alias("phase_id"), "ord", "name", F.coalesce(F.try_element_at(triggers, F.lit(-1)), F.lit("")).alias("trigger"), F.coalesce(F.get(goals, F.lit(0)), F.lit("")).alias("objective"))


def units(rows: DataFrame) -> DataFrame:
    """plan_id, row_idx, unit_id, ord, name, role of the matrix rows; blank unit cells are skipped and not counted."""
    kept = rows.where("row_idx > 0").select("plan_id", "row_idx", strip(_lines(F.element_at("cells", 1))).alias("cell")).where("cell <> ''")
    line = strip(F.get(F.split("cell", "\n", 2), F.lit(0)))
    name = F.when(F.endswith(line, F.lit(")*")) & F.contains(line, F.lit("*(")), strip(F.substring_index(line, "*(", 1))).otherwise(line)
    starred = F.get(F.split("cell", r"\*\(", 2), F.lit(1))
    role = F.when(F.contains(starred, F.lit(")*")), strip(F.substring_index(starred, ")*", 1)))
    bracketed = F.transform(F.slice(F.split(F.translate("name", "（）", "()"), r"\("), 2, 1 << 20), lambda x: F.when(F.contains(x, F.lit(")")), strip(F.substring_index(x, ")", 1))))
    code = F.translate(F.get(F.filter(bracketed, lambda x: x.rlike(r"^[A-Za-z0-9/-]+$")), F.lit(0)), "/-", "__")
    ord_ = F.row_number().over(Window.partitionBy("plan_id").orderBy("row_idx"))
    out = kept.select("plan_id", "row_idx", ord_.alias("n"), name.alias("name"), F.coalesce(role, F.lit("")).alias("role"))
    return out.select("plan_id", "row_idx", F.coalesce(code, F.concat(F.lit("Unit_"), F.col("n").cast("string"))).alias("unit_id"), (F.col("n") - 1).alias("ord"), "name", "role")


def cells(rows: DataFrame) -> DataFrame:
    """plan_id, unit_id, phase_id, unit_ord, phase_ord, actions: a cell for each unit and phase; missing cells have no actions."""
    header = phases(rows).select("plan_id", "phase_id", F.col("ord").alias("phase_ord"))
    body = rows.join(units(rows).select("plan_id", "row_idx", "unit_id", F.col("ord").alias("unit_ord")), ["plan_id", "row_idx"])
    text = F.coalesce(F.get("cells", F.col("phase_ord") + 1), F.lit(""))
    return body.join(header, "plan_id").select("plan_id", "unit_id", "phase_id", "unit_ord", "phase_ord", action_cell(_lines(text)).alias("actions"))


def _holder(key: str):
    """Whether a header holds the key, in any case of letters."""
    return lambda h: F.contains(F.lower(h), F.lit(key.lower()))


def records(bodies: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """plan_id, row_idx and a column for each name, found by the first header that equals or holds one of its keywords; of repeated headers the last counts; placeholders are null."""
    rows = table_rows(bodies)
    header = rows.where("row_idx = 0").select("plan_id", F.col("cells").alias("header"))
    last = F.transform("header", lambda h: F.coalesce(F.get("cells", (F.size("header") - F.array_position(F.reverse("header"), h)).cast("int")), F.lit("")))
    data = rows.where("row_idx > 0").join(header, "plan_id").withColumn("cells", last)

    def value(keys: tuple[str, ...]) -> Column:
        tries = []
        for key in keys:
            holds = F.transform("header", _holder(key))
            for at in (F.array_position("header", key), F.array_position(holds, F.lit(True))):
                tries.append(missing_as_null(F.when(at > 0, F.coalesce(F.get("cells", (at - 1).cast("int")), F.lit("")))))
        return F.coalesce(*tries)

    return data.select("plan_id", "row_idx", *[value(keys).alias(name) for name, keys in columns.items()])


def effects(parts: DataFrame) -> DataFrame:
    found = records(find_section(parts, *SECTIONS["effects"]), {"effect_id": ("效果ID", "effect_id", "id"), "description": ("描述", "description"), "measures": ("度量", "measures", "measure"), "achieved_by": ("实现单元", "achieved_by", "units")})
    return found.where("effect_id IS NOT NULL").select("plan_id", "row_idx", "effect_id", F.coalesce("description", F.lit("")).alias("description"), list_cell(F.coalesce("measures", F.lit(""))).alias("measures"), list_cell(F.coalesce("achieved_by", F.lit(""))).alias("achieved_by"))


def decisions(parts: DataFrame) -> DataFrame:
    found = records(find_section(parts, *SECTIONS["decisions"]), {"dp_id": ("决策点ID", "dp_id", "id"), "phase_id": ("阶段", "phase"), "condition": ("条件", "condition"), "options": ("选项", "options")})
    return found.where("dp_id IS NOT NULL").select("plan_id", "row_idx", "dp_id", F.coalesce("phase_id", F.lit("")).alias("phase_id"), F.coalesce("condition", F.lit("")).alias("condition"), decision_options(F.coalesce("options", F.lit(""))).alias("options"))


def risks(parts: DataFrame) -> DataFrame:
    found = records(find_section(parts, *SECTIONS["risks"]), {"category": ("类别", "category"), "description": ("描述", "description"), "mitigation": ("缓解", "mitigation")})
    return found.where("description IS NOT NULL").select("plan_id", "row_idx", F.coalesce("category", F.lit("GENERAL")).alias("category"), "description", F.coalesce("mitigation", F.lit("")).alias("mitigation"))


def rejected(plans: DataFrame) -> DataFrame:
    """Plans that are null or too short to be one."""
    return plans.where(~F.coalesce(accepted(F.col("md")), F.lit(False)))


def _listed(child: DataFrame, name: str, order: str) -> DataFrame:
    fields = [c for c in child.columns if c not in ("plan_id", order)]
    return child.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def assemble(plans: DataFrame) -> DataFrame:
    """A row for each accepted plan: plan_id, name, overview and its units, phases, cells, effects, decisions and risks in order.

    A part that a plan lacks is empty. Rejected plans have no row (see ``rejected``).
    """
    plans = plans.where(accepted(F.col("md")))
    parts = sections(plans)
    rows = table_rows(find_section(parts, *SECTIONS["matrix"]))
    grid = cells(rows).select("plan_id", F.struct("unit_ord", "phase_ord").alias("ord"), "unit_id", "phase_id", "actions")
    children = {
        "units": (units(rows).drop("row_idx"), "ord"), "phases": (phases(rows), "ord"), "cells": (grid, "ord"),
        "effects": (effects(parts), "row_idx"), "decisions": (decisions(parts), "row_idx"), "risks": (risks(parts), "row_idx"),
    }
    out = titles(plans).join(find_section(parts, *SECTIONS["overview"]).withColumnRenamed("body", "overview"), "plan_id", "left").withColumn("overview", F.coalesce("overview", F.lit("")))
    for name, (child, order) in children.items():
        listed = _listed(child, name, order)
        out = out.join(listed, "plan_id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out
