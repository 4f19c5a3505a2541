"""Review: decisions on a note's entities, applied and spliced anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.functions.text import escape_html
from nubla.operators.substitute import splice


def apply_decisions(done: DataFrame, decisions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``done`` (key, text, entities) with each entity reviewed and ``processed`` made anew.

    decisions: (key, idx, action, value, notes) with idx from 0 by start; ``accept`` keeps the label, ``restore`` and
    ``delete`` put the original back, ``modify`` takes ``value``. Of several decisions on an entity the largest counts, as
    (action, value, notes) compare; entities without one stay as they are.
    """
    decisions = decisions.groupBy(key, "idx").agg(F.max(F.struct("action", "value", "notes")).alias("d")).select(key, "idx", "d.*")
    mine = decisions.groupBy(key).agg(F.collect_list(F.struct("idx", "action", "value", "notes")).alias("_decisions"))
    out = done.join(mine, key, "left")

    def reviewed(s, i):
        d = F.try_element_at(F.filter("_decisions", lambda x: x["idx"] == i), F.lit(1))
        label = F.when(d["action"].isin("restore", "delete"), s["text"]).when(d["action"] == "modify", F.coalesce(d["value"], s["transformed"])).otherwise(s["transformed"])
        return s.withField("transformed", label).withField("reviewed", d["action"].isNotNull()).withField("deleted", F.coalesce(d["action"] == "delete", F.lit(False))).withField("notes", d["notes"])

    out = out.withColumn("entities", F.transform("entities", reviewed)).drop("_decisions")
    return out.withColumn("processed", splice(F.col(text), F.col("entities")))


def progress(reviewed: F.Column, total: F.Column) -> F.Column:
    """Per cent, halves up."""
    return F.when(total > 0, F.floor(100 * reviewed / total + 0.5)).otherwise(F.lit(0)).cast("long")


def reviewed_documents(done: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``done`` with ``reviewed``: whether its ``key`` is in ``seen``, the documents that a reviewer left or exported."""
    mark = seen.select(key).distinct().withColumn("reviewed", F.lit(True))
    return done.join(mark, key, "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def highlighted(done: DataFrame, text: str = "text") -> DataFrame:
    """``done`` with ``html``: the text, escaped, with each entity marked."""
    at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("entities", F.greatest(i, F.lit(1)))["end"])

    def piece(s, i):
        gap = escape_html(F.substring(F.col(text), at(i) + 1, s["start"] - at(i)))
        return F.concat(gap, F.lit('<mark data-type="'), s["type"], F.lit('">'), escape_html(s["text"]), F.lit("</mark>"))

    rest = escape_html(F.substring(F.col(text), at(F.size("entities")) + 1, F.length(text)))
    return done.withColumn("html", F.concat(F.array_join(F.transform("entities", piece), ""), rest))
