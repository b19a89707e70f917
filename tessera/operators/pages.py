"""From extracted blocks to a corpus of cited pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import tidy, unescape, word_count
from tessera.session import materialized


def _intervals(df: DataFrame, starts: list[tuple[int, str]], name: str) -> DataFrame:
    """(lo, hi, name): each start holds up to the next one. The tables have a fixed size, so broadcasting them is safe."""
    rows = df.sparkSession.createDataFrame(starts, f"lo int, {name} string")
    return F.broadcast(rows.withColumn("hi", F.lead("lo", 1, 1 << 30).over(Window.orderBy("lo"))))


def as_of(df: DataFrame, starts: list[tuple[int, str]], name: str, start: str | None = None, page: str = "page") -> DataFrame:
    """df with the last entry that starts at or before its page, null if there is none."""
    t = _intervals(df, starts, name)
    out = df.join(t, (F.col(page) >= t["lo"]) & (F.col(page) < t["hi"]), "left").drop("hi")
    return out.withColumnRenamed("lo", start) if start else out.drop("lo")


def as_of_keyed(rows: DataFrame, entries: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """rows with entry: the struct of the last of `entries` of the same key that starts at or before the row, null if there is none.

    For entries that are too many to broadcast. Both sides are put together and range-partitioned by key and place, so that a key with
    many rows or entries is spread; the last start is carried forward within a range, and from range to range by one row each. Of
    entries with equal start the greatest counts; null keys and places have no entry.
    """
    told = F.struct(F.col(start), *(F.col(c) for c in entries.columns if c not in (key, start)))
    own = rows.select(F.col(key).alias("tessera_key"), F.col(at).cast("double").alias("tessera_at"), F.lit(1).alias("tessera_side"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("tessera_row"), F.lit(None).alias("tessera_entry"))
    other = entries.filter(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        F.col(key).alias("tessera_key"), F.col(start).cast("double").alias("tessera_at"), F.lit(0).alias("tessera_side"), F.lit(None).alias("tessera_row"), told.alias("tessera_entry")
    )
    order = [F.col("tessera_at").asc_nulls_first(), "tessera_side", "tessera_entry"]
    both = materialized(own.unionByName(other).repartitionByRange("tessera_key", "tessera_at", "tessera_side").withColumn("tessera_range", F.spark_partition_id()), "as_of")
    here = F.last("tessera_entry", ignorenulls=True).over(Window.partitionBy("tessera_key", "tessera_range").orderBy(*order))
    ends = both.groupBy("tessera_key", "tessera_range").agg(F.max(F.when(F.col("tessera_entry").isNotNull(), F.struct("tessera_at", "tessera_entry"))).alias("end"))
    before = Window.partitionBy("tessera_key").orderBy("tessera_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("tessera_key", "tessera_range", F.last("end.tessera_entry", ignorenulls=True).over(before).alias("tessera_carried"))
    found = both.select("tessera_key", "tessera_range", "tessera_side", "tessera_at", "tessera_row", here.alias("tessera_here"))
    joined = found.filter("tessera_side = 1").join(carried, ["tessera_key", "tessera_range"], "left")
    entry = F.when(F.col("tessera_at").isNotNull(), F.coalesce("tessera_here", "tessera_carried"))
    return joined.select("tessera_row.*", entry.alias("entry"))


def allowed(df: DataFrame, page: str = "page") -> DataFrame:
    keep = F.lit(False)
    for lo, hi in config.ALLOWED_PAGES:
        keep = keep | ((F.col(page) >= lo) & (F.col(page) < hi))
    return df.filter(keep)


def long_enough(df: DataFrame, least: int = config.DEFAULT.min_words, text: str = "text") -> DataFrame:
    return df.filter(word_count(F.col(text)) >= least)


def overridden(df: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """Curated texts take the place of extracted ones; `curated` tells where."""
    rows = df.sparkSession.createDataFrame(config.OVERRIDES, "_page int, _text string")
    out = df.join(F.broadcast(rows), F.col(page) == F.col("_page"), "left")
    return out.withColumn(text, F.coalesce("_text", text)).withColumn("curated", F.col("_page").isNotNull()).drop("_page", "_text")


def located(df: DataFrame, page: str = "page") -> DataFrame:
    """Section, activity, tool and stage of a page: activity and tool only on activity pages, a tool only inside its activity."""
    out = as_of(df, config.SECTIONS, "seccion", page=page)
    out = as_of(out, config.ACTIVITIES, "_act", "_act_at", page)
    out = as_of(out, config.TOOLS, "_tool", "_tool_at", page)
    lo, hi = config.ACTIVITY_PAGES
    inside = (F.col(page) >= lo) & (F.col(page) < hi)
    out = out.withColumn("actividad", F.when(inside, F.coalesce("_act", F.lit(""))).otherwise(""))
    out = out.withColumn("herramienta", F.when(inside & (F.col("_tool_at") >= F.col("_act_at")), F.col("_tool")).otherwise(""))
    return with_stage(out.drop("_act", "_act_at", "_tool", "_tool_at"))


def with_stage(df: DataFrame, activity: str = "actividad") -> DataFrame:
    """Stage number of an activity, null if it has none; of several, the smallest."""
    rows = df.sparkSession.createDataFrame(config.STAGES, "etapa int, _name string").groupBy("_name").agg(F.min("etapa").alias("etapa"))
    return df.join(F.broadcast(rows), F.col(activity) == F.col("_name"), "left").drop("_name")


def label(page: str = "page") -> Column:
    """`A › B, p. N`: the section only where there is no activity."""
    parts = F.concat_ws(
        " › ",
        F.when(F.col("actividad") == "", F.col("seccion")),
        F.when(F.col("actividad") != "", F.col("actividad")),
        F.when(F.col("herramienta") != "", F.col("herramienta")),
    )
    return F.concat(parts, F.lit(", p. "), F.col(page).cast("string"))


def blocks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, text) of texts: lines are blocks; every fifth is a picture's text, every seventh a footer."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.when(F.col("pos") % 7 == 6, "footer").when(F.col("pos") % 5 == 2, "picture").otherwise("text")
    return lines.select("doc_id", "pos", kind.alias("kind"), "text")


def figure_parts(blocks: DataFrame) -> DataFrame:
    """The child texts of pictures, in reading order."""
    pictures = blocks.filter("kind = 'picture'")
    return pictures.select("doc_id", F.col("pos").alias("fig_id"), F.posexplode(F.split("text", ", ")).alias("part", "text"))


def figure_texts(parts: DataFrame) -> DataFrame:
    """One text per picture: non-blank parts in order, single blanks, marked; empty below three words."""
    listed = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("part", "text"))))
    whole = F.trim(F.regexp_replace(F.array_join(F.transform(listed, lambda x: x["text"]), " "), r"\s+", " "))
    out = parts.groupBy("doc_id", "fig_id").agg(whole.alias("_text"))
    return out.select("doc_id", "fig_id", F.when(word_count(F.col("_text")) >= 3, F.concat(F.lit("[Figura] "), "_text")).otherwise("").alias("text"))


def assembled(blocks: DataFrame, figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, quarantine): text and figures in order, footers dropped, cleaned; pages whose pictures and figures differ in number apart."""
    figure = figures.select("doc_id", F.col("fig_id").alias("pos"), F.col("text").alias("_figure"))
    rows = blocks.filter("kind != 'footer'").join(figure, ["doc_id", "pos"], "left")
    body = F.when(F.col("kind") == "picture", F.col("_figure")).otherwise(F.col("text"))
    pages = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", body.alias("body")))).alias("parts"),
        F.count_if(F.col("kind") == "picture").alias("pictures"),
        F.count("_figure").alias("figures"),
    )
    pages = pages.withColumn("text", tidy(unescape(F.array_join(F.transform("parts", lambda x: x["body"]), "\n\n")))).drop("parts")
    return pages.filter("pictures = figures"), pages.filter("pictures != figures")


def pages_of(docs: DataFrame) -> DataFrame:
    """Documents as pages of the guide."""
    return docs.select("doc_id", (F.col("doc_id") % 168 + 1).cast("int").alias("page"), "text")


def build_pages(pages: DataFrame, settings: config.Settings = config.DEFAULT) -> DataFrame:
    """The page corpus of (doc_id, page, text)."""
    rows = located(long_enough(overridden(allowed(pages)), settings.min_words))
    return rows.select(
        F.format_string("guia-p%03d", "page").alias("id"), "doc_id", "text", label().alias("fuente"), F.col("page").alias("pagina_inicio"),
        F.col("page").alias("pagina_fin"), "seccion", "actividad", "herramienta", "etapa", F.lit(settings.corpus_version).alias("version_corpus"),
    )
