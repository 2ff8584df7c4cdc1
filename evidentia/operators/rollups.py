"""Dashboard rollups, lists and details. Children are counted before they are joined: no fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions.text import occurrences
from evidentia.session import shared_checkpoints

#: Fixed values, in order: themes and the strings that count for them.
THEMES = {
    "parking": ("parking", "garage", "vehicle", "traffic"),
    "delay": ("continued", "continuance", "delay", "postpone"),
    "housing": ("housing", "dwelling", "residential", "unit", "units"),
    "ceqa": ("ceqa", "environmental", "shadow"),
    "transit": ("transit", "muni", "bus", "rail", "station"),
    "opposition": ("opposition", "concern", "objection", "neighbor", "comment"),
}


def with_counts(parent: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Adds, for each child (frame, its key to the parent), the number of its rows; 0 where there are none."""
    for name, (child, foreign) in children.items():
        counts = child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        parent = parent.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return parent


def summary(spark: SparkSession, **counted: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame."""
    one = None
    for name, df in counted.items():
        n = df.agg(F.count("*").alias(name)).withColumn("__one", F.lit(1))
        one = n if one is None else one.join(n, "__one")
    return spark.range(1).select() if one is None else one.drop("__one")


def dashboard_summary(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    staff = t["document_links"].join(t["source_documents"].where(F.col("source_type") == "staff_report").select("document_id"), "document_id")
    return summary(
        spark, hearings_indexed=t["hearings"], pdfs_downloaded=t["source_documents"].where(F.col("local_path").isNotNull()), pages_parsed=t["pages"],
        agenda_items_extracted=t["agenda_items"], staff_reports_linked=staff, chunks_indexed=t["chunks"], embeddings_indexed=t["chunk_embeddings"],
    )


def recent_activity(hearings: DataFrame, documents: DataFrame, pages: DataFrame, items: DataFrame, limit: int = 8) -> DataFrame:
    placed = pages.join(documents.select("document_id", "hearing_id"), "document_id")
    latest = hearings.orderBy(F.col("hearing_date").desc_nulls_last(), "hearing_id").limit(at_least_one(limit))
    counted = with_counts(latest, "hearing_id", document_count=(documents, "hearing_id"), page_count=(placed, "hearing_id"), agenda_item_count=(items, "hearing_id"))
    return counted.select("hearing_id", "hearing_date", "title", "status", "document_count", "page_count", "agenda_item_count").orderBy(F.col("hearing_date").desc_nulls_last(), "hearing_id")


def hearing_list(hearings: DataFrame, documents: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    latest = hearings.orderBy(F.col("hearing_date").desc_nulls_last(), "hearing_id").limit(at_least_one(limit))
    return with_counts(latest, "hearing_id", document_count=(documents, "hearing_id"), agenda_item_count=(items, "hearing_id")).orderBy(F.col("hearing_date").desc_nulls_last(), "hearing_id")


def hearing_detail(hearings: DataFrame, documents: DataFrame, items: DataFrame, hearing_id: str) -> DataFrame:
    """The hearing with its documents and agenda items as ordered arrays; no row if it is unknown."""
    own = F.col("hearing_id") == hearing_id
    docs = ordered_list(documents.where(own), "hearing_id", "documents", F.col("source_type"), F.col("title").isNull(), F.col("title"), F.col("document_id"))
    listed = ordered_list(items.where(own), "hearing_id", "agenda_items", natural_key(F.col("item_number")).isNull(), natural_key(F.col("item_number")), F.col("item_number"))
    return hearings.where(own).join(docs, "hearing_id", "left").join(listed, "hearing_id", "left")


def ordered_list(df: DataFrame, key: str, name: str, *order: Column) -> DataFrame:
    """(key, name): rows as an array of structs in the given order."""
    ranked = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))))
    return df.groupBy(key).agg(F.transform(ranked, lambda x: x["row"]).alias(name))


def hearing_items(items: DataFrame, hearing_id: str) -> DataFrame:
    """A hearing's agenda items as the service lists them, in natural order of their numbers."""
    return items.where(F.col("hearing_id") == hearing_id).drop("case_suffix", "continued_from", "proposed_continuance_date").orderBy(*natural_order("item_number"), "agenda_item_id")


def as_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object with all its fields, null ones too, dates and times by ISO 8601."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("json"))


def item_detail(items: DataFrame, agenda_item_id: str) -> DataFrame:
    """The item's columns that the service shows."""
    return items.where(F.col("agenda_item_id") == agenda_item_id).drop("case_suffix", "continued_from", "proposed_continuance_date")


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).limit(1).isEmpty()


def natural_key(text: Column) -> Column:
    """The number that the text begins with, or null."""
    return F.regexp_extract(text, "^[0-9]+", 0).try_cast("int")


def natural_order(column: str) -> list[Column]:
    return [natural_key(F.col(column)).asc_nulls_last(), F.col(column).asc_nulls_last()]


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's place in ``order``, from 1, which must leave no ties: rows are dealt out by ranges
    of the order, numbered within their range, and moved up by the rows of the ranges before it."""
    shared_checkpoints(df.sparkSession)
    # ranges are drawn from a sample: they are kept, so that all that follows sees the same ones
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    # one row for each range
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)).cast("bigint")
    return dealt.withColumn(name, place).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def counts_by(df: DataFrame, name: Column, alias: str, count: str) -> DataFrame:
    """Rows by value, most first, ties by value."""
    return df.groupBy(name.alias(alias)).agg(F.count("*").alias(count)).orderBy(F.col(count).desc(), F.col(alias))


def document_types(documents: DataFrame) -> DataFrame:
    return counts_by(documents, F.col("source_type"), "source_type", "count")


def extraction_health(pages: DataFrame) -> DataFrame:
    return counts_by(pages, F.coalesce("extraction_quality", F.lit("unknown")), "extraction_quality", "page_count")


def theme_mentions(df: DataFrame, text_col: str = "text", themes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(theme, mention_count): occurrences of each theme's strings in all texts; one aggregate row is unpivoted."""
    known = THEMES if themes is None else themes
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counts = df.select(lower.alias("t")).agg(*[F.coalesce(F.sum(sum((occurrences(F.col("t"), w) for w in words), F.lit(0))), F.lit(0)).cast("bigint").alias(name) for name, words in known.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("theme"), F.col(n).alias("mention_count")) for i, n in enumerate(known)])).alias("r")).select("r.*")
    return rows.orderBy(F.col("mention_count").desc(), "at").select("theme", "mention_count")


def at_least_one(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit
