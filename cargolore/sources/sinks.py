"""Writers of results, errors, datasets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_COLUMNS = ("row_index", "external_ref", "commodity_text", "cargo_text", "origin_iso", "destination_iso", "error")


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """K1: Parquet; a row without a version stamp fails the write."""
    stamped = F.coalesce(F.length(F.col("versions").cast("string")) > 0, F.lit(False)) if "versions" in results.columns else F.lit(False)
    checked = results.withColumn("__ok", F.when(stamped, F.lit(True)).otherwise(F.raise_error(F.lit("a result has no version stamp")).cast("boolean")))
    checked.where("__ok").drop("__ok").write.mode(mode).parquet(path)


def write_errors(rows: DataFrame, path: str) -> None:
    """K2: the rows with an ``error`` as CSV with fixed columns."""
    rows.where("error IS NOT NULL").select(*ERROR_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_ranking(rows: DataFrame, path: str) -> None:
    """K3: one CSV row a query and candidate."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """K4: JSON lines in one folder a split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Reports, pending gold rows and adversarial sets as JSON lines."""
    rows.write.mode("overwrite").json(path)


def feedback_to_gold(feedback: DataFrame, results: DataFrame, shipments: DataFrame) -> DataFrame:
    """Overridden results as pending gold rows.  A result's equal corrections are
    made one before the joins, so a line of a shipment meets each once."""
    own = feedback.where("kind = 'override' AND corrected_code IS NOT NULL").select("result_id", F.col("corrected_code").alias("hs_code")).distinct()
    asked = own.join(results.select("result_id", "query_id").distinct(), "result_id").select("query_id", "hs_code").distinct()
    return asked.join(shipments.select("query_id", "text"), "query_id").select(F.col("text").alias("description"), "hs_code").distinct()


def adversarial_set(goods: DataFrame, rulings: DataFrame) -> DataFrame:
    """Controlled descriptions as positives; as negatives, rulings with
    a code of theirs and another text."""
    positive = goods.where("sys_to IS NULL").select("description", F.explode("hs_codes").alias("hs_code"))
    near = rulings.join(positive.select("hs_code").distinct(), "hs_code", "left_semi")
    negative = near.join(positive.select("description").distinct(), "description", "left_anti")
    yes = positive.groupBy("description").agg(F.array_sort(F.collect_set("hs_code")).alias("expected_hs_codes")).withColumn("label", F.lit("positive"))
    return yes.unionByName(negative.select("description", F.array("hs_code").alias("expected_hs_codes"), F.lit("negative").alias("label")))
