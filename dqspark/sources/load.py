"""Load a folder of raw files into tables with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqspark.sources.contracts import FLAT_FILES, SHOP_FILES
from dqspark.sources.manifest import load_manifest, load_profile, require_profile
from dqspark.sources.readers import (CORRUPT, no_actions, path_exists, read_actions_xml,
                                     read_contract, read_delimited, read_fixed_width_lines)

EMPTY_LINES = "source_file string, line_no bigint, pts string, rec_type string, line string"


def load_brokerage(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All raw tables of a brokerage batch, and the manifest. Absent files are listed as missing and
    give empty tables; flat tables keep lines that do not fit in ``_corrupt``."""
    tables, listed = {}, {}
    for name, (file, sep, schema) in FLAT_FILES.items():
        df = read_delimited(spark, f"{folder}/{file}", schema, sep)
        listed[name] = (file, df)
        tables[name] = df if df is not None else spark.createDataFrame([], f"{schema}, {CORRUPT} string")
    if path_exists(spark, f"{folder}/FINWIRE*"):
        tables["raw_finwire"] = read_fixed_width_lines(spark, folder, "FINWIRE*")
        listed["raw_finwire"] = ("FINWIRE*", tables["raw_finwire"])
    else:
        tables["raw_finwire"] = spark.createDataFrame([], EMPTY_LINES)
        listed["raw_finwire"] = ("FINWIRE*", None)
    actions = read_actions_xml(spark, f"{folder}/CustomerMgmt.xml")
    for i, name in enumerate(("raw_customer_actions", "raw_account_actions")):
        tables[name] = (actions or no_actions(spark))[i]
        listed[name] = ("CustomerMgmt.xml", tables[name] if actions else None)
    return tables, load_manifest(spark, listed)


def load_shop(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six shop tables, each checked against its header contract and date profile."""
    tables = {table: read_contract(spark, f"{folder}/{file}", schema)
              for file, (table, schema) in SHOP_FILES.items()}
    dates = {"raw_orders": "ordered_at", "raw_stores": "opened_at"}
    require_profile(load_profile({t: (df, dates.get(t)) for t, df in tables.items()}))
    return tables
