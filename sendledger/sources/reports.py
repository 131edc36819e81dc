"""Delivery reports and number lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sendledger.functions.dates import parse_report_ts
from sendledger.functions.text import (
    clean_tag_id, clean_txn_id, lead_float, lead_int, normal_mobile, number_text, plain_mobile,
    source_from_path, strip,
)
from sendledger.schemas import HEADER_SPELLINGS, REPORT_HEADERS, STAGED_COLUMNS
from sendledger.session import settle
from sendledger.sources.csv_rows import file_heads, header_names, named_cells, read_lines

CAMPAIGN_FIELDS = ["client", "product", "base", "vendor", "channel"]

# FIXED VALUES: what a number list leaves open is filled with these.
NOT_GIVEN = "NA"
LIST_STATUS = "e"
UNKNOWN_CIRCLE = "Unknown"


def _normal_name(name: Column) -> Column:
    name = F.lower(name)
    for spelling, plain in HEADER_SPELLINGS.items():
        name = F.replace(name, F.lit(spelling), F.lit(plain))
    return name


def read_delivery_reports(
    spark: SparkSession, paths, campaign: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows of all acceptable files, and the files turned away.

    A file is turned away whole when it ends inside a quoted cell, when it lacks a required
    column, or when a file of the same name stands in the same batch (the first path wins).
    """
    lines = read_lines(spark, paths)
    required = F.array(*[F.lit(n) for n in REPORT_HEADERS])
    heads = file_heads(lines).select(
        "file_path",
        "is_closed",
        source_from_path(F.col("file_path")).alias("source"),
        F.transform(header_names(F.col("header")), _normal_name).alias("names"),
    )
    heads = heads.withColumn("missing", F.array_except(required, "names"))
    sound = F.when(F.col("is_closed") & (F.size("missing") == 0), F.col("file_path"))
    same = Window.partitionBy("source")
    judged = settle(
        heads.withColumn("first_path", F.min(sound).over(same)).withColumn(
            "reason",
            F.when(~F.col("is_closed"), "unclosed quote")
            .when(F.size("missing") > 0, "missing columns")
            .when(F.col("file_path") != F.col("first_path"), "same name in batch"),
        )
    )
    rejected = judged.where(F.col("reason").isNotNull()).select(
        "source", "file_path", "missing", "reason"
    )
    accepted = judged.where(F.col("reason").isNull()).select("file_path", "names")
    rows = named_cells(lines, accepted, REPORT_HEADERS).withColumn(
        "source", source_from_path(F.col("file_path"))
    )

    def kept(c: Column) -> Column:
        # These fields keep an empty cell as empty text, not NULL.
        return F.coalesce(c, F.lit(""))

    cleaned = {
        "transaction_id": clean_txn_id(F.col("transaction_id")),
        "message_id": kept(strip(F.col("message_id"))),
        "mobileNo": plain_mobile(F.col("mobile")),
        "sender": kept(F.col("sender_name")),
        "text": kept(F.col("text_message")),
        "type": kept(F.col("type")),
        "length": lead_int(F.col("length")).cast("string"),
        "cost": number_text(lead_float(F.col("cost"))),
        "status": kept(strip(F.col("status"))),
        "cause": kept(F.col("cause")),
        "channel_name": kept(F.col("channel_name")),
        "submit_time": parse_report_ts(F.col("submitted_time")),
        "delivered_time": parse_report_ts(F.col("delivered_time")),
        "ip": kept(strip(F.col("ip"))),
        "entity_id": clean_tag_id(F.col("entity_id")),
        "template_id": clean_tag_id(F.col("template_id")),
        "source": F.col("source"),
        "circle": F.lit(UNKNOWN_CIRCLE),
        **{name: F.lit(campaign.get(name)).cast("string") for name in CAMPAIGN_FIELDS},
    }
    return rows.select([cleaned[n].alias(n) for n in STAGED_COLUMNS]), rejected


# How much of a number list is looked at to see what parts its entries.
_PEEK_BYTES = 1 << 16


def _separators(spark: SparkSession, paths) -> dict[str, list[str]]:
    """Files by what Spark should split them at: a comma where no line ends near the start.

    Both separators are honoured in every file; this only keeps a list that stands
    on one huge line from becoming one row.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    for r in spark.read.format("binaryFile").load(paths).select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(r["path"])
        stream = path.getFileSystem(conf).open(path)
        try:
            start = bytes(stream.readNBytes(_PEEK_BYTES))
        finally:
            stream.close()
        one_line = b"\n" not in start and b"," in start
        found.setdefault("," if one_line else "\n", []).append(re.sub(r"[\[\]{}*?\\]", r"\\\g<0>", r["path"]))
    return found


def read_number_list(
    spark: SparkSession, paths, campaign: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Staged rows of all valid numbers, and the invalid entries.

    Lines and commas both separate numbers.
    """
    read = [
        spark.read.option("lineSep", sep).text(files).select("value", F.col("_metadata.file_path").alias("file_path"))
        for sep, files in _separators(spark, paths).items()
    ]
    entries = (
        reduce(DataFrame.unionByName, read)
        .select(
            source_from_path(F.col("file_path"), any_extension=True).alias("source"),
            F.explode(F.split("value", r"\r?\n|,")).alias("entry"),
        )
        .select("source", strip(F.col("entry")).alias("entry"))
        .where(F.col("entry") != "")
        .withColumn("mobileNo", normal_mobile(F.col("entry")))
    )
    filled = {n: F.lit(NOT_GIVEN) for n in STAGED_COLUMNS}
    filled.update(
        mobileNo=F.col("mobileNo"),
        sender=F.lit(campaign.get("sender")).cast("string"),
        status=F.lit(LIST_STATUS),
        cause=F.lit(LIST_STATUS),
        submit_time=F.lit(campaign["date"]),
        delivered_time=F.lit(campaign["date"]),
        source=F.col("source"),
        circle=F.lit(UNKNOWN_CIRCLE),
        **{n: F.lit(campaign.get(n)).cast("string") for n in CAMPAIGN_FIELDS},
    )
    rows = entries.where(F.col("mobileNo").isNotNull()).select(
        [filled[n].alias(n) for n in STAGED_COLUMNS]
    )
    return rows, entries.where(F.col("mobileNo").isNull()).select("source", "entry")
