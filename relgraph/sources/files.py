"""Tuple tables from text, CSV, JSON and Parquet. Ids are strings: no reader infers types."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.tuples import parsed, rendered, valid
from ..model import COLUMNS, REL


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One tuple a line; empty lines and those that start with `//` or `#` are skipped; `valid` tells malformed ones."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '//') and not startswith(value, '#')")
    return lines.select(*parsed(F.col("value"))).withColumn("valid", valid())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=REL, header=True, nullValue="\0", emptyValue="").na.fill("").select(*COLUMNS)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=REL, primitivesAsString=True).na.fill("").select(*COLUMNS)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def write_text(rels: DataFrame, path: str) -> None:
    rels.select(rendered().alias("value")).write.text(path)


def validation_file(text: str) -> dict:
    """schema, relationships, assertTrue, assertFalse and validation of a file in that YAML layout.

    The subset of YAML that such files use: top-level keys, block scalars (`|`, `|-`, `>-`), lists of strings.
    """
    out: dict = {"schema": "", "relationships": [], "assertTrue": [], "assertFalse": [], "validation": {}}
    blocks: dict[str, list[str]] = {}
    key = None
    for line in text.splitlines():
        m = re.match(r"([A-Za-z_]+):(?:\s*[|>][+-]?)?\s*(.*)$", line)
        if m and not line[0].isspace():
            key = m[1]
            blocks[key] = [m[2]] if m[2] else []
        elif key is not None:
            blocks[key].append(line)
        elif line.strip() and not line.startswith(("#", "---")):
            raise InvalidArgument(f"not a validation file: {line!r}")
    out["schema"] = "\n".join(blocks.get("schema", []))
    out["relationships"] = [x.strip() for x in blocks.get("relationships", []) if x.strip() and not x.strip().startswith(("//", "#"))]
    part = None
    for line in blocks.get("assertions", []):
        if m := re.match(r"\s*(assertTrue|assertFalse):", line):
            part = m[1]
        elif part and (m := re.match(r"\s*-\s*(.*)$", line)):
            out[part].append(m[1].strip().strip("\"'"))
    part = None
    for line in blocks.get("validation", []):
        if m := re.match(r"""\s*-\s*["']?(\[.*)$""", line):
            out["validation"][part].append(m[1].rstrip("\"'"))
        elif m := re.match(r"""\s*["']?([^"'\s]+#[^"'\s:]+)["']?:""", line):
            part = m[1]
            out["validation"][part] = []
    return out
