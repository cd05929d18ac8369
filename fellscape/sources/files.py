"""Readers and writers of matrices, bundles, triplets, lineage tables and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = "array<double>"


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, x): a matrix from .json (a list, or an object with data or matrix), .jsonl, .tsv/.tab or .csv.

    Files have no header; blank rows are skipped. ``row`` is 0-based in file order: a single file
    is read as one ordered sequence of lines.
    """
    name = path.lower()
    if name.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        wrapped = F.from_json("value", "struct<data: array<array<double>>, matrix: array<array<double>>>")
        rows = F.coalesce(F.from_json("value", "array<array<double>>"), wrapped["data"], wrapped["matrix"])
        return text.select(F.posexplode(rows).alias("row", "x")).select(F.col("row").cast("bigint"), "x")
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    # monotonically_increasing_id keeps file order: partition number, then line
    part = lines.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n"))
    before = part.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("base"))  # one row a partition
    row = F.row_number().over(Window.partitionBy("p").orderBy("at")) - 1
    numbered = lines.withColumn("p", F.shiftright("at", 33)).withColumn("r", row).join(before, "p")
    if name.endswith(".jsonl"):
        x = F.from_json("value", NUMBERS)
    else:
        x = F.split("value", "\t" if name.endswith((".tsv", ".tab")) else ",").cast(NUMBERS)
    return numbered.select((F.col("base") + F.col("r")).alias("row"), x.alias("x"))


def write_matrix(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Rows (row, x) as a folder of csv, tsv or jsonl files, sorted by row within and across files."""
    ordered = rows.orderBy("row")
    if form == "jsonl":
        ordered.select(F.to_json("x").alias("value")).write.mode("overwrite").text(path)
    else:
        sep = "," if form == "csv" else "\t"
        ordered.select(F.array_join(F.col("x").cast("array<string>"), sep).alias("value")).write.mode("overwrite").text(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(idx, cell_id, label, expr, vel) from a JSON object with expression and velocity.

    Missing labels are "unlabeled", missing ids cell_00000 by position; a bundle without either
    matrix or with matrices of different lengths is an error.
    """
    schema = "expression array<array<double>>, velocity array<array<double>>, labels array<string>, cell_ids array<string>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    bad = whole.where("expression is null or velocity is null or size(expression) <> size(velocity)")
    if not bad.isEmpty():
        raise ValueError(f"{path}: expression and velocity must be there, with equal rows")
    rows = whole.select(F.posexplode("expression").alias("idx", "expr"), "velocity", "labels", "cell_ids")
    return rows.select(
        F.col("idx").cast("bigint"), F.coalesce(F.get("cell_ids", "idx"), F.format_string("cell_%05d", "idx")).alias("cell_id"),
        F.coalesce(F.get("labels", "idx"), F.lit("unlabeled")).alias("label"), "expr", F.get("velocity", "idx").alias("vel"),
    )


def check_rectangular(rows: DataFrame, vector: str) -> None:
    """An error unless all vectors have one length and finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high, broken = rows.agg(F.min(F.size(vector)), F.max(F.size(vector)), F.sum(F.coalesce(bad, F.lit(True)).cast("int"))).first()
    if low != high or broken:
        raise ValueError(f"{vector}: lengths {low} to {high}, {broken} rows with missing numbers")


def read_triplets(spark: SparkSession, path: str, genes: Sequence[int] | None = None, cells: Sequence[int] | None = None) -> DataFrame:
    """(cell, gene, value) of a Matrix Market file (gzip too), 0-based, filtered while it is scanned."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select((f[0].cast("bigint") - 1).alias("gene"), (f[1].cast("bigint") - 1).alias("cell"), f[2].cast("double").alias("value"), F.monotonically_increasing_id().alias("at"))
    head = rows.agg(F.min("at")).first()[0]  # the size line
    rows = rows.where(F.col("at") != (head if head is not None else -1)).drop("at")
    if genes is not None:
        rows = rows.where(F.col("gene").isin(list(genes)))
    if cells is not None:
        rows = rows.where(F.col("cell").isin(list(cells)))
    return rows.select("cell", "gene", "value")


def read_lineage(spark: SparkSession, path: str, cell_names: Sequence[str] = ("cell_id", "cell", "barcode"), fate_names: Sequence[str] = ("fate", "outcome", "label")) -> DataFrame:
    """(cell_id, fate) from a delimited file with a header; the first known column names are taken."""
    raw = spark.read.csv(path, header=True, sep="\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    names = {c.lower(): c for c in raw.columns}
    pick = lambda wanted: next((names[w] for w in wanted if w in names), None)
    cell, fate = pick(cell_names), pick(fate_names)
    if cell is None or fate is None:
        raise ValueError(f"{path}: no column of {list(cell_names)} or {list(fate_names)}")
    return raw.select(F.col(cell).alias("cell_id"), F.col(fate).alias("fate"))


def read_observations(spark: SparkSession, path: str, fields: dict[str, tuple[str, Sequence[str]]], wrapper: Sequence[str] = ("observations", "cells", "studies")) -> DataFrame:
    """Typed rows of a JSON list, or of an object that wraps one, with aliases of field names coalesced.

    ``fields``: name -> (type, accepted names).
    """
    raw = spark.read.json(path, multiLine=True)
    for w in wrapper:
        if w in raw.columns and raw.schema[w].dataType.typeName() == "array":
            raw = raw.select(F.explode(w).alias("o")).select("o.*")
            break
    out = []
    for name, (kind, accepted) in fields.items():
        there = [F.col(f"`{a}`").cast(kind) for a in accepted if a in raw.columns]
        out.append((F.coalesce(*there) if there else F.lit(None).cast(kind)).alias(name))
    return raw.select(*out)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A fit as one Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_cells(cells: DataFrame, path: str) -> None:
    """Exported cells as CSV with a header."""
    cells.write.mode("overwrite").option("header", True).csv(path)
