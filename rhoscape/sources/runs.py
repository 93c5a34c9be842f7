"""Outputs of calculation runs and structure documents as DataFrames."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rhoscape.functions.chemistry import parent_directory


def pseudopotentials(spark: SparkSession, path: str) -> DataFrame:
    """Datasets and valences that run logs name before their first iteration, in order, a row a run directory.

    Lines are numbered within a file by byte order of the text source, and only the few matching lines are gathered.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    marks = lines.where(F.col("value").rlike("TITEL|ZVAL|Iteration"))
    first = marks.where(F.col("value").contains("Iteration")).groupBy("file").agg(F.min("line").alias("stop"))
    head = marks.join(first, "file", "left").where(F.col("stop").isNull() | (F.col("line") < F.col("stop")))
    title = F.trim(F.regexp_extract("value", r"TITEL\s*=\s*(.*)$", 1))
    valence = F.regexp_extract("value", r"ZVAL\s*=\s*([0-9.]+)", 1)
    rows = head.select("file", "line", F.when(title != "", title).alias("title"), F.when(F.col("value").contains("POMASS") & (valence != ""), valence).alias("zval"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line", c)))), lambda s: s[c])
    found = rows.groupBy("file").agg(ordered("title").alias("titles"), ordered("zval").alias("zvals"))
    return found.select(parent_directory(F.col("file")).alias("structure"), F.array_join("titles", ";").alias("paw_datasets"), F.array_join("zvals", ";").alias("zval"), (F.size("titles") == F.size("zvals")).alias("complete"))


def flattened(documents: DataFrame, schema: str, column: str = "json", tensor: str | None = None) -> DataFrame:
    """JSON documents with nested fields as prefix_key columns; arrays stay JSON, a 6x6 tensor becomes C11..C66."""
    from pyspark.sql import types as T

    parsed = documents.withColumn("__d", F.from_json(column, schema))
    out: list[Column] = []

    def walk(kind, field: Column, name: str) -> None:
        if tensor and name == tensor:
            out.extend(field[i][j].alias(f"C{i + 1}{j + 1}") for i in range(6) for j in range(i, 6))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, field[f.name], f"{name}_{f.name}" if name else f.name)
        elif isinstance(kind, T.ArrayType):
            out.append(F.to_json(field).alias(name))
        else:
            out.append(field.alias(name))

    walk(parsed.schema["__d"].dataType, F.col("__d"), "")
    return parsed.select(*(c for c in documents.columns if c != column), *out)


def first_by_rank(files: DataFrame, names: list[str]) -> DataFrame:
    """Of each directory's files the one whose name comes first in a list of names."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("path", "/"), -1))
    window = Window.partitionBy(parent_directory(F.col("path"))).orderBy("__rank")
    return files.withColumn("__rank", rank).where("__rank > 0").withColumn("__row", F.row_number().over(window)).where("__row = 1").drop("__rank", "__row")


def parse_cif(text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lattice, species and fractional coordinates of a crystallographic file with explicit sites (symmetry P1)."""
    number = lambda t: float(re.sub(r"\(.*\)", "", t))
    lengths = [number(re.search(rf"_cell_length_{c}\s+(\S+)", text)[1]) for c in "abc"]
    angles = np.radians([number(re.search(rf"_cell_angle_{c}\s+(\S+)", text)[1]) for c in ("alpha", "beta", "gamma")])
    ca, cb, cg = np.cos(angles)
    a, b, c = lengths
    cy = (ca - cb * cg) / np.sin(angles[2])
    lattice = np.array([(a, 0, 0), (b * cg, b * np.sin(angles[2]), 0), (c * cb, c * cy, c * np.sqrt(max(0.0, 1 - cb * cb - cy * cy)))])
    operations = re.findall(r"^\s*(?:\d+\s+)?'?x\s*,\s*y\s*,\s*z'?\s*$", text, re.M | re.I)
    if re.search(r"_symmetry_equiv_pos_as_xyz|_space_group_symop_operation_xyz", text) and len(re.findall(r"^\s*(?:\d+\s+)?'?[-+xyz0-9/. ]+,[-+xyz0-9/. ]+,[-+xyz0-9/. ]+'?\s*$", text, re.M | re.I)) > len(operations):
        raise ValueError("only sites without further symmetry operations are read")
    for block in re.split(r"^loop_\s*$", text, flags=re.M)[1:]:
        rows = [line.strip() for line in block.strip().splitlines()]
        names = [r for r in rows if r.startswith("_")]
        if "_atom_site_fract_x" not in names:
            continue
        body = [r.split() for r in rows[len(names) :] if r and not r.startswith(("_", "#", "data_"))]
        body = [r for r in body if len(r) == len(names)]
        label = names.index("_atom_site_type_symbol") if "_atom_site_type_symbol" in names else names.index("_atom_site_label")
        places = [[number(r[names.index(f"_atom_site_fract_{c}")]) for c in "xyz"] for r in body]
        return lattice, [re.match(r"[A-Z][a-z]?", r[label])[0] for r in body], np.array(places)
    raise ValueError("no atom sites")


def dimension_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV table with a header and lines of comments."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
