"""Crystal structures without a density: headers of volumetric files, crystallographic files and extended XYZ, as DataFrames."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rhoscape.sources.density import decompress, parse_structure
from rhoscape.sources.runs import parse_cif

STRUCTURES = "path string, lattice array<double>, species array<string>, frac array<double>, error string"


def parse_xyz(text: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lattice, species and fractional coordinates of an extended XYZ file; one without a lattice isn't periodic."""
    lines = text.splitlines()
    n, cell = int(lines[0]), re.search(r'Lattice="([^"]+)"', lines[1])
    if cell is None:
        raise ValueError("no lattice: only periodic structures are read")
    lattice = np.array(cell[1].split(), float).reshape(3, 3)
    rows = [line.split() for line in lines[2 : 2 + n]]
    if len(rows) < n or any(len(r) < 4 for r in rows):
        raise ValueError(f"fewer than {n} atoms")
    return lattice, [re.match(r"[A-Z][a-z]?", r[0])[0] for r in rows], np.array([r[1:4] for r in rows], float) @ np.linalg.inv(lattice)


def parse(path: str, content: bytes) -> tuple[np.ndarray, list[str], np.ndarray]:
    """A structure by its file's name: .cif, .xyz or .extxyz, else a header as volumetric files have."""
    text, name = decompress(content).decode(), re.sub(r"\.(gz|bz2|xz)$", "", path.lower())
    if name.endswith(".cif"):
        return parse_cif(text)
    if name.endswith((".xyz", ".extxyz")):
        return parse_xyz(text)
    return parse_structure(text.splitlines())[:3]


def read_structures(files: DataFrame) -> DataFrame:
    """A row a file (path, content); what can't be read becomes the row's error."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    lattice, species, frac = parse(path, content)
                    if abs(np.linalg.det(lattice)) < 1e-9:
                        raise ValueError("the lattice has no volume")
                    row = (path, lattice.ravel().tolist(), species, frac.ravel().tolist(), "")
                except Exception as problem:  # recorded in the row
                    row = (path, None, None, None, f"{type(problem).__name__}: {problem}")
                kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["path", "lattice", "species", "frac", "error"])

    return files.select("path", "content").mapInArrow(run, STRUCTURES)


def structure_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
