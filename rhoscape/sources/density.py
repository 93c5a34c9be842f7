"""Volumetric density files as DataFrames, and back.

binaryFile gives one row a file; a parser UDF turns it into a packed structure row. What can't be read becomes the row's
error. Text is never split across tasks: the unit of parallelism is the structure.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from rhoscape.kernels.lattice import Cell
from rhoscape.sources.runs import first_by_rank
from rhoscape.storage import materialise

#: A packed structure: grids are C-order little-endian float64.
PACKED = "path string, lattice array<double>, species array<string>, frac array<double>, shape array<int>, grid binary, error string"


def decompress(content: bytes) -> bytes:
    """Content of a plain, gzip, bzip2, xz or zip file, told by its first bytes; a zip must hold one density file."""
    if content.startswith(b"\x1f\x8b"):
        return gzip.decompress(content)
    if content.startswith(b"BZh"):
        return bz2.decompress(content)
    if content.startswith(b"\xfd7zXZ\x00"):
        return lzma.decompress(content)
    if content.startswith(b"PK\x03\x04"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if not n.endswith("/") and n.rsplit("/", 1)[-1].upper().startswith("CHG")]
            if len(names) != 1:
                raise ValueError(f"the archive must hold exactly one density file, found {len(names)}")
            return decompress(z.read(names[0]))
    return content


def clean_species(labels: list[str], counts: list[int]) -> list[str]:
    """One symbol an atom, from a label a group ("Fe_pv", "O/abc") or a label an atom."""
    if len(labels) == len(counts):
        return [label.split("_")[0].split("/")[0] for label, n in zip(labels, counts) for _ in range(n)]
    if len(labels) == sum(counts):
        return list(labels)
    raise ValueError(f"labels {labels} fit neither the groups nor the atoms of counts {counts}")


def _integers(line: str) -> list[int] | None:
    try:
        return [int(t) for t in line.split()]
    except ValueError:
        return None


def parse_structure(lines: list[str], species: list[str] | None = None) -> tuple[np.ndarray, list[str], np.ndarray, int]:
    """Lattice, species, fractional coordinates and the line after them of a structure header."""
    scale = [float(t) for t in lines[1].split()]
    lattice = np.array([[float(t) for t in line.split()[:3]] for line in lines[2:5]])
    stretch = 1.0
    if len(scale) == 3:
        lattice *= np.array(scale)[:, None]
    else:
        stretch = scale[0] if scale[0] >= 0 else (-scale[0] / abs(np.linalg.det(lattice))) ** (1 / 3)  # negative: the volume
        lattice *= stretch
    at, labels = 5, None
    if _integers(lines[at]) is None:
        labels, at = lines[at].split(), at + 1
    counts = _integers(lines[at])
    labels = species if species is not None else labels
    if labels is None:
        raise ValueError("the header has no species line and no species are given")
    if counts is None:
        raise ValueError("the header has no line of atom counts")
    at += 1
    at += lines[at].strip()[:1].lower() == "s"  # selective dynamics
    cartesian = lines[at].strip()[:1].lower() in ("c", "k")
    at += 1
    n = sum(counts)
    places = np.array([[float(t) for t in line.split()[:3]] for line in lines[at : at + n]]).reshape(-1, 3)
    return lattice, clean_species(list(labels), counts), places * stretch @ np.linalg.inv(lattice) if cartesian else places, at + n


def parse_density(text: str, species: list[str] | None = None, by_volume: bool = True, blocks: int | None = 1):
    """Structure and the data blocks (n1, n2, n3) of a volumetric file; values are divided by the volume."""
    lines = text.splitlines()
    lattice, labels, frac, at = parse_structure(lines, species)
    norm = Cell(lattice).volume if by_volume else 1.0
    found, shape = [], None
    while blocks is None or len(found) < blocks:
        while at < len(lines) and not ((size := _integers(lines[at])) is not None and len(size) == 3 and (shape is None or tuple(size) == shape)):
            at += 1
        if at >= len(lines):
            break
        shape, at = tuple(_integers(lines[at])), at + 1
        need = int(np.prod(shape))
        width = max(1, len(lines[at].split())) if at < len(lines) else 1
        taken, count = [], 0
        while count < need and at < len(lines):
            step = max(1, -(-(need - count) // width))
            part = np.array(" ".join(lines[at : at + step]).split(), float)
            taken.append(part)
            count += len(part)
            at += step
        if count < need:
            raise ValueError(f"the file ends {need - count} values before its {'x'.join(map(str, shape))} grid does")
        found.append(np.concatenate(taken)[:need].reshape(shape, order="F") / norm)
    if not found:
        raise ValueError("nothing after the structure says how large a grid is")
    return lattice, labels, frac, found


def format_density(lattice, species: list[str], frac, grids, by_volume: bool = True, comment: str = "density") -> str:
    """Text of a volumetric file; atoms are grouped by element. Inverse of parse_density()."""
    lattice, frac = np.asarray(lattice, float).reshape(3, 3), np.asarray(frac, float).reshape(-1, 3)
    elements = list(dict.fromkeys(species))
    order = [k for e in elements for k, s in enumerate(species) if s == e]
    row = lambda v: "  " + " ".join(f"{x:.12f}" for x in v)
    out = [comment, "1.0", *map(row, lattice), "  " + " ".join(elements), "  " + " ".join(str(species.count(e)) for e in elements), "Direct", *(row(frac[k]) for k in order)]
    norm = Cell(lattice).volume if by_volume else 1.0
    for grid in grids:
        flat = (np.asarray(grid, float) * norm).ravel(order="F")
        out += ["", " " + " ".join(f"{n:4d}" for n in np.shape(grid))]
        out += [" " + " ".join(f"{v:.11E}" for v in flat[k : k + 5]) for k in range(0, len(flat), 5)]
    return "\n".join(out) + "\n"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "lattice", "species", "frac", "shape", "grid", "error"])


def density_files(spark: SparkSession, path: str, pattern: str = "CHG*", one_per_directory: bool = False) -> DataFrame:
    """path and content of density files below a folder; of a run directory's plain and packed files optionally the first of plain, gz, bz2, xz."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")
    if one_per_directory:
        chosen = first_by_rank(files.select("path"), ["CHGCAR", "CHGCAR.gz", "CHGCAR.bz2", "CHGCAR.xz"])
        files = files.join(chosen, "path")
    return files


def read_densities(files: DataFrame, species: list[str] | None = None, all_blocks: bool = False, by_volume: bool = True) -> DataFrame:
    """Packed structures, a row a file (or a data block) in the order of files' rows; errors are recorded."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    lattice, labels, frac, grids = parse_density(decompress(content).decode(), species, by_volume, None if all_blocks else 1)
                    rows = [(path, lattice.ravel().tolist(), labels, frac.ravel().tolist(), list(g.shape), np.ascontiguousarray(g, "<f8").tobytes(), "") for g in grids]
                except Exception as problem:  # recorded in the row
                    rows = [(path, None, None, None, None, None, f"{type(problem).__name__}: {problem}")]
                for row in rows:
                    yield _packed([row])

    return files.select("path", "content").mapInArrow(run, PACKED)


def density_texts(packed: DataFrame) -> DataFrame:
    """path and text of each structure as a volumetric file; rows without a grid have none."""

    def run(batches):
        for batch in batches:
            rows = [(r["path"], format_density(r["lattice"], r["species"], r["frac"], [np.frombuffer(r["grid"], "<f8").reshape(r["shape"])])) for r in batch.to_pylist() if r["grid"] is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["path", "text"])

    return packed.mapInArrow(run, "path string, text string")


def write_densities(packed: DataFrame, folder: str) -> DataFrame:
    """Write each structure as a file below a folder that all executors reach, and return path, file and bytes of each.

    A file has its structure's name and the CRC-32 of its whole path, so equal names don't meet. A task writes beside
    and renames at the end: a task that is run again leaves the same files.
    """

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                name = f"{path.rstrip('/').rsplit('/', 1)[-1]}-{zlib.crc32(path.encode()):08x}.vasp"
                beside, data = f"{root}/.{name}.{uuid.uuid4().hex}", text.encode()
                with system.open_output_stream(beside) as out:
                    out.write(data)
                system.move(beside, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([len(data)])], ["path", "file", "bytes"])

    return materialise(density_texts(packed).mapInArrow(run, "path string, file string, bytes bigint"), "written")
