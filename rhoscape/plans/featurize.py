"""Featurisation as Spark plans: one narrow map over packed structures, a wide row each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscape.kernels.features import featurize_or_error
from rhoscape.options import Options
from rhoscape.plans.registry import selected
from rhoscape.sources.density import density_files, read_densities

_SIZES = [("n_atoms", "int"), ("volume", "double"), ("grid_shape", "string"), ("site_counts", "string")]
_SETTINGS = [(n, "string") for n in ("partition", "shells", "derivative_backend", "laplacian_method", "precision")]
_HOOKS = [("euler_consistency", "int"), ("n_elements", "int"), ("max_sites_per_element", "int")]
_TAIL = [("sentinels", "string"), ("wall_time_s", "double"), ("version", "string"), ("error", "string")]
_ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def columns(options: Options) -> list[tuple[str, str]]:
    """Names and types of a featurised row, fixed by the registry and the options."""
    chosen = selected(options.domains)
    return [("path", "string"), *((d.name, "double") for d in chosen), *_SIZES, *_SETTINGS, *_HOOKS, *((f"{d.name}__flag", "int") for d in chosen if d.cases), *_TAIL]


def featurize(packed: DataFrame, options: Options | None = None, on_error: str = "record") -> DataFrame:
    """A row of all selected descriptors and metadata for each packed structure.

    on_error: "record" keeps a failed structure as a row with its error and NaN descriptors, "skip" leaves it out,
    "raise" fails the query. Structures are independent, so there is no shuffle; a lost task redoes its own.
    """
    if on_error not in ("record", "skip", "raise"):
        raise ValueError(f"on_error must be record, skip or raise; got {on_error!r}")
    options = options or Options()
    fields = columns(options)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():

                def make(r=r):
                    if r["error"]:
                        kind, _, text = r["error"].partition(": ")
                        raise type(kind, (Exception,), {})(text)
                    return np.frombuffer(r["grid"], "<f8").reshape(r["shape"]), np.array(r["lattice"]).reshape(3, 3), r["species"], np.array(r["frac"]).reshape(-1, 3)

                row = {"path": r["path"]} | featurize_or_error(make, options)
                if row["error"]:
                    if on_error == "skip":
                        continue
                    if on_error == "raise":
                        raise RuntimeError(f"{r['path']}: {row['error']}\n{row.get('traceback', '')}")
                blank = {d.name: float("nan") for d in selected(options.domains)}
                row = blank | row
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], _ARROW[t]) for n, t in fields], [n for n, _ in fields])

    return packed.select("path", "lattice", "species", "frac", "shape", "grid", "error").mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def featurize_batch(spark: SparkSession, path: str, pattern: str = "CHG*", options: Options | None = None, on_error: str = "record", one_per_directory: bool = False) -> DataFrame:
    """Featurise every density file below a folder, a task a file, large files first; rows come back sorted by path.

    Names sort by code point, so a list of files that is to keep an order of its own is joined by path afterwards.
    """
    files = density_files(spark, path, pattern, one_per_directory)
    spread = max(1, min(10_000, files.select("path").count()))
    ordered = files.repartition(spread, "path").sortWithinPartitions(F.desc("length"))
    return featurize(read_densities(ordered), options, on_error).orderBy("path")


def sweep(packed: DataFrame, factors: list[tuple[float, float]], options: Options | None = None) -> DataFrame:
    """The region-dependent descriptors of each structure for sphere factors (a, b), pairs with a >= b left out.

    All factors of a structure are worked off in one task, so its grid is read and its geometry found once.
    """
    from dataclasses import replace

    from rhoscape.kernels.features import Density
    from rhoscape.plans.registry import Fallback

    options = options or Options()
    chosen = [d for d in selected(options.domains) if "shells" in d.requires]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["grid"] is None:
                    continue
                base = Density(np.frombuffer(r["grid"], "<f8").reshape(r["shape"]), r["lattice"], r["species"], r["frac"], options)
                rows = []
                for a, b in factors:
                    if a >= b:
                        continue
                    base.options = replace(options, shells=(a, b))
                    for made in ("regions", "eigenvalues", "ghosts", "sphere_sums", "shared_sums"):
                        base.__dict__.pop(made, None)
                    values = [d.function(base) for d in chosen]
                    rows.append((r["path"], a, b, *(float(v.value if isinstance(v, Fallback) else v) for v in values)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "a", "b", *(d.name for d in chosen)])

    return packed.mapInArrow(run, "path string, a double, b double, " + ", ".join(f"`{d.name}` double" for d in chosen))


def grid_convergence(packed: DataFrame, scales: tuple[float, ...] = (0.9, 0.8), options: Options | None = None) -> DataFrame:
    """Every descriptor on the full grid and on band-limited resampled grids, with the relative change, long form."""
    from rhoscape.kernels.features import featurize_grid
    from rhoscape.kernels.spectral import fourier_resample

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["grid"] is None:
                    continue
                grid = np.frombuffer(r["grid"], "<f8").reshape(r["shape"])
                full, _ = featurize_grid(grid, r["lattice"], r["species"], r["frac"], options)
                rows = []
                for s in scales:
                    found, _ = featurize_grid(fourier_resample(grid, [max(4, int(round(n * s))) for n in grid.shape]), r["lattice"], r["species"], r["frac"], options)
                    rows += [(r["path"], k, s, v, found[k], abs(found[k] - v) / max(abs(v), 1e-300)) for k, v in full.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "descriptor", "scale", "full", "scaled", "rel_change"])

    return packed.mapInArrow(run, "path string, descriptor string, scale double, full double, scaled double, rel_change double")
