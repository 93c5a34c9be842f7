"""Command line: featurize, batch, catalogue, sweep, predict. Exit codes: 0 done, 1 nothing matched or a row failed, 2 usage."""

from __future__ import annotations

import argparse
import json
import math
import sys


def _options(args) -> "Options":  # noqa: F821
    from rhoscape.options import Options

    return Options(domains=tuple(args.domains.split(",")) if args.domains else Options().domains, partition=args.partition, shells=(args.a, args.b), laplacian_method=args.laplacian, derivative_backend=args.backend, fd_order=args.fd_order, float32=args.float32)


def build() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="rhoscape", description="Descriptors of crystal charge densities on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("featurize", "one density file to JSON"), ("batch", "a folder of density files to CSV"), ("sweep", "region descriptors over sphere factors"), ("catalogue", "the descriptors")):
        sub = commands.add_parser(name, help=text)
        if name != "catalogue":
            sub.add_argument("path")
            sub.add_argument("--domains")
            sub.add_argument("--partition", default="nearest", choices=("nearest", "becke"))
            sub.add_argument("--laplacian", default="metric", choices=("metric", "diagonal"))
            sub.add_argument("--backend", default="fft", choices=("fft", "fd"))
            sub.add_argument("--fd-order", type=int, default=4, choices=(2, 4, 6, 8))
            sub.add_argument("--float32", action="store_true")
            sub.add_argument("-a", type=float, default=0.79)
            sub.add_argument("-b", type=float, default=1.14)
        if name == "batch":
            sub.add_argument("--pattern", default="CHG*")
            sub.add_argument("--on-error", default="record", choices=("record", "skip", "raise"))
        if name == "sweep":
            sub.add_argument("--a-values", default="0.79")
            sub.add_argument("--b-values", default="1.14")
        sub.add_argument("--out")
    sub = commands.add_parser("predict", help="densities of structures by a plug-in model, written as volumetric files")
    sub.add_argument("path")
    sub.add_argument("--model", default="rhoscape.plans.predict:gaussians", help="module:function of a density model")
    sub.add_argument("--encut", type=float, default=500.0, help="energy cutoff in eV that grids are made for")
    sub.add_argument("--precision", default="accurate", choices=("accurate", "normal"))
    sub.add_argument("--out", required=True)
    return parser


def _predicted(spark, args) -> int:
    """Write the predicted densities of all readable structures below a path; report those that can't be read."""
    from importlib import import_module

    from rhoscape.plans.predict import packed_predictions, sized
    from rhoscape.sources.density import write_densities
    from rhoscape.sources.structures import read_structures, structure_files

    module, _, name = args.model.partition(":")
    found = read_structures(structure_files(spark, args.path))
    bad = found.where("error <> ''").select("path", "error").collect()
    for row in bad:
        print(f"{row['path']}: {row['error']}", file=sys.stderr)
    good = sized(found.where("error = ''"), args.encut, args.precision)
    if good.isEmpty():
        print(f"no structure below {args.path}", file=sys.stderr)
        return 1
    write_densities(packed_predictions(good, getattr(import_module(module), name)), args.out).select("path", "file").show(1000, truncate=False)
    return 1 if bad else 0


def finite(value):
    return None if isinstance(value, float) and not math.isfinite(value) else value


def main(argv: list[str] | None = None) -> int:
    args = build().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    if args.command == "predict":
        return _predicted(spark, args)
    if args.command == "catalogue":
        from rhoscape.plans.registry import catalogue

        made = catalogue(spark)
    elif args.command == "batch":
        from rhoscape.plans.featurize import featurize_batch

        made = featurize_batch(spark, args.path, args.pattern, _options(args), args.on_error)
        if made.isEmpty():
            print(f"no file matches {args.pattern} below {args.path}", file=sys.stderr)
            return 1
    else:
        from rhoscape.plans.featurize import featurize, sweep
        from rhoscape.sources.density import read_densities

        packed = read_densities(spark.read.format("binaryFile").load(args.path).select("path", "content"))
        if args.command == "featurize":
            row = featurize(packed, _options(args)).first().asDict()
            text = json.dumps({k: finite(v) for k, v in row.items()}, indent=1)
            print(text) if not args.out else open(args.out, "w").write(text)
            return 1 if row["error"] else 0
        made = sweep(packed, [(float(a), float(b)) for a in args.a_values.split(",") for b in args.b_values.split(",")], _options(args))
    if args.out:
        made.write.mode("overwrite").option("header", True).csv(args.out)
    else:
        made.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
