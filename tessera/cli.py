"""Command line: python -m tessera --window=100 --input_a_file_name=a.txt [...]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException

from .operators import profiles as P
from .params import LEAST_TILE
from .sources import text

TYPES = ("1NN_INDEX", "1NN", "SUM_THRESH", "ALL_NEIGHBORS", "MATRIX_SUMMARY")
_FLAGS = {
    "output_pearson": "correlations instead of distances",
    "print_debug_info": "say what runs",
    "no_gpu": "accepted; there is no GPU",
    "ultra_precision": "64-bit",
    "double_precision": "64-bit (the default)",
    "single_precision": "inputs as 32-bit numbers",
    "keep_rows": "also the profile of B against A",
    "aligned": "A and B are aligned: exclude trivial matches",
    "autotune": "measure block lengths and keep the best",
    "list_variants": "list what autotune measures",
}
_OUTPUTS = {"output_a_file_name": "mp_columns_out", "output_a_index_file_name": "mp_columns_out_index", "output_b_file_name": "mp_rows_out", "output_b_index_file_name": "mp_rows_out_index"}


class UsageError(ValueError):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise UsageError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="tessera", description="Similarity joins of time series.", allow_abbrev=False)
    p.add_argument("--window", type=int)
    p.add_argument("--input_a_file_name", default="")
    p.add_argument("--input_b_file_name", default="")
    for name, default in _OUTPUTS.items():
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--profile_type", choices=TYPES, default="1NN_INDEX")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--max_matches_per_column", type=int, default=5)
    p.add_argument("--reduced_height", type=int, default=50)
    p.add_argument("--reduced_width", type=int, default=50)
    p.add_argument("--num_cpu_workers", type=int, default=0)
    p.add_argument("--max_tile_size", type=int)
    p.add_argument("--gpus", default="")
    p.add_argument("--global_row", type=int)
    p.add_argument("--global_col", type=int)
    p.add_argument("--cache_path", default="")
    for name, text_ in _FLAGS.items():
        p.add_argument(f"--{name}", nargs="?", const=True, default=False, type=_bool, help=text_)
    return p


def _bool(x: str) -> bool:
    if x.lower() in ("true", "t", "yes", "y", "1"):
        return True
    if x.lower() in ("false", "f", "no", "n", "0"):
        return False
    raise argparse.ArgumentTypeError(f"{x!r} is neither true nor false")


def normalised(argv: list[str]) -> list[str]:
    """-x as --x, --nox as --x=false, and a flag never takes the next argument as its value."""
    out = []
    for x in argv:
        if x.startswith("-") and not x.startswith("--") and len(x) > 2 and not x[1].isdigit():
            x = f"-{x}"
        if x.startswith("--no") and x[4:] in _FLAGS:
            x = f"--{x[4:]}=false"
        elif x.startswith("--") and x[2:] in _FLAGS:
            x = f"{x}=true"
        out.append(x)
    return out


def checked(o: argparse.Namespace) -> argparse.Namespace:
    """Rules that need no input."""
    if o.window is None or not o.input_a_file_name:
        raise UsageError("--window and --input_a_file_name are needed")
    if o.window < 3:
        raise UsageError("--window must be at least 3")
    two = bool(o.input_b_file_name)
    if o.keep_rows and not two:
        raise UsageError("--keep_rows needs --input_b_file_name")
    if o.keep_rows and o.profile_type == "MATRIX_SUMMARY":
        raise UsageError("--keep_rows does not apply to MATRIX_SUMMARY")
    if o.aligned and not two:
        raise UsageError("--aligned needs --input_b_file_name")
    if (o.global_row is not None or o.global_col is not None) and not o.aligned:
        raise UsageError("--global_row and --global_col need --aligned")
    if sum((o.ultra_precision, o.double_precision, o.single_precision)) > 1:
        raise UsageError("choose one precision")
    if o.max_tile_size is not None and o.max_tile_size < LEAST_TILE:
        raise UsageError(f"--max_tile_size must be at least {LEAST_TILE}")
    if o.gpus.strip():
        raise UsageError("no GPU is available")
    if o.profile_type in ("SUM_THRESH", "ALL_NEIGHBORS", "MATRIX_SUMMARY") and not -1 <= o.threshold <= 1:
        raise UsageError("--threshold must be between -1 and 1")
    inputs = [o.input_a_file_name] + [o.input_b_file_name] * two
    if inputs.count("-") > 1:
        raise UsageError("standard input can be read once")
    used = [getattr(o, n) for n in active(o)]
    if used.count("-") > 1:
        raise UsageError("standard output can be written once")
    files = [os.path.realpath(x) for x in used if x != "-"]
    if len(set(files)) < len(files) or set(files) & {os.path.realpath(x) for x in inputs if x != "-"}:
        raise UsageError("outputs must differ from each other and from the inputs")
    return o


def active(o: argparse.Namespace) -> list[str]:
    names = ["output_a_file_name"] + ["output_a_index_file_name"] * (o.profile_type == "1NN_INDEX")
    if o.keep_rows:
        names += ["output_b_file_name"] + ["output_b_index_file_name"] * (o.profile_type == "1NN_INDEX")
    return names


def compute(o: argparse.Namespace, a, b) -> dict[str, object]:
    """Lines by the name of their output."""
    common = {"precision": "single" if o.single_precision else "ultra" if o.ultra_precision else "double", "verbose": o.print_debug_info}
    if o.max_tile_size is not None:
        common["max_tile_size"] = o.max_tile_size
    if o.num_cpu_workers:
        common["threads"] = o.num_cpu_workers
    kind, m = o.profile_type, o.window
    if kind != "SUM_THRESH":
        common["pearson"] = o.output_pearson
    if kind in ("SUM_THRESH", "ALL_NEIGHBORS", "MATRIX_SUMMARY"):
        common["threshold"] = o.threshold
    if kind == "MATRIX_SUMMARY":
        common |= {"mheight": o.reduced_height, "mwidth": o.reduced_width}
    value = "corr" if o.output_pearson else "dist"

    def one(first, second, turned: bool):
        options = dict(common)
        series = (first,) if second is None else (first, second)
        if second is not None:
            options["allow_trivial_match"] = not o.aligned
            row, col = o.global_row or 0, o.global_col or 0
            options |= {"row_offset": col if turned else row, "col_offset": row if turned else col}
        name = {"1NN_INDEX": "", "1NN": "_1nn", "SUM_THRESH": "_sum", "ALL_NEIGHBORS": "_knn", "MATRIX_SUMMARY": "_matrix"}[kind]
        run = getattr(P, f"{'selfjoin' if second is None else 'abjoin'}{name}")
        return run(*series, m, o.max_matches_per_column, **options) if kind == "ALL_NEIGHBORS" else run(*series, m, **options)

    out: dict[str, object] = {}

    def profile(side: str, found) -> None:
        out[f"output_{side}_file_name"] = text.values(found, value)
        if kind == "1NN_INDEX":
            out[f"output_{side}_index_file_name"] = text.values(found, "row_idx")

    if o.keep_rows and kind in ("1NN", "1NN_INDEX"):  # both sides from one pass over the pairs
        options = common | {"allow_trivial_match": not o.aligned, "row_offset": o.global_row or 0, "col_offset": o.global_col or 0}
        both = P.abjoin_bidirectional(a, b, m, **options).withColumnsRenamed({"idx": "col_idx", "match_idx": "row_idx"}).persist()
        for side in ("a", "b"):
            profile(side, both.filter(both["axis"] == side))
        return out
    for side, first, second in (("a", a, b), *([("b", b, a)] if o.keep_rows else [])):
        found = one(first, second, side == "b")
        main = f"output_{side}_file_name"
        if kind == "ALL_NEIGHBORS":
            out[main] = text.matches(found, value)
        elif kind == "MATRIX_SUMMARY":
            out[main] = text.matrix(found, value)
        elif kind == "SUM_THRESH":
            out[main] = text.values(found, "corr_sum")
        else:
            profile(side, found.persist())
    return out


def run(argv: list[str]) -> int:
    o = parser().parse_args(normalised(argv))
    if o.list_variants:
        from .tuning import strategy_descriptions

        for s in strategy_descriptions():
            print(f"{s.name}: {s.text}")
        return 0
    from pyspark.sql import SparkSession

    if not o.autotune:
        checked(o)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if o.autotune:
        from .tuning import autotune

        print(f"{autotune(spark, o.cache_path)} records")
        return 0

    def read(path: str):
        if path == "-":
            from .sources.series import Series

            return Series.from_values(spark, sys.stdin.read().split(), "single" if o.single_precision else "double")
        return text.read_series(spark, os.path.abspath(path) if "://" not in path else path, "single" if o.single_precision else "double")

    a = read(o.input_a_file_name)
    b = read(o.input_b_file_name) if o.input_b_file_name else None
    lines = compute(o, a, b)
    files = {getattr(o, n): x for n, x in lines.items() if getattr(o, n) != "-"}
    shown = [x for n, x in lines.items() if getattr(o, n) == "-"]
    text.write_all(files)
    for x in shown:
        sys.stdout.writelines(f"{line}\n" for line in x)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except (ValueError, TypeError, OSError, AnalysisException) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
