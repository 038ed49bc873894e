"""The command line that prepares a job's input: `python -m gridfactor.plans.prepare -i raw -o orbitals`.

`raw` is a catalog with the contents of a mean-field calculation: real_space_grid (Ng, 3), fft_grid (3, 1),
fft_coulomb (Ng, 1), ao (Ng, basis functions), mo_coeff (basis functions, M), hcore (M, M, in the basis of
orbitals), num_electrons (1, 2) and constant_energy_factors (1, 1).  `orbitals` gets the datasets that
`plans.job` reads, those of the half-rotated pass included.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.matrix import local
from ..sources.catalog import Catalog
from .job import column_of, grid_of, rows_of, write_input


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Prepare the input of a factorization.")
    parser.add_argument("-i", "--input", required=True, help="catalog of the raw tables")
    parser.add_argument("-o", "--output", default="orbitals", help="catalog that the job reads")
    return parser.parse_args(args)


def prepare(spark: SparkSession, raw: str, output: str) -> None:
    """The grid's tables stay distributed; coefficients and hcore are small and checked by `local`."""
    source = Catalog(spark, raw)
    shape = tuple(int(r.v) for r in source.load("fft_grid").orderBy("i").collect())  # three rows
    small = lambda name: local(source.load(name), *source.shape(name))
    electrons = tuple(int(x) for x in small("num_electrons")[0])
    energy = float(small("constant_energy_factors")[0, 0].real)
    kernel = column_of(source.load("fft_coulomb"), "v")
    write_input(Catalog(spark, output), grid_of(source.load("real_space_grid")), shape, kernel, rows_of(source.load("ao")), small("mo_coeff"), small("hcore"), electrons, energy)


def main(args: list[str] | None = None) -> None:
    options = arguments(args)
    prepare(SparkSession.builder.appName("gridfactor").getOrCreate(), options.input, options.output)


if __name__ == "__main__":
    main()
