"""The JSON configuration of a factorization job.  Keys are fixed values of the file format."""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    orbital_file: str
    thc_cfac: int
    output_file: str | None = None
    find_interp_vec: bool = True
    half_rotated: bool = False
    thc_half_cfac: int | None = None
    solver: str = "kmeans"
    max_it: int = 1000
    threshold: float = 1e-5
    rng_seed: int = 0
    density: str = "density"
    sub_sample: bool = False  # pivots by a sketch of the pair products

    @classmethod
    def from_json(cls, text: str) -> JobConfig:
        raw = json.loads(text)
        points = raw.get("interpolating_points", {})
        km = points.get("kmeans")
        if km is None and "qrcp" not in points:
            raise ValueError("interpolating_points needs a kmeans or a qrcp block")
        config = cls(
            orbital_file=raw["orbital_file"],
            thc_cfac=int(raw["thc_cfac"]),
            output_file=raw.get("output_file"),
            find_interp_vec=bool(raw.get("find_interp_vec", True)),
            half_rotated=bool(raw.get("half_rotated", False)),
            thc_half_cfac=int(raw.get("thc_half_cfac", raw["thc_cfac"])),
            solver="qrcp" if km is None else "kmeans",  # both: k-means
            sub_sample=km is None and bool(points["qrcp"].get("sub_sample", False)),
            **({} if km is None else {"max_it": int(km["max_it"]), "threshold": float(km["threshold"]), "rng_seed": int(km.get("rng_seed", 0)), "density": km.get("density", "density")}),
        )
        if config.find_interp_vec and not config.output_file:
            raise ValueError("output_file is needed to write interpolation vectors")
        return config
