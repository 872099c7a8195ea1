"""Run settings and their validation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

HEADLINES = ("ANNUAL", "SR15", "AR6", "CGWL")
#: Extra headline years of the named year set, by definition.
NAMED_EXTRA = {"ANNUAL": (2017,), "SR15": (2017,), "AR6": (2019,)}
PERCENTILES = (5.0, 17.0, 83.0, 95.0, 50.0)


def derived_variables(regressed: Iterable[str]) -> list[str]:
    """Variables that follow from the regressed set, in output order."""
    names = sorted(regressed)
    if names == ["Tot"]:
        return ["Res"]
    if names == ["Ant", "Nat"]:
        return ["Tot", "Res"]
    if len(names) == 3 and "Ant" not in names:
        return ["Ant", "Tot", "Res"]
    raise ValueError(f"no derived variables for {names}")


def contiguous(steps: Iterable[int]) -> bool:
    """Whether the sorted steps go up by one."""
    s = sorted(steps)
    return all(b - a == 1 for a, b in zip(s, s[1:], strict=False))


def parse_range(text: str) -> tuple[int, int]:
    """``a-b`` as inclusive integers."""
    a, sep, b = text.partition("-")
    if not (sep and a.isnumeric() and b.isnumeric()) or int(a) > int(b):
        raise ValueError(f"not a range: {text!r}")
    return int(a), int(b)


def headline_years(spec: str, end_regress: int, end_truncate: int, definition: str = "ANNUAL") -> list[int]:
    """Years of a specification: ``end_regress``, ``end_trunc``, ``IGCC`` or a comma list."""
    if spec == "end_regress":
        return [end_regress]
    if spec == "end_trunc":
        return [end_truncate]
    if spec == "IGCC":
        return sorted({*NAMED_EXTRA.get(definition, ()), end_regress})
    parts = [p.strip() for p in spec.split(",")]
    if not all(p.isnumeric() for p in parts):
        raise ValueError(f"not a list of years: {spec!r}")
    return sorted({int(p) for p in parts})


def clamp(wanted: tuple[int, int], *have: tuple[int, int]) -> tuple[int, int]:
    """The part of a range that all the data cover."""
    a, b = max(wanted[0], *(h[0] for h in have)), min(wanted[1], *(h[1] for h in have))
    if a > b:
        raise ValueError(f"{wanted} lies outside the data")
    return a, b


@dataclass(frozen=True)
class RunConfig:
    """One attribution run; ranges are inclusive."""

    scenario: str = "observed-2024"
    preindustrial: tuple[int, int] = (1850, 1900)
    regress: tuple[int, int] = (1850, 2024)
    truncate: tuple[int, int] | None = None
    samples: int = 60
    include_rate: bool = True
    #: The first year that a rate is reported for.
    first_rate: int = 1950
    headlines: tuple[str, ...] = HEADLINES
    headline_years: str = "end_regress"
    variables: tuple[str, ...] = ("GHG", "Nat", "OHF")
    ensemble_member: str = "all"
    percentiles: tuple[float, ...] = field(default=PERCENTILES)

    def __post_init__(self):
        derived_variables(self.variables)
        unknown = set(self.headlines) - set(HEADLINES)
        if unknown:
            raise ValueError(f"unknown headline definitions: {sorted(unknown)}")
        if self.samples < 1:
            raise ValueError("samples must be positive")

    @property
    def output_range(self) -> tuple[int, int]:
        return self.truncate or self.regress

    @classmethod
    def from_args(cls, args: Iterable[str]) -> RunConfig:
        """From ``--key=value`` arguments."""
        got = dict(a.removeprefix("--").split("=", 1) for a in args)
        names = {"annual": "ANNUAL", "sr1.5": "SR15", "ar6": "AR6", "cgwl": "CGWL"}
        make = {
            "preindustrial-era": ("preindustrial", parse_range), "regress-range": ("regress", parse_range), "truncate": ("truncate", parse_range),
            "samples": ("samples", int), "include-rate": ("include_rate", lambda v: v == "y"), "headline-years": ("headline_years", str), "scenario": ("scenario", str),
            "specify-ensemble-member": ("ensemble_member", str), "regress-variables": ("variables", lambda v: tuple(sorted(v.split(",")))),
            "headline-toggles": ("headlines", lambda v: () if v in ("n", "") else tuple(names[x.strip().lower()] for x in v.split(","))),
        }
        unknown = set(got) - set(make)
        if unknown:
            raise ValueError(f"unknown arguments: {sorted(unknown)}")
        return cls(**{make[k][0]: make[k][1](v) for k, v in got.items()})
