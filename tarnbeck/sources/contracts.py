"""Table contracts: one JSON file is the schema, the checks and the version of a table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from tarnbeck.functions.lineage import columns_digest, digest


#: Types that contracts know, by name.
TYPES: dict[str, DataType] = {
    "string": StringType(), "timestamp": TimestampType(), "date": DateType(), "long": LongType(), "int": IntegerType(),
    "double": DoubleType(), "float": FloatType(), "boolean": BooleanType(),
}


def struct_of(columns: list[tuple[str, str]], optional: list[str] | None = None) -> StructType:
    """Columns are nullable unless a list of the optional ones is given and lacks them."""
    return StructType([StructField(n, TYPES[t], optional is None or n in optional) for n, t in columns])


def _type_name(simple: str) -> str:
    return "long" if simple == "bigint" else simple


@dataclass(frozen=True)
class Contract:
    name: str
    key: list[str]
    columns: list[tuple[str, str]]
    version: str  # digest of the whole contract
    optional: list[str] = field(default_factory=list)
    allowed: dict[str, list] = field(default_factory=dict)
    least: dict[str, float] = field(default_factory=dict)
    ordered: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, spec: dict) -> Contract:
        """A contract in this package's layout, or in that of contract files with `contract_name` and a
        map of columns; the version is the digest of the file as it stands."""
        if "contract_name" in spec:
            return cls._from_map(spec)
        return cls(
            spec["name"], spec["key"], [tuple(c) for c in spec["columns"]], digest(spec), spec.get("optional", []),
            spec.get("allowed", {}), spec.get("least", {}), [tuple(p) for p in spec.get("ordered", [])],
        )

    @classmethod
    def _from_map(cls, spec: dict) -> Contract:
        """Columns are {name: {type, nullable, min_value}}; orderings are texts such as "a <= b"."""
        columns = spec["columns"]
        order = spec.get("required_columns", [])
        names = [*(n for n in order if n in columns), *(n for n in columns if n not in order)]
        rules = spec.get("quality_rules", {})
        ordered = [tuple(x.strip() for x in rule.split("<=")) for rule in rules.get("ordering_rules", [])]
        least = {n: columns[n]["min_value"] for n in names if "min_value" in columns[n]}
        return cls(
            spec["contract_name"], spec.get("primary_key", []), [(n, columns[n]["type"]) for n in names], digest(spec),
            [n for n in names if columns[n].get("nullable", True)], spec.get("allowed_values", {}), least, ordered,
        )

    @classmethod
    def load(cls, path: str) -> Contract:
        with open(path, encoding="utf-8") as f:
            return cls.parse(json.load(f))

    @classmethod
    def own(cls, name: str) -> Contract:
        """A contract that comes with the package."""
        return cls.parse(json.loads(cls.own_text(name)))

    @staticmethod
    def own_text(name: str) -> str:
        """The file of a contract that comes with the package."""
        return resources.files("tarnbeck").joinpath(f"contracts/{name}.json").read_text("utf-8")

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.columns]

    @property
    def schema_hash(self) -> str:
        return columns_digest(self.columns)

    def struct(self) -> StructType:
        return struct_of(self.columns, self.optional)

    def check_schema(self, schema: StructType) -> None:
        """ValueError on missing columns or other types; further columns pass."""
        have = {f.name: _type_name(f.dataType.simpleString()) for f in schema}
        if missing := [n for n, _ in self.columns if n not in have]:
            raise ValueError(f"{self.name}: missing columns: {', '.join(missing)}")
        if wrong := [f"{n} is {have[n]}, not {t}" for n, t in self.columns if have[n] != t]:
            raise ValueError(f"{self.name}: {'; '.join(wrong)}")

    def violations(self, without: tuple[str, ...] = ()) -> dict[str, Column]:
        """Predicates of rows that break a rule, by the name of its metric. Each counts its own kind
        only: a null breaks not_null and nothing else."""
        needed = [n for n, _ in self.columns if n not in self.optional and n not in without]
        out = {"null_rows": reduce(or_, (F.col(n).isNull() for n in needed), F.lit(False))}
        if self.least:
            out["range_rows"] = reduce(or_, (F.coalesce(F.col(n) < low, F.lit(False)) for n, low in self.least.items()))
        if self.ordered:
            out["order_rows"] = reduce(or_, (F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in self.ordered))
        for n, values in self.allowed.items():
            out[f"{n}_rows"] = F.coalesce(~F.col(n).isin(values), F.lit(False))
        return out
