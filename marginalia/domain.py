"""Domains: ordered categorical attributes and how many values each has."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Domain:
    """Attributes with their sizes; the values of an attribute are 0 to size - 1."""

    attrs: tuple[str, ...]
    shape: tuple[int, ...]

    def __post_init__(self):
        if len(self.attrs) != len(self.shape) or len(set(self.attrs)) != len(self.attrs):
            raise ValueError("one size per attribute, each attribute once")

    @classmethod
    def of(cls, sizes: dict[str, int]) -> Domain:
        return cls(tuple(sizes), tuple(int(n) for n in sizes.values()))

    @classmethod
    def from_json(cls, text: str) -> Domain:
        return cls.of(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(self.config)

    @property
    def config(self) -> dict[str, int]:
        return dict(zip(self.attrs, self.shape))

    def __getitem__(self, attr: str) -> int:
        return self.config[attr]

    def __contains__(self, attr: str) -> bool:
        return attr in self.attrs

    def __len__(self) -> int:
        return len(self.attrs)

    def project(self, attrs: str | Iterable[str]) -> Domain:
        """The given attributes, in the given order."""
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        return Domain(attrs, tuple(self[a] for a in attrs))

    def marginalize(self, attrs: Iterable[str]) -> Domain:
        gone = set(attrs)
        return self.project(a for a in self.attrs if a not in gone)

    invert = marginalize

    def canonical(self, attrs: Iterable[str]) -> tuple[str, ...]:
        """The given attributes in the domain's order."""
        wanted = set(attrs)
        return tuple(a for a in self.attrs if a in wanted)

    def axes(self, attrs: Iterable[str]) -> tuple[int, ...]:
        return tuple(self.attrs.index(a) for a in attrs)

    def transpose(self, attrs: Iterable[str]) -> Domain:
        return self.project(attrs)

    def merge(self, other: Domain) -> Domain:
        """This domain followed by what only the other has."""
        extra = other.marginalize(self.attrs)
        return Domain(self.attrs + extra.attrs, self.shape + extra.shape)

    def contains(self, other: Domain) -> bool:
        return set(other.attrs) <= set(self.attrs)

    def sort(self, by: str = "size") -> Domain:
        return self.project(sorted(self.attrs, key=self.__getitem__ if by == "size" else None))

    def size(self, attrs: Iterable[str] | None = None) -> int:
        return math.prod(self.shape if attrs is None else self.project(attrs).shape)

    def schema(self) -> T.StructType:
        """Integer columns that carry their size as metadata."""
        return T.StructType([T.StructField(a, T.IntegerType(), True, {"size": n}) for a, n in zip(self.attrs, self.shape)])
