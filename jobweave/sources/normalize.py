"""The record that every source yields, and the registry of source kinds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.schemas import SCRAPED_LISTING

#: Kind of source: a test over an address, and a function from landed payloads (and what else it takes) to listings.
Normalizer = Callable[..., DataFrame]
REGISTRY: dict[str, tuple[Callable[[Column], Column], Normalizer]] = {}


def register(kind: str, detect: Callable[[Column], Column]) -> Callable[[Normalizer], Normalizer]:
    def add(f: Normalizer) -> Normalizer:
        REGISTRY[kind] = (detect, f)
        return f

    return add


def listing(df: DataFrame) -> DataFrame:
    """The columns of the common record, cast to their types; those that a source lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCRAPED_LISTING.fields])


def normalize(kind: str, *payloads: DataFrame, **options: object) -> DataFrame:
    """Listings of a kind's payloads, given in the order of its function's parameters."""
    return listing(REGISTRY[kind][1](*payloads, **options))


def union_sources(*feeds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [listing(f) for f in feeds])
