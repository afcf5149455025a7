"""Dictionaries of relation and entity kinds as column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.schemas import CUSTOM_REL_KIND, ENTITY_KINDS, OTHER, OTHER_ENTITY_KIND, REL_KINDS


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])


def rel_kind_code(name: Column) -> Column:
    """Code of a relation kind; any name outside the dictionary is a custom kind."""
    return F.coalesce(F.element_at(_map(REL_KINDS), name), F.lit(CUSTOM_REL_KIND))


def rel_kind_name(code: Column, custom: Column | None = None) -> Column:
    """Name of a relation code; a custom one has the given name, and an unknown code raises an error."""
    known = F.element_at(_map({v: k for k, v in REL_KINDS.items()}), code.cast("int"))
    other = F.when(code == CUSTOM_REL_KIND, custom if custom is not None else F.lit(None).cast("string")).when(code.isNotNull(), F.raise_error(F.concat(F.lit("unknown relation kind "), code.cast("string"))).cast("string"))
    return F.when(known.isNotNull(), known).otherwise(other)


def entity_kind_code(name: Column) -> Column:
    return F.coalesce(F.element_at(_map(ENTITY_KINDS), name), F.lit(OTHER_ENTITY_KIND))


def entity_kind_name(code: Column) -> Column:
    """Name of an entity code; unknown codes are ``Other``."""
    return F.coalesce(F.element_at(_map({v: k for k, v in ENTITY_KINDS.items()}), code.cast("int")), F.lit(OTHER))


def is_tombstone(value: Column) -> Column:
    """Whether a stored binary value is the deletion marker: exactly one byte 0xFF."""
    return F.coalesce(F.hex(value) == "FF", F.lit(False))
