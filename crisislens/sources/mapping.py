"""Logical column mapping (metadata only: runs on ``df.columns``, no job)."""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COLUMN_CANDIDATES, REQUIRED_COLUMNS

Mapping = dict[str, "str | None"]


def norm_name(name: object) -> str:
    """Header key: lower-case ASCII letters and digits, everything else one '_' between them."""
    plain = (c for c in unicodedata.normalize("NFKD", f"{name}".lower()) if not unicodedata.combining(c))
    return "_".join(re.findall("[a-z0-9]+", "".join(plain)))


def ranked_columns(columns: Iterable[str], candidates: Iterable[str]) -> list[tuple[int, int, str]]:
    """Every (pass, position, column) by which a logical name could be filled.

    Pass 0 is equality of header keys, at the candidate's position; pass 1 is
    one key within the other, at the column's position in the table.  Of
    columns with one key the last stands for it.
    """
    keys = [norm_name(c) for c in candidates]
    table = {norm_name(c): c for c in columns}
    equal = [(0, keys.index(k), c) for k, c in table.items() if k in keys]
    partial = [(1, i, c) for i, (k, c) in enumerate(table.items()) if any(x and (x in k or k in x) for x in keys)]
    return sorted(equal + partial)


def auto_map_columns(columns: Iterable[str], candidates: dict[str, list[str]] | None = None) -> Mapping:
    """The best-ranked column of each logical name, None without any."""
    table = list(columns)
    best = {}
    for logical, names in (COLUMN_CANDIDATES if candidates is None else candidates).items():
        ranked = ranked_columns(table, names)
        best[logical] = ranked[0][2] if ranked else None
    return best


def missing_columns(mapping: Mapping) -> list[str]:
    """Required logical names that the mapping leaves open."""
    return [name for name in REQUIRED_COLUMNS if not mapping.get(name)]


def resolve_mapping(df: DataFrame, mapping: Mapping | None = None) -> Mapping:
    """Auto mapping, overridden by the caller's entries; raises when a
    required column is missing and warns when one header feeds two names."""
    auto = auto_map_columns(df.columns)
    if mapping is not None:
        auto = {k: None for k in auto}
        auto.update(mapping)
    missing = missing_columns(auto)
    if missing:
        raise ValueError("required columns not found: " + ", ".join(sorted(missing))
                         + "; pass mapping= to name them")
    used: dict[str, list[str]] = {}
    for logical, physical in auto.items():
        if physical:
            used.setdefault(physical, []).append(logical)
    shared = {p: ls for p, ls in used.items() if len(ls) > 1}
    if shared:
        warnings.warn(f"one physical column feeds several logical names: {shared}", stacklevel=2)
    return auto


def select_mapped(df: DataFrame, mapping: Mapping) -> DataFrame:
    """One projection: every mapped physical column under ``src_<logical>``.

    Renaming first avoids Spark's case-insensitive clashes between raw
    headers (``Likes``) and derived names (``likes``)."""
    cols = []
    present = set(df.columns)
    for logical, physical in mapping.items():
        if physical and physical in present:
            cols.append(F.col(f"`{physical}`").alias(f"src_{logical}"))
    return df.select(*cols)
