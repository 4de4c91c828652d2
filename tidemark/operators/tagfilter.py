"""Predicates on tags.

Byte-exact predicates are ordinary filters, which Spark pushes to the files.
Predicates under a collation are not pushed; they are resolved on the series
first, of which there are few, and then restrict the rows by exact values. Up to
IN_LIST of them go into the filter, beyond that rows are joined with the series;
the rows found are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgError

#: Spark collation of the collations that tag predicates are known for, and what
#: is replaced first: these collations give all characters beyond U+FFFF one
#: weight, and sharp s and umlauts the letters named here.
_BEYOND = (r"[\x{10000}-\x{10FFFF}]", "\ufffd")
COLLATIONS = {
    "latin1_swedish_ci": ("UTF8_LCASE_RTRIM", ()),
    "utf8mb4_general_ci": ("UNICODE_CI_AI_RTRIM", (_BEYOND, ("ß", "s"))),
    "utf8mb4_general_nopad_ci": ("UNICODE_CI_AI", (_BEYOND, ("ß", "s"))),
    "utf8mb4_unicode_ci": ("UNICODE_CI_AI_RTRIM", (_BEYOND,)),
    "utf8mb4_uca1400_ai_ci": ("UNICODE_CI_AI_RTRIM", ()),
    "utf8mb4_bin": ("UTF8_BINARY_RTRIM", ()),
    "utf8mb4_nopad_bin": ("UTF8_BINARY", ()),
    "utf8mb4_czech_ci": ("cs_CI_AI_RTRIM", ()),
    "latin1_german2_ci": ("de_CI_AI_RTRIM", (("[äÄ]", "ae"), ("[öÖ]", "oe"), ("[üÜ]", "ue"), ("ß", "ss"))),
}
#: Exact values resolved from a collated predicate are put into the filter up to
#: this number; beyond it, rows are joined with the series.
IN_LIST = 1000


def tag_predicate(predicates: dict[str, object]) -> Column:
    """AND over tags of = or IN, byte-exact. A null value matches nothing, and a
    null in a list is passed over."""

    def one(name: str, value: object) -> Column:
        if isinstance(value, (list, tuple, set, frozenset)):
            return F.col(name).isin(*[v for v in value if v is not None])
        return F.lit(False) if value is None else F.col(name) == F.lit(value)

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in predicates.items()), F.lit(True))


def collated(value: Column, collation: str) -> Column:
    """A value as the collation compares it."""
    name, replaced = COLLATIONS.get(collation, (collation, ()))
    for pattern, by in replaced:
        value = F.regexp_replace(value, pattern, by)
    return F.collate(value, name)


def collated_predicate(predicates: dict[str, object], collation: str) -> Column:
    def one(name: str, value: object) -> Column:
        values = [v for v in (value if isinstance(value, (list, tuple, set, frozenset)) else [value]) if v is not None]
        return collated(F.col(name), collation).isin(*(collated(F.lit(v), collation) for v in values)) if values else F.lit(False)

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in predicates.items()), F.lit(True))


def resolve_series(rows: DataFrame, series: DataFrame, predicates: dict[str, object], collation: str) -> DataFrame:
    """Rows whose tags fit under a collation: matching series are found first,
    their exact values go into the filter of the rows."""
    if not predicates:
        raise InvalidArgError("no predicate")
    tags = list(predicates)
    fits = series.select(*tags).distinct().where(collated_predicate(predicates, collation))
    found = fits.limit(IN_LIST + 1).collect()
    if len(found) <= IN_LIST:
        for t in tags:
            rows = rows.where(F.col(t).isin(*sorted({r[t] for r in found})))
        return rows.where(collated_predicate(predicates, collation)) if len(tags) > 1 else rows
    return rows.join(fits, tags, "left_semi")
