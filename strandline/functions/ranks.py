"""Taxonomic ranks: ordinals, names and the main ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranks in order, from the least to the greatest.
RANKS = (
    "sequence", "form", "variety", "subspecies", "species", "subgenus", "genus", "subtribe", "tribe", "subfamily", "family", "suborder", "order", "subclass", "class", "subphylum",
    "phylum", "subkingdom", "kingdom", "domain", "root", "none",
)
SEQUENCE, SPECIES, GENUS, ROOT, NONE = 0, 4, 6, 20, 21
N_RANKS = 21
#: Other names of ranks.
ALIASES = {
    "genome": "sequence", "forma": "form", "varietas": "variety", "species group": "subgenus", "species subgroup": "subgenus", "superfamily": "suborder", "parvorder": "suborder",
    "infraorder": "suborder", "superorder": "subclass", "infraclass": "subclass", "superclass": "subphylum", "division": "phylum", "superphylum": "subkingdom", "subdomain": "kingdom", "superkingdom": "domain",
}
MAIN = ("sequence", "species", "genus", "family", "order", "class", "phylum", "kingdom", "domain", "root")
_ORDINAL = {name: i for i, name in enumerate(RANKS)}
_MAIN = [_ORDINAL[m] for m in MAIN]


def rank_from_name(name: Column) -> Column:
    """The ordinal of a rank's name or alias, in any case; unknown names and null give `none`."""
    table = _ORDINAL | {a: _ORDINAL[r] for a, r in ALIASES.items()}
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, F.lower(name)), F.lit(NONE))


def rank_name(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, RANKS)), rank), F.lit("none"))


def next_main(rank: int) -> int:
    """The least main rank above; `none` above root."""
    return next((m for m in _MAIN if m > rank), NONE)


def prev_main(rank: int) -> int:
    """The greatest main rank below; `none` below sequence."""
    return NONE if rank == NONE else next((m for m in reversed(_MAIN) if m < rank), NONE)


def next_main_rank(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(next_main(r)) for r in range(NONE + 1)]), rank), F.lit(NONE))


def prev_main_rank(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(prev_main(r)) for r in range(NONE + 1)]), rank), F.lit(NONE))


def rank_plus(rank: Column, n: int) -> Column:
    """n ranks up; `root` from `none`."""
    return F.when(rank < N_RANKS, F.least(rank + n, F.lit(NONE))).otherwise(ROOT)


def rank_minus(rank: Column, n: int) -> Column:
    """n ranks down, to `sequence` at least."""
    return F.greatest(rank - n, F.lit(SEQUENCE))
