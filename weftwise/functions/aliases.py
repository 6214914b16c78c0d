"""Spellings of one name, as groups, and the search prefixes that they add."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwise.functions.text import short_prefix

# Equivalent spellings.
FIRST_NAMES = [
    ("Mike", "Maik", "Marek"), ("Marc", "Mark"), ("Stefan", "Stephan"), ("Stefanie", "Stephanie"), ("Christina", "Kristina"), ("Phillip", "Philip", "Philipp"), ("Kai", "Kay"), ("Jan", "Yan"), ("Nico", "Niko"),
    ("Lukas", "Lucas", "Luca"), ("Sara", "Sarah"), ("Thomas", "Tomas"), ("Alexander", "Aleksander"), ("Kathrin", "Katrin"), ("Georg", "George"), ("Henrik", "Hendrik"), ("Nicole", "Nikole"), ("Simone", "Simona"),
    ("Veronika", "Veronica"), ("Mathias", "Matthias"), ("Markus", "Marcus"), ("Monika", "Monica"), ("Christian", "Kristian"), ("Michael", "Mikael", "Mikhail"),
]
LAST_NAMES = [("Maier", "Mayer", "Meier", "Meyer")]


def prefix_table(groups: list[tuple[str, ...]]) -> dict[str, list[str]]:
    """For each spelling, the three-letter prefixes of the others that differ from its own."""
    out: dict[str, list[str]] = {}
    for group in groups:
        for name in (g.lower() for g in group):
            found = {o.lower()[:3] for o in group} - {name[:3]}
            if found:
                out[name] = sorted(found)
    return out


def alias_prefixes(name_a: Column, groups: list[tuple[str, ...]]) -> Column:
    """Array of further prefixes for a normalised name; empty if it has no alias."""
    table = F.create_map(*[x for k, v in prefix_table(groups).items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.filter(F.coalesce(F.element_at(table, name_a), F.array().cast("array<string>")), lambda p: p != short_prefix(name_a))
