"""Which state or home place a location string names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .places import STATES
from .text import col, let


def _padded(text: Column) -> Column:
    return F.concat(
        F.lit(" "),
        F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")),
        F.lit(" "),
    )


def state_named(location: Column | str) -> Column:
    """Two-letter state a location names, '' for none. A full name counts
    anywhere, the longest first; a code only right after a comma."""
    names = {n: c.lower() for n, c in STATES.items() if c != "PR"}
    codes = sorted(set(names.values()))
    text = F.lower(F.coalesce(col(location), F.lit("")))

    def spelled(padded: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name in sorted(names, key=lambda n: (-len(n), n)):
            out = out.when(padded.contains(f" {name} "), F.lit(names[name]))
        return out

    after = F.split(text, ",")
    coded = F.filter(
        F.transform(
            F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0))),
            lambda chunk: F.regexp_replace(F.split(F.trim(chunk), " ")[0], r"^[ .]+|[ .]+$", ""),
        ),
        lambda w: w.isin(*codes),
    )
    return F.coalesce(let(_padded(col(location)), spelled), F.try_element_at(coded, F.lit(1)), F.lit(""))


def place_named(location: Column | str, places: Iterable[str], state: str = "") -> Column:
    """The first home place the location names as whole words, else null.
    A location naming another state is refused whatever its city says."""
    wanted = sorted({" ".join("".join(c if c.isalnum() else " " for c in p.lower()).split()): p
                     for p in places if p.strip()}.items())

    def found(padded: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for needle, original in wanted:
            out = out.when(padded.contains(f" {needle} "), F.lit(original))
        return out

    hit = let(_padded(col(location)), found)
    if not state:
        return hit
    return let(
        state_named(location),
        lambda said: F.when((said == "") | (said == state.strip().lower()), hit),
    )
