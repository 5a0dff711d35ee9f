"""Where a posting is: the market it competes in and the state it names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squash

# --- fixed values: state names and codes -------------------------------------
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI",
    "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "puerto rico": "PR", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX",
    "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
# --- fixed values: cities that are written without their state ---------------
CITIES = {
    "new york city": "NY", "new york": "NY", "nyc": "NY", "san francisco": "CA",
    "los angeles": "CA", "san diego": "CA", "boston": "MA", "chicago": "IL",
    "seattle": "WA", "austin": "TX", "dallas": "TX", "houston": "TX",
    "atlanta": "GA", "denver": "CO", "philadelphia": "PA", "phoenix": "AZ",
    "miami": "FL", "richmond": "VA", "washington": "DC", "washington dc": "DC",
    "arlington": "VA", "charlotte": "NC", "nashville": "TN", "portland": "OR",
    "minneapolis": "MN", "detroit": "MI", "pittsburgh": "PA", "baltimore": "MD",
    "st louis": "MO", "tampa": "FL", "orlando": "FL",
}
REMOTE_WORDS = "remote|anywhere|work from home|distributed|wfh"


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def region(location: Column | str, remote: Column | str) -> Column:
    """Remote, a state code, or Elsewhere. Remote beats a city named beside it;
    the last comma piece that is a state wins, then the first known city."""
    codes = {code.lower(): code for code in STATES.values()} | STATES
    remote = F.col(remote) if isinstance(remote, str) else remote

    def decide(text: Column) -> Column:
        pieces = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda p: p != "")
        states = F.filter(
            F.transform(
                pieces,
                lambda p: F.try_element_at(
                    lookup(codes), F.lower(F.trim(F.regexp_replace(p, r"\(.*?\)", "")))
                ),
            ),
            lambda s: s.isNotNull(),
        )
        cities = F.filter(
            F.transform(
                pieces,
                lambda p: F.try_element_at(
                    lookup(CITIES), F.trim(F.regexp_replace(F.lower(p), "[^a-z ]", ""))
                ),
            ),
            lambda s: s.isNotNull(),
        )
        return F.coalesce(
            F.try_element_at(states, F.lit(-1)),
            F.try_element_at(cities, F.lit(1)),
            F.lit("Elsewhere"),
        )

    return let(
        squash(location),
        lambda text: F.when(
            F.coalesce(remote, F.lit(False)) | F.lower(text).rlike(REMOTE_WORDS), F.lit("Remote")
        )
        .when(text == "", F.lit("Elsewhere"))
        .otherwise(decide(text)),
    )


def place_label(place: Column) -> Column:
    return (
        F.when(place == "Remote", F.lit("remote roles"))
        .when(place == "Elsewhere", F.lit("unparsed locations"))
        .otherwise(place)
    )
