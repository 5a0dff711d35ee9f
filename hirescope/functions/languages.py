"""Spoken languages a posting requires or prefers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import anywhere, by_letter, cut, let, mentions, spans

# --- fixed values: language names, names that cover each other, cue words --------
LANGUAGES = (
    "american sign language", "sign language", "haitian creole", "spanish", "french",
    "german", "italian", "portuguese", "mandarin", "cantonese", "chinese", "japanese",
    "korean", "vietnamese", "tagalog", "filipino", "arabic", "russian", "hindi", "urdu",
    "bengali", "punjabi", "gujarati", "tamil", "telugu", "farsi", "persian", "dari",
    "pashto", "turkish", "polish", "ukrainian", "hebrew", "greek", "creole", "somali",
    "amharic", "tigrinya", "swahili", "yoruba", "igbo", "thai", "khmer", "lao", "hmong",
    "burmese", "nepali", "dutch", "swedish", "norwegian", "danish", "finnish", "czech",
    "hungarian", "romanian", "serbian", "croatian", "bosnian", "albanian", "armenian",
)
COVERS = {
    "chinese": ("mandarin", "cantonese"), "mandarin": ("chinese",), "cantonese": ("chinese",),
    "tagalog": ("filipino",), "filipino": ("tagalog",), "farsi": ("persian",),
    "persian": ("farsi",), "sign language": ("american sign language",),
    "american sign language": ("sign language",), "creole": ("haitian creole",),
    "haitian creole": ("creole",),
}
NAMES = by_letter(LANGUAGES)
NAME = NAMES[:NAMES.index("(?:")] + r"\b(" + NAMES + r")\b"
CUE = (
    r"(?:(?=[bcfinoprstvw])\b(?:fluen\w*|bilingual|proficien\w*|speak\w*|native|conversational|"
    r"verbal|written|oral|read\w*|writ\w*|interpret\w*|translat\w*))"
)
SPOKEN = (
    CUE + r"(?:\W+\w+){0,3}?\W+(?:in\W+)?" + NAME,
    NAME + r"(?:\W+\w+){0,2}?\W+(?:speak\w*|speaker|fluen\w*|proficien\w*|language|"
    r"bilingual|required|is\s+required|a\s+must|skills?)\b",
    r"(?=e)\benglish\s*(?:/|and|&|\+)\s*" + NAME,
    NAME + r"\s*(?:/|and|&|\+)\s*english\b",
)
#: Without one of these a pattern above finds nothing.
SPOKEN_SIGNS = (
    ("fluen", "bilingual", "proficien", "speak", "native", "conversational", "verbal", "written", "oral", "read",
     "writ", "interpret", "translat"),
    ("speak", "fluen", "proficien", "language", "bilingual", "required", "must", "skill"),
    ("english",),
    ("english",),
)
BILINGUAL = r"(?=b)\bbilingual\b"
MUST = r"(?:required|requirement|must|mandatory|need\w*|essential)"
SOFT = (
    r"(?:preferred|a\s+plus|is\s+a\s+plus|desired|nice\s+to\s+have|bonus|helpful|"
    r"advantage|encouraged)"
)
FRENCH_TITLE = (
    r"\b(?:analyste|d['’]affaires|gestionnaire|conseill[eè]re?|d[ée]veloppeu(?:r|se)|"
    r"ing[ée]nieure?|technicienn?e?|coordonnat(?:eur|rice)|charg[ée]e? de|adjointe?|"
    r"sp[ée]cialiste|responsable de|agente? de)\b"
)
#: How the names of FRENCH_TITLE begin, written out.
FRENCH_STEMS = (
    "analyste", "d'affaires", "d’affaires", "gestionnaire", "conseill", "développeu", "developpeu",
    "ingénieu", "ingenieu", "technicien", "coordonnat", "chargé", "charge", "adjoint",
    "spécialiste", "specialiste", "responsable de", "agent",
)
WINDOW, SOFT_BEFORE = 60, 25
SPANS = "array<struct<begin:int,stop:int,hit:string>>"
#: Where a word starts that begins like one of the names: what stands before is looked at first.
SIGNS = "[^a-z]" + anywhere((*LANGUAGES, "bilingual", *FRENCH_STEMS))


def spoken_set(languages: Iterable[str]) -> set[str]:
    """What a profile speaks: English, what it lists, and names those cover."""
    have = {"english"} | {x.strip().lower() for x in languages if x.strip()}
    return have | {c for name in have for c in COVERS.get(name, ())}


def _ask(name: Column, soft: Column) -> Column:
    return F.struct(name.alias("name"), soft.alias("soft"))


def _asks_in(text: Column, soft_half: bool) -> Column:
    def read(t: Column) -> Column:
        def soft(s: Column) -> Column:
            if soft_half:
                return F.lit(True)
            return cut(t, s["begin"] - SOFT_BEFORE, s["stop"] + WINDOW).rlike(SOFT)

        def found_by(rx: str, signs: tuple[str, ...]) -> Column:
            return F.transform(
                F.when(mentions(t, signs), spans(t, rx)).otherwise(F.array().cast(SPANS)),
                lambda s: F.struct(
                    s["begin"].alias("begin"), s["stop"].alias("stop"),
                    F.regexp_extract(s["hit"], rx, 1).alias("name"), soft(s).alias("soft"),
                ),
            )

        found = [found_by(rx, signs) for rx, signs in zip(SPOKEN, SPOKEN_SIGNS, strict=True)]

        def with_bare(named: Column) -> Column:
            bare = F.filter(
                F.transform(
                    F.filter(
                        spans(t, BILINGUAL),
                        lambda s: ~F.exists(
                            named, lambda n: (n["begin"] <= s["begin"]) & (s["begin"] < n["stop"])
                        ),
                    ),
                    lambda s: F.struct(
                        F.lit("bilingual").alias("name"),
                        soft(s).alias("soft"),
                        cut(t, s["begin"] - WINDOW, s["stop"] + WINDOW).rlike(MUST).alias("must"),
                    ),
                ),
                lambda b: b["soft"] | b["must"],
            )
            return F.concat(
                F.transform(named, lambda n: _ask(n["name"], n["soft"])),
                F.transform(bare, lambda b: _ask(b["name"], b["soft"])),
            )

        return let(F.concat(*found), with_bare)

    return let(text, read)


def language_asks(title: Column, binding: Column, tail: Column) -> Column:
    """struct(must, nice), names in the order they are met. A language in
    the title is required; a wish word beside a name makes it a preference."""
    low = F.lower(title)
    none = F.array().cast("array<struct<name:string,soft:boolean>>")
    in_title = F.concat(
        F.transform(
            F.regexp_extract_all(low, F.lit(NAME), F.lit(1)), lambda n: _ask(n, F.lit(False))
        ),
        F.when(low.rlike(FRENCH_TITLE), F.array(_ask(F.lit("french"), F.lit(False)))).otherwise(none),
        F.when(low.rlike(BILINGUAL), F.array(_ask(F.lit("bilingual"), F.lit(False)))).otherwise(none),
    )
    every = F.concat(in_title, _asks_in(F.lower(binding), False), _asks_in(F.lower(tail), True))

    none_asked = F.struct(
        F.array().cast("array<string>").alias("must"), F.array().cast("array<string>").alias("nice")
    )

    def split(asks: Column) -> Column:
        names = F.transform(asks, lambda a: a["name"])
        first = F.filter(asks, lambda a, i: F.array_position(names, a["name"]) == i + 1)
        return let(
            first,
            lambda f: F.struct(
                F.transform(F.filter(f, lambda a: ~a["soft"]), lambda a: a["name"]).alias("must"),
                F.transform(F.filter(f, lambda a: a["soft"]), lambda a: a["name"]).alias("nice"),
            ),
        )

    # Most postings name no language, and one look settles that.
    text = F.lower(F.concat_ws("\n", F.lit(""), title, binding, tail))
    # Words that share their beginnings are looked for first, as the whole names cost
    # sixty tries at every word.
    named = text.rlike(SIGNS) & text.rlike(NAME + "|" + BILINGUAL + "|" + FRENCH_TITLE)
    return F.when(named, let(every, split)).otherwise(none_asked)


def unspoken(names: Column, languages: Iterable[str]) -> Column:
    """The asked names the profile does not speak; 'bilingual' is met by any
    language besides English."""
    have = spoken_set(languages)
    if have - {"english"}:
        have = have | {"bilingual"}
    return F.filter(names, lambda n: ~n.isin(*sorted(have)))


def is_language_phrase(phrase: str) -> bool:
    """Whether a dealbreaker phrase is about speaking a language."""
    low = " " + "".join(c if c.isalnum() else " " for c in phrase.lower()) + " "
    return any(f" {w} " in low for w in (*LANGUAGES, "bilingual")) or " fluen" in low
