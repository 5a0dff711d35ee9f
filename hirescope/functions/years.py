"""Years of experience written in a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import anywhere, cut, let, mentions, spans

# --- fixed values: number words and the phrasings that matter ------------------
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
YEARS = (
    r"(?i)(?=\d)(?<!\d)(\d{1,2})\)?\s*\+?\s*(?:(?:-|to|–|—)\s*(\d{1,2})\s*)?\+?\s*"
    r"(?:or\s+(?:more|greater)\s+)?years?\b"
)
DEGREE_SWAP = (
    r"(?i)(?:in\s+lieu\s+of\s+(?:a|an|the)?\s*(?:\w+\s+){0,2}degree"
    r"|without\s+a\s+(?:\w+\s+)?degree|high\s+school\s+diploma|\bged\b)"
    r"[^.;]{0,60}?\d{1,2}\s*\+?\s*(?:or\s+more\s+)?years?"
)
#: One of these stands in every such phrase.
DEGREE_WORDS = ("lieu", "without", "diploma", "ged")
MONTHS = (
    r"(?i)(?=\d)(?<!\d)(?<!within\s)(?<!first\s)(?<!after\s)(\d{1,2})\s*"
    r"(?:(?:-|to|–|—)\s*(\d{1,2})\s*)?\+?\s*months?(?:'|’)?\s+[^.;\n]{0,60}?experience"
)
HISTORY_BEFORE = (
    r"(?i)(?:\bfor|\b(?:over|in|during)\s+the\s+(?:last|past)|\bthe\s+(?:last|past)"
    r"|\bterm(?:\s+of)?\s*:?|\bafter|\bcelebrating|\bnearly|\bfounded\s+\w+)"
    r"\s*(?:over\s+|more\s+than\s+|almost\s+)?$"
)
HISTORY_AFTER = (
    r"(?i)^\W{0,3}(?:running|ago|in\s+business|contract|of\s+(?:service|history"
    r"|excellence|serving|training)|old\b|history|strong)"
)
PREFERRED_MARKER = (
    r"(?i)(?=[pnbd])(preferred qualification|preferred experience|nice to have|"
    r"bonus points|desired qualification|plus(?:es)?:)"
)
TAIL_CUE = "(?i)" + anywhere((
    "required", "requirement", "minimum", "must have", "at least",
    "relevant work experience", "years of experience",
))
GATE_CUE = "(?i)" + anywhere((
    "experience", "require", "required", "minimum", "must have", "at least",
    "qualification", "background in", "track record", "proficien",
))
#: From where a clause is over to the end.
CLAUSE_OVER = r"(?s)(?:[.;\n•]|\s-\s).*"
TAIL_WINDOW, GATE_WINDOW, CLAUSE_WINDOW, MARKER_FROM, MAX_YEARS = 60, 90, 140, 200, 20


BANDS = (
    "array<struct<low:int,high:int,history:boolean,gated:boolean,tail_gated:boolean,clause:string>>"
)


def numerals(text: Column) -> Column:
    """Spelled numbers (with a bracketed copy) become digits; years offered in
    place of a degree are taken out."""
    spelled = text
    for word, n in NUMBER_WORDS.items():
        spelled = F.regexp_replace(spelled, rf"(?i)\b{word}\b(?:\s*\(\s*\d{{1,2}}\s*\))?", str(n))
    any_word = rf"(?i)(?=[efnost])\b(?:{'|'.join(NUMBER_WORDS)})\b"
    digits = F.when(text.rlike(any_word), spelled).otherwise(text)
    swap = mentions(F.lower(text), DEGREE_WORDS)
    return F.when(swap, F.regexp_replace(digits, DEGREE_SWAP, " ")).otherwise(digits)


def marker_at(body: Column) -> Column:
    """1-based position of the first 'preferred' marker, 0 when there is none."""
    return F.regexp_instr(body, F.lit(PREFERRED_MARKER))


def binding_text(body: Column, at: Column | None = None) -> Column:
    """The half of a posting that states real requirements. ``at`` is ``marker_at``
    of the body, where the caller has it."""
    return let(
        F.struct(body.alias("b"), (marker_at(body) if at is None else at).alias("p")),
        lambda s: F.when(s["p"] > MARKER_FROM + 1, F.substring(s["b"], F.lit(1), s["p"] - 1)).otherwise(s["b"]),
    )


def preferred_tail(body: Column, at: Column | None = None) -> Column:
    """Whatever the binding text left out."""
    return let(
        F.struct(body.alias("b"), (marker_at(body) if at is None else at).alias("p")),
        lambda s: F.when(
            s["p"] > MARKER_FROM + 1, F.substring(s["b"], s["p"], F.length(s["b"]))
        ).otherwise(F.lit("")),
    )


def _history(before: Column, after: Column) -> Column:
    return before.rlike(HISTORY_BEFORE) | after.rlike(HISTORY_AFTER)


def year_bands(text: Column) -> Column:
    """Every years figure as (low, high) with what stands around it.

    ``text`` has digits already (see numerals). "3-5 years" is (3, 5), a bare
    "5+ years" is (5, 5); "0 years" says nothing.
    """

    def read(t: Column) -> Column:
        def one(s: Column) -> Column:
            low = F.regexp_extract(s["hit"], YEARS, 1).cast("int")
            top = F.nullif(F.regexp_extract(s["hit"], YEARS, 2), F.lit("")).cast("int")
            band = F.struct(low.alias("low"), top.alias("top"))
            return let(band, lambda b: around(s, b["low"], b["top"]))

        def around(s: Column, low: Column, top: Column) -> Column:
            return F.struct(
                low.alias("low"),
                F.when((top >= low) & (top <= MAX_YEARS), top).otherwise(low).alias("high"),
                _history(
                    cut(t, s["begin"] - 40, s["begin"]), cut(t, s["stop"], s["stop"] + 30)
                ).alias("history"),
                cut(t, s["begin"] - GATE_WINDOW, s["stop"] + GATE_WINDOW)
                .rlike(GATE_CUE).alias("gated"),
                cut(t, s["begin"] - TAIL_WINDOW, s["stop"] + TAIL_WINDOW)
                .rlike(TAIL_CUE).alias("tail_gated"),
                F.lower(
                    F.regexp_replace(cut(t, s["stop"], s["stop"] + CLAUSE_WINDOW), CLAUSE_OVER, "")
                ).alias("clause"),
            )

        read_all = F.filter(
            F.transform(spans(t, YEARS), one),
            lambda b: (b["low"] <= MAX_YEARS) & (b["high"] > 0),
        )
        return F.when(t.rlike("(?i)year"), read_all).otherwise(F.array().cast(BANDS))

    return let(text, read)


def month_bands(text: Column) -> Column:
    """Months of experience as whole years: "6-12 months" is (0, 1)."""

    def read(t: Column) -> Column:
        def one(s: Column) -> Column:
            low = F.regexp_extract(s["hit"], MONTHS, 1).cast("int")
            top = F.coalesce(
                F.nullif(F.regexp_extract(s["hit"], MONTHS, 2), F.lit("")).cast("int"), low
            )
            return F.struct(
                F.floor(low / 12).cast("int").alias("low"),
                F.greatest(F.lit(1), F.floor((top + 11) / 12).cast("int")).alias("high"),
                _history(
                    cut(t, s["begin"] - 40, s["begin"]), cut(t, s["stop"], s["stop"] + 30)
                ).alias("history"),
            )

        read_all = F.filter(F.transform(spans(t, MONTHS), one), lambda b: ~b["history"])
        return F.when(t.rlike("(?i)month"), read_all).otherwise(
            F.array().cast("array<struct<low:int,high:int,history:boolean>>")
        )

    return let(text, read)


def _pairs(bands: Column) -> Column:
    return F.transform(bands, lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high")))


def required_band(bands: Column, months: Column, tail: Column) -> Column:
    """Highest binding floor and highest binding ceiling, null if unsaid."""
    every = F.concat(
        _pairs(F.filter(bands, lambda b: ~b["history"])),
        _pairs(months),
        _pairs(F.filter(tail, lambda b: b["tail_gated"])),
    )
    return let(
        every,
        lambda bs: F.when(
            F.size(bs) > 0,
            F.struct(
                F.array_max(F.transform(bs, lambda b: b["low"])).alias("low"),
                F.array_max(F.transform(bs, lambda b: b["high"])).alias("high"),
            ),
        ),
    )


def gating_years(bands: Column, tail: Column) -> Column:
    """The figure that blocks: a requirement cue must stand near it."""
    return F.array_max(
        F.concat(
            F.transform(F.filter(bands, lambda b: b["gated"] & ~b["history"]), lambda b: b["low"]),
            F.transform(F.filter(tail, lambda b: b["tail_gated"]), lambda b: b["low"]),
        )
    )
