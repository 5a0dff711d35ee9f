"""Pay written in a posting body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut, let, mentions, spans, zero_to_null

# --- fixed values: amounts, ranges, cues and the plausible bands ----------------
USD = r"(?=[Uu$])(?<![A-Za-z])(?:US)?\$"
AMOUNT = USD + r"\s?(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)\s*(k\b)?"
DASH = r"(?:-|–|—|&[mn]dash;|\bto\b)"
FILLER = (
    r"(?:\s|<[^>]{0,120}>|&nbsp;|&amp;|USD|/\s*(?:yr|year|hr|hour)"
    r"|per\s+(?:year|hour|annum)|annually|hourly)*"
)
RANGE = "(?i)" + AMOUNT + FILLER + DASH + FILLER + AMOUNT
LABEL_AMOUNT = (
    r"((?:US)?\$)?\s?(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)\s*(k\b)?"
)
LABELLED = (
    r"(?i)\b(?:minimum|min\.?|low(?:est)?|starting)\b[^0-9$\n]{0,40}?" + LABEL_AMOUNT
    + r"[^0-9$]{0,60}?\b(?:maximum|max\.?|high(?:est)?|up\s+to)\b[^0-9$\n]{0,40}?" + LABEL_AMOUNT
)
#: One of these names the top of every labelled band.
TOP_WORDS = ("max", "high", "up")
SINGLE = "(?i)" + AMOUNT
HOURLY = (
    "(?i)" + USD + r"\s?(\d{1,3}(?:\.\d{1,2})?)\s*(?:/|\s+per\s+|\s+an\s+)\s*(?:hr|hour)"
)
PAY_CUE = (
    r"(?i)(?=[bchprsw])\b(?:salary|compensation|pay\s*[-\s]?range|pay\s+band|pay\s+rate"
    r"|base\s+pay|hourly\s+rate|wage|remuneration|hiring\s+range"
    r"|class=\"pay-range\")"
)
MAGNITUDE = r"(?i)^\s*(?:[bm]\b|bn\b|billion|million|trillion)"
HOUR_LOW, HOUR_HIGH = 7.0, 300.0
YEAR_LOW, YEAR_HIGH = 15_000.0, 900_000.0
HOURS_A_YEAR = 2080
RANGE_SPAN, CUE_RANGE, CUE_SINGLE = 6, 300, 200


def written_annual(raw: Column, kilo: Column) -> Column:
    """One written amount as annual pay, null when it cannot be pay. What is read from
    the text is bound, as the tests below would read it again for each use."""

    def value(s: Column) -> Column:
        return F.struct(
            F.when(s["thousands"], s["number"] * 1000).otherwise(s["number"]).alias("v"),
            s["thousands"].alias("thousands"),
        )

    def plausible(s: Column) -> Column:
        return F.when(s["v"].between(YEAR_LOW, YEAR_HIGH), s["v"]).when(
            s["v"].between(HOUR_LOW, HOUR_HIGH) & ~s["thousands"], s["v"] * HOURS_A_YEAR
        )

    number = F.regexp_replace(raw, ",", "").try_cast("double")
    thousands = F.coalesce(kilo, F.lit("")) != ""
    return let(let(F.struct(number.alias("number"), thousands.alias("thousands")), value), plausible)


def _band(lo: Column, hi: Column) -> Column:
    """A band struct when both ends are pay and in order, else null."""
    return let(
        F.struct(lo.alias("lo"), hi.alias("hi")),
        lambda b: F.when(
            b["lo"].isNotNull() & (b["hi"] >= b["lo"]) & (b["hi"] <= b["lo"] * RANGE_SPAN), b
        ),
    )


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda b: b.isNotNull()), F.lit(1))


def _groups(hit: Column, pattern: str, *numbers: int) -> list[Column]:
    return [F.regexp_extract(hit, pattern, n) for n in numbers]


def range_in(text: Column) -> Column:
    """The first plausible pay range of a stretch of text."""

    def read(t: Column) -> Column:
        def one(s: Column) -> Column:
            a, ak, b, bk = _groups(s["hit"], RANGE, 1, 2, 3, 4)
            return F.when(
                ~cut(t, s["stop"], s["stop"] + 16).rlike(MAGNITUDE),
                _band(written_annual(a, ak), written_annual(b, bk)),
            )

        return F.when(t.contains("$"), _first(F.transform(spans(t, RANGE), one)))

    return let(text, read)


def labelled_in(text: Column) -> Column:
    """A 'minimum ... maximum ...' band."""

    def end(dollar: Column, raw: Column, kilo: Column) -> Column:
        bare = (dollar == "") & (kilo == "")
        small = F.regexp_replace(raw, ",", "").try_cast("double") < YEAR_LOW
        return F.when(~(bare & small), written_annual(raw, kilo))

    def one(hit: Column) -> Column:
        d1, r1, k1, d2, r2, k2 = _groups(hit, LABELLED, 1, 2, 3, 4, 5, 6)
        return _band(end(d1, r1, k1), end(d2, r2, k2))

    def read(t: Column) -> Column:
        bands = F.transform(F.regexp_extract_all(t, F.lit(LABELLED), F.lit(0)), one)
        return F.when(mentions(F.lower(t), TOP_WORDS), _first(bands))

    return let(text, read)


def _floor_in(text: Column) -> Column:
    def read(t: Column) -> Column:
        def one(s: Column) -> Column:
            raw, kilo = _groups(s["hit"], SINGLE, 1, 2)
            return F.when(
                ~cut(t, s["stop"], s["stop"] + 16).rlike(MAGNITUDE), written_annual(raw, kilo)
            )

        return F.when(t.contains("$"), _first(F.transform(spans(t, SINGLE), one)))

    return let(text, read)


def salary_in(text: Column) -> Column:
    """R05, body part: near a cue, anywhere, a lone hourly rate, one floor."""
    has_figure = text.rlike(r"\d")

    def read(t: Column) -> Column:
        cues = spans(t, PAY_CUE)

        def passes(cs: Column) -> Column:
            near = _first(
                F.transform(
                    cs,
                    lambda c: let(
                        cut(t, c["begin"], c["begin"] + CUE_RANGE),
                        lambda w: F.coalesce(range_in(w), labelled_in(w)),
                    ),
                )
            )
            hourly = let(
                F.regexp_extract(t, HOURLY, 1).try_cast("double"),
                lambda rate: F.when(
                    rate.between(HOUR_LOW, HOUR_HIGH),
                    F.struct((rate * HOURS_A_YEAR).alias("lo"), (rate * HOURS_A_YEAR).alias("hi")),
                ),
            )
            floor = _first(
                F.transform(cs, lambda c: _floor_in(cut(t, c["begin"], c["begin"] + CUE_SINGLE)))
            )
            only = let(
                floor,
                lambda lo: F.when(
                    lo.isNotNull(), F.struct(lo.alias("lo"), F.lit(None).cast("double").alias("hi"))
                ),
            )
            dollars = t.contains("$")
            return F.coalesce(
                near, F.when(dollars, F.coalesce(range_in(t), hourly, only))
            )

        return let(cues, passes)

    return F.when(has_figure, let(text, read))


def parse_salary(description: Column, salary_min: Column, salary_max: Column) -> Column:
    """struct(lo, hi, stated). A board's own figure wins unless it is too
    small to be a salary."""
    low, high = zero_to_null(salary_min), zero_to_null(salary_max)
    top = F.coalesce(high, low)
    stated = top >= YEAR_LOW
    return F.when(
        stated, F.struct(low.alias("lo"), high.alias("hi"), F.lit(True).alias("stated"))
    ).otherwise(
        let(
            salary_in(F.coalesce(description, F.lit(""))),
            lambda b: F.struct(
                b["lo"].alias("lo"), b["hi"].alias("hi"), F.lit(False).alias("stated")
            ),
        )
    )


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.bround(c), 0))


def salary_text(low: Column, high: Column) -> Column:
    """The band as a reader sees it, '' when unknown."""
    lo, hi = zero_to_null(low), zero_to_null(high)
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), F.concat(dollars(lo), F.lit("-"), dollars(hi)))
        .when(lo.isNotNull(), F.concat(dollars(lo), F.lit("+")))
        .when(hi.isNotNull(), F.concat(F.lit("up to "), dollars(hi)))
        .otherwise(F.lit(""))
    )
