"""Identity and grouping keys. Five title keys look alike and are not: each
has its own rule, so each has its own function."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_ALNUM, alnum, col, in_turn, let, pieces, squash, trailing_dropped, word_list

# --- fixed values ------------------------------------------------------------
MARKET_LEVELS = (
    r"(?=[aeijlmpsv123])\b(senior|sr|junior|jr|lead|principal|staff|entry.level|mid.level|"
    r"associate|i{1,3}|iv|v|1|2|3)\b"
)
ROLE_LEVELS = r"\b(i{1,3}|iv|v|1|2|3|jr|sr|junior|senior|associate|lead)\b"
DIVISION_FULL = {
    "dept": "department", "depts": "department", "div": "division",
    "svcs": "services", "svc": "service", "admin": "administration",
    "med": "medical", "rec": "recreation", "univ": "university",
    "comm": "commission", "auth": "authority", "&": "and",
}
DIVISION_DROP = ("of", "the", "for", "and", "a")
DECORATION = (
    "hybrid", "remote", "onsite", "on", "site", "w2", "1099", "c2c", "local",
    "locals", "candidate", "candidates", "resident", "residents", "applicant",
    "applicants", "must", "be", "current", "only", "in", "usa", "us",
    "contract", "fulltime", "full", "time", "position", "immediate", "urgent",
    "hiring", "job", "id", "no", "and", "or", "the",
)
COMPANY_SUFFIXES = (
    "inc", "inc.", "llc", "l.l.c.", "corp", "corp.", "corporation", "co", "co.", "company",
    "ltd", "ltd.", "plc", "group", "holdings", "incorporated", "limited",
)
COMPANY_GENERIC = (
    "financial", "health", "healthcare", "group", "systems", "system",
    "technologies", "technology", "bank", "holdings", "industries",
    "partners", "services", "solutions", "company", "companies",
    "enterprises", "international", "global", "usa", "us", "america",
    "american", "national",
)


def dedupe_key(company: Column | str = "company", title: Column | str = "title") -> Column:
    # No squashing first: of white space nothing stays anyway.
    return alnum(F.concat(*[F.coalesce(col(c), F.lit("")) for c in (company, title)]))


def uid(key: Column | str = "dedupe_key") -> Column:
    return F.substring(F.sha1(col(key).cast("binary")), 1, 16)


def company_key(c: Column | str) -> Column:
    return alnum(c)


def role_key(title: Column | str) -> Column:
    """Application cooldown key: level words out, alphanumerics only."""
    low = F.lower(F.coalesce(col(title), F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, ROLE_LEVELS, " "), "[^a-z0-9]+", "")


def division_key(division: Column | str) -> Column:
    """Division names folded so their usual abbreviations agree."""
    full = F.create_map(*[F.lit(x) for kv in DIVISION_FULL.items() for x in kv])
    words = F.split(F.lower(F.coalesce(col(division), F.lit(""))), "[^a-z0-9&]+")
    spelled = F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w))
    return F.array_join(F.filter(spelled, lambda w: (w != "") & ~w.isin(*DIVISION_DROP)), "")


def market_role(title: Column | str) -> Column:
    """Role inside a peer group: punctuation and seniority words out."""
    low = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), NOT_ALNUM, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, MARKET_LEVELS, " "), " {2,}", " "))


def discovery_title(title: Column | str) -> Column:
    """Exact-match key for board confirmation: case and punctuation only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), NOT_ALNUM + "+", " "))


def repost_title(title: Column | str, places: Iterable[str] = ()) -> Column:
    """A title with the sales copy taken off, for repost grouping.

    Bracketed spans and trailing segments go when every word in them is
    decoration or a number; a leading organisation acronym goes; trailing
    decoration words and long numbers go.
    """
    decor = sorted(set(DECORATION) | {w for p in places for w in _plain_words(p)})

    def is_decor(text: Column) -> Column:
        return let(
            word_list(text),
            lambda ws: (F.size(ws) > 0)
            & F.forall(ws, lambda w: w.isin(*decor) | w.rlike(r"^\d+$")),
        )

    raw = F.coalesce(col(title), F.lit(""))
    bracket = r"[(\[{][^)\]}]*[)\]}]"
    # The text outside brackets and, between, the brackets worth keeping.
    text = F.array_join(
        F.transform(
            in_turn(raw, bracket),
            lambda x, i: F.when((i % 2 == 1) & is_decor(x), F.lit(" ")).otherwise(x),
        ),
        "",
    )
    parts = F.filter(
        let(text, lambda x: pieces(x, r"(?=[|\s])(?:\||\s+-+\s+)")), lambda p: F.trim(p) != ""
    )

    def drop_tail(ps: Column) -> Column:
        # The first part always stays, however decorative.
        return F.concat(
            F.slice(ps, 1, 1),
            trailing_dropped(F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), is_decor),
        )

    def drop_acronym(ps: Column) -> Column:
        short = F.length(F.regexp_replace(F.lower(ps[0]), "[^a-z0-9]+", "")) <= 4
        return F.when((F.size(ps) > 1) & short, F.slice(ps, F.lit(2), F.size(ps) - 1)).otherwise(ps)

    kept = let(
        parts,
        lambda ps: F.when(F.size(ps) > 1, let(drop_tail(ps), drop_acronym)).otherwise(ps),
    )
    words = trailing_dropped(
        word_list(F.array_join(kept, " ")), lambda w: w.isin(*decor) | w.rlike(r"^\d{3,}$")
    )
    return F.array_join(words, " ")


def _plain_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]


def company_words(name: Column | str) -> Column:
    """The words that identify a company; legal and generic tails are dropped."""
    generic = sorted(set(COMPANY_SUFFIXES) | set(COMPANY_GENERIC))

    def trim_tail(ws: Column) -> Column:
        return F.concat(
            F.slice(ws, 1, 1),
            trailing_dropped(
                F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))),
                lambda w: w.isin(*generic),
            ),
        )

    return let(word_list(name), lambda ws: F.when(F.size(ws) > 1, trim_tail(ws)).otherwise(ws))


def same_company_key(name: Column | str) -> Column:
    """Equal keys mean the same company; '' never matches anything."""
    return F.array_join(company_words(name), " ")


# --- fixed values: role nouns, level words, and leads split from their phrase --
ROLE_NOUN = (
    r"(analyst|specialist|engineer|developer|scientist|manager|coordinator|administrator|"
    r"technician|consultant|tester|architect|associate|representative|officer|accountant|"
    r"auditor|investigator|assistant|designer|programmer|clerk|strategist|writer)s?"
)
FAMILY_LEVELS = (
    r"\b(senior|sr|junior|jr|entry[- ]level|principal|staff|mid[- ]level|level|lead|i{1,3}|iv|"
    r"[1-5]|trainee|intern|apprentice|remote|hybrid|onsite|temporary|contract|part[- ]time|"
    r"full[- ]time)\b\.?"
)
TITLE_BREAKS = r"\s[-–—|]\s|[(),:|]|\s-\s?"
SPLIT_LEADS = {
    "desk": "help desk", "intelligence": "business intelligence", "system": "systems",
    "quality": "quality", "service": "service",
}


def title_family(title: Column | str) -> Column:
    """The role noun of a title and the word before it, '' when it names none.

    The first comma/dash part that holds a role noun answers. When the noun
    opens its part, the last two words of the next part name the field.
    """
    lead_full = F.create_map(*[F.lit(x) for kv in SPLIT_LEADS.items() for x in kv])
    parts = F.filter(
        F.split(F.coalesce(col(title), F.lit("")), TITLE_BREAKS), lambda p: F.trim(p) != ""
    )

    def no_level(p: Column) -> Column:
        return F.regexp_replace(F.lower(p), FAMILY_LEVELS, " ")

    def read(p: Column, following: Column) -> Column:
        words = F.regexp_extract_all(
            F.regexp_replace(no_level(p), "/", " "), F.lit("[a-z&+#.]+"), F.lit(0)
        )

        def named(ws: Column) -> Column:
            at = F.array_position(F.transform(ws, lambda w: w.rlike(f"^{ROLE_NOUN}$")), True)
            before = F.filter(F.slice(ws, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))),
                              lambda w: w.rlike("^[a-z]+$"))
            after = F.filter(
                F.regexp_extract_all(no_level(following), F.lit("[a-z]+"), F.lit(0)),
                lambda w: ~w.isin("analytics", "and", "of", "the"),
            )
            tail = F.array_join(
                F.slice(after, F.greatest(F.size(after) - 1, F.lit(1)), F.lit(2)), " "
            )
            last = F.try_element_at(before, F.lit(-1))
            lead = F.coalesce(
                F.try_element_at(lead_full, last),
                last,
                F.when(following.isNotNull() & (tail != ""),
                       F.coalesce(F.try_element_at(lead_full, tail), tail)),
                F.lit(""),
            )
            noun = F.try_element_at(ws, at.cast("int"))
            single = F.when(noun.endswith("s") & ~noun.endswith("ss"),
                            F.regexp_replace(noun, "s+$", "")).otherwise(noun)
            return F.when(at > 0, F.trim(F.concat(lead, F.lit(" "), single)))

        return let(words, named)

    found = let(
        parts,
        lambda ps: F.filter(
            F.transform(ps, lambda p, i: read(p, F.try_element_at(ps, i + 2))),
            lambda x: x.isNotNull(),
        ),
    )
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
