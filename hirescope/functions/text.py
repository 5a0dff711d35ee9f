"""Column helpers for text. Everything stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Unicode means it, including the non-breaking space.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Inside a higher-order function an outer expression is evaluated again for
    every element; passing it as the element of a one-item array is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def each(df: DataFrame, array: Column, alias: str, *keep: Column | str, pos: str = "") -> DataFrame:
    """One row per element. The outer form with a null test on the element:
    a plain explode makes the optimizer test the size of ``array`` below the
    projection, which would compute an expensive array twice."""
    gen = F.posexplode_outer(array).alias(pos, alias) if pos else F.explode_outer(array).alias(alias)
    return df.select(*keep, gen).filter(F.col(alias).isNotNull())


def squash(c: Column | str) -> Column:
    """Null to '', whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE + "+", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(squash(c), F.lit(""))


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(col(c).cast("double"), F.lit(0.0))


#: A class of single characters is one look into a table, where ranges are tried one by one.
NOT_ALNUM = "[^abcdefghijklmnopqrstuvwxyz0123456789]"


def alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), NOT_ALNUM + "+", "")


def word_list(c: Column | str) -> Column:
    """Lower-case alphanumeric words, in order."""
    apart = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), NOT_ALNUM + "+", " ")
    return F.filter(F.split(apart, " ", -1), lambda w: w != "")


def either(words: Iterable[str]) -> str:
    """A regex alternation of literal words, longest first."""
    return "|".join(quoted(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def quoted(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def whole(words: Iterable[str]) -> str:
    """Case-blind pattern: any of the words, not glued to other alphanumerics."""
    return rf"(?i)(?<![a-z0-9])(?:{either(words)})(?![a-z0-9])"


NEVER = r"(?!)"


def one_of(chars: Iterable[str]) -> str:
    """A class of single characters."""
    return "[" + "".join(re.sub(r"([\\\]\[^&\-])", r"\\\1", c) for c in sorted(set(chars))) + "]"


def anywhere(words: Iterable[str]) -> str:
    """A pattern found where any of the words is, for tests alone. Words share their
    beginnings, so that a place is given up at its first letter instead of once a word;
    a word that begins another stands for both."""

    def tree(rest: list[str]) -> str:
        if "" in rest:
            return ""
        groups: dict[str, list[str]] = {}
        for w in rest:
            groups.setdefault(w[0], []).append(w[1:])
        arms = [quoted(c) + tree(tails) for c, tails in sorted(groups.items())]
        return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"

    words = sorted(set(words))
    return f"(?={one_of(w[0] for w in words)})" + tree(words) if words and words[0] else tree(words)


def by_letter(words: Iterable[str]) -> str:
    """An alternation of literal words in their order, by first letter: only words of one
    first letter can stand at one place, so the one that is found stays the same."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return f"(?={one_of(groups)})(?:" + "|".join(
        quoted(c) + "(?:" + "|".join(quoted(x) for x in rest) + ")" for c, rest in sorted(groups.items())) + ")"


#: So many words are looked for one by one, byte by byte; more of them by one pattern.
FEW_WORDS = 8


def mentions(c: Column, words: Iterable[str]) -> Column:
    """True when any of the words is contained."""
    words = [w for w in words if w]
    if not words:
        return F.lit(False)
    if len(words) > FEW_WORDS:
        return c.rlike(anywhere(words))
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def hits(c: Column, words: Iterable[str]) -> Column:
    """The words contained in ``c``, in list order."""
    words = list(words)
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]))


#: A character that stands for the matches of a pattern.
MARK = "\x01"


def pieces(text: Column, pattern: str) -> Column:
    """``split`` with a pattern compiled once: split compiles its pattern for every text,
    save a single character. A text that holds the mark itself is split by the pattern."""
    marked = F.split(F.regexp_replace(text, pattern, MARK), MARK, -1)
    return F.when(text.contains(MARK), F.split(text, pattern, -1)).otherwise(marked)


def in_turn(text: Column, pattern: str) -> Column:
    """The text in an array: what stands before the first match, the match, and so on in turn."""

    def apart(t: Column) -> Column:
        both = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit"))
        return F.flatten(F.transform(both, lambda z: F.array(z["gap"], F.coalesce(z["hit"], F.lit("")))))

    def read(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        return F.when(t.contains(MARK), apart(t)).otherwise(marked)

    return let(text, read)


def spans(text: Column, pattern: str) -> Column:
    """Every match as ``array<struct<begin:int, stop:int, hit:string>>``.

    Offsets are 0-based. Spark reports no positions, but the pieces between
    the matches give them: a match starts after all earlier pieces and matches.
    One reading puts each match between two marks, so that a split gives pieces and
    matches in turn; a text that holds the mark itself is read for either.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def in_turn(ps: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            return F.when(i % 2 == 1, let(
                F.length(F.array_join(F.slice(ps, F.lit(1), i), "")),
                lambda b: F.struct(b.alias("begin"), (b + F.length(hit)).alias("stop"), hit.alias("hit")),
            ))

        return F.filter(F.transform(ps, one), lambda s: s.isNotNull())

    return F.when(text.contains(MARK), _spans_apart(text, pattern)).otherwise(let(parts, in_turn))


def _spans_apart(text: Column, pattern: str) -> Column:
    rx = F.lit(pattern)

    def place(s: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            before = F.length(F.array_join(F.slice(s["gaps"], F.lit(1), i + 1), "")) + F.length(
                F.array_join(F.slice(s["hits"], F.lit(1), i), "")
            )
            return let(
                before,
                lambda b: F.struct(
                    b.alias("begin"), (b + F.length(hit)).alias("stop"), hit.alias("hit")
                ),
            )

        return F.transform(s["hits"], one)

    return let(
        F.struct(
            F.regexp_extract_all(text, rx, F.lit(0)).alias("hits"),
            # Mostly nothing is found, and there are no gaps to tell.
            F.when(text.rlike(pattern), pieces(text, pattern)).alias("gaps"),
        ),
        place,
    )


def cut(text: Column, begin: Column, stop: Column) -> Column:
    """``text[begin:stop]`` with Python's clamping at the start."""
    lo = F.greatest(begin, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(stop - lo, F.lit(0)))


def group_list(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match, null when there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def trailing_dropped(words: Column, droppable: Callable[[Column], Column]) -> Column:
    """Drop words from the end of an array while ``droppable`` holds."""
    keep = F.aggregate(
        F.reverse(words),
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")),
        # Each word is tested once, and none before the last that stays.
        lambda s, w: F.when(s["done"], s)
        .when(droppable(w), F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("done")))
        .otherwise(F.struct(s["n"].alias("n"), F.lit(True).alias("done"))),
    )
    return F.slice(words, F.lit(1), F.size(words) - keep["n"])
