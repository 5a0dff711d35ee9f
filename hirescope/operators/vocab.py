"""Vocabulary matching. A vocabulary is a small dimension: ``terms`` (id, label,
kind), ``phrases`` (phrase, cased, term) and ``implies`` (term, implied).

Few terms are matched by one generated expression per term; a large library is
a trie that texts are walked over (``trie``), never by testing every phrase against
every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col, each, either, let
from ..session import checkpointed
from .trie import match_library, tokens



@dataclass(frozen=True)
class Term:
    id: str
    label: str
    kind: str = "method"
    aliases: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    implies: tuple[str, ...] = ()
    echo: tuple[str, ...] = ()

    def surfaces(self) -> tuple[str, ...]:
        return self.aliases or (self.label,)


def term_pattern(phrases: Iterable[str]) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{either(p.lower() for p in phrases)})(?![a-z0-9])"


def find_terms(text: Column | str, terms: Sequence[Term]) -> Column:
    """array<struct<term, n>>: occurrences per term, longest alias first.
    The substring test keeps the regex off the texts that cannot match."""

    def read(low: Column) -> Column:
        found = []
        for t in terms:
            aliases = [a.lower() for a in t.surfaces()]
            maybe = F.lit(False)
            for a in aliases:
                maybe = maybe | low.contains(a)
            n = F.when(maybe, F.regexp_count(low, F.lit(term_pattern(aliases)))).otherwise(0)
            found.append(F.struct(F.lit(t.id).alias("term"), n.cast("int").alias("n")))
        return F.filter(F.array(*found), lambda x: x["n"] > 0)

    return let(F.lower(F.coalesce(col(text), F.lit(""))), read)


def phrase_table(spark: SparkSession, terms: Sequence[Term]) -> DataFrame:
    rows = []
    for i, t in enumerate(terms):
        rows += [(a, False, t.id, i) for a in t.surfaces()]
        rows += [(a, True, t.id, i) for a in t.exact]
    raw = spark.createDataFrame(rows, "alias string, cased boolean, term string, priority int")
    return first_claims(raw)


def normal_phrase(alias: Column, cased: Column) -> Column:
    joined = F.array_join(tokens(alias), " ")
    return F.when(cased, joined).otherwise(F.lower(joined))


def first_claims(aliases: DataFrame) -> DataFrame:
    """One owner per phrase, the first claimant by priority."""
    return (
        aliases.withColumn("phrase", normal_phrase(F.col("alias"), F.col("cased")))
        .filter(F.col("phrase") != "")
        .groupBy("phrase", "cased")
        .agg(F.min_by("term", F.struct("priority", "term")).alias("term"))
    )


def match_phrases(texts: DataFrame, key: Sequence[str], text: str, phrases: DataFrame) -> DataFrame:
    """(key, term, n): longest phrase first from the left, no word counted
    twice, exact case before case-blind. Phrases may be of any length."""
    return match_library(texts, key, text, phrases)


def closure(implies: DataFrame) -> DataFrame:
    """(term, implied) followed all the way down, each term with itself.

    The edges are vocabulary-sized; path length doubles per round.
    """
    terms = implies.select("term").union(implies.select("implied")).distinct()
    reach = terms.select("term", F.col("term").alias("implied")).union(
        implies.select("term", "implied")
    ).distinct()
    before = -1
    while True:
        now = reach.count()
        if now == before:
            return reach
        before = now
        step = reach.alias("a").join(
            reach.alias("b"), F.col("a.implied") == F.col("b.term")
        ).select(F.col("a.term"), F.col("b.implied"))
        reach = checkpointed(step.distinct())


def expand(tagged: DataFrame, key: Sequence[str], closed: DataFrame) -> DataFrame:
    """(key, term) plus everything implied; unknown terms stay."""
    more = tagged.join(closed, "term").select(*key, F.col("implied").alias("term"))
    return tagged.select(*key, "term").union(more).distinct()


def echo_surfaces(text: Column | str, phrases: Iterable[str]) -> Column:
    """The text's own spelling of the phrases, first seen first, one each."""
    found = F.regexp_extract_all(
        F.coalesce(col(text), F.lit("")), F.lit(term_pattern(phrases)), F.lit(0)
    )
    return let(
        found,
        lambda fs: let(
            F.transform(fs, F.lower),
            lambda low: F.filter(fs, lambda f, i: F.array_position(low, F.lower(f)) == i + 1),
        ),
    )


def fold_library(entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, target): each library entry's owning term.

    ``entries`` (id, priority, alias), ``vocabulary`` (term, alias). An entry
    whose alias a vocabulary term owns folds into it; entries sharing an alias
    fold into the first of them. Groups grow along shared aliases until no
    label moves.
    """
    norm = F.lower(F.array_join(tokens("alias"), " "))
    e = entries.withColumn("phrase", norm).filter(F.col("phrase") != "").select(
        "id", "priority", "phrase"
    ).distinct()
    owned = vocabulary.withColumn("phrase", norm).groupBy("phrase").agg(F.min("term").alias("owner"))
    # Rank -1 is a vocabulary term, so it wins every group it touches.
    labels = (
        e.join(owned, "phrase", "left")
        .groupBy("id")
        .agg(
            F.min(
                F.when(F.col("owner").isNotNull(), F.struct(F.lit(-1).alias("rank"), F.col("owner").alias("name")))
                .otherwise(F.struct(F.col("priority").cast("int").alias("rank"), F.col("id").alias("name")))
            ).alias("label")
        )
    )
    while True:
        best = e.join(labels, "id").groupBy("phrase").agg(F.min("label").alias("label"))
        moved = e.join(best, "phrase").groupBy("id").agg(F.min("label").alias("next"))
        step = checkpointed(labels.join(moved, "id").select(
            "id", F.col("next").alias("label"), (F.col("label") != F.col("next")).alias("changed")
        ))
        changed = step.filter("changed").limit(1).count()
        labels = step.drop("changed")
        if not changed:
            return labels.select("id", F.col("label.name").alias("target"))


# --- fixed values: how common a word may be (Zipf scale) and still name a product ---
RARE, PROPER, PHRASE_SLACK = 3.3, 4.4, 1.2
GENERIC_SUFFIX = (
    r"(?i)\s+(software|programming language|language|platform|framework|library|system|"
    r"systems|suite|tools?)$"
)
ACRONYM = r"^[A-Z][A-Z0-9&+]{1,7}s?$"


def zipf(words: DataFrame, word: str = "word") -> DataFrame:
    """Word frequencies on the Zipf scale: log10 of occurrences per billion."""
    counted = words.groupBy(word).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(word, "n", F.log10(F.col("n") / total * 1e9).alias("zipf"))


def spelling_candidates(name: Column | str, vendors: Iterable[str] = ()) -> Column:
    """struct(base, tail, names): a product name without its generic suffix,
    the acronym that ends it, and the ways it may be written."""
    whole = F.trim(F.regexp_replace(col(name), r"\s+", " "))
    words = F.filter(F.split(F.regexp_replace(whole, "[()]", " "), r"\s+"), lambda w: w != "")

    def read(s: Column) -> Column:
        last = F.element_at(s["words"], -1)
        is_tail = (F.size(s["words"]) > 1) & last.rlike(ACRONYM) & (
            (F.length(last) > 2) | s["name"].contains("(")
        )
        kept = F.when(is_tail, F.slice(s["words"], F.lit(1), F.size(s["words"]) - 1)).otherwise(s["words"])
        joined = F.array_join(kept, " ")
        base = F.coalesce(F.nullif(F.regexp_replace(joined, GENERIC_SUFFIX, ""), F.lit("")), joined)

        def named(b: Column) -> Column:
            short = F.when(F.lit(False), F.lit(""))
            for v in vendors:
                short = short.when(
                    b.startswith(v + " ") & (F.length(b) > len(v) + 2), F.substring(b, len(v) + 2, 1000)
                )
            return F.struct(
                b.alias("base"), F.when(is_tail, last).alias("tail"), s["name"].alias("name"),
                F.array_distinct(F.array_compact(F.array(b, F.trim(short), s["name"]))).alias("names"),
            )

        return let(base, named)

    return let(F.struct(whole.alias("name"), words.alias("words")), read)


def build_library(software: DataFrame, frequencies: DataFrame, vendors: Iterable[str] = ()) -> DataFrame:
    """(product, hot, jobs, phrase, cased) from a software list with one row
    per (job, product, hot).

    A phrase is as common as its rarest word. Rare names and phrases match in
    any case; acronyms and everyday words written as names only in their own;
    a phrase of everyday words is a description and is dropped.
    """
    products = software.groupBy("product").agg(F.max("hot").alias("hot"), F.count("*").alias("jobs"))
    spelled = products.withColumn("s", spelling_candidates("product", vendors)).select(
        "product", "hot", "jobs", "s.tail", "s.name", F.explode("s.names").alias("c")
    ).filter(F.length("c") >= 2)
    words = spelled.select(
        "c", F.explode(F.regexp_extract_all(F.lower("c"), F.lit(r"[a-z0-9+#.]+"), F.lit(0))).alias("_w")
    ).distinct()
    rarest = words.join(
        frequencies.select(F.lower("word").alias("_w"), "zipf"), "_w", "left"
    ).groupBy("c").agg(F.min(F.coalesce("zipf", F.lit(0.0))).alias("freq"))
    c, freq = F.col("c"), F.coalesce("freq", F.lit(0.0))
    multi, short = c.contains(" "), c.rlike(ACRONYM)
    ordinary = ~multi & (c != F.col("name")) & (freq >= RARE) & ~short
    proper = F.forall(F.split(c, " "), lambda w: w.rlike(r"^\p{Lu}") | (F.length(w) <= 3))
    blind = ~short & (multi | (freq < RARE)) & (multi | (F.length(c) >= 3)) & (
        ~multi | (freq < RARE + PHRASE_SLACK) | proper
    )
    cased = short | (~multi & (freq >= RARE) & (freq < PROPER) & c.rlike(r"^\p{Lu}"))
    judged = spelled.join(rarest, "c", "left").filter(~ordinary)
    out = judged.filter(blind | cased).select(
        "product", "hot", "jobs", F.when(blind, F.lower(c)).otherwise(c).alias("phrase"),
        (~blind).alias("cased"),
    )
    tails = spelled.filter(F.col("tail").isNotNull()).select(
        "product", "hot", "jobs", F.col("tail").alias("phrase"), F.lit(True).alias("cased")
    )
    keep = F.col("hot") | F.when(F.col("cased"), F.length("phrase") >= 4).otherwise(
        F.col("phrase").contains(" ")
    )
    return out.unionByName(tails).filter(keep).distinct()


# -- search terms -----------------------------------------------------------------


def widen(anchors: DataFrame, alternates: DataFrame, budget: int, seeds: DataFrame) -> DataFrame:
    """One alternate per anchor, then a second per anchor, and so on, never
    a seed, each once, at most ``budget``. Seeds' own alternates (phase 0) come
    before those of other ranked titles (phase 1). ``anchors`` (anchor, phase,
    pos), ``alternates`` (anchor, alternate, rank)."""
    turns = (
        alternates.join(anchors, "anchor")
        .join(seeds.select(F.lower(F.trim("seed")).alias("alternate")), "alternate", "left_anti")
        .groupBy("alternate")
        .agg(F.min(F.struct("phase", "rank", "pos", "anchor")).alias("turn"))
    )
    return (
        turns.orderBy("turn.phase", "turn.rank", "turn.pos", "alternate")
        .limit(budget)
        .select("alternate", F.col("turn.anchor").alias("anchor"), F.col("turn.rank").alias("rank"))
    )


def clean_title(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(title)), r"\s+", " "))


def containment(titles: DataFrame, longest: int) -> DataFrame:
    """(title, covered_by) for titles (title, pos) that contain another
    title as whole words in order, the first such in ``pos`` order; null when
    kept. ``longest`` is the most words a title has.

    Word n-grams of each title meet the titles in an equi-join, so no pair of
    titles is ever compared.
    """
    own = titles.groupBy(clean_title("title").alias("title")).agg(F.min("pos").alias("pos")).filter(
        F.col("title") != ""
    )
    words = own.withColumn("_w", F.split("title", " "))
    grams = words.select(
        "title",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.size("_w")),
                        lambda i: F.transform(
                            F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i + 1)),
                            lambda n: F.array_join(F.slice("_w", i, n), " "),
                        ),
                    )
                )
            )
        ).alias("gram"),
    ).filter(F.col("gram") != F.col("title"))
    cover = (
        grams.join(own.select(F.col("title").alias("gram"), "pos"), "gram")
        .groupBy("title")
        .agg(F.min_by("gram", "pos").alias("covered_by"))
    )
    return own.join(cover, "title", "left")


EVERY_RUN_CAP = 25


def search_plan(titles: DataFrame, size: int, turn: int, cap: int = EVERY_RUN_CAP) -> DataFrame:
    """``titles`` (title, pos, every_run) to those asked this turn. The
    first ``cap`` every-run titles are always asked; the rest rotate, ``size``
    at a time, wrapping round. A profile's own list, so it is small."""
    w = Window.partitionBy("_always").orderBy("pos", "title")
    first = titles.withColumn("_rank", F.row_number().over(Window.partitionBy("every_run").orderBy("pos", "title")))
    split = first.withColumn("_always", F.col("every_run") & (F.col("_rank") <= cap))
    ranked = split.withColumn("_rn", F.row_number().over(w) - 1).withColumn(
        "_n", F.count("*").over(Window.partitionBy("_always"))
    )
    start = F.pmod(F.lit(turn * size), F.greatest(F.col("_n"), F.lit(1)))
    asked = F.col("_always") | (F.pmod(F.col("_rn") - start, F.col("_n")) < F.least(F.lit(size), F.col("_n")))
    return ranked.filter(asked).select(
        "title", "pos", F.col("_always").alias("always"),
        F.when(~F.col("_always"), F.ceil(F.col("_n") / F.greatest(F.lit(size), F.lit(1)))).alias("runs_to_cover"),
    )


# -- free-text ranking --------------------------------------------------------------

# --- fixed values: filler words, by use ------------------------------------------------
QUESTION_FILLER = (
    "you", "the", "a", "to", "for", "in", "of", "your", "is", "are", "do", "and", "this",
    "what", "why", "how", "would", "like", "us",
)
PARAGRAPH_FILLER = (
    "about", "above", "after", "also", "against", "been", "before", "being", "between", "both",
    "came", "could", "does", "doing", "done", "down", "each", "even", "every", "from", "have",
    "having", "here", "into", "just", "keep", "less", "like", "made", "make", "many", "more",
    "most", "much", "must", "only", "other", "over", "own", "part", "past", "rather", "same",
    "since", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they",
    "thing", "things", "this", "those", "through", "time", "under", "using", "very", "want",
    "well", "were", "what", "when", "where", "which", "while", "will", "with", "work", "worked",
    "working", "would", "your", "role", "team", "experience", "years",
)
EMPLOYER_FILLER = (
    "inc", "llc", "corp", "company", "group", "holdings", "systems", "solutions", "services",
    "international",
)


@dataclass(frozen=True)
class Answer:
    id: str
    question: str
    answer: str = ""
    aliases: tuple[str, ...] = ()
    confirm: bool = False


def _words(text: str, pattern: str = r"[a-z0-9]+") -> set[str]:
    return set(re.findall(pattern, text.lower()))


def rank_answers(text: Column | str, bank: Sequence[Answer]) -> Column:
    """array<struct<points, id>> best first: an alias in the question is
    worth ten plus its words, a shared content word one. The bank is a person's
    own few dozen answers, so it is part of the expression."""

    def read(q: Column) -> Column:
        asked = F.array_distinct(F.regexp_extract_all(q, F.lit("[a-z0-9]+"), F.lit(0)))

        def judge(ws: Column) -> Column:
            rows = []
            for i, a in enumerate(bank):
                points = F.lit(0)
                for alias in a.aliases:
                    points = points + F.when(q.contains(alias.lower()), 10 + len(alias.split())).otherwise(0)
                content = sorted(_words(a.question) - set(QUESTION_FILLER))
                if content:
                    points = points + F.size(F.array_intersect(ws, F.array(*[F.lit(w) for w in content])))
                rows.append(F.struct((-points).alias("_less"), F.lit(i).alias("_i"),
                                     points.alias("points"), F.lit(a.id).alias("id")))
            ranked = F.array_sort(F.filter(F.array(*rows), lambda r: r["points"] > 0))
            return F.transform(ranked, lambda r: F.struct(r["points"].alias("points"), r["id"].alias("id")))

        return let(asked, judge)

    return let(F.lower(F.coalesce(col(text), F.lit(""))), read)


def unconfirmed(bank: Sequence[Answer]) -> list[Answer]:
    return [a for a in bank if a.confirm]


def paragraph_relevance(description: Column | str, company: Column | str, paragraphs: dict[str, str]) -> Column:
    """array<struct<paragraph, relevance>>: distinct uncommon words of each
    approved paragraph found in the posting; +100 when it names the employer."""
    names = F.filter(
        F.split(F.regexp_replace(F.lower(F.coalesce(col(company), F.lit(""))), "[^a-z0-9 ]+", " "), " +"),
        lambda w: (F.length(w) > 3) & ~w.isin(*EMPLOYER_FILLER),
    )

    def read(s: Column) -> Column:
        rows = []
        for pid, raw in paragraphs.items():
            text = re.sub(r"\{[^}]*\}", " ", raw).lower()
            points = F.lit(0)
            for w in sorted(_words(text, r"[a-z][a-z+#.\-]{3,}") - set(PARAGRAPH_FILLER)):
                points = points + F.when(s["jd"].contains(w), 1).otherwise(0)
            named = (F.size(s["names"]) > 0) & _all_in(s["names"], text)
            rows.append(F.struct(F.lit(pid).alias("paragraph"),
                                 (points + F.when(named, 100).otherwise(0)).alias("relevance")))
        return F.array(*rows)

    return let(
        F.struct(F.lower(F.coalesce(col(description), F.lit(""))).alias("jd"), names.alias("names")), read
    )


def _all_in(names: Column, text: str) -> Column:
    return F.forall(names, lambda n: F.lit(text).contains(n))


CERTIFICATE = r"(?i)\b(certif\w*|license[sd]?|licensure|credential)\b"


def evidence(documents: DataFrame, terms: Sequence[Term], known_words: DataFrame) -> DataFrame:
    """(doc_id, kind, name, n, snippet) of what documents show: known
    terms with the line that names them, unknown product names used twice, and
    the first ten certificate lines."""
    from .skills import NOT_PRODUCTS, PRODUCT_NAME, STOP_NAMES

    lines = F.transform(
        F.split("text", r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    )
    docs = documents.select("doc_id", "text", lines.alias("lines"))
    by_id = F.create_map(*[F.lit(x) for t in terms for x in (t.id, term_pattern(t.surfaces()))])
    found = each(docs, find_terms("text", terms), "t", "doc_id", "lines").withColumn(
        "_rx", F.element_at(by_id, F.col("t.term"))
    )
    line = F.try_element_at(F.filter("lines", lambda x: F.regexp_like(x, F.col("_rx"))), F.lit(1))
    snippet = F.when(F.length(line) <= 160, line).otherwise(F.concat(F.substring(line, 1, 157), F.lit("...")))
    termed = found.select("doc_id", F.lit("term").alias("kind"), F.col("t.term").alias("name"),
                          F.col("t.n").cast("long").alias("n"), F.coalesce(snippet, F.lit("")).alias("snippet"))
    names = (
        each(documents, F.regexp_extract_all("text", F.lit(PRODUCT_NAME), F.lit(1)), "name", "doc_id")
        .filter(~F.col("name").isin(*NOT_PRODUCTS, *STOP_NAMES))
        .join(known_words.select(F.lower("word").alias("_w")).distinct(), F.lower("name") == F.col("_w"), "left_anti")
        .groupBy("doc_id", "name").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= 2)
        .select("doc_id", F.lit("name").alias("kind"), "name", "n", F.lit("").alias("snippet"))
    )
    certs = each(
        docs,
        F.slice(
            F.array_distinct(
                F.filter("lines", lambda x: F.length(x).between(6, 140) & x.rlike(CERTIFICATE))
            ), 1, 10,
        ),
        "name", "doc_id",
    ).select("doc_id", F.lit("certificate").alias("kind"), "name", F.lit(1).cast("long").alias("n"),
             F.lit("").alias("snippet"))
    return termed.unionByName(names).unionByName(certs)


def known_terms(sources: Sequence[DataFrame], closed: DataFrame) -> DataFrame:
    """The distinct terms a profile backs up (skills, bullet tags, phrasing
    tags, coursework), with what they imply."""
    every = sources[0].select("term")
    for s in sources[1:]:
        every = every.union(s.select("term"))
    return expand(every.distinct(), [], closed)
