"""Companies: their domains, boards, map pins and rank."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import alnum, col, each, let, trailing_dropped, word_list

# --- fixed values ---------------------------------------------------------------------
DEPARTMENT_PREFIX = (
    r"^(?:maps|map|www2|jobs|careers|career|store|shop|locations|location|recruiting|apply|my|"
    r"portal|secure)\."
)
LEGAL_WORDS = (
    "inc", "llc", "corp", "corporation", "co", "company", "ltd", "plc", "group", "holdings",
    "incorporated", "limited", "the", "of", "and",
)
EMPLOYER_KEYS = ("office", "healthcare", "industrial", "military")
EMPLOYER_PAIRS = (
    ("amenity", "hospital"), ("amenity", "university"), ("amenity", "college"),
    ("amenity", "clinic"), ("amenity", "research_institute"), ("amenity", "school"),
    ("amenity", "courthouse"), ("amenity", "townhall"), ("man_made", "works"),
    ("landuse", "industrial"), ("building", "office"), ("building", "commercial"),
    ("building", "industrial"), ("building", "hospital"), ("building", "university"),
)
BOILERPLATE_HOSTS = (
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com",
    "google.com", "goo.gl", "bit.ly", "apple.com", "wordpress.com", "pinterest.com",
    "tiktok.com", "adobe.com", "mailchimp.com", "eventbrite.com", "chambermaster.com",
    "wikipedia.org", "paypal.com", "vimeo.com", "flickr.com", "yelp.com", "threads.net",
)
FURNITURE = (
    r"(?i)^(?:home|about|contact|menu|search|log ?in|sign ?in|join|more|read more|next|"
    r"prev(?:ious)?|back|top|share|print|subscribe|privacy|terms|cookie|advertis|newsletter|"
    r"facebook|twitter|linkedin|instagram|youtube|click here|view all|see all|learn more|"
    r"apply now|\d+)\b"
)
ANCHOR = r"(?is)<a\b[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
ANCHOR_ENTITY = r"&(?:nbsp|amp|#39|quot|rsquo|lsquo|ldquo|rdquo|#\d+);"
CAREERS = r"(?i)career|jobs|join[- ]?us|work[- ]?(?:with|for|at)[- ]?us|employment|opportunit"
PORTAL = r"(?i)^(?:careers?|jobs)\.|search[- ]?jobs|job[- ]?search|open[- ]?jobs|apply"
# Hosting signatures, tried in this order; a group holds the tenant.
SIGNATURES = (
    ("workday", r"([a-z0-9-]+)\.wd\d+\.myworkdayjobs\.com"),
    ("successfactors", r"successfactors\.(?:com|eu)[^\"'\s]*?company=([A-Za-z0-9]+)"),
    ("successfactors", r"[a-z0-9-]+\.successfactors\.(?:com|eu)"),
    ("phenom", r"cdn\.phenompeople\.com/CareerConnectResources/([A-Z0-9]+)/"),
    ("phenom", r"phenompeople\.com"),
    ("icims", r"([a-z0-9-]+)\.icims\.com"),
    ("taleo", r"([a-z0-9-]+)\.taleo\.net"),
    ("brassring", r"([a-z0-9-]+)\.brassring\.com"),
    ("cornerstone", r"([a-z0-9-]+)\.csod\.com"),
    ("neogov", r"governmentjobs\.com/careers/([a-z0-9]+)"),
    ("neogov", r"governmentjobs\.com|neogov\.com"),
    ("applitrack", r"applitrack\.com/([a-z0-9]+)/"),
    ("applitrack", r"([a-z0-9]+)\.tedk12\.com"),
    ("eightfold", r"([a-z0-9-]+)\.eightfold\.ai"),
    ("avature", r"([a-z0-9-]+)\.avature\.net"),
    ("radancy", r"([a-z0-9-]+)\.talentbrew\.com"),
    ("greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/([a-z0-9_-]+)"),
    ("greenhouse", r"greenhouse\.io"),
    ("lever", r"jobs\.lever\.co/([a-z0-9-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9-]+)"),
    ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([A-Za-z0-9]+)"),
    ("workable", r"apply\.workable\.com/([a-z0-9-]+)"),
    ("recruitee", r"([a-z0-9-]+)\.recruitee\.com"),
    ("paylocity", r"recruiting\.paylocity\.com/recruiting/jobs/List/(\d+)"),
    ("ultipro", r"recruiting\d*\.ultipro\.com/([A-Za-z0-9]+)"),
    ("dayforce", r"([a-z0-9-]+)\.dayforcehcm\.com"),
    ("oracle", r"([a-z0-9-]+)\.fa\.[a-z0-9]+\.oraclecloud\.com"),
    ("jobvite", r"jobs\.jobvite\.com/([a-z0-9-]+)"),
    ("bamboohr", r"([a-z0-9-]+)\.bamboohr\.com"),
    ("jazzhr", r"([a-z0-9-]+)\.applytojob\.com"),
    ("adp", r"(?:workforcenow|myjobs)\.adp\.com"),
    ("paycom", r"([a-z0-9-]+)\.paycomonline\.net"),
    ("paycor", r"([a-z0-9-]+)\.paycor\.com"),
    ("clearcompany", r"([a-z0-9-]+)\.clearcompany\.com"),
    ("isolved", r"([a-z0-9-]+)\.myisolved\.com"),
    ("peopleadmin", r"([a-z0-9-]+)\.peopleadmin\.com"),
)
WORKDAY_URL = r"(?i)https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/([^\"'\s<>\\?#]*)"
LOCALE = r"^[a-z]{2}(?:[-_][A-Za-z]{2})?$"


def domain_of(url: Column | str) -> Column:
    """The bare hostname, '' for none; a .edu keeps its last two labels."""
    raw = F.trim(F.coalesce(col(url), F.lit("")))
    host = F.lower(
        F.regexp_extract(
            F.when(raw.contains("//"), raw).otherwise(F.concat(F.lit("http://"), raw)),
            r"//([^/?#:]*)", 1,
        )
    )
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), DEPARTMENT_PREFIX, "")

    def trimmed(h: Column) -> Column:
        h2 = F.when(h.rlike(r"\.[^.]+\.edu$"), F.regexp_extract(h, r"([^.]+\.edu)$", 1)).otherwise(h)
        return F.when(h2.contains(".") & ~h2.contains(" "), h2).otherwise(F.lit(""))

    return let(host, trimmed)


def core_words(name: Column | str) -> Column:
    """The words that tell a company from another, or all of them."""
    return let(
        word_list(name),
        lambda ws: let(
            F.filter(ws, lambda w: ~w.isin(*LEGAL_WORDS)),
            lambda kept: F.when(F.size(kept) > 0, kept).otherwise(ws),
        ),
    )


def _no_suffix(name: Column | str) -> Column:
    def trim(ws: Column) -> Column:
        return F.concat(
            F.slice(ws, 1, 1),
            trailing_dropped(
                F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))),
                lambda w: w.isin(*keys.COMPANY_SUFFIXES),
            ),
        )

    return let(word_list(name), lambda ws: F.when(F.size(ws) > 1, trim(ws)).otherwise(ws))


def board_slugs(name: Column | str) -> Column:
    """Board slugs worth trying: joined, then hyphenated."""
    return let(
        _no_suffix(name),
        lambda ws: F.when(
            F.size(ws) > 1, F.array(F.array_join(ws, ""), F.array_join(ws, "-"))
        ).when(F.size(ws) == 1, F.array(ws[0])).otherwise(F.array().cast("array<string>")),
    )


def likely_domains(name: Column | str) -> Column:
    """At most two .com guesses: all words, then without the last."""
    return let(
        _no_suffix(name),
        lambda ws: F.transform(
            F.array_distinct(
                F.filter(
                    F.array(
                        F.array_join(ws, ""),
                        F.when(F.size(ws) > 1,
                               F.array_join(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), "")),
                    ),
                    lambda d: F.length(d) > 2,
                )
            ),
            lambda d: F.concat(d, F.lit(".com")),
        ),
    )


def site_guesses(name: Column | str) -> Column:
    """Wider guesses, each tried under .com, .org and .net."""
    def stems(ws: Column) -> Column:
        n = F.size(ws)
        initials = F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
        return F.array_distinct(
            F.filter(
                F.array(
                    F.array_join(ws, ""),
                    F.when(n > 1, F.array_join(ws, "-")),
                    F.when(n > 2, F.array_join(F.slice(ws, F.lit(1), F.greatest(n - 1, F.lit(0))), "")),
                    F.when(n > 2, initials),
                ),
                lambda s: F.length(s) > 2,
            )
        )

    return let(
        core_words(name),
        lambda ws: F.flatten(
            F.transform(
                stems(ws),
                lambda s: F.transform(
                    F.array(F.lit(".com"), F.lit(".org"), F.lit(".net")), lambda tld: F.concat(s, tld)
                ),
            )
        ),
    )


def _has_group(pattern: str) -> bool:
    return re.compile(pattern).groups > 0


def hosting(url: Column | str, html: Column | str) -> Column:
    """struct(ats, tenant) of the first signature in the address or page."""
    def read(hay: Column) -> Column:
        case = F.when(F.lit(False), F.struct(F.lit("").alias("ats"), F.lit("").alias("tenant")))
        for ats, pattern in SIGNATURES:
            rx = "(?i)" + pattern
            tenant = F.regexp_extract(hay, rx, 1) if _has_group(pattern) else F.lit("")
            case = case.when(hay.rlike(rx), F.struct(F.lit(ats).alias("ats"), tenant.alias("tenant")))
        return case.otherwise(F.struct(F.lit("").alias("ats"), F.lit("").alias("tenant")))

    return let(
        F.concat(F.coalesce(col(url), F.lit("")), F.lit("\n"), F.coalesce(col(html), F.lit(""))), read
    )


def workday_board(url: Column | str, html: Column | str) -> Column:
    """struct(host, tenant, site) when a page links a Workday board outright."""
    hay = F.concat(F.coalesce(col(url), F.lit("")), F.lit("\n"), F.coalesce(col(html), F.lit("")))

    def read(h: Column) -> Column:
        tenant, centre, path = (F.regexp_extract(h, WORKDAY_URL, i) for i in (1, 2, 3))
        site = F.try_element_at(
            F.filter(F.split(path, "/"), lambda p: (p != "") & ~p.rlike(LOCALE)), F.lit(1)
        )
        return F.when(
            (tenant != "") & site.isNotNull(),
            F.struct(
                F.concat(tenant, F.lit("."), centre, F.lit(".myworkdayjobs.com")).alias("host"),
                tenant.alias("tenant"), site.alias("site"),
            ),
        )

    return let(hay, read)


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def anchors(pages: DataFrame) -> DataFrame:
    """P20: (page_id, url, pos, href, label) of every anchor of every page."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    inner = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    return each(
        pages, F.arrays_zip(hrefs.alias("href"), inner.alias("inner")), "a", "page_id", "url", pos="pos"
    ).select("page_id", "url", "pos", "a.href", F.col("a.inner").alias("inner"))


def is_boilerplate_host(site: Column) -> Column:
    test = F.lit(False)
    for h in BOILERPLATE_HOSTS:
        test = test | (site == h) | site.endswith("." + h)
    return test


def roster(pages: DataFrame) -> DataFrame:
    """P20: employers a page lists: (page_id, site, name), the shortest name per
    site; links home and to boilerplate hosts are left out."""
    links = anchors(pages).withColumn("site", domain_of(absolute(F.col("url"), F.col("href"))))
    name = F.regexp_replace(F.regexp_replace("inner", r"<[^>]+>", " "), ANCHOR_ENTITY, " ")
    name = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^[ .,:;|-]+|[ .,:;|-]+$", "")
    host = domain_of("url")
    return (
        links.withColumn("name", name)
        .withColumn("_host", host)
        .filter(
            (F.col("site") != "") & F.length("name").between(3, 70) & ~F.col("name").rlike(FURNITURE)
            & F.col("name").rlike("[A-Za-z]{3}")
            & ~((F.col("_host") != "") & ((F.col("site") == F.col("_host"))
                                         | F.col("site").endswith(F.concat(F.lit("."), F.col("_host")))))
            & ~is_boilerplate_host(F.col("site"))
        )
        .groupBy("page_id", "site")
        .agg(F.min(F.struct(F.length("name").alias("n"), F.col("pos"), F.col("name"))).alias("b"))
        .select("page_id", "site", "b.name")
    )


def careers_links(pages: DataFrame) -> DataFrame:
    """P20: links that may lead to a page's jobs, portals first."""
    label = F.substring(
        F.trim(F.regexp_replace(F.regexp_replace("inner", r"<[^>]+>", " "), r"\s+", " ")), 1, 60
    )
    links = (
        anchors(pages)
        .filter(~F.col("href").contains("#"))
        .withColumn("label", label)
        .filter(F.col("href").rlike(CAREERS) | F.col("label").rlike(CAREERS))
        .withColumn("link", absolute(F.col("url"), F.trim("href")))
        .filter(F.col("link").startswith("http"))
        .withColumn("_host", F.regexp_extract("link", r"^https?://([^/]*)", 1))
        .withColumn("_rest", F.regexp_extract("link", r"^https?://[^/]*(.*)$", 1))
    )
    rank = F.when(F.col("_host").rlike(PORTAL) | F.col("_rest").rlike(PORTAL), -2).otherwise(0) + F.when(
        F.col("_host").rlike("(?i)career|job"), -1
    ).otherwise(0)
    best = links.groupBy("page_id", "link").agg(F.min(F.struct(rank.alias("rank"), F.col("pos"))).alias("b"))
    order = Window.partitionBy("page_id").orderBy("b.rank", "b.pos")
    return best.select("page_id", "link", F.col("b.rank").alias("rank"), F.row_number().over(order).alias("place"))


def looks_like_employer(tags: Column) -> Column:
    """H16 helper: map tags that mean salaried staff work there."""
    test = F.lit(False)
    for k in EMPLOYER_KEYS:
        test = test | F.map_contains_key(tags, k)
    for k, v in EMPLOYER_PAIRS:
        test = test | F.coalesce(F.try_element_at(tags, F.lit(k)) == v, F.lit(False))
    return test


def collapse_pins(pins: DataFrame) -> DataFrame:
    """Map pins (name, website, tags) to one row per domain.

    Names are counted per (domain, name) first; the choice of name reads those
    counts, so a domain with a million pins is a handful of rows. A name the
    domain echoes wins, the longest; else the one most pins agree on.
    """
    rows = pins.select(
        F.trim("name").alias("name"), domain_of("website").alias("site"),
        (F.map_contains_key("tags", "brand") | F.map_contains_key("tags", "brand:wikidata")).alias("branded"),
        looks_like_employer(F.col("tags")).alias("employer"),
    ).filter((F.col("name") != "") & (F.col("site") != ""))
    named = rows.groupBy("site", "name").agg(
        F.count("*").alias("n"), F.max("branded").alias("branded"), F.max("employer").alias("employer")
    )
    stem = F.regexp_replace(F.regexp_replace("site", r"\.[^.]*$", ""), "[^a-z0-9]", "")
    slug = alnum("name")
    initials = F.array_join(F.transform(core_words("name"), lambda w: F.substring(w, 1, 1)), "")
    echoes = ((slug != "") & stem.contains(slug)) | ((F.length(stem) >= 6) & slug.contains(stem)) | (
        (initials != "") & (initials == stem)
    )
    rank = F.struct(
        echoes.alias("echo"),
        F.when(echoes, F.length(slug)).otherwise(F.col("n")).alias("first"),
        F.when(echoes, F.col("n")).otherwise(-F.length("name")).alias("second"),
        F.col("name"),
    )
    return named.groupBy("site").agg(
        F.max(rank).alias("best"), F.sum("n").alias("pins"),
        F.max("branded").alias("branded"), F.max("employer").alias("employer_tag"),
    ).select("site", "best.name", "pins", "branded", "employer_tag")


def merge_companies(candidates: DataFrame) -> DataFrame:
    """One ranked row per company from (name, site, source, pins, branded,
    employer_tag, listed, pos). A published name beats one read off the map."""
    key = F.coalesce(F.nullif("site", F.lit("")), alnum("name"))
    merged = candidates.groupBy(key.alias("company_key")).agg(
        F.min(F.struct((~F.col("listed")).alias("_u"), F.col("pos"), F.col("name"))).alias("b"),
        F.max("site").alias("site"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sum("pins").alias("pins"),
        F.max("branded").alias("branded"),
        F.max("employer_tag").alias("employer_tag"),
        F.max("listed").alias("listed"),
    )
    points = (
        F.when(F.col("listed"), 100).otherwise(0)
        + F.when(F.array_contains("sources", "wikidata"), 40).otherwise(0)
        + F.when(F.size("sources") > 1, 30).otherwise(0)
        + F.when(F.coalesce("site", F.lit("")) != "", 10).otherwise(0)
        + F.when(F.col("employer_tag"), 4).otherwise(0)
        + F.least(F.col("pins"), F.lit(6)) * 3
    )
    return merged.select(
        "company_key", F.col("b.name").alias("name"), F.coalesce("site", F.lit("")).alias("site"),
        "sources", "pins", "branded", "employer_tag", "listed", points.cast("int").alias("score"),
    )


#: Words are looked up by so many of their first characters.
GRAM = 8


def confirm_sites(companies: DataFrame, pages: DataFrame, home_terms: Iterable[str]) -> DataFrame:
    """(name, host) where a fetched page belongs to the company: every
    distinctive word of the name is in the title, and a one-word name also
    needs the home area in the body.

    A host may have many pages and many names, so they are not joined on the host:
    each name meets the titles that hold its rarest word. A word is letters and
    digits, so it stands inside one such run of the title, and is looked up by its
    first characters among the runs' pieces."""
    terms = [t.lower().strip() for t in home_terms if len(t.strip()) > 3]
    home = F.lit(False)
    for t in terms:
        home = home | F.col("_body").rlike(rf"\b{t}\b")
    page = (
        pages.select(
            domain_of("url").alias("host"),
            F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("_title"),
            F.lower("html").alias("_body"),
        )
        .filter((F.col("host") != "") & (F.col("_title") != ""))
        .groupBy("host", "_title").agg(F.max(home).alias("_home"))
    )
    words = core_words("name")
    strong = let(
        words,
        lambda ws: let(F.filter(ws, lambda w: F.length(w) > 3),
                       lambda s: F.when(F.size(s) > 0, s).otherwise(ws)),
    )
    named = companies.select("name", domain_of("site").alias("host"), F.array_distinct(strong).alias("_strong"),
                             (F.size(words) > 1).alias("_many")).distinct().filter(F.size("_strong") > 0)
    asked = named.select("host", F.explode("_strong").alias("_word")).distinct().withColumn("_gram", F.substring("_word", 1, GRAM))
    runs = page.select("host", "_title", "_home", F.explode(F.array_distinct(
        F.regexp_extract_all("_title", F.lit("[a-z0-9]+"), F.lit(0)))).alias("_run"))
    pieces = runs.select("host", "_run").distinct().select("host", "_run", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("_run")),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("_run") - i + 1)),
                              lambda n: F.substring(F.col("_run"), i, n)),
    )))).alias("_gram"))
    held = asked.join(pieces, ["host", "_gram"]).filter(F.col("_run").contains(F.col("_word"))).select("host", "_word", "_run")
    titles = held.join(runs, ["host", "_run"])
    number = titles.groupBy("host", "_word").agg(F.count("*").alias("_n"))
    # The rarest word decides which titles a name meets; a name with a word in no title meets none.
    rarest = (
        named.select("name", "host", "_strong", "_many", F.explode("_strong").alias("_word"))
        .join(number, ["host", "_word"], "left")
        .groupBy("name", "host", "_strong", "_many")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("word"))).alias("_least"))
        .filter(F.col("_least.n") > 0)
        .select("name", "host", "_strong", "_many", F.col("_least.word").alias("_word"))
    )
    met = titles.select("host", "_word", "_title", "_home").distinct()
    return (
        rarest.join(met, ["host", "_word"])
        .filter(F.forall("_strong", lambda w: F.col("_title").contains(w)) & (F.col("_many") | F.col("_home")))
        .select("name", "host")
        .distinct()
    )


# --- fixed values: company slots holding an API's own schema ---------------------------
PLACEHOLDERS = ("name", "companyname", "company name", "string", "thumbnail_url", "null", "none")


def deslug(slug: Column) -> Column:
    return F.array_join(
        F.transform(
            F.filter(F.split(F.replace(slug, F.lit("_"), F.lit("-")), "-"), lambda p: p != ""),
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000))),
        ),
        " ",
    )


def repair_companies(rows: DataFrame) -> DataFrame:
    """Stored rows whose company is a placeholder take it from their link."""
    broken = F.lower(F.trim("company")).isin(*PLACEHOLDERS)
    named = deslug(F.regexp_extract("url", r"/companies/([^/]+)/", 1))
    return rows.withColumn("repaired", broken & (named != "")).withColumn(
        "stuck", broken & (named == "")
    ).withColumn("company", F.when(F.col("repaired"), named).otherwise(F.col("company")))


def four_places(location: Column | str, home: str) -> Column:
    """HYBRID, the home city, REMOTE or ON-SITE, in that order."""
    t = F.lower(F.trim(F.coalesce(col(location), F.lit(""))))
    case = F.when(t.contains("hybrid"), F.lit("HYBRID"))
    if home:
        case = case.when(t.contains(home.lower()), F.lit(home))
    return case.when(t.contains("remote"), F.lit("REMOTE")).otherwise(F.lit("ON-SITE"))


def first_number(text: Column | str) -> Column:
    """The bottom of a written range."""
    t = F.replace(F.coalesce(col(text), F.lit("")), F.lit(" "), F.lit(""))
    return F.regexp_replace(F.regexp_extract(t, r"\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")
