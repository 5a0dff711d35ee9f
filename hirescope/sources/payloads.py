"""Landed board payloads to postings.

A payload is text someone landed: one row per fetched document with the
employer it was fetched for. Each normaliser is a projection over that column
with an explicit schema, so it runs the same over a batch of files, a table of
payloads, or a stream of a landing folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.html import clean_text, unescape
from ..functions.places import STATES
from ..functions.text import by_letter, each, let, mentions, squash
from ..operators.companies import PLACEHOLDERS, deslug
from ..operators.market import stamp
from ..schema import POSTING, conform

# --- fixed values: pay periods and the band of believable annual pay ---------------
PERIODS = {"HOUR": 2080, "DAY": 260, "WEEK": 52, "MONTH": 12, "YEAR": 1}
PAY_LOW, PAY_HIGH = 15_000, 900_000
SMART_SECTIONS = ("jobDescription", "qualifications", "additionalInformation")
MUSE_REMOTE = "Flexible / Remote"


def read_payloads(spark: SparkSession, path: str, company: str = "", slug: str = "", stream: bool = False) -> DataFrame:
    """One row per landed file: payload, company, slug."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").option("wholetext", True).load(path)
    return files.select(
        F.col("value").alias("payload"), F.lit(company).alias("company"), F.lit(slug).alias("slug")
    )


def _rows(payloads: DataFrame, schema: str, path: str = "") -> DataFrame:
    """Payload rows to one row per posting ``j``. ``path`` is the array inside;
    '' means the document is the array. Unreadable documents give no rows."""
    parsed = F.from_json("payload", schema)
    items = parsed[path] if path else parsed
    keep = [c for c in ("company", "slug", "host", "tenant", "site", "run_id") if c in payloads.columns]
    return each(payloads, items, "j", *keep)


def corrupt_payloads(payloads: DataFrame) -> DataFrame:
    """The documents that are not JSON, for the side table."""
    return payloads.filter(F.try_parse_json("payload").isNull())


def _or(*options: Column | str) -> Column:
    """The first non-empty text, else ''."""
    cols = [F.col(c) if isinstance(c, str) else c for c in options]
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(""))


def _num(c: Column | str) -> Column:
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(v > 0, v)


def _joined(*parts: Column | str) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in parts]
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), ", ")


def normalise(df: DataFrame) -> DataFrame:
    """Whitespace folded, nulls to '', the body cleaned."""
    df = conform(df, {k: v for k, v in POSTING.items()})
    for c in ("title", "company", "division", "location", "department"):
        df = df.withColumn(c, squash(c))
    df = df.withColumn("external_id", F.trim(F.coalesce("external_id", F.lit(""))))
    return df.withColumn("description", clean_text("description"))


def _postings(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    cols = {"source": F.lit(source)} | fields
    return normalise(df.select(*[c.alias(k) for k, c in cols.items()]))


# -- company boards -------------------------------------------------------------------

GREENHOUSE = (
    "jobs array<struct<title:string,absolute_url:string,location:struct<name:string>,content:string,"
    "first_published:string,updated_at:string,departments:array<struct<name:string>>,id:string>>"
)


def greenhouse(payloads: DataFrame) -> DataFrame:
    """S01"""
    return _postings(
        _rows(payloads, GREENHOUSE, "jobs"), "greenhouse",
        title=F.col("j.title"), company=F.col("company"), url=F.col("j.absolute_url"),
        location=F.col("j.location.name"), description=F.col("j.content"),
        posted_at=dates.parse_date(_or("j.first_published", "j.updated_at")),
        department=F.array_join(F.transform("j.departments", lambda d: F.coalesce(d["name"], F.lit(""))), ", "),
        external_id=F.col("j.id"),
    )


LEVER = (
    "array<struct<text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,"
    "team:string,department:string,commitment:string>,descriptionPlain:string,description:string,"
    "createdAt:bigint,id:string>>"
)


def lever(payloads: DataFrame) -> DataFrame:
    """S02"""
    return _postings(
        _rows(payloads, LEVER), "lever",
        title=F.col("j.text"), company=F.col("company"), url=_or("j.hostedUrl", "j.applyUrl"),
        location=F.col("j.categories.location"),
        description=_or("j.descriptionPlain", "j.description"),
        posted_at=dates.parse_epoch("j.createdAt"),
        department=_or("j.categories.team", "j.categories.department"), external_id=F.col("j.id"),
        remote=F.lower(F.coalesce("j.categories.commitment", F.lit(""))) == "remote",
    )


ASHBY = (
    "jobs array<struct<title:string,jobUrl:string,applyUrl:string,location:string,"
    "descriptionPlain:string,descriptionHtml:string,publishedAt:string,department:string,team:string,"
    "id:string,isRemote:boolean,compensation:struct<summaryComponents:array<struct<"
    "compensationType:string,currencyCode:string,interval:string,minValue:double,maxValue:double>>>>>"
)


def period_factor(period: Column) -> Column:
    case = F.when(F.lit(False), F.lit(0))
    for unit, n in PERIODS.items():
        case = case.when(period == unit, F.lit(n))
    return case


def _believable(v: Column) -> Column:
    return F.when(v.between(PAY_LOW, PAY_HIGH), v)


def ashby_pay(components: Column) -> Column:
    """struct(lo, hi): dollar Salary components made annual, the widest
    band, swapped when inverted."""
    def factor(c: Column) -> Column:
        unit = F.element_at(F.split(F.upper(F.coalesce(F.nullif(c["interval"], F.lit("")), F.lit("YEAR"))), " "), -1)
        return period_factor(F.regexp_replace(unit, "S+$", ""))

    pay = F.filter(
        components,
        lambda c: (c["compensationType"] == "Salary")
        & (F.upper(F.coalesce(F.nullif(c["currencyCode"], F.lit("")), F.lit("USD"))) == "USD"),
    )
    lo = F.array_min(F.transform(pay, lambda c: _believable(c["minValue"] * factor(c))))
    hi = F.array_max(F.transform(pay, lambda c: _believable(c["maxValue"] * factor(c))))
    return ordered_band(lo, hi)


def ordered_band(lo: Column, hi: Column) -> Column:
    return let(
        F.struct(lo.alias("a"), hi.alias("b")),
        lambda s: F.when(
            s["b"] < s["a"], F.struct(s["b"].alias("lo"), s["a"].alias("hi"))
        ).otherwise(F.struct(s["a"].alias("lo"), s["b"].alias("hi"))),
    )


def ashby(payloads: DataFrame) -> DataFrame:
    """S03"""
    rows = _rows(payloads, ASHBY, "jobs").withColumn(
        "pay", ashby_pay(F.col("j.compensation.summaryComponents"))
    )
    return _postings(
        rows, "ashby",
        title=F.col("j.title"), company=F.col("company"), url=_or("j.jobUrl", "j.applyUrl"),
        location=F.col("j.location"), description=_or("j.descriptionPlain", "j.descriptionHtml"),
        posted_at=dates.parse_date("j.publishedAt"), department=_or("j.department", "j.team"),
        external_id=F.col("j.id"), remote=F.col("j.isRemote"),
        salary_min=F.col("pay.lo"), salary_max=F.col("pay.hi"),
    )


SMART = (
    "content array<struct<name:string,id:string,location:struct<city:string,region:string,"
    "country:string,remote:boolean>,jobAdInternal:string,releasedDate:string,"
    "department:struct<label:string>>>"
)
SMART_DETAIL = (
    "id string, releasedDate string, compensation struct<period:string,currency:string,min:double,max:double>, "
    "jobAd struct<sections:struct<" + ",".join(f"{s}:struct<title:string,text:string>" for s in SMART_SECTIONS) + ">>"
)


def smartrecruiters(payloads: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """The list, and the bodies from landed detail documents when given.
    The join is on the posting id; yearly dollar pay fills only a blank."""
    rows = _rows(payloads, SMART, "content")
    out = rows.select(
        F.lit("smartrecruiters").alias("source"), F.col("j.name").alias("title"), "company",
        F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), F.coalesce("j.id", F.lit(""))).alias("url"),
        _joined("j.location.city", "j.location.region", "j.location.country").alias("location"),
        F.col("j.jobAdInternal").alias("description"),
        dates.parse_date("j.releasedDate").alias("posted_at"),
        F.col("j.department.label").alias("department"), F.col("j.id").alias("external_id"),
        F.col("j.location.remote").alias("remote"),
        F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"),
    )
    if details is not None:
        d = details.select(F.from_json("payload", SMART_DETAIL).alias("d")).select("d.*")
        body = F.array_join(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.trim(F.coalesce(f"jobAd.sections.{s}.text", F.lit(""))) != "",
                            F.concat(F.lit("<h3>"), F.coalesce(f"jobAd.sections.{s}.title", F.lit("")),
                                     F.lit("</h3>"), F.col(f"jobAd.sections.{s}.text")),
                        )
                        for s in SMART_SECTIONS
                    ]
                )
            ), "",
        )
        yearly = (F.col("compensation.period") == "YEARLY") & (F.col("compensation.currency") == "USD")
        d = d.select(
            F.col("id").alias("external_id"), F.nullif(body, F.lit("")).alias("_body"),
            dates.parse_date("releasedDate").alias("_at"),
            F.when(yearly, F.col("compensation.min")).alias("_lo"),
            F.when(yearly, F.col("compensation.max")).alias("_hi"),
        )
        has = F.col("_body").isNotNull()
        out = out.join(d, "external_id", "left").withColumns({
            "description": F.coalesce("_body", "description"),
            "posted_at": F.when(has, F.coalesce("_at", "posted_at")).otherwise(F.col("posted_at")),
            "salary_min": F.when(has, F.col("_lo")), "salary_max": F.when(has, F.col("_hi")),
        })
    return normalise(out)


WORKABLE = (
    "jobs array<struct<title:string,url:string,application_url:string,city:string,state:string,"
    "country:string,description:string,published_on:string,department:string,shortcode:string,"
    "telecommuting:boolean>>"
)


def workable(payloads: DataFrame) -> DataFrame:
    """S05"""
    return _postings(
        _rows(payloads, WORKABLE, "jobs"), "workable",
        title=F.col("j.title"), company=F.col("company"), url=_or("j.url", "j.application_url"),
        location=_joined("j.city", "j.state", "j.country"), description=F.col("j.description"),
        posted_at=dates.parse_date("j.published_on"), department=F.col("j.department"),
        external_id=F.col("j.shortcode"), remote=F.col("j.telecommuting"),
    )


RECRUITEE = (
    "offers array<struct<title:string,careers_url:string,careers_apply_url:string,city:string,"
    "state_name:string,country:string,description:string,published_at:string,department:string,"
    "id:string,remote:boolean>>"
)


def recruitee(payloads: DataFrame) -> DataFrame:
    """S06"""
    return _postings(
        _rows(payloads, RECRUITEE, "offers"), "recruitee",
        title=F.col("j.title"), company=F.col("company"), url=_or("j.careers_url", "j.careers_apply_url"),
        location=_joined("j.city", "j.state_name", "j.country"), description=F.col("j.description"),
        posted_at=dates.parse_date("j.published_at"), department=F.col("j.department"),
        external_id=F.col("j.id"), remote=F.col("j.remote"),
    )


WORKDAY = (
    "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,"
    "bulletFields:array<string>>>"
)
WORKDAY_DETAIL = (
    "jobPostingInfo struct<jobDescription:string,startDate:string,externalUrl:string,remoteType:string>"
)


def workday(payloads: DataFrame, as_of, details: DataFrame | None = None) -> DataFrame:
    """The list rows once per board and path, with landed detail documents
    (path, payload) laid over them."""
    rows = _rows(payloads, WORKDAY, "jobPostings").filter(F.coalesce("j.externalPath", F.lit("")) != "")
    one = rows.groupBy("company", "host", "site", F.col("j.externalPath").alias("path")).agg(F.min("j").alias("j"))
    out = one.select(
        F.lit("workday").alias("source"), F.col("j.title").alias("title"), "company", "path",
        F.concat(F.lit("https://"), "host", F.lit("/"), "site", "path").alias("url"),
        F.col("j.locationsText").alias("location"), F.lit("").alias("description"),
        dates.posted_ago("j.postedOn", stamp(as_of)).alias("posted_at"),
        F.try_element_at("j.bulletFields", F.lit(1)).alias("external_id"), F.lit(False).alias("remote"),
    )
    if details is not None:
        d = details.select("path", F.from_json("payload", WORKDAY_DETAIL)["jobPostingInfo"].alias("d"))
        out = out.join(d, "path", "left").withColumns({
            "description": _or("d.jobDescription", "description"),
            "posted_at": F.coalesce(dates.parse_date("d.startDate"), "posted_at"),
            "url": _or("d.externalUrl", "url"),
            "remote": F.when(F.coalesce("d.remoteType", F.lit("")) != "",
                             F.lower("d.remoteType").contains("remote")).otherwise(F.col("remote")),
        })
    return normalise(out)


# -- sitemaps and marked-up pages --------------------------------------------------------

TRAILING_ID = r"-[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def slug_parts(slug: Column) -> Column:
    """struct(title, location) from a job slug: the id, country and state
    come off the end, the last word left is the city."""
    states = sorted((n.replace(" ", "-") for n in STATES if n != "puerto rico"), key=lambda n: (-len(n), n))
    s = F.regexp_replace(F.regexp_replace(slug, TRAILING_ID, ""), "^/+|/+$", "")

    state_rx = "-(" + by_letter(states) + ")$"

    # Each part is bound, as it would be cut off anew for every use of what is left.
    def peel(x: Column) -> Column:
        bare = F.when(x.contains("-united-states"), F.regexp_replace(x, "-united-states$", "")).otherwise(x)
        return let(bare, lambda b: let(F.regexp_extract(b, state_rx, 1), lambda state: cored(x, b, state)))

    def cored(x: Column, bare: Column, state: Column) -> Column:
        core = F.when(state != "", F.regexp_replace(bare, state_rx, "")).otherwise(bare)
        return let(core, lambda c: let(c.rlike("..*-"), lambda has_city: named(x, state, c, has_city)))

    def named(x: Column, state: Column, core: Column, has_city: Column) -> Column:
        title = F.when(has_city, F.regexp_extract(core, r"^(.*)-[^-]*$", 1)).otherwise(core)
        city = F.when(has_city, F.regexp_extract(core, r"-([^-]*)$", 1)).otherwise(F.lit(""))
        words = lambda c: F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))
        country = F.when(x.endswith("-united-states"), F.lit("United States"))
        return F.struct(
            words(title).alias("title"),
            let(F.struct(words(city).alias("c"), words(state).alias("s"), country.alias("u")),
                lambda p: _joined(p["c"], p["s"], p["u"])).alias("location"),
        )

    return let(s, peel)


def sitemap(
    payloads: DataFrame, job_path: str = "/job", local_terms: Sequence[str] = (), keywords: Sequence[str] = ()
) -> DataFrame:
    """Every job link of a sitemap; with local terms, only links that name
    one or whose title has a keyword."""
    blocks = each(
        payloads, F.regexp_extract_all("payload", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)), "b", "company"
    ).select(
        "company",
        F.regexp_extract("b", r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url"),
        F.regexp_extract("b", r"<lastmod>\s*([^<\s]+)\s*</lastmod>", 1).alias("lastmod"),
    )
    return link_postings(blocks, job_path, local_terms, keywords)


def link_postings(links: DataFrame, job_path: str = "/job", local_terms: Sequence[str] = (),
                  keywords: Sequence[str] = ()) -> DataFrame:
    """Postings of links (company, url, lastmod)."""
    jobs = links.filter(F.col("url").contains(job_path))
    after = F.substring("url", F.instr("url", job_path) + len(job_path), F.length("url"))
    # Not a plain column: the filter below would be moved before it and read the slug four times more.
    rows = each(jobs, F.array(slug_parts(after)), "p", "company", "url", "lastmod")
    if local_terms:
        hay = F.lower(F.concat_ws(" ", "p.title", "p.location"))
        rows = rows.filter(
            mentions(hay, [t.lower() for t in local_terms])
            | mentions(F.lower("p.title"), [k.lower() for k in keywords])
        )
    return _postings(
        rows, "sitemap",
        title=F.col("p.title"), company=F.col("company"), url=F.col("url"), location=F.col("p.location"),
        posted_at=dates.parse_date("lastmod"), external_id=F.element_at(F.split("url", "/"), -1),
    )


JSONLD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
NODE = "string"


def _scalar(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _fields(v: Column, *names: str) -> Column:
    """The fields of an object, each a VARIANT; null for anything else. Read together, as a
    path that leads nowhere costs as much as many that do."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def _text(v: Column) -> Column:
    return _scalar(v, "$")


def _first_or_self(v: Column) -> Column:
    """A list answers with its first element."""
    return let(v, lambda x: F.coalesce(F.get(F.try_variant_get(x, "$", "array<variant>"), F.lit(0)), x))


def job_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, node) every JobPosting node of every page. The
    document may be one node, a list, or wrapped in @graph; the type may be a
    list. Shapes vary, so nodes stay VARIANT."""
    docs = each(
        pages, F.regexp_extract_all("html", F.lit(JSONLD), F.lit(1)), "_raw", "page_id", "url", pos="_doc"
    ).select("page_id", "url", "_doc", F.try_parse_json("_raw").alias("_v"))
    # A broken document is a null node without a type. A test for null here would parse each document twice.
    listed = F.try_variant_get("_v", "$", "array<variant>")
    tops = docs.select(
        "page_id", "url", "_doc",
        F.posexplode(F.coalesce(listed, F.array("_v"))).alias("_top", "_n"),
    )
    graph = F.coalesce(
        F.try_variant_get(_fields(F.col("_n"), "@graph")["@graph"], "$", "array<variant>"), F.array().cast("array<variant>"))
    nodes = tops.select(
        "page_id", "url", "_doc", "_top", F.posexplode(F.concat(F.array("_n"), graph)).alias("_in", "node")
    )
    kind = _fields(F.col("node"), "@type")["@type"]
    kinds = F.coalesce(F.try_variant_get(kind, "$", "array<string>"), F.array(_text(kind)))
    # Wrapped nodes are read after every node of the outer list.
    order = F.struct("_doc", (F.col("_in") > 0).alias("_deep"), "_top", "_in")
    return nodes.filter(F.array_contains(kinds, "JobPosting")).select("page_id", "url", order.alias("pos"), "node")


def schema_pay(node: Column) -> Column:
    """struct(lo, hi) annual from baseSalary: a scalar, a list, or a
    MonetaryAmount whose unit says how often it is paid."""
    return _pay(_fields(node, "baseSalary")["baseSalary"])


def _pay(salary: Column) -> Column:
    def read(s: Column) -> Column:
        value = s["amount"]
        plain = _text(s["salary"]["value"])
        return F.struct(
            _text(value["minValue"]).alias("lo"), _text(value["maxValue"]).alias("hi"),
            F.coalesce(_text(value["value"]), F.when(~plain.rlike(r"^[\[{]"), plain)).alias("only"),
            period_factor(F.upper(F.coalesce(
                _text(value["unitText"]), _text(s["salary"]["unitText"]), F.lit("YEAR")))).alias("factor"),
        )

    def annual(raw: Column, factor: Column) -> Column:
        return F.regexp_replace(raw, "[,$]", "").try_cast("double") * factor

    def band(r: Column) -> Column:
        none = r["lo"].isNull() & r["hi"].isNull()
        return F.struct(*[annual(F.when(none, r["only"]).otherwise(r[c]), r["factor"]).alias(c) for c in ("lo", "hi")])

    # Each step is worked out once a node: the salary, its value, their texts, and the figures.
    amount = lambda s: _fields(_first_or_self(s["value"]), "minValue", "maxValue", "value", "unitText")
    given = _fields(_first_or_self(salary), "value", "unitText")
    texts = let(let(given, lambda s: F.struct(s.alias("salary"), amount(s).alias("amount"))), read)
    return let(let(texts, band), lambda v: ordered_band(_believable(v["lo"]), _believable(v["hi"])))


def postings_from_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as posting fields, entities and markup still in the body."""
    n = F.col("_f")
    read = nodes.withColumn("_f", _fields(F.col("node"), "title", "description", "datePosted", "jobLocation", "baseSalary"))
    address = _fields(_fields(_first_or_self(n["jobLocation"]), "address")["address"], "addressLocality", "addressRegion")
    place = let(
        let(address, lambda a: F.struct(_text(a["addressLocality"]).alias("city"), _text(a["addressRegion"]).alias("region"))),
        lambda p: _joined(p["city"], F.when(p["city"].isNotNull(), p["region"])),
    )
    return read.select(
        "page_id", "url", "pos", F.coalesce(_text(n["title"]), F.lit("")).alias("title"),
        clean_text(_text(n["description"])).alias("description"),
        dates.parse_date(_text(n["datePosted"])).alias("posted_at"),
        place.alias("location"),
        _pay(n["baseSalary"]).alias("pay"),
    )


def apply_pages(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """A stored row takes title, body, date, place and pay from the first
    node of its page; blanks never replace what it has."""
    first = nodes.groupBy("url").agg(F.min_by(F.struct("title", "description", "posted_at", "location", "pay"), "pos").alias("n"))
    low_or_high = F.col("n.pay.lo").isNotNull() | F.col("n.pay.hi").isNotNull()
    return rows.join(first, "url", "left").withColumns({
        "title": _or("n.title", "title"), "description": _or("n.description", "description"),
        "posted_at": F.coalesce("n.posted_at", "posted_at"), "location": _or("n.location", "location"),
        "salary_min": F.when(low_or_high, F.col("n.pay.lo")).otherwise(F.col("salary_min")),
        "salary_max": F.when(low_or_high, F.col("n.pay.hi")).otherwise(F.col("salary_max")),
    }).drop("n")


AD_LAND = r"(?i)^https?://(?:www\.)?adzuna\.com/land/ad/(\d+)"
AD_DETAIL = r"(?i)^https?://(?:www\.)?adzuna\.com/details/\d+"
AD_BODY = r"(?is)<section[^>]*class=[\"']adp-body[^\"']*[\"'][^>]*>(.*?)</section>"


def urls_to_try(url: Column | str) -> Column:
    """A posting's link, and the aggregator's own page of the same ad."""
    u = F.col(url) if isinstance(url, str) else url
    ad = F.regexp_extract(u, AD_LAND, 1)
    return F.when(
        ad != "", F.array(u, F.concat(F.lit("https://www.adzuna.com/details/"), ad))
    ).otherwise(F.array(u))


def aggregator_pages(pages: DataFrame) -> DataFrame:
    """Title and body printed on an aggregator's detail page."""
    body = F.regexp_replace(F.regexp_extract("html", AD_BODY, 1), r"^(?:\s*Job Description)+\s*", "")
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", " ")
    return pages.filter(F.col("url").rlike(AD_DETAIL) & F.col("html").rlike(AD_BODY)).select(
        "page_id", "url", F.trim(unescape(title)).alias("title"), clean_text(body).alias("description")
    )


# --- fixed values: when a page's body may replace a snippet -----------------------------
MIN_FULL_BODY, MIN_ANY_BODY, MIN_PROOF_WORDS = 900, 200, 20


def _plain_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _long_words(c: Column) -> Column:
    return F.filter(F.array_distinct(_plain_words(c)), lambda w: F.length(w) > 3)


def upgrade_snippets(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """An aggregator's snippet takes the posting it was cut from.

    ``rows`` (uid, url, title, description, partial, salary_min, salary_max),
    ``bodies`` (url, pos, title, description, pay). A body is believed when it
    is longer, long enough or holds the snippet's own words, and the titles
    share a real word. The first one believed is taken, in link order.
    """
    tries = rows.filter("partial").select(
        "uid", F.col("url").alias("_own"), F.col("title").alias("_title"), F.col("description").alias("_snippet"),
        F.posexplode(urls_to_try("url")).alias("_try", "url"),
    )
    snippet = F.col("_snippet")
    words = _plain_words(snippet)
    proof = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    holds = (F.size(words) - 1 >= MIN_PROOF_WORDS) & F.concat(
        F.lit(" "), F.array_join(_plain_words(F.col("description")), " "), F.lit(" ")
    ).contains(F.concat(F.lit(" "), proof, F.lit(" ")))
    floor = F.when(snippet != "", MIN_FULL_BODY).otherwise(MIN_ANY_BODY)
    want, got = _long_words(F.col("_title")), _long_words(F.col("title"))
    same_job = (F.size(want) == 0) | (F.size(got) == 0) | (F.size(F.array_intersect(want, got)) > 0)
    good = (
        tries.join(bodies, "url")
        .filter(
            (F.length("description") > F.length(snippet))
            & ((F.length("description") >= floor) | holds) & same_job
        )
        .groupBy("uid", "_own")
        .agg(F.min_by(F.struct("description", "pay"), F.struct("_try", "pos")).alias("_b"))
        .withColumnRenamed("_own", "url")
    )
    unpaid = F.nullif("salary_min", F.lit(0.0)).isNull() & F.nullif("salary_max", F.lit(0.0)).isNull()
    paid = F.col("_b.pay.lo").isNotNull() | F.col("_b.pay.hi").isNotNull()
    return rows.join(good, ["uid", "url"], "left").withColumns({
        "description": F.coalesce("_b.description", "description"),
        "partial": F.col("partial") & F.col("_b").isNull(),
        "salary_min": F.when(unpaid & paid, F.col("_b.pay.lo")).otherwise(F.col("salary_min")),
        "salary_max": F.when(unpaid & paid, F.col("_b.pay.hi")).otherwise(F.col("salary_max")),
    }).drop("_b")


# -- public boards --------------------------------------------------------------------------

REMOTEOK = (
    "array<struct<position:string,company:string,url:string,location:string,description:string,"
    "date:string,epoch:bigint,salary_min:double,salary_max:double,id:string>>"
)


def remoteok(payloads: DataFrame) -> DataFrame:
    """Rows without a position are notices."""
    rows = _rows(payloads, REMOTEOK).filter(F.coalesce("j.position", F.lit("")) != "")
    return _postings(
        rows, "remoteok",
        title=F.col("j.position"), company=F.col("j.company"), url=F.col("j.url"),
        location=F.coalesce(F.nullif("j.location", F.lit("")), F.lit("Remote")),
        description=F.col("j.description"),
        posted_at=F.coalesce(dates.parse_date(F.nullif("j.date", F.lit(""))), dates.parse_epoch("j.epoch")),
        salary_min=_num("j.salary_min"), salary_max=_num("j.salary_max"), remote=F.lit(True),
        external_id=F.col("j.id"),
    )


REMOTIVE = (
    "jobs array<struct<title:string,company_name:string,url:string,candidate_required_location:string,"
    "description:string,publication_date:string,category:string,id:string>>"
)


def remotive(payloads: DataFrame) -> DataFrame:
    """S11"""
    return _postings(
        _rows(payloads, REMOTIVE, "jobs"), "remotive",
        title=F.col("j.title"), company=F.col("j.company_name"), url=F.col("j.url"),
        location=F.coalesce(F.nullif("j.candidate_required_location", F.lit("")), F.lit("Remote")),
        description=F.col("j.description"), posted_at=dates.parse_date("j.publication_date"),
        department=F.col("j.category"), remote=F.lit(True), external_id=F.col("j.id"),
    )


HIMALAYAS = (
    "jobs array<struct<title:string,companyName:string,companySlug:string,applicationLink:string,"
    "guid:string,locationRestrictions:array<string>,description:string,pubDate:string,"
    "minSalary:double,maxSalary:double>>"
)


def himalayas(payloads: DataFrame) -> DataFrame:
    """A page of placeholders keeps its postings; the company is rebuilt
    from its slug."""
    name = F.trim(F.coalesce("j.companyName", F.lit("")))
    real = (name != "") & ~F.lower(name).isin(*PLACEHOLDERS)
    places = F.array_join(F.coalesce("j.locationRestrictions", F.array().cast("array<string>")), ", ")
    stamp_text = F.col("j.pubDate")
    return _postings(
        _rows(payloads, HIMALAYAS, "jobs"), "himalayas",
        title=F.col("j.title"),
        company=F.when(real, name).otherwise(deslug(F.trim(F.coalesce("j.companySlug", F.lit(""))))),
        url=_or("j.applicationLink", "j.guid"),
        location=F.coalesce(F.nullif(places, F.lit("")), F.lit("Remote")),
        description=F.col("j.description"),
        posted_at=F.when(stamp_text.rlike(r"^\d+$"), dates.parse_epoch(stamp_text.try_cast("double")))
        .otherwise(dates.parse_date(stamp_text)),
        salary_min=_num("j.minSalary"), salary_max=_num("j.maxSalary"), remote=F.lit(True),
        external_id=F.col("j.guid"),
    )


def weworkremotely(payloads: DataFrame) -> DataFrame:
    """An RSS feed; titles read 'Company: Role'."""
    items = each(payloads, F.regexp_extract_all("payload", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1)), "i")

    def tag(name: str) -> Column:
        raw = F.regexp_extract("i", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
        data = F.regexp_extract(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
        return F.trim(F.when(raw.contains("<![CDATA["), data).otherwise(unescape(raw)))

    return feed_postings(items.select(*[tag(n).alias(n) for n in ("title", "link", "region", "description", "pubDate")]))


def feed_postings(rows: DataFrame) -> DataFrame:
    """Postings of feed items (title, link, region, description, pubDate)."""
    split = F.split("title", ": ", 2)
    two = (F.size(split) == 2) & (F.coalesce(F.try_element_at(split, F.lit(2)), F.lit("")) != "")
    return _postings(
        rows, "weworkremotely",
        title=F.when(two, F.try_element_at(split, F.lit(2))).otherwise(F.col("title")),
        company=F.when(two, split[0]).otherwise(F.lit("")),
        url=F.col("link"), location=F.coalesce(F.nullif("region", F.lit("")), F.lit("Remote")),
        description=F.col("description"), posted_at=dates.parse_date("pubDate"), remote=F.lit(True),
    )


ADZUNA = (
    "results array<struct<title:string,company:struct<display_name:string>,redirect_url:string,"
    "location:struct<display_name:string>,description:string,created:string,salary_min:double,"
    "salary_max:double,salary_is_predicted:string,id:string>>"
)


def adzuna(payloads: DataFrame) -> DataFrame:
    """Guessed pay is no pay, and every body is a snippet."""
    guessed = F.coalesce("j.salary_is_predicted", F.lit("0")) == "1"
    return _postings(
        _rows(payloads, ADZUNA, "results"), "adzuna",
        title=F.col("j.title"), company=F.col("j.company.display_name"), url=F.col("j.redirect_url"),
        location=F.col("j.location.display_name"), description=F.col("j.description"),
        posted_at=dates.parse_date("j.created"),
        salary_min=F.when(~guessed, _num("j.salary_min")), salary_max=F.when(~guessed, _num("j.salary_max")),
        external_id=F.col("j.id"), partial=F.lit(True),
    )


THEMUSE = (
    "results array<struct<name:string,company:struct<name:string>,refs:struct<landing_page:string>,"
    "locations:array<struct<name:string>>,contents:string,publication_date:string,id:string>>"
)


def themuse(payloads: DataFrame) -> DataFrame:
    """S15"""
    places = F.transform("j.locations", lambda p: F.coalesce(p["name"], F.lit("")))
    return _postings(
        _rows(payloads, THEMUSE, "results"), "themuse",
        title=F.col("j.name"), company=F.col("j.company.name"), url=F.col("j.refs.landing_page"),
        location=F.array_join(places, "; "), description=F.col("j.contents"),
        posted_at=dates.parse_date("j.publication_date"), remote=F.array_contains(places, MUSE_REMOTE),
        external_id=F.col("j.id"),
    )


JOBICY = (
    "jobs array<struct<jobTitle:string,companyName:string,url:string,jobGeo:string,"
    "jobDescription:string,pubDate:string,salaryMin:double,salaryMax:double,salaryPeriod:string,"
    "salaryCurrency:string,id:string>>"
)


def jobicy(payloads: DataFrame) -> DataFrame:
    """Only yearly dollar pay is kept."""
    kept = F.lower(F.coalesce("j.salaryPeriod", F.lit(""))).isin("year", "yearly", "annual") & (
        F.upper(F.coalesce("j.salaryCurrency", F.lit(""))) == "USD"
    )
    return _postings(
        _rows(payloads, JOBICY, "jobs"), "jobicy",
        title=F.col("j.jobTitle"), company=F.col("j.companyName"), url=F.col("j.url"),
        location=F.coalesce(F.nullif("j.jobGeo", F.lit("")), F.lit("Remote")),
        description=F.col("j.jobDescription"), posted_at=dates.parse_date("j.pubDate"),
        salary_min=F.when(kept, _num("j.salaryMin")), salary_max=F.when(kept, _num("j.salaryMax")),
        remote=F.lit(True), external_id=F.col("j.id"),
    )


USAJOBS = (
    "SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<"
    "PositionTitle:string,OrganizationName:string,PositionURI:string,PositionID:string,"
    "PositionLocation:array<struct<LocationName:string>>,QualificationSummary:string,"
    "UserArea:struct<Details:struct<JobSummary:string>>,PublicationStartDate:string,"
    "PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string>>>>>>"
)


def usajobs(payloads: DataFrame) -> DataFrame:
    """The first pay row, the first three places."""
    d = "j.MatchedObjectDescriptor"
    rows = each(payloads, F.from_json("payload", USAJOBS)["SearchResult"]["SearchResultItems"], "j")
    pay = F.try_element_at(f"{d}.PositionRemuneration", F.lit(1))
    body = F.array_join(
        F.filter(F.array(F.col(f"{d}.UserArea.Details.JobSummary"), F.col(f"{d}.QualificationSummary")),
                 lambda x: x.isNotNull() & (x != "")), " ",
    )
    return _postings(
        rows, "usajobs",
        title=F.col(f"{d}.PositionTitle"), company=F.col(f"{d}.OrganizationName"), url=F.col(f"{d}.PositionURI"),
        location=F.array_join(F.transform(F.slice(f"{d}.PositionLocation", 1, 3), lambda p: F.coalesce(p["LocationName"], F.lit(""))), ", "),
        description=body, posted_at=dates.parse_date(f"{d}.PublicationStartDate"),
        salary_min=_num(pay["MinimumRange"]), salary_max=_num(pay["MaximumRange"]),
        external_id=F.col(f"{d}.PositionID"),
    )


HACKERNEWS = "id bigint, text string, time bigint, deleted boolean, dead boolean"


def hackernews(payloads: DataFrame) -> DataFrame:
    """A comment's first sentence is 'Company | Role | Place'."""
    c = payloads.select(F.from_json("payload", HACKERNEWS).alias("c")).filter(
        ~F.coalesce("c.deleted", F.lit(False)) & ~F.coalesce("c.dead", F.lit(False))
        & (F.coalesce("c.text", F.lit("")) != "")
    ).withColumn("flat", clean_text("c.text"))
    head = F.substring(F.split(F.split("flat", "\n")[0], r"\.")[0], 1, 200)
    c = c.withColumn("head", head).withColumn("parts", F.transform(F.split("head", r"\|"), lambda x: F.trim(x)))
    return _postings(
        c, "hackernews",
        title=F.coalesce(F.try_element_at("parts", F.lit(2)), F.substring("head", 1, 80)),
        company=F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("Unknown")),
        url=F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("c.id").cast("string")),
        location=F.coalesce(F.try_element_at("parts", F.lit(3)), F.lit("")), description=F.col("flat"),
        posted_at=dates.parse_epoch("c.time"), remote=F.substring("flat", 1, 400).rlike(r"(?i)\bremote\b"),
        external_id=F.col("c.id").cast("string"),
    )


HIRINGCAFE_ROW = (
    "array<struct<job_information:struct<title:string,company:string,location:string,"
    "description:string,posted_at:string>,company:struct<name:string>,apply_url:string,url:string,"
    "created_at:string,title:string,location:string,description:string,posted_at:string>>"
)


def hiringcafe(payloads: DataFrame) -> DataFrame:
    """Results or hits; the fields sit in job_information or on the row."""
    doc = F.from_json("payload", f"results {HIRINGCAFE_ROW}, hits {HIRINGCAFE_ROW}")
    items = F.when(F.size(doc["results"]) > 0, doc["results"]).otherwise(doc["hits"])
    rows = each(payloads, items, "j")
    inner = F.col("j.job_information").isNotNull()
    field = lambda n: F.when(inner, F.col(f"j.job_information.{n}")).otherwise(F.col(f"j.{n}"))
    return _postings(
        rows, "hiringcafe",
        title=field("title"), company=_or("j.company.name", "j.job_information.company"),
        url=_or("j.apply_url", "j.url"), location=field("location"), description=field("description"),
        posted_at=dates.parse_date(_or(F.col("j.created_at"), field("posted_at"))),
    )


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters,
    "workable": workable, "recruitee": recruitee, "sitemap": sitemap, "remoteok": remoteok,
    "remotive": remotive, "himalayas": himalayas, "weworkremotely": weworkremotely,
    "adzuna": adzuna, "themuse": themuse, "jobicy": jobicy, "usajobs": usajobs,
    "hackernews": hackernews, "hiringcafe": hiringcafe,
}


def collect(landed: dict[str, DataFrame], only: str = "") -> DataFrame:
    """The union of every enabled source. A source whose documents do not
    parse costs only its own rows."""
    chosen = [REGISTRY[name](df) for name, df in landed.items() if only in name]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def source_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count("*").alias("n"))


# -- employers, snapshots, digests ------------------------------------------------------------


def watch_list(curated: DataFrame, learned: DataFrame, tiers: Iterable[int] = (1, 2)) -> DataFrame:
    """Curated employers and learned ones; curated wins a name."""
    key = F.lower(F.trim("name"))
    extra = learned.withColumn("_k", key).join(
        curated.select(key.alias("_k")).distinct(), "_k", "left_anti"
    ).drop("_k")
    return curated.unionByName(extra, allowMissingColumns=True).filter(
        F.coalesce("tier", F.lit(2)).isin(*tiers)
    )


def _snapshot_files(spark: SparkSession, paths: Sequence[str], keep: int | None) -> DataFrame:
    """file, rows (null where the file does not parse) of the last ``keep`` files, or all."""
    from ..schema import SNAPSHOT

    stored = {k: ("string" if v == "timestamp" else v) for k, v in SNAPSHOT.items()}
    newest = sorted(paths) if keep is None else sorted(paths)[-keep:]
    schema = f"array<struct<{', '.join(f'{k}:{v}' for k, v in stored.items())}>>"
    files = spark.read.option("wholetext", True).option("ignoreCorruptFiles", True).text(newest)
    return files.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("rows"))


def unreadable_snapshots(spark: SparkSession, paths: Sequence[str], keep: int | None = None) -> DataFrame:
    """File: those that ``read_snapshots`` can't parse, as a table beside its rows."""
    return _snapshot_files(spark, paths, keep).filter(F.col("rows").isNull()).select("file")


def read_snapshots(spark: SparkSession, paths: Sequence[str], keep: int | None = None) -> DataFrame:
    """The snapshot files (the last ``keep``, if given), each a JSON list of rows.
    Files that do not parse are told by ``unreadable_snapshots``; rows without title or
    company are skipped."""
    rows = _snapshot_files(spark, paths, keep).select("file", F.posexplode("rows").alias("pos", "r")).select("file", "pos", "r.*")
    return rows.withColumns(
        {c: dates.parse_date(c) for c in ("posted_at", "first_seen")}
    ).filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("company", F.lit("")) != ""))


def read_digest(lines: DataFrame) -> DataFrame:
    """Candidates from digest lines (doc, pos, line): a tier heading, then
    '### [score] [title](url)' and a starred line of company, place, source.

    The windows run per digest document.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    tier = F.nullif(F.regexp_extract("line", r"^## ([A-F]) - ", 1), F.lit(""))
    head = r"^### \[(\d+)\] \[(.+?)\]\((\S+)\)\s*$"
    is_head = F.col("line").rlike(head)
    meta = F.nullif(F.regexp_extract("line", r"^\*(.+?)\*\s*$", 1), F.lit(""))
    marked = lines.withColumns({
        "tier": F.last(tier, ignorenulls=True).over(w),
        "_group": F.sum(is_head.cast("int")).over(w), "_head": is_head, "_meta": meta,
    })
    # A tier heading ends nothing: the first starred line after a head is its own.
    found = marked.filter(F.col("_group") > 0).groupBy("doc", "_group").agg(
        F.min(F.when(F.col("_head"), F.struct("pos", "line", "tier"))).alias("h"),
        F.min(F.when(~F.col("_head") & F.col("_meta").isNotNull(), F.struct("pos", F.col("_meta").alias("meta")))).alias("m"),
    )
    parts = F.transform(F.split("m.meta", " - "), lambda x: F.trim(x))
    out = found.select(
        "doc", F.col("h.pos").alias("pos"),
        F.regexp_extract("h.line", head, 1).cast("int").alias("score"),
        F.regexp_extract("h.line", head, 2).alias("title"), F.regexp_extract("h.line", head, 3).alias("url"),
        F.coalesce("h.tier", F.lit("")).alias("tier"), parts.alias("p"),
    )
    last = F.element_at("p", -1)
    return out.filter(F.coalesce(F.try_element_at("p", F.lit(1)), F.lit("")) != "").select(
        "doc", "pos", "score", "title", "url", "tier", F.col("p")[0].alias("company"),
        F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")).alias("location"),
        F.when(last != F.col("p")[0], last).otherwise(F.lit("digest")).alias("source"),
    )


def board_of_url(rows: DataFrame, employers: DataFrame) -> DataFrame:
    """The watched employer a stored row came from. Host and first path
    part make the prefix test an equi-join; case does not matter."""
    wd = F.concat(F.lit("https://"), "host", F.lit("/"), "site", F.lit("/"))
    sr = F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"))
    prefix = F.lower(F.when(F.col("ats") == "workday", wd).when(F.col("ats") == "smartrecruiters", sr))
    boards = employers.withColumn("_prefix", prefix).filter(F.col("_prefix").isNotNull()).select(
        F.col("name").alias("employer"), F.col("ats").alias("source"), "_prefix",
        F.regexp_extract("_prefix", r"^(https://[^/]+/[^/]+/)", 1).alias("_key"), F.col("pos").alias("_pos"),
    )
    keyed = rows.withColumn("_url", F.lower("url")).withColumn(
        "_key", F.regexp_extract("_url", r"^(https://[^/]+/[^/]+/)", 1)
    )
    match = (
        keyed.select("uid", "source", "_url", "_key")
        .join(boards, ["source", "_key"])
        .filter(F.startswith(F.col("_url"), F.col("_prefix")))
        .groupBy("uid", "_url")
        .agg(F.min_by("employer", "_pos").alias("employer"))
    )
    return keyed.join(match, ["uid", "_url"], "left").drop("_url", "_key")
