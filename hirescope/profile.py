"""The targeting profile: whom the postings are scored for.

A profile is small configuration. Its lists become literals inside column
expressions, so scoring needs no join and no broadcast. The sample below is
invented.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Family:
    points: int
    label: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Signal:
    label: str
    points: int
    phrases: tuple[str, ...]


@dataclass(frozen=True)
class Targeting:
    tier_1_titles: tuple[str, ...] = ()
    tier_2_titles: tuple[str, ...] = ()
    tier_3_titles: tuple[str, ...] = ()
    family_titles: tuple[str, ...] = ()
    adjacent_titles: tuple[str, ...] = ()
    title_disqualifiers: tuple[str, ...] = ()
    entry_level_markers: tuple[str, ...] = ()
    clerical_markers: tuple[str, ...] = ()
    off_field_markers: tuple[str, ...] = ()
    function_families: tuple[Family, ...] = ()
    domain_modifiers: tuple[str, ...] = ()
    core_skills: dict[str, int] = field(default_factory=dict)
    supporting_skills: dict[str, int] = field(default_factory=dict)
    foreign_skills: tuple[str, ...] = ()
    owned_text: str = ""
    products: tuple[str, ...] = ()
    home_metro: str = ""
    local_terms: tuple[str, ...] = ()
    state_terms: tuple[str, ...] = ()
    remote_terms: tuple[str, ...] = ("remote", "work from home", "anywhere")
    hybrid_terms: tuple[str, ...] = ("hybrid", "onsite", "on-site", "in office")
    remote_exclusions: tuple[str, ...] = ()
    non_us_markers: tuple[str, ...] = ()
    years_comfortable: int = 2
    max_years_stretch: int = 4
    equivalency_ceiling: int = 6
    equivalency_phrases: tuple[str, ...] = ()
    no_experience_phrases: tuple[str, ...] = ()
    bachelors_terms: tuple[str, ...] = ()
    degree_fields: tuple[str, ...] = ()
    advanced_degree_terms: tuple[str, ...] = ()
    staffing_agencies: tuple[str, ...] = ()
    agency_phrases: tuple[str, ...] = ()
    dealbreaker_signals: tuple[Signal, ...] = ()
    hard_disqualifiers: tuple[str, ...] = ()
    comp_structure_blocks: tuple[str, ...] = ()
    volunteer_markers: tuple[str, ...] = ()
    fresh_days: int = 7
    stale_days: int = 45
    salary_floor: float = 55_000
    salary_target: float = 80_000
    salary_ceiling: float = 0
    languages_spoken: tuple[str, ...] = ("english",)
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    synonyms_enabled: bool = True
    synonym_discount: int = 6
    search_synonym_limit: int = 6
    search_queries: tuple[str, ...] = ()
    workday_search_terms: tuple[str, ...] = ()

    @property
    def pay_ceiling(self) -> float:
        return float(self.salary_ceiling or 2 * self.salary_target)

    def alternates(self) -> dict[str, list[str]]:
        """Canonical term to its other wordings; nothing when switched off."""
        if not self.synonyms_enabled:
            return {}
        out: dict[str, list[str]] = {}
        for term, also in self.synonyms:
            term = term.strip().lower()
            if term:
                known = out.setdefault(term, [])
                known += [a.strip().lower() for a in also if a.strip() and a.strip().lower() != term]
        return out


SAMPLE = Targeting(
    tier_1_titles=("data analyst", "reporting analyst", "business intelligence analyst"),
    tier_2_titles=("operations analyst", "business analyst"),
    tier_3_titles=("research assistant", "data technician"),
    family_titles=("analyst",),
    adjacent_titles=("data quality", "insights "),
    title_disqualifiers=("senior", "sr", "lead", "manager", "director", "principal", "head"),
    entry_level_markers=("entry level", "junior", "jr", "associate", "graduate", "trainee"),
    clerical_markers=("receptionist", "data entry"),
    off_field_markers=("real estate", "nurse", "warehouse"),
    function_families=(
        Family(18, "analyst function", ("analyst", "analytics", "analysis")),
        Family(14, "reporting function", ("reporting", "dashboard")),
        Family(10, "engineering function", ("data engineer", "developer")),
    ),
    domain_modifiers=("data", "supply chain", "marketing"),
    core_skills={"sql": 4, "excel": 3, "python": 4, "tableau": 3},
    supporting_skills={"power bi": 2, "dbt": 1, "snowflake": 2, "statistics": 1},
    foreign_skills=("java", "scala", ".net"),
    owned_text="sql excel python tableau power bi statistics git",
    home_metro="Columbus, OH",
    local_terms=("columbus", "dublin, oh", "westerville"),
    state_terms=("ohio", ", oh"),
    remote_exclusions=("remote (canada)", "europe only", "must reside in canada"),
    non_us_markers=("canada", "london", "bangalore", "toronto"),
    equivalency_phrases=("or equivalent experience", "equivalent combination of education"),
    no_experience_phrases=("no experience required", "we will train", "no prior experience"),
    bachelors_terms=("bachelor", "undergraduate degree"),
    degree_fields=("statistics", "economics", "mathematics"),
    advanced_degree_terms=("master's degree", "phd", "doctorate"),
    staffing_agencies=("hirewell temps", "apex contract staffing"),
    agency_phrases=("our client is seeking", "on behalf of our client"),
    dealbreaker_signals=(
        Signal("off-hours availability", -8, ("weekend availability", "night shift")),
        Signal("heavy travel", -6, ("50% travel", "extensive travel")),
        Signal("bilingual ask", -4, ("fluent in",)),
    ),
    hard_disqualifiers=("security clearance", "cpa required"),
    comp_structure_blocks=("commission only", "1099 only"),
    volunteer_markers=("volunteer position", "unpaid internship"),
    synonyms=(
        ("data analyst", ("insights analyst", "analytics associate")),
        ("power bi", ("powerbi", "dax")),
        ("sql", ("t-sql", "postgres")),
        ("operations analyst", ("ops analyst",)),
    ),
    search_queries=("data analyst", "reporting analyst", "sql"),
)
