"""Source profiles: what a listing site looks like, as data. Seeds, alternatives and follow-up pages are planned by joins over stored pages; a site's patterns become Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions import urls
from almanack.functions.places import CITIES
from almanack.plans.steps import written


@dataclass(frozen=True)
class Profile:
    """key and platform; templates of listing addresses with {slug} (a city's spellings are alternatives); pattern of event addresses. The rest: patterns of follow-up pages and of addresses that
    are no events after all; the id in an event's address and whole ids in JSON; addresses made of a slug or of section, slug and id; how event and listing slugs differ where they share a
    path; the city's place in an address; a venue's own city, or one list for all cities; pages to read; whether to guess links, and whether organisers are ever named."""

    key: str
    platform: str
    templates: tuple[str, ...]
    event: str
    follow: tuple[str, ...] = ()
    exclude: str = ""
    event_id: str = ""
    json_id: str = ""
    slug_url: str = ""
    id_url: str = ""
    section_of: str = ""
    sections: tuple[str, ...] = ()
    section_categories: dict[str, str] = field(default_factory=dict)
    listing_slug: str = ""
    event_slug: str = ""
    url_city: str = ""
    city: str = ""
    national: bool = False
    pages: int = 12
    stop_after: int = 3
    enabled: bool = True
    guess: bool = False
    organizer_published: bool = True
    slugs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def slugs_of(self, city_key: str) -> tuple[str, ...]:
        return self.slugs.get(city_key, ())

    def covers(self, name: str, key: str) -> bool:
        return self.city == name if self.city else self.national or bool(self.slugs_of(key))

    def is_event(self, url: Column) -> Column:
        out = url.rlike(f"(?i){self.event}")
        if self.exclude:
            out &= ~url.rlike(f"(?i){self.exclude}")
        if self.listing_slug:
            slug = F.lower(F.regexp_extract(url, r"([^/]*)/*$", 1))
            out &= slug.rlike(self.event_slug) | ~slug.rlike(self.listing_slug)
        return F.coalesce(out, F.lit(False))

    def id_of(self, url: Column) -> Column:
        return F.regexp_extract(url, f"(?i){self.event_id}", 1) if self.event_id else F.lit("")

    def made_url(self, page: Column, slug: Column, ident: Column) -> Column:
        """The address of an object that has an id, in the section of the page that lists it."""
        section = F.regexp_extract(page, self.section_of, 1)
        parts = {"{section}": F.when(section == "", self.sections[0]).otherwise(section), "{slug}": slug, "{id}": ident}
        return F.concat(*(parts[x] if x in parts else F.lit(x) for x in re.split(r"(\{\w+\})", self.id_url) if x))

    def alternates(self, url: Column) -> Column:
        """The same event in the site's other sections."""
        if not self.sections:
            return F.array().cast("array<string>")
        kinds = "|".join(self.sections)
        own = F.regexp_extract(url, f"/({kinds})/[^/?#]+/[^/?#]+$", 1)
        return F.filter(F.array(*(F.when((own != "") & (own != s), F.regexp_replace(url, f"/({kinds})/(?=[^/?#]+/[^/?#]+$)", f"/{s}/")) for s in self.sections)), lambda u: u.isNotNull())

    def follows(self, city_key: str) -> list[str]:
        """Patterns of a city's further listing pages."""
        spelled = "|".join(re.escape(s) for s in self.slugs_of(city_key))
        return [p.replace("{slug}", f"(?:{spelled})") for p in self.follow if spelled or "{slug}" not in p]

    def domains(self) -> list[str]:
        return sorted({re.sub(r"^www\.", "", t.split("/")[2]) for t in self.templates})


PROFILES: dict[str, Profile] = {}


def register_profile(profile: Profile) -> None:
    PROFILES[profile.key] = profile


def known() -> dict[str, Profile]:
    """All profiles, those of the known sites and the user's own."""
    from almanack.sources import sites  # noqa: F401  registers them

    return PROFILES


def chosen(keys: list[str] | None = None) -> list[Profile]:
    """The named profiles, or those that are on by default; an unknown name is an error."""
    have = known()
    if keys is None:
        return [p for p in have.values() if p.enabled]
    if unknown := [k for k in keys if k not in have]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return [have[k] for k in have if k in keys]


def seeds(spark: SparkSession, keys: list[str] | None = None, cities: list[str] | None = None) -> DataFrame:
    """(source, platform, city, template, alternative, url): every template with every spelling of each covered city."""
    rows = []
    for p in chosen(keys):
        for name, key, _ in CITIES:
            if (cities is None or name in cities) and p.covers(name, key):
                for t, template in enumerate(p.templates):
                    spellings = p.slugs_of(key) if "{slug}" in template else ("",)
                    rows += [(p.key, p.platform, name, t, a, template.replace("{slug}", s)) for a, s in enumerate(spellings)]
    return spark.createDataFrame(rows, "source string, platform string, city string, template int, alternative int, url string")


def first_working(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """Of alternative spellings the first whose page has events (pages: url, status, n_events), else the first that is not missing."""
    order = Window.partitionBy("source", "city", "template").orderBy(F.desc(F.col("n_events") > 0), "alternative")
    return planned.join(pages, "url").where("status != 404").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def loaded(plain: DataFrame, rendered: DataFrame, least: int = 6) -> DataFrame:
    """The page of each url (both: url, n_events, ...): as it was downloaded, or as a browser showed it where the download has fewer event links than `least` and the browser's page has more."""
    both = plain.select("url", F.struct(*plain.columns).alias("p")).join(rendered.select("url", F.struct(*plain.columns).alias("r")), "url", "full")
    better = F.col("p").isNull() | ((F.col("p.n_events") < least) & (F.col("r.n_events") > F.col("p.n_events")))
    return both.select(F.when(better & F.col("r").isNotNull(), F.col("r")).otherwise(F.col("p")).alias("x")).select("x.*")


def _pattern(keys: list[str]) -> Column:
    """The follow-up pattern of a row's source and city, as one CASE."""
    out = F.lit(None).cast("string")
    for p in chosen(keys):
        for name, key, _ in CITIES:
            if own := p.follows(key):
                out = F.when((F.col("source") == p.key) & (F.col("city") == name), "(?i)" + "|".join(own)).otherwise(out)
    return out


def frontier(start: DataFrame, links: DataFrame, follow: dict[str, str] | None = None, budget: int = 12, found: DataFrame | None = None, stop_after: int = 3) -> DataFrame:
    """(source, city, url, depth, place): breadth-first over stored links (page, pos, url) from the start pages, the first `budget` pages of a source and city in the order met. With found (page, new:
    events not seen before) pages after `stop_after` ones without any are left out. follow: a pattern for each source, else the profiles' own. Each round is a written table; there are no more rounds than `budget`."""
    keys = sorted(r.source for r in start.select("source").distinct().collect())  # one row a source
    rx = _pattern(keys) if follow is None else F.try_element_at(F.create_map(*(F.lit(x) for kv in follow.items() for x in kv)) if follow else F.create_map().cast("map<string,string>"), F.col("source"))
    links = links if "pos" in links.columns else links.withColumn("pos", F.lit(0))
    seen = written(start.groupBy("source", "city", "url").agg(F.lit(0).alias("depth"), F.array(F.lit(0)).alias("path")), "frontier")
    edge = seen
    for depth in range(1, budget):
        step = edge.withColumnRenamed("url", "page").join(links.select("page", "pos", "url"), "page").withColumn("rx", rx).where(F.col("rx").isNotNull() & (F.col("rx") != "") & F.regexp_like("url", F.col("rx")))
        new = step.groupBy("source", "city", "url").agg(F.min(F.concat("path", F.array("pos"))).alias("path")).join(seen, ["source", "city", "url"], "left_anti")
        edge = written(new.select("source", "city", "url", F.lit(depth).alias("depth"), "path"), "frontier")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    order = Window.partitionBy("source", "city").orderBy("depth", "path", "url")
    out = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)
    if found is not None:
        out = out.join(found.select(F.col("page").alias("url"), "new"), "url", "left")
        island = F.sum(F.when(F.coalesce("new", F.lit(0)) > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("i", island).withColumn("dry", F.row_number().over(Window.partitionBy("source", "city", "i").orderBy("place")) - F.when(F.col("i") > 0, 1).otherwise(0))
        end = F.min(F.when(F.col("dry") >= stop_after, F.col("place"))).over(Window.partitionBy("source", "city"))
        out = out.withColumn("end", end).where(F.col("end").isNull() | (F.col("place") <= F.col("end")))
    return out.select("source", "city", "url", "depth", "place")


def platform_of(url: Column) -> Column:
    """The platform whose host an address has; '' if none."""
    from almanack.sources.sites import DOMAINS

    return F.coalesce(urls.domain_rank(urls.host_of(url), DOMAINS), F.lit(""))


def other_town(source: Column, url: Column, cities: list[str]) -> Column:
    """Whether a source's own address names a town that is none of the cities (by the site's spellings or the cities' aliases)."""
    out = F.lit(False)
    for p in known().values():
        if p.url_city:
            ours = {s for name, key, _ in CITIES if name in cities for s in p.slugs_of(key)} | {re.sub(r"[^a-z0-9]+", "-", a) for name, _, aliases in CITIES if name in cities for a in aliases}
            town = F.regexp_extract(url, p.url_city, 1)
            out = F.when(source == p.key, (town != "") & ~town.isin(*sorted(ours)) if ours else town != "").otherwise(out)
    return F.coalesce(out, F.lit(False))


def stamped(events: DataFrame, p: Profile) -> DataFrame:
    """Events with what their source knows: its name first among sources and platforms, their link, the id in their address, and its city if it has one or the row has none (column `listed_city`)."""
    platform = F.coalesce(F.nullif("platform", F.lit("")), F.lit(p.platform))
    entries = F.map_entries("links")
    linked = F.when((F.col("url") != "") & ~F.array_contains(F.map_keys("links"), platform), F.map_concat("links", F.create_map(platform, F.col("url")))).otherwise(F.map_from_entries(entries))
    return events.withColumns({
        "source": F.lit(p.key), "sources": F.array_union("sources", F.array(F.lit(p.key))), "platform": platform, "platforms": F.when(F.array_contains("platforms", platform), F.col("platforms")).otherwise(F.array_prepend("platforms", platform)),
        "links": linked, "source_id": F.coalesce(F.nullif("source_id", F.lit("")), p.id_of(F.col("url"))), "city": F.lit(p.city) if p.city else F.coalesce(F.nullif("city", F.lit("")), "listed_city", F.lit("")),
    }).drop("listed_city")


def needs_detail(organizer_published: Column) -> Column:
    """Whether a listing lacks anything that its page may tell."""
    whole = F.col("start").isNotNull() & F.col("has_time") & (F.col("venue") != "") & (F.col("price_min").isNotNull() | F.col("is_free")) & (F.length("description") >= 40) & ((F.col("organizer") != "") | ~organizer_published)
    return (F.col("url") != "") & ~whole
