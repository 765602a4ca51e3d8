"""Registered queries over the driver's tables, and the same in SQL for an independent engine.

Window of the listing queries: 1996-03-01 to 1996-06-30, both ends included.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanack.functions import classify, dates, money, places, text, urls
from almanack.operators import filters, resolve, tables
from almanack.operators.merge import merged
from almanack.plans.listings import SQL as LISTINGS
from almanack.plans.listings import listings, table
from almanack.schema import as_events
from almanack.sources import pages as readers

FIRST, LAST = dt.date(1996, 3, 1), dt.date(1996, 6, 30)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, over: str | None = "listings"):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with listings as ({LISTINGS}) {sql.strip()}" if over == "listings" else sql.strip()
        return f

    return add


IN_WINDOW = "start_d <= date '1996-06-30' and coalesce(end_d, start_d) >= date '1996-03-01'"


def _tier_sql(price: str) -> str:
    return f"case when {price} >= 5000 then 'Ultra Premium' when {price} >= 1550 then 'Luxury' when {price} >= 500 then 'Premium' else 'Standard' end"


LOW = "case when is_free then 0 else price_min end"
HIGH = f"greatest(coalesce(price_max, price_min), {LOW})"


def _windowed(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("start_d") <= F.lit(LAST)) & (F.coalesce("end_d", "start_d") >= F.lit(FIRST)))


def _tier(basis: str = "min"):
    return classify.tier(F.col("price_min"), F.col("price_max"), F.col("is_free"), basis)


@query(f"select lid, title, city, start_d, tier, cast(row_number() over (order by city, start_d, title, lid) as bigint) as serial, count(*) over (partition by city) as in_city from (select *, {_tier_sql(LOW)} as tier from listings where {IN_WINDOW}) w")
def calendar_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _windowed(listings(spark, sf_dir)).withColumn("tier", _tier())
    out = tables.bands(tables.serials(rows, [F.col("city"), F.col("start_d"), F.col("title"), F.col("lid")]), "city", ["start_d", "title", "lid"])
    return out.select("lid", "title", "city", "start_d", "tier", "serial", F.col("in_group").alias("in_city"))


REASON = f"""case when lid % 17 = 0 then 'other city' when lid % 19 = 0 then 'online' when lid % 23 = 0 then 'abroad' when lid % 29 = 0 then 'placeholder title' when lid % 13 = 0 then 'no date'
  when end_d - start_d > 31 and start_d < date '1996-03-01' then 'long series' when not ({IN_WINDOW.replace("coalesce(end_d, start_d)", "coalesce(case when end_d - start_d <= 31 then end_d end, start_d)")}) then 'outside the window' end"""


@query(f"select coalesce(reason, 'kept') as reason, count(*) as n from (select {REASON} as reason from listings) r group by 1")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a run: filters.settled and filters.drop_reason over listings of which some are made to fail in each way."""
    own = lambda k: F.col("lid") % k == 0
    rows = listings(spark, sf_dir).withColumns({
        "city": F.when(own(17), "Elsewhere").otherwise("Pune"), "online": own(19), "venue": F.when(own(23) & ~own(19), "Arena, Singapore").otherwise(""), "title": F.when(own(29), "tba").otherwise(F.col("title")),
        "start": F.when(~own(13), F.col("start_d").cast("timestamp_ntz")), "end": F.when(~own(13), F.col("end_d").cast("timestamp_ntz")),
    })
    rows = filters.settled(as_events(rows, "lid"), FIRST, LAST)
    reason = filters.drop_reason(FIRST, LAST, ["Pune"], flags=())
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _tier_query(basis: str, price: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listings(spark, sf_dir).groupBy(_tier(basis).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price_min"), 2).alias("sum_min"))

    run.__name__ = f"tier_{basis}"
    query(f"select {_tier_sql(price)} as tier, count(*) as n, round(sum(price_min), 2) as sum_min from listings group by 1")(run)


for _basis, _price in (("min", f"({LOW})"), ("max", f"({HIGH})"), ("avg", f"((({LOW}) + ({HIGH})) / 2)")):
    _tier_query(_basis, _price)


def _rule_sql(rules: classify.Rules, column: str) -> str:
    """A rule chain for an engine whose patterns cannot look around: what stands beside a word is matched with it."""
    plain = lambda words: words.replace("(?<!martial )", "").replace(r"run(?=\s+20\d\d)", r"run\s+20\d\d").replace("'", "''")
    return "case " + " ".join(f"when regexp_matches({column}, '(?i)(^|[^a-z0-9])({plain(words)})($|[^a-z0-9])') then '{label}'" for label, words in rules) + " end"


TOPICS = ["Volleyball", "Certificate Course", "Odissi", "Stand-up", "Garba Nights", "Shooting Range", "City Run 2027", "Wine tasting", "Solo Show", "DJ set", "National Games", "Quiz", "World Tour", "Festival", "Nothing", "Oktoberfest", "Women's run", "Laugh Store"]
TOPIC = f"concat(([{', '.join(repr(t) if chr(39) not in t else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t in TOPICS)}])[1 + p_partkey % {len(TOPICS)}], ' ', p_name)"
KIND = "case p_size % 5 when 0 then 'Plays' when 1 then 'Sports' when 2 then 'Performances' else '' end"
ABOUT = "case when p_size % 3 = 0 then 'An evening of kathak.' else 'It is on.' end"


@query(f"""
select activity, count(*) as n from (
  select case when weak <> 'Culture' and main is null and prior is null then weak else coalesce(prior, main, told, weak, 'Other') end as activity from (
    select coalesce({_rule_sql(classify.PRIORITY_RULES, "concat(title, ' |  | ', kind)")}) as prior, coalesce({_rule_sql(classify.MAIN_RULES, "kind")}, {_rule_sql(classify.MAIN_RULES, "title")}) as main,
      {_rule_sql(classify.WEAK_RULES, "concat(kind, ' | ', title)")} as weak, {_rule_sql(classify.MAIN_RULES, "about")} as told
    from (select {TOPIC} as title, {KIND} as kind, {ABOUT} as about from part) p) r) a group by 1
""", over=None)
def activity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify.activity with all its rules over titles, kinds and descriptions made of parts."""
    topics = F.array(*map(F.lit, TOPICS))
    title = F.concat_ws(" ", F.element_at(topics, (1 + F.col("p_partkey") % len(TOPICS)).cast("int")), "p_name")
    rows = table(spark, sf_dir, "part").select(classify.activity(F.array(F.expr(KIND)), title, F.expr(ABOUT), F.lit("")).alias("activity"))
    return rows.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


TIERS = ["Ultra Premium", "Luxury", "Premium", "Standard"]
CELLS = ", ".join(f"count(*) filter (where tier = '{t}') as \"{t}\"" for t in TIERS)


@query(f"select city, {CELLS} from (select *, {_tier_sql(LOW)} as tier from listings) t group by city")
def city_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.crosstab(listings(spark, sf_dir).withColumn("tier", _tier()), "city", "tier", TIERS)


@query(f"select case when grouping(city) = 1 then 'Total' else city end as city, {CELLS}, count(*) as total from (select *, {_tier_sql(LOW)} as tier from listings) t group by rollup(city)")
def city_crosstab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.crosstab(listings(spark, sf_dir).withColumn("tier", _tier()), "city", "tier", TIERS, totals=True)


@query("select platform, count(*) as n from (select unnest([platform, concat('also ', status)]) as platform from listings) p group by 1")
def platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.counts_by(listings(spark, sf_dir).withColumn("ps", F.array("platform", F.concat(F.lit("also "), "status"))), "ps", "platform")


@query("""
select concat(url, '|', city) as identity, count(*) as merged, arg_min(title, lid) as title, arg_min(start_d, lid) as start_d, arg_min(price_min, lid) as price_min,
  arg_min(price_max, lid) filter (where price_max is not null) as price_max, bool_or(is_free) as is_free, count(distinct platform) as platforms, count(distinct platform) as links
from listings group by 1
""")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merge.merged, the fold of one event's rows, by url and city."""
    rows = listings(spark, sf_dir).withColumns({"identity": F.concat_ws("|", "url", "city"), "start": F.col("start_d").cast("timestamp_ntz"), "platforms": F.array("platform"), "links": F.create_map("platform", "url"), "sources": F.array(F.col("lid").cast("string"))})
    rows = merged(as_events(rows, "identity", "lid"), ["identity"], "lid")
    return rows.select("identity", F.size("sources").cast("bigint").alias("merged"), "title", F.to_date("start").alias("start_d"), "price_min", "price_max", "is_free", F.size("platforms").cast("bigint").alias("platforms"), F.size("links").cast("bigint").alias("links"))


STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOP_WORDS)
TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w not in ({STOP}) and not regexp_full_match(w, '20[0-9][0-9]'))))"


@query(f"select title, array_to_string({TOKENS}, ' ') as tokens, len({TOKENS}) as n from (select distinct title from listings) t")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array_sort(text.title_tokens(F.col("title")))
    return listings(spark, sf_dir).select("title").distinct().select("title", F.array_join(t, " ").alias("tokens"), F.size(t).cast("bigint").alias("n"))


@query(f"""
, t as (select city, title, {TOKENS} as k from (select distinct city, title from listings) d),
p as (select a.city, a.title as a, b.title as b, len(list_intersect(a.k, b.k)) as shared, len(a.k) as na, len(b.k) as nb from t a join t b on a.city = b.city and a.title < b.title)
select city, a, b from p where least(na, nb) > 0 and ((least(na, nb) >= 2 and shared = least(na, nb)) or shared * 1.0 / (na + nb - shared) >= 0.6)
""")
def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almanack.plans.steps import written

    rows = listings(spark, sf_dir).select("city", "title").distinct().withColumn("id", F.xxhash64("city", "title"))
    rows = written(rows.withColumn("tokens", text.title_tokens(F.col("title"))).where(F.size("tokens") > 0), "titles")
    pairs = resolve.title_pairs(rows.select("id", "city", "tokens"))
    x, y = rows.select(F.col("id").alias("a"), "city", F.col("title").alias("x")), rows.select(F.col("id").alias("b"), F.col("title").alias("y"))
    out = pairs.join(x, "a").join(y, "b")
    return out.select("city", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@query(f"""
, t as (select lid, city, platform, year(start_d) as y, month(start_d) as m, status, {TOKENS} as k from listings)
select n.lid from t n where n.status <> 'F' and not exists (select 1 from t s where s.status = 'F' and s.city = n.city and s.platform = n.platform and s.y = n.y and s.m = n.m and least(len(s.k), len(n.k)) > 0
  and ((least(len(s.k), len(n.k)) >= 2 and len(list_intersect(s.k, n.k)) = least(len(s.k), len(n.k))) or len(list_intersect(s.k, n.k)) * 1.0 / (len(s.k) + len(n.k) - len(list_intersect(s.k, n.k))) >= 0.6))
""")
def unseen_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings whose title matches none of the closed ones of its city, platform and month."""
    from almanack.plans.steps import written

    rows = written(listings(spark, sf_dir).select("lid", "city", "platform", F.year("start_d").alias("y"), F.month("start_d").alias("m"), "status", "title"), "unseen-rows")
    words = written(rows.select("title").distinct().withColumn("tokens", text.title_tokens(F.col("title"))), "unseen-words")  # a title is read once, however many rows have it
    rows = rows.join(words, "title", "left")
    return resolve.unseen_titles(rows.where("status <> 'F'"), rows.where("status = 'F'"), ["city", "platform", "y", "m"]).select("lid")


@query("""
select r.lid as run, s.lid as show from listings r join listings s on r.city = s.city and r.title = s.title and r.lid < s.lid and (r.start_d = s.start_d or (s.start_d between r.start_d and coalesce(r.end_d, r.start_d)
  and coalesce(r.end_d, r.start_d) - r.start_d <= 120) or (r.start_d between s.start_d and coalesce(s.end_d, s.start_d) and coalesce(s.end_d, s.start_d) - s.start_d <= 120))
""")
def run_contains_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resolve.dates_compatible between listings of one title and city: one first day, or a first day inside the other's run."""
    rows = listings(spark, sf_dir)
    one = rows.select(F.col("lid").alias("run"), "city", "title", F.col("start_d").alias("a"), F.col("end_d").alias("b"))
    other = rows.select(F.col("lid").alias("show"), "city", "title", F.col("start_d").alias("c"), F.col("end_d").alias("d"))
    return one.join(other, ["city", "title"]).where((F.col("run") < F.col("show")) & resolve.dates_compatible(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).select("run", "show")


@query("""
, o as (select * from listings where start_d < date '1996-01-01'), n as (select * from listings where start_d >= date '1996-01-01')
select city, count(*) as n, min(lid) as first from n
where not exists (select 1 from o where o.url = n.url and o.city = n.city) and not exists (select 1 from o where o.title = n.title and o.city = n.city) group by city
""")
def master_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumns({"identity": F.concat_ws("|", "url", "city"), "match_key": F.concat_ws("|", "title", "city")})
    old, new = rows.where("start_d < date'1996-01-01'"), rows.where("start_d >= date'1996-01-01'")
    return tables.not_in_master(new, old, ["identity", "match_key"]).groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("first"))


@query("""
, i as (select url, arg_max(start_d, lid) as added_on from listings where start_d < date '1996-01-01' group by url)
select l.lid, i.added_on from listings l left join i on l.url = i.url
""")
def first_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    index = rows.where("start_d < date'1996-01-01'").select("url", F.col("start_d").alias("added_on"), F.col("lid").alias("seq"))
    return tables.first_added(rows, index, "url").select("lid", "added_on")


@query("""
, d as (select url, arg_min(end_d, lid) filter (where end_d is not null) as e, arg_min(price_max, lid) filter (where price_max is not null) as m from listings where lid % 2 = 0 group by url)
select l.lid, coalesce(d.e, l.end_d) as end_d, coalesce(d.m, l.price_max) as price_max from listings l left join d on l.url = d.url where l.lid % 2 = 1
""")
def detail_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("lid"))).alias(c)
    detail = rows.where("lid % 2 = 0").groupBy("url").agg(first("end_d"), first("price_max"))
    return tables.enriched(rows.where("lid % 2 = 1"), detail, "url", ["end_d", "price_max"]).select("lid", "end_d", "price_max")


@query("""
, d as (select url, max(title) as title from listings where lid % 7 = 0 group by url),
a as (select lid, 1 as pos, concat('https://x.test/', cast((lid * 3) % 5000 as varchar)) as url from listings union all select lid, 2, concat('https://x.test/', cast((lid * 11) % 5000 as varchar)) from listings)
select lid, cast(pos as integer) as pos, url, title from (select a.lid, a.pos, d.url, d.title, row_number() over (partition by a.lid order by a.pos) as r from a join d on a.url = d.url) x where r = 1
""")
def fallback_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    link = lambda k: F.concat(F.lit("https://x.test/"), (F.col("lid") * k % 5000).cast("string"))
    detail = rows.where("lid % 7 = 0").groupBy("url").agg(F.max("title").alias("title"))
    return tables.fallback(rows, F.array("url", link(3), link(11)), detail, "lid")


@query("select platform, lid, queue from (select platform, lid, cast(row_number() over (partition by platform order by d nulls last, lid) as integer) as queue from (select *, case when lid % 5 = 0 then null else start_d end as d from listings) x) q where queue <= 50")
def top_details_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("d", F.when(F.col("lid") % 5 != 0, F.col("start_d")))
    return tables.nearest_first(rows, "platform", "d", 50, "lid").select("platform", "lid", "queue")


@query("select lid, cast(1000 + row_number() over (order by city, start_d, lid) as bigint) as serial from listings")
def serial_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.serials(listings(spark, sf_dir), [F.col("city"), F.col("start_d"), F.col("lid")], 1000).select("lid", "serial")


@query("select lid, city, coalesce(city <> lag(city) over (order by city, start_d, lid), true) as band, count(*) over (partition by city) as in_city from listings")
def city_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bands(listings(spark, sf_dir), "city", ["start_d", "lid"]).select("lid", "city", "band", F.col("in_group").alias("in_city"))


QUERIES |= {"serial_all": serial_continue, "city_bands_all": city_bands}  # their names of a round in which the first two read a part
ORACLES |= {"serial_all": ORACLES["serial_continue"], "city_bands_all": ORACLES["city_bands"]}


@query("""
with e as (select user_id, event_id, ts, event_type = 'error' as bad from events),
g as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as isl from e),
s as (select *, sum(case when bad then 1 else 0 end) over (partition by user_id, isl order by ts, event_id rows unbounded preceding) as streak from g)
select user_id, min(ts) filter (where streak >= 2) as opened, count(*) filter (where bad) as refused, cast(max(streak) as bigint) as longest from s group by user_id
""", over=None)
def breaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.breaker(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", after=2)


@query("""
with p as (select user_id, event_id, ts, value, sum(case when value > 80 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as isl from events),
s as (select *, sum(case when value > 80 then 0 else 1 end) over (partition by user_id, isl order by ts, event_id rows unbounded preceding) as streak from p)
select user_id, count(*) filter (where stop is null or ts <= stop) as pages from (select *, min(case when streak >= 3 then ts end) over (partition by user_id) as stop from s) x group by user_id
""", over=None)
def empty_page_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.runs_of(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ~(F.col("value") > 80))
    stop = F.min(F.when(F.col("streak") >= 3, F.col("ts"))).over(Window.partitionBy("user_id"))
    rows = seen.withColumn("stop", stop)
    return rows.groupBy("user_id").agg(F.count_if(F.col("stop").isNull() | (F.col("ts") <= F.col("stop"))).alias("pages"))


@query(r"""
with u as (select page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) as s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '\?([^#]*)', 1) as q from pages),
k as (select *, list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_full_match(lower(split_part(x, '=', 1)), 'utm_.*|gclid|fbclid|ref|referrer|source|src')) as qs from u),
c as (select *, case when p = '' then '/' when length(regexp_replace(p, '/{2,}', '/', 'g')) > 1 then regexp_replace(regexp_replace(p, '/{2,}', '/', 'g'), '/+$', '') else '/' end as pp from k)
select page_id, concat(lower(s), '://', lower(h), pp, case when len(qs) = 0 then '' else concat('?', array_to_string(qs, '&')) end) as url, lower(h) as host from c
""", over=None)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"), urls.host_of(F.col("url")).alias("host"))


ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"


@query(f"""
with a as (select page_id, url, regexp_extract_all(html, '{ANCHOR}', 1) as h, regexp_extract_all(html, '{ANCHOR}', 2) as t from pages),
x as (select page_id, url, unnest(h) as href, unnest(t) as text, generate_subscripts(h, 1) - 1 as pos from a)
select page_id, cast(pos as integer) as pos, href, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text,
  case when href like '/%' then concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), href) else href end as target from x
""", over=None)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return readers.links(pages, "page_id", F.col("url")).select(F.col("page").alias("page_id"), "pos", "href", "text", F.col("url").alias("target"))


@query(f"select page_id, cast(len(list_distinct(regexp_extract_all(html, '{ANCHOR}', 1))) as bigint) as links from pages", over=None)
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of a page, as the listing loader counts them."""
    pages = table(spark, sf_dir, "pages")
    found = readers.links(pages, "page_id", F.col("url")).groupBy("page").agg(F.count_distinct("href").alias("links"))
    return pages.select("page_id").join(found.withColumnRenamed("page", "page_id"), "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).alias("links"))


def _seen(x: str, tags: bool = True) -> str:
    plain = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')" if tags else f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = f"replace({plain}, '{name}', '{char}')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


@query(f"""
select page_id, {_seen("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title, {_seen("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as h1 from pages
""", over=None)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.heads(table(spark, sf_dir, "pages"), "page_id").select("page_id", "title", "h1")


@query(f"""
with s as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|main|title|dl|dt|dd|form|option)\\b[^>]*>', chr(10), 'g') as x from pages),
l as (select page_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: {_seen('y')}), lambda y: y <> '' and not regexp_matches(y, '{readers.NOISE}')) as ls from s)
select page_id, cast(len(ls) as bigint) as lines, cast(list_sum(list_transform(ls, lambda y: length(y))) as bigint) as chars, ls[1] as first_line from l
""", over=None)
def page_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.text_lines(table(spark, sf_dir, "pages"), "page_id")
    return lines.groupBy(F.col("page").alias("page_id")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.min_by("line", "pos").alias("first_line"))


@query("""
with c as (select c_custkey as page, case c_custkey % 4 when 0 then 'Organised by' when 1 then concat('Hosted by ', c_name) when 2 then concat('Duration: ', cast(1 + c_nationkey as varchar), ' hours') else 'Languages -' end as line, c_name as next from customer)
select page, case page % 4 when 2 then 'duration' when 3 then 'language' else 'organizer' end as fact, case page % 4 when 2 then replace(line, 'Duration: ', '') else next end as value from c
""", over=None)
def label_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled facts of pages of three lines made of customers: a label, its value beside or below it, and a line that is none."""
    line = F.expr("case c_custkey % 4 when 0 then 'Organised by' when 1 then concat('Hosted by ', c_name) when 2 then concat('Duration: ', 1 + c_nationkey, ' hours') else 'Languages -' end")
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.posexplode(F.array(line, F.col("c_name"), F.lit("and no label"))).alias("pos", "line"))
    return readers.labelled_facts(lines)


#: Robots files of hosts under .net and of the others; the first has a group for this agent beside the one for any.
ROBOTS_NET = "# made up\nUser-agent: otherbot\nUser-agent: *\nDisallow: /\n\nUser-agent: Almanack\nAllow: /\nDisallow: /en/\nAllow: /en/1*   # but these\nDisallow: /*.html$\nDisallow: /fr/\nDisallow:\n"
ROBOTS_ANY = "Disallow: /nobody\nUser-agent: *\nCrawl-delay: 5\nDisallow: /es/\nAllow: /es/\nDisallow: /de/\n"


@query(r"""
with r(kind, rule, rx, allow) as (values ('net', '/', '^/', true), ('net', '/en/', '^/en/', false), ('net', '/en/1*', '^/en/1.*', true), ('net', '/*.html$', '^/.*\.html$', false), ('net', '/fr/', '^/fr/', false),
  ('any', '/es/', '^/es/', false), ('any', '/es/', '^/es/', true), ('any', '/de/', '^/de/', false)),
p as (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from pages),
m as (select page_id, arg_max(allow, length(rule) * 2 + cast(allow as integer)) as allow from p join r on kind = case when host like '%.net' then 'net' else 'any' end and regexp_matches(path, rx) group by page_id)
select p.page_id, p.host, p.path, coalesce(m.allow, true) as allowed from p left join m on p.page_id = m.page_id
""", over=None)
def robots_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files read for one agent, and their rules met with pages by host."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    files = rows.select("host").distinct().withColumn("text", F.when(F.endswith("host", F.lit(".net")), ROBOTS_NET).otherwise(ROBOTS_ANY))
    return tables.robots(rows, tables.robots_rules(files, "almanack/0.2"))


@query("""
with p as (select page_id, case when page_id % 17 = 0 then 403 when page_id % 5 = 0 then 500 else 200 end as status, concat(html, case page_id % 7 when 1 then 'window._cf_chl_opt={}' when 2 then 'Access DENIED' when 3 then 'Just a moment...' when 4 then 'on captchas, blocked' else '' end) as body from pages)
select page_id, status = 403 or (page_id % 7 = 1 and length(body) <= 60000) or (status >= 400 and length(body) < 25000 and page_id % 7 in (2, 3)) or (status < 400 and length(body) < 8000 and page_id % 7 = 3) as blocked from p
""", over=None)
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with marks of refusal put into pages of their own."""
    status = F.when(F.col("page_id") % 17 == 0, 403).when(F.col("page_id") % 5 == 0, 500).otherwise(200)
    mark = F.expr("case page_id % 7 when 1 then 'window._cf_chl_opt={}' when 2 then 'Access DENIED' when 3 then 'Just a moment...' when 4 then 'on captchas, blocked' else '' end")
    return table(spark, sf_dir, "pages").select("page_id", tables.looks_blocked(status, F.concat("html", mark)).alias("blocked"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), '') as varchar) as label from events", over=None)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k"), F.lit("")).alias("label"))


PRICE_TEXT = "concat('Rs. ', cast(cast(floor(price_min) as bigint) as varchar(20)), case when lid % 3 = 0 then ' onwards' when lid % 3 = 1 then concat(' - ₹', cast(cast(floor(price_min * 2) as bigint) as varchar(20))) else '' end, case when lid % 11 = 0 then ' free' else '' end)"


@query(f"""
, x as (select lid, {PRICE_TEXT} as t, cast(floor(price_min) as double) as a, case when lid % 3 = 1 then cast(floor(price_min * 2) as double) end as b from listings)
select lid, case when lid % 11 = 0 then 0 else a end as price_min, case when b is null and lid % 3 = 0 then null else coalesce(b, a) end as price_max, lid % 11 = 0 as is_free from x
""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("lid", money.price_of_text(F.expr(PRICE_TEXT)).alias("p"))
    return rows.select("lid", "p.*")


def _inr(x: str) -> str:
    n = f"cast(cast(round_even({x}, 0) as bigint) as varchar)"
    head, tail = f"left({n}, greatest(length({n}) - 3, 0))", f"right({n}, 3)"
    pairs = f"reverse(regexp_replace(reverse({head}), '([0-9]{{2}})', '\\1,', 'g'))"
    return f"concat('₹', case when length({n}) <= 3 then {n} else concat(ltrim({pairs}, ','), ',', {tail}) end)"


@query(f"select lid, {_inr('price_min * 100')} as inr, case when is_free then concat('Free – ', {_inr('coalesce(price_max, price_min)')}) when price_max is null then concat({_inr('price_min')}, ' onwards') else concat({_inr('price_min')}, ' – ', {_inr('price_max')}) end as price_range from listings")
def price_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("lid", money.format_inr(F.col("price_min") * 100).alias("inr"), money.format_price_range(F.col("price_min"), F.col("price_max"), F.col("is_free")).alias("price_range"))


@query("""
select o_orderkey, case when o_orderkey % 8 = 5 then d + cast((case when strftime(d, '%m%d') >= '0603' then 1996 else 1997 end - year(d)) as integer) * interval 1 year else d end
  + case when o_orderkey % 8 in (3, 4) then interval '19 hours 30 minutes' when o_orderkey % 8 = 7 then interval '5 hours 30 minutes' else interval 0 hour end as start, o_orderkey % 8 in (3, 4, 7) as has_time
from (select o_orderkey, cast(case when o_orderkey % 8 = 5 and strftime(o_orderdate, '%m%d') = '0229' then date '1996-02-28' else o_orderdate end as timestamp) as d from orders) o
""", over=None)
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in eight ways: ISO, with month names, weekdays, ordinals and clocks, without a year (the next one from 1996-07-18 on, less 45 days), by numbers and with a zone."""
    d = F.when((F.col("o_orderkey") % 8 == 5) & (F.date_format("o_orderdate", "MMdd") == "0229"), F.lit(dt.date(1996, 2, 28))).otherwise(F.col("o_orderdate").cast("date"))
    said = lambda form: F.date_format(d, form)
    day = F.dayofmonth(d)
    ordinal = F.concat(day.cast("string"), F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th"))
    k = F.col("o_orderkey") % 8
    told = (
        F.when(k == 0, said("yyyy-MM-dd")).when(k == 1, said("d MMM yyyy")).when(k == 2, said("EEE, MMMM d, yyyy")).when(k == 3, F.concat(said("EEEE, MMM d yyyy"), F.lit(" at 7:30 PM")))
        .when(k == 4, F.concat(ordinal, F.lit(" "), said("MMMM yyyy"), F.lit(" | 19:30 | Call +91 98200 12345"))).when(k == 5, F.concat(said("EEE, d MMM"), F.lit(" onwards"))).when(k == 6, said("d/M/yyyy")).otherwise(F.concat(said("yyyy-MM-dd"), F.lit("T00:00:00Z")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.date_range(told, dt.date(1996, 7, 18)).alias("d"))
    return rows.select("o_orderkey", "d.start", "d.has_time")


def _told_ranges(orders: DataFrame) -> DataFrame:
    last = F.date_add("o_orderdate", 3)
    k = F.col("o_orderkey") % 4
    told = (
        F.when(k == 0, F.concat_ws(" - ", F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.date_format(last, "d MMM yyyy"))).when(k == 1, F.concat_ws(" to ", F.date_format("o_orderdate", "MMMM d"), F.date_format(last, "MMMM d, yyyy")))
        .when(k == 2, F.concat_ws("-", F.dayofmonth("o_orderdate"), F.date_format(last, "d MMM yyyy"))).otherwise(F.concat_ws("–", F.date_format("o_orderdate", "d/M/yyyy"), F.date_format(last, "d/M/yyyy")))
    )
    rows = orders.select("o_orderkey", dates.date_range(told, dt.date(1996, 1, 1)).alias("d"))
    return rows.select("o_orderkey", "d.start", "d.end")


@query("select o_orderkey, cast(o_orderdate as timestamp) as start, cast(o_orderdate as timestamp) + interval 3 day as \"end\" from orders", over=None)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told_ranges(table(spark, sf_dir, "orders"))


QUERIES["date_range_all"], ORACLES["date_range_all"] = date_range, ORACLES["date_range"]


@query(f"select doc_id, {_seen('coalesce(text, chr(0))', tags=False)} as clean, length({_seen('coalesce(text, chr(0))', tags=False)}) as n from documents", over=None)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("clean"), F.length(c).cast("bigint").alias("n"))


@query()
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text"), plain=False).alias("line"))


@query("""
with d as (select text, lang, source, quality, toxic from documents left join labels using (doc_id)),
f as (select 'text' as field, count(*) filter (where text <> '') as filled, count(*) as rows from d union all select 'lang', count(*) filter (where lang <> ''), count(*) from d union all select 'source', count(*) filter (where source <> ''), count(*) from d
  union all select 'quality', count(quality), count(*) from d union all select 'toxic', count(toxic), count(*) from d)
select field, filled, rows, round(filled * 1.0 / rows, 4) as rate from f
""", over=None)
def field_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return tables.fill_rates(rows, ["text", "lang", "source", "quality", "toxic"])


@query(f"select count(*) as listings, count(*) filter (where {IN_WINDOW}) as kept, count(distinct city) as cities, count(distinct url) as urls, round(avg(price_min), 4) as mean_price, min(start_d) as first_day, max(start_d) as last_day from listings")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("start_d") <= F.lit(LAST)) & (F.coalesce("end_d", "start_d") >= F.lit(FIRST))
    return listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("listings"), F.count_if(inside).alias("kept"), F.count_distinct("city").alias("cities"), F.count_distinct("url").alias("urls"), F.round(F.avg("price_min"), 4).alias("mean_price"), F.min("start_d").alias("first_day"), F.max("start_d").alias("last_day"))


@query("select url, max(lid) as lid, arg_max(title, lid) as title from listings group by url")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("url", "lid", "title").withColumn("fetched_at", F.col("lid"))
    return tables.newest(rows, "url", "fetched_at").select("url", "lid", "title")


@query("select lid, case when end_d < start_d then null when end_d - start_d > 31 then null else end_d end as end_d, coalesce(end_d - start_d <= 31, true) as end_known from listings")
def settle_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_events(listings(spark, sf_dir).withColumns({"start": F.col("start_d").cast("timestamp_ntz"), "end": F.col("end_d").cast("timestamp_ntz")}), "lid")
    return filters.settled(rows, dt.date(1990, 1, 1), dt.date(2000, 1, 1)).select("lid", F.to_date("end").alias("end_d"), "end_known")


CITY_TEXT = "concat('Hall ', c_custkey, ', ', case c_nationkey % 5 when 0 then 'Andheri West, Mumbai' when 1 then 'Mumbai Masala, Koregaon Park, Pune' when 2 then 'Salt Lake' when 3 then 'Hyderabad' else 'Delhi Road, Bangalore' end)"


@query("select c_custkey, case c_nationkey % 5 when 0 then 'Mumbai' when 1 then 'Pune' when 2 then 'Kolkata' when 3 then 'none' else 'Bengaluru' end as city, case when c_nationkey % 5 = 3 then 'Hyderabad' else 'none' end as town from customer", over=None)
def city_of_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("a", F.expr(CITY_TEXT))
    return rows.select("c_custkey", F.coalesce(places.detect_city(F.col("a")), F.lit("none")).alias("city"), F.coalesce(places.detect_other_town(F.col("a")), F.lit("none")).alias("town"))


@query()
def resolve_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one day's window resolved by the exact greedy fold; a fold in order is not SQL, so tests hold it against a plain one."""
    from almanack.plans.pipeline import listing_events

    return resolve.leads(listing_events(spark, sf_dir)).groupBy("lead").agg(F.count(F.lit(1)).alias("rows"))


@query()
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan on listings: resolve, settle, audit, classify."""
    from almanack.plans.pipeline import RunParams, calendar, listing_events

    kept, _ = calendar(listing_events(spark, sf_dir), RunParams(FIRST, LAST, cities=None))
    return kept.select("ord", "title", "city", F.to_date("start").alias("start_d"), "tier", "activity_type", "notes")
