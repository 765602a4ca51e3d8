"""From stored pages to event rows: listing pages give partial events, detail pages fill them."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanack.functions import places, text, urls
from almanack.operators.merge import merged
from almanack.plans.steps import written
from almanack.schema import EVENT, as_events
from almanack.sources import objects, pages, profiles
from almanack.sources.profiles import Profile

_NAMES = EVENT.names


def _tier(rows: DataFrame, tier: int, *place: Column | str) -> DataFrame:
    """Event columns, page, and o: the tier and the place in it, by which later merges go."""
    spots = [*place, *(F.lit(0) for _ in range(3 - len(place)))]
    return rows.select("page", F.struct(F.lit(tier).alias("tier"), *(F.col(c).cast("int").alias(f"p{i}") if isinstance(c, str) else c.alias(f"p{i}") for i, c in enumerate(spots))).alias("o"), *_NAMES)


def listed(stored: DataFrame, p: Profile, ref: dt.date) -> DataFrame:
    """Partial events of one source's listing pages (url, html, city: the page's city, place: its turn), one row for each event address of a city. What a page says is
    taken in the order JSON-LD, other JSON, cards, bare links; guessed links count where a page of a site that asks for guesses has nothing else."""
    stored = written(stored.select("url", "html", "city", "place"), "listing-pages")
    found = written(objects.objects(objects.blocks(stored)), "listing-objects")
    links = written(pages.links(stored), "listing-links")
    id_url = p.made_url if p.id_url else None
    tiers = [
        _tier(objects.ld_events(found, ref), 0, "pos", "ord"),
        _tier(objects.walked_events(found, ref, p.is_event, p.json_id, p.slug_url, id_url), 1, _kind(), "pos", "ord"),
        _tier(pages.card_events(pages.cards(stored, p.is_event), ref), 2, "pos"),
        _tier(as_events(pages.distinct_event_links(links, p.is_event).withColumn("title", text.clean_title(F.col("title"))), "page", "pos"), 3, "pos"),
    ]
    rows = reduce(DataFrame.unionByName, tiers).where((F.col("url") != "") & (F.col("title") != "") & p.is_event(F.col("url")))
    if p.guess:
        rows = written(rows, "listing-rows")
        guessed = pages.guessed_event_links(links.join(rows.select("page").distinct(), "page", "left_anti"))
        rows = rows.unionByName(_tier(as_events(guessed.withColumn("title", text.clean_title(F.col("title"))), "page", "pos"), 4, "pos"))
    if p.section_of and p.section_categories:
        rows = rows.withColumn("categories", _with_section(p, F.col("url"), F.col("categories")))
    own = stored.select(F.col("url").alias("page"), F.col("city").alias("listed_city"), "place")
    rows = rows.join(own, "page").withColumn("o", F.struct(F.col("place").alias("page_place"), "o.*"))
    once = merged(rows.withColumn("key", F.col("url")), ["listed_city", "key"], "o")
    return profiles.stamped(once.drop("o", "key"), p).select(*_NAMES)


def _kind() -> Column:
    """Blocks of a page's own scripts come before its streamed payload."""
    return F.when(F.col("kind") == "rsc", 1).otherwise(0)


def _with_section(p: Profile, url: Column, categories: Column) -> Column:
    out = categories
    for section, name in p.section_categories.items():
        out = F.when(F.contains(url, F.lit(f"/{section}/")) & ~F.array_contains(categories, name), F.array_append(categories, F.lit(name))).otherwise(out)
    return out


def all_listed(stored: DataFrame, ref: dt.date, keys: list[str] | None = None) -> DataFrame:
    """The same of every chosen source; stored has a column source too."""
    return reduce(DataFrame.unionByName, (listed(stored.where(F.col("source") == p.key), p, ref) for p in profiles.chosen(keys)))


def _matches(title: Column, url: Column, source_id: Column) -> Column:
    """Whether a candidate of a page is the listing (l_*) that the page was asked for."""
    same_url = (url != "") & ((url == F.col("l_url")) | (url == urls.canonical_url(F.col("page"))))
    return same_url | ((source_id != "") & (source_id == F.col("l_source_id"))) | text.titles_match(title, F.col("l_title"))


def chosen_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates of each page (columns of events, page, o, locality and the listing's l_title, l_url, l_source_id, l_city) that are its listing's: those that match, or the only one; of these
    the ones in the listing's city, if any."""
    page, match = Window.partitionBy("page"), F.coalesce(_matches(F.col("title"), F.col("url"), F.col("source_id")), F.lit(False))
    rows = candidates.withColumns({"match": match, "n": F.count(F.lit(1)).over(page)}).withColumn("any", F.max(F.col("match").cast("int")).over(page))
    rows = rows.where(F.col("match") | ((F.col("any") == 0) & (F.col("n") == 1)))
    inside = (F.col("l_city") != "") & F.coalesce(places.detect_city(F.col("locality"), F.col("address"), F.col("venue")) == F.col("l_city"), F.lit(False))
    rows = rows.withColumn("inside", inside).withColumn("anyone", F.max(F.col("inside").cast("int")).over(page))
    return rows.where(F.col("inside") | (F.col("anyone") == 0)).drop("match", "n", "any", "inside", "anyone")


def collapsed(chosen: DataFrame) -> DataFrame:
    """One row for each page: the candidate that starts first; of several dated ones the first start, the last end if it is later, all days, the first organiser, and the least
    and greatest price."""
    first = F.struct(F.col("start").isNull().alias("undated"), "start", "o")
    last = F.coalesce("end", "start")
    days = F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("o", F.to_date("start").alias("day")))))
    out = chosen.groupBy("page").agg(
        F.min_by(F.struct(*_NAMES), first).alias("e"), F.count(F.lit(1)).alias("n"), F.min("start").alias("a"), F.max(last).alias("b"), days.alias("days"),
        F.min_by(F.when(F.col("organizer") != "", F.col("organizer")), F.when((F.col("organizer") != "") & F.col("start").isNotNull(), F.col("o"))).alias("organizer"), F.min("price_min").alias("low"), F.max("price_max").alias("high"),
    )
    many = (F.col("n") > 1) & F.col("a").isNotNull()
    new = {
        "start": F.when(many, F.col("a")).otherwise(F.col("e.start")), "end": F.when(many, F.when(F.col("b") > F.col("a"), F.col("b"))).otherwise(F.col("e.end")),
        "session_dates": F.when(many, F.array_union("e.session_dates", F.transform("days", lambda x: x.day))).otherwise(F.col("e.session_dates")),
        "organizer": F.when(many & (F.col("e.organizer") == ""), F.coalesce("organizer", F.lit(""))).otherwise(F.col("e.organizer")),
        "price_min": F.when(many, F.col("low")).otherwise(F.col("e.price_min")), "price_max": F.when(many, F.col("high")).otherwise(F.col("e.price_max")),
    }
    return out.select("page", *(new.get(n, F.col(f"e.{n}")).alias(n) for n in _NAMES))


def details(stored: DataFrame, asked: DataFrame, p: Profile, ref: dt.date) -> DataFrame:
    """What event pages say: stored (url: the address asked for, final_url or null, html) and asked, the listings (title, url, source_id, city) of one source. One row of event columns for each page that tells a title, a
    start or a venue, url being the address asked for, with own_url (the address that the page gives itself, '' if it is no event's or another's) and verified (title and start are known). In order: JSON-LD and microdata, other JSON, meta tags, the line of facts, labelled
    facts, a deadline, a price."""
    stored = stored.select("url", F.col("final_url") if "final_url" in stored.columns else F.col("url").alias("final_url"), "html")
    asked = asked.groupBy("url").agg(F.first("title").alias("l_title"), F.first("source_id").alias("l_source_id"), F.first("city").alias("l_city")).withColumn("l_url", F.col("url"))
    stored = written(stored.join(asked.select("url"), "url", "left_semi"), "detail-pages")
    listing = asked.withColumnRenamed("url", "page")
    found = written(objects.objects(objects.blocks(stored)), "detail-objects")
    with_place = lambda rows, tier: rows.withColumn("o", F.struct(F.lit(tier).alias("tier"), F.col("pos").alias("pos"), F.col("ord").alias("ord")))
    lds = with_place(objects.ld_events(found, ref), 0).unionByName(with_place(objects.microdata_events(pages.microdata(stored), ref), 1))
    primary = written(collapsed(chosen_candidates(lds.join(listing, "page"))), "detail-primary")
    walked = objects.walked_events(found, ref, None, p.json_id, p.slug_url, p.made_url if p.id_url else None).join(listing, "page").join(primary.select("page", F.col("title").alias("p_title"), F.lit(True).alias("has")), "page", "left")
    near = _matches(F.col("title"), F.col("url"), F.col("source_id")) | (F.col("has") & text.titles_match(F.col("title"), F.coalesce("p_title", F.lit(""))))
    walked = walked.where(F.coalesce(near, F.lit(False)))
    head = pages.heads(stored, "url")
    meta = lambda *names: F.coalesce(*(F.nullif(F.try_element_at("meta", F.lit(n)), F.lit("")) for n in names))
    heads = as_events(head.select(
        F.col("url").alias("page"), text.clean_title(F.coalesce(meta("og:title"), F.nullif("h1", F.lit("")), F.nullif("title", F.lit("")))).alias("title"), meta("og:description", "description").alias("description"), meta("og:image").alias("image"),
    ), "page")
    lines = written(pages.text_lines(stored), "detail-lines")
    quick = as_events(pages.pipe_facts(lines), "page")
    told = pages.labelled_facts(lines).groupBy("page").pivot("fact", list(pages.LABELS)).agg(F.first("value"))
    told = told.withColumns({"organizer": F.when(~objects.is_seller(F.col("organizer")), F.col("organizer")), "categories": F.filter(F.split("genre", r"\s*[,|/]\s*"), lambda g: g != "")})
    labelled = as_events(told.drop("genre"), "page")
    deadline = as_events(pages.register_by(lines, ref), "page")
    tiers = [_tier(primary, 0), _tier(walked, 1, _kind(), "pos", "ord"), _tier(heads, 2), _tier(quick, 3), _tier(labelled, 4), _tier(deadline, 5)]
    rows = merged(reduce(DataFrame.unionByName, tiers).drop("url").withColumn("url", F.lit("")), ["page"], "o").drop("o")
    price = pages.page_price(lines).select("page", F.struct("price_min", "price_max", "is_free").alias("box"))
    rows = rows.join(price, "page", "left")
    bare = F.col("price_min").isNull() & ~F.col("is_free") & F.col("box").isNotNull()
    rows = rows.withColumns({c: F.when(bare, F.col(f"box.{c}")).otherwise(F.col(c)) for c in ("price_min", "price_max", "is_free")}).drop("box")
    own = primary.select("page", F.col("url").alias("ld_url"))
    final = stored.select(F.col("url").alias("page"), "final_url")
    rows = rows.join(own, "page", "left").join(head.select(F.col("url").alias("page"), "canonical", meta("og:url").alias("og_url")), "page", "left").join(final, "page", "left")
    seen = F.array(*(F.when(F.coalesce(c, F.lit("")) != "", objects.seen_from(F.col("page"), c)) for c in (F.col("ld_url"), F.col("canonical"), F.col("og_url"), F.col("final_url"))))
    here = urls.canonical_url(F.col("page"))
    fits = F.filter(seen, lambda u: F.coalesce((u != here) & p.is_event(u) & (p.id_of(u) == p.id_of(here)), F.lit(False)))
    if p.section_categories:
        rows = rows.withColumn("categories", _with_section(p, here, F.col("categories")))
    rows = rows.withColumns({"own_url": F.coalesce(F.get(fits, F.lit(0)), F.lit("")), "url": F.col("page"), "verified": (F.col("title") != "") & F.col("start").isNotNull()})
    return rows.where((F.col("title") != "") | F.col("start").isNotNull() | (F.col("venue") != "")).select(*_NAMES, "own_url", "verified")


def all_details(stored: DataFrame, events: DataFrame, ref: dt.date, keys: list[str] | None = None) -> DataFrame:
    """The same of every chosen source (stored has a column source); pages are read for listings that lack something, and for other addresses of theirs."""
    from almanack.plans.pipeline import other_pages

    lacking = events.where(profiles.needs_detail(~F.col("source").isin([p.key for p in profiles.known().values() if not p.organizer_published])))
    more = other_pages(lacking).select("url", "other")
    asked = lacking.select("source", "url", "title", "source_id", "city")
    asked = written(asked.unionByName(asked.join(more, "url").select("source", F.col("other").alias("url"), "title", "source_id", "city")), "detail-asked")
    return reduce(DataFrame.unionByName, (details(stored.where(F.col("source") == p.key), asked.join(stored.where(F.col("source") == p.key).select("url").distinct(), "url", "left_semi"), p, ref) for p in profiles.chosen(keys)))
