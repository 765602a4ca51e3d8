"""The listing sites that are known, as data. Addresses, patterns and the spellings of cities in them."""

from __future__ import annotations

from almanack.sources.profiles import Profile, register_profile

_CITIES = {"mumbai": ("mumbai",), "pune": ("pune",), "delhi": ("delhi", "new-delhi"), "bengaluru": ("bangalore", "bengaluru"), "kolkata": ("kolkata",), "ahmedabad": ("ahmedabad",), "chennai": ("chennai",)}
_ONE = {k: (k,) for k in _CITIES}


def _venue(key: str, platform: str, city: str, templates: tuple[str, ...], event: str) -> Profile:
    return Profile(key, platform, templates, event, city=city, pages=4, guess=True)


SITES = [
    Profile(
        "bookmyshow", "BookMyShow", tuple(f"https://in.bookmyshow.com/explore/{k}-{{slug}}" for k in ("events", "plays", "sports")),
        r"^https?://in\.bookmyshow\.com/(?:[a-z0-9-]+/)?(?:events|plays|sports|activities)/[^/?#]+/ET\d{5,}", exclude="/activities/",
        follow=(r"^https://in\.bookmyshow\.com/explore/(?!movies|activities|home|cinemas|buzz|offers)[a-z0-9-]+-{slug}(?:\?page=\d+)?$",), event_id=r"/(ET\d{5,})", json_id=r"ET\d{5,}", pages=14, organizer_published=False,
        id_url="https://in.bookmyshow.com/{section}/{slug}/{id}", section_of=r"/explore/(events|plays|sports|activities)-", sections=("events", "plays", "sports"), section_categories={"plays": "Plays", "sports": "Sports"},
        slugs=_ONE | {"delhi": ("national-capital-region-ncr",)},
    ),
    Profile(
        "district", "Zomato District",
        ("https://www.district.in/events/upcoming-events-in-{slug}", *(f"https://www.district.in/events/{k}-in-{{slug}}-book-tickets" for k in ("music", "comedy-shows", "performances", "sports-events", "nightlife"))),
        r"^https?://(?:www\.)?district\.in/events/[a-z0-9][a-z0-9-]*[a-z0-9]$",
        follow=(r"^https://www\.district\.in/events/(?![a-z0-9-]*(?:this-weekend|today|tomorrow))[a-z0-9-]+-in-{slug}(?:-book-tickets)?(?:\?[^#]*)?$",), event_id=r"/events/([a-z0-9-]+)$", slug_url="https://www.district.in/events/{slug}", pages=14,
        listing_slug=r"(?:^|-)in-[a-z-]+$|^upcoming-|^events-|this-weekend|^things-to-do|^best-|^top-|-near-me$|^all-", event_slug=r"-buy-tickets$|-(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\d{1,2}-20\d\d(?:-|$)",
        slugs=_ONE | {"delhi": ("delhi-ncr", "delhi", "new-delhi", "ncr", "gurugram"), "bengaluru": ("bengaluru", "bangalore")},
    ),
    Profile(
        "allevents", "AllEvents", ("https://allevents.in/{slug}/all",), r"^https?://allevents\.in/[a-z0-9-]+/[^/?#]+/\d{6,}",
        follow=(r"^https://allevents\.in/{slug}/(?:all|music|concerts|comedy|theatre|theater|art|arts|food-drinks|sports|workshops|festivals|parties|performances|exhibitions|dance)(?:\?page=\d+)?$",), event_id=r"/(\d{6,})(?:[/?#]|$)",
        url_city=r"^https?://allevents\.in/([a-z0-9-]+)/", pages=10, slugs=_CITIES,
    ),
    Profile("skillbox", "Skillbox", ("https://www.skillboxes.com/events",), r"^https?://(?:www\.)?skillboxes\.com/events?/[^/?#]+$", follow=(r"^https://www\.skillboxes\.com/events\?(?:page|p)=\d+$",), exclude=r"/events?/(?:page|category|categories|city|search|tag)(?:/|$)", national=True, pages=8),
    Profile("sortmyscene", "SortMyScene", ("https://sortmyscene.com/", "https://sortmyscene.com/events"), r"^https?://(?:www\.)?sortmyscene\.com/(?:events?|e)/[^/?#]+$", national=True, pages=6),
    Profile(
        "eventbrite", "Eventbrite", ("https://www.eventbrite.com/d/{slug}/all-events/",), r"^https?://www\.eventbrite\.(?:com|co\.in|co\.uk|com\.au|ca|ie)/e/[^/?#]+", follow=(r"^https://www\.eventbrite\.(?:com|co\.in)/d/{slug}/all-events/?\?page=\d+$",), event_id=r"-(\d{9,})(?:[/?#]|$)", pages=6,
        slugs={k: (f"india--{k}",) for k in _ONE} | {"delhi": ("india--new-delhi", "india--delhi"), "bengaluru": ("india--bengaluru", "india--bangalore")},
    ),
    Profile("fever", "Fever", ("https://feverup.com/en/{slug}",), r"^https?://feverup\.com/(?:[a-z]{2}/[a-z-]+/)?m/\d+", event_id=r"/m/(\d+)", pages=4, slugs=_CITIES),
    Profile(
        "meetup", "Meetup", ("https://www.meetup.com/find/?location={slug}&source=EVENTS",), r"^https?://www\.meetup\.com/[^/]+/events/\d+", event_id=r"/events/(\d+)", pages=2,
        slugs={k: (f"in--{k.title()}",) for k in _ONE} | {"delhi": ("in--New%20Delhi", "in--Delhi"), "bengaluru": ("in--Bangalore", "in--Bengaluru")},
    ),
    _venue("ncpa", "NCPA", "Mumbai", ("https://www.ncpamumbai.com/whats-on", "https://www.ncpamumbai.com/events"), r"^https?://(?:www\.)?ncpamumbai\.com/(?:events?|shows?|whats-on)/[^/?#]+$"),
    _venue("nmacc", "NMACC", "Mumbai", ("https://nmacc.com/events", "https://nmacc.com/whats-on"), r"^https?://(?:www\.)?nmacc\.com/(?:events?|shows?|whats-on|performances?)/[^/?#]+$"),
    _venue("jioworldcentre", "Jio World Centre", "Mumbai", ("https://www.jioworldcentre.com/events",), r"^https?://(?:www\.)?jioworldcentre\.com/events?/[^/?#]+$"),
    _venue("prithvi", "Prithvi Theatre", "Mumbai", ("https://prithvitheatre.org/",), r"^https?://(?:www\.)?prithvitheatre\.org/(?:plays?|events?|shows?|productions?|performances?)/[^/?#]+/?$"),
    _venue("rangashankara", "Ranga Shankara", "Bengaluru", ("https://rangashankara.org/",), r"^https?://(?:www\.)?rangashankara\.org/(?:plays?|events?|shows?|productions?|performances?)/[^/?#]+/?$"),
    _venue("ihc", "India Habitat Centre", "Delhi NCR", ("https://www.indiahabitat.org/ihc-programmes", "https://www.indiahabitat.org/"), r"^https?://(?:www\.)?indiahabitat\.org/(?:ihc-programmes?|programmes?|events?)/[^/?#]+"),
    _venue("iic", "India International Centre", "Delhi NCR", ("https://iicdelhi.in/programmes", "https://iicdelhi.in/"), r"^https?://(?:www\.)?iicdelhi\.in/programmes?/[^/?#]+"),
    _venue("bic", "Bangalore International Centre", "Bengaluru", ("https://bangaloreinternationalcentre.org/events/",), r"^https?://(?:www\.)?bangaloreinternationalcentre\.org/events?/[^/?#]+/?$"),
    Profile("explara", "Explara", ("https://www.explara.com/events",), r"^https?://(?:www\.)?explara\.com/e/[^/?#]+", national=True, pages=4, enabled=False),
    Profile("lbb", "LBB", ("https://lbb.in/{slug}/events/",), r"^https?://lbb\.in/[a-z]+/(?!events/?$)[^/?#]+/?$", pages=3, enabled=False, slugs={k: v for k, v in _CITIES.items() if k != "ahmedabad"}),
    Profile("dreamsetgo", "DreamSetGo", ("https://www.dreamsetgo.com/",), r"^https?://(?:www\.)?dreamsetgo\.com/(?:experiences?|packages?|events?|tickets?)/[^/?#]+", national=True, pages=4, enabled=False),
    Profile("platinumlist", "Platinumlist", ("https://platinumlist.net/event-tickets",), r"^https?://(?:[a-z-]+\.)?platinumlist\.net/event-tickets/\d+/[^/?#]+", event_id=r"/event-tickets/(\d+)/", national=True, pages=4, enabled=False),
]
#: Hosts by which an address tells its platform, the first that fits.
DOMAINS = [
    ("bookmyshow.com", "BookMyShow"), ("district.in", "Zomato District"), ("zomato.com", "Zomato District"), ("insider.in", "Zomato District"), ("skillboxes.com", "Skillbox"), ("sortmyscene.com", "SortMyScene"),
    ("eventbrite.com", "Eventbrite"), ("eventbrite.co.in", "Eventbrite"), ("feverup.com", "Fever"), ("meetup.com", "Meetup"), ("explara.com", "Explara"), ("dreamsetgo.com", "DreamSetGo"), ("platinumlist.net", "Platinumlist"),
    ("allevents.in", "AllEvents"), ("ncpamumbai.com", "NCPA"), ("nmacc.com", "NMACC"), ("jioworldcentre.com", "Jio World Centre"), ("prithvitheatre.org", "Prithvi Theatre"), ("rangashankara.org", "Ranga Shankara"),
    ("indiahabitat.org", "India Habitat Centre"), ("iicdelhi.in", "India International Centre"), ("bangaloreinternationalcentre.org", "Bangalore International Centre"), ("lbb.in", "LBB"),
]

for _site in SITES:
    register_profile(_site)
