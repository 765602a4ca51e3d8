"""Tier and activity type. Rules are ordered data; Catalyst gets one CASE chain of literal patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

#: Rupees from which a tier starts.
TIERS = [("Ultra Premium", 5000.0), ("Luxury", 1550.0), ("Premium", 500.0), ("Standard", float("-inf"))]
UNKNOWN_TIER = "TBC"
ACTIVITIES = ["Culture", "Art", "Music", "F&B", "Sports to Watch", "Recreational Sports", "Theatre", "Comedy", "Workshops", "Other"]
#: The order in which activities are asked, and the words of each.
MAIN_RULES: Rules = [
    ("Workshops", r"workshops?|master\s?class(?:es)?|bootcamps?|crash course|certificate course|short course|classes|hands[\s-]on|diy|pottery|candle making|resin art|terrarium|calligraphy|crochet|embroidery|learn to \w+|training|skill session"),
    ("Comedy", r"comedy|comedians?|comic|stand[\s-]?up|standup|improv|roast|sketch show|hasya|funny|laugh(?:ter)? (?:club|riot)"),
    ("Theatre", r"theat(?:re|er|rical)|plays?|drama|natak|naatak|nataka|the musical|a musical|musical play|broadway|stage play|monologues?|immersive theat(?:re|er)|puppetry|mime|tamasha|lavani|yakshagana"),
    ("Sports to Watch", r"cricket|ipl|isl|football match|football|kabaddi|hockey|badminton|tennis|formula ?1|f1|motogp|grand prix|ufc|wwe|boxing|mma|wrestling|e-?sports|basketball|volleyball|t20|odi|test match|premier league|pro league|league match|sports? screening|live screening|match screening|spectator|rugby|nrl|afl|grand final|state of origin|athletics|vs\.?|v/s|fight night|olympics?|(?:asian|commonwealth|olympic|national|khelo india)[\w &]{0,30} games"),
    ("Recreational Sports", r"marathon|half marathon|\d{1,2}\s?k\s?(?:run|walk)|fun run|cyclothon|cycling|cycle ride|treks?|trekking|hikes?|hiking|yoga|fitness|workout|zumba|golf|swimming|triathlon|pickleball|kayaking|climbing|bouldering|skating|paragliding|camping|adventure|run club|running|turf|futsal|run(?=\s+20\d\d)|(?:city|fun|charity|colou?r|heritage|pink|women'?s|freedom|monsoon|midnight) run"),
    ("F&B", r"food|foodie|drinks?|brunch|dining|dinner|lunch|chefs?|wine|beer|brew(?:ery|eries)?|cocktails?|whisk(?:e)?y|gin|tequila|tasting|culinary|cuisine|mixology|buffet|feast|supper club|bar takeover|pop-?up kitchen|high tea|coffee|bakery|food & drinks"),
    ("Art", r"(?<!martial )arts?|artist|exhibitions?|gallery|galleries|museums?|paintings?|sculptures?|photography|installations?|art fair|biennale|visual arts|retrospective|solo show|group show|curated show"),
    ("Music", r"music|musical night|concerts?|gigs?|dj|djs|edm|techno|house music|hip[\s-]?hop|rap|bands?|orchestra|symphony|jazz|blues|rock|metal|indie|qawwali|orchestra(?:l)?|symphon(?:y|ic)|tribute|dj sets?|weekender|residency|ghazal|sufi|classical music|carnatic|hindustani|bollywood night|karaoke|nightlife|party|parties|rave|club night|singers?|unplugged|acoustic|live music|open air|festival of music|bhajan clubbing|kirtan|recital|choir|music shows?|sunburn|lollapalooza|gig"),
    ("Culture", r"cultur(?:e|al)|heritage|literature|literary|fairs?|parv|jayanti|lit fest|books?|poetry|poets?|storytelling|spoken word|mushaira|kavi|sammelan|spiritual(?:ity)?|devotional|satsang|garba|dandiya|navratri|diwali|holi|durga puja|ganesh|dance|kathak|bharatanatyam|odissi|kuchipudi|talks?|lectures?|screenings?|film|films|cinema|heritage walks?|walking tours?|walks?|performances?|mela|utsav"),
    ("Other", r"kids|children|family|conferences?|summit|expo|exhibitors?|trade (?:fair|show)|meetups?|networking|business|startups?|career|seminars?|webinars?|pets?|dogs?|gaming|quiz|flea market|pop-?up market|sale|awards?"),
]
#: Asked first, on title, venue and categories together.
PRIORITY_RULES: Rules = [
    ("Culture", r"navratri|garba|dandiya|raas|ram ?leela"),
    ("Comedy", r"comedy club|comedy store|laugh store"),
    ("F&B", r"oktober ?fest|octoberfest|beer fest(?:ival)?|food fest(?:ival)?"),
    ("Recreational Sports", r"shooting range|shooting academy|archery|go-?karting|paintball|(?:cricket|football|tennis|badminton|swimming|skating) (?:coaching|training|camp|academy)|coaching (?:camp|centre|center)|training camp"),
]
#: Labels that decide only when nothing above does.
WEAK_RULES: Rules = [
    ("Sports to Watch", r"sports?|matches|match|tournaments?|league|championships?"),
    ("Music", r"tours?|live in|live at|live|world tour|in concert"),
    ("Culture", r"festivals?|fests?|celebrations?|performances?|shows?|entertainment|events?"),
]
#: Schema.org types with an activity of their own.
SCHEMA_TYPES = {
    "comedyevent": "Comedy", "musicevent": "Music", "theaterevent": "Theatre", "sportsevent": "Sports to Watch", "foodevent": "F&B", "exhibitionevent": "Art", "visualartsevent": "Art",
    "danceevent": "Culture", "literaryevent": "Culture", "festival": "Culture", "educationevent": "Workshops", "childrensevent": "Other", "businessevent": "Other", "screeningevent": "Culture",
}


def tier(lo: Column, hi: Column, free: Column, basis: str = "min") -> Column:
    """The tier of a ticket price: the cheapest (min), the dearest (max) or their mean (avg)."""
    low = F.when(free, F.lit(0.0)).otherwise(lo)
    high = F.coalesce(hi, lo)
    low, top = F.coalesce(low, high), F.greatest(F.coalesce(high, low), F.coalesce(low, high))
    price = {"min": low, "max": top, "avg": (low + top) / 2}[basis]
    out = F.when(price.isNull(), UNKNOWN_TIER)
    for name, least in TIERS[:-1]:
        out = out.when(price >= least, name)
    return out.otherwise(TIERS[-1][0])


def first_rule(text: Column, rules: Rules) -> Column:
    """The label of the first rule with a whole word in text; null if none has."""
    out = F.lit(None).cast("string")
    for label, words in reversed(rules):
        out = F.when(text.rlike(rf"(?i)(?<![a-z0-9])(?:{words})(?![a-z0-9])"), label).otherwise(out)
    return out


def activity(categories: Column, title: Column, description: Column, venue: Column, main: Rules = MAIN_RULES, priority: Rules = PRIORITY_RULES, weak: Rules = WEAK_RULES) -> Column:
    """Priority rules, then the platform's categories, then the title; a weak label stands unless it is only Culture and the description knows better."""
    cats = F.array_join(F.filter(categories, lambda c: c != ""), " | ")
    opening = F.substring(description, 1, 400)
    loose = first_rule(F.concat_ws(" | ", cats, title), weak)
    return F.coalesce(
        first_rule(F.concat_ws(" | ", title, venue, cats), priority), first_rule(cats, main), first_rule(title, main),
        F.when(loose != "Culture", loose), first_rule(opening, main), loose, first_rule(opening, weak), F.lit("Other"),
    )


def schema_category(types: Column) -> Column:
    """The activity of the first known schema.org type of an array; null if none is."""
    names = F.transform(types, lambda t: F.lower(F.substring_index(t, "/", -1)))
    table = F.create_map(*(F.lit(x) for pair in SCHEMA_TYPES.items() for x in pair))
    return F.get(F.filter(F.transform(names, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()), F.lit(0))
