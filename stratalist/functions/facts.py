"""Facts in free text, as column functions. What a text does not state stays null, empty or ``unknown``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, words_array

# Patterns and tables of stated facts.
SALARY = (
    r"(?i)(?:([$€£])\s?)?(\d{1,3}(?:,\d{3})+|\d{2,7}(?:\.\d+)?)\s*(?:(?:-|–|to)\s*(?:[$€£]\s?)?(\d{1,3}(?:,\d{3})+|\d{2,7}(?:\.\d+)?))?"
    r"\s*(per\s+hour|/\s*hour|/\s*hr|hourly|an hour|per\s+year|/\s*year|annually|per\s+month|/\s*month)?"
)
YEARS = r"(?i)(\d{1,2})\s*(?:\+|plus)?\s*(?:-|to|–)?\s*(\d{1,2})?\s*\+?\s*year[s]?\b[^.]{0,40}(?:experience|exp\b)"
DEGREE = r"(?i)\b(bachelor'?s?|b\.?s\.?|b\.?a\.?|master'?s?|m\.?s\.?|ph\.?d\.?|doctoral|mba|associate'?s?)\b"
DEGREES = {
    "bachelor": "Bachelors", "bachelors": "Bachelors", "bs": "Bachelors", "ba": "Bachelors", "master": "Masters", "masters": "Masters", "ms": "Masters", "phd": "PhD",
    "doctoral": "PhD", "mba": "MBA", "associate": "Associates", "associates": "Associates",
}
TERM = r"(?i)\b((?:summer|fall|autumn|spring|winter)\s*(?:20\d{2})?)\b"
TERM_LIMIT = 6
SPONSORSHIP = {
    "security_clearance_required": ["security clearance", "secret clearance", "top secret", "ts/sci", "active clearance"],
    "citizenship_required": [r"must be a? ?u\.?s\.? citizen", r"u\.?s\.? citizenship (?:is )?required", "citizenship requirement", "itar", "export control"],
    "not_offered": [
        r"(?:will |can )?not (?:be able to )?(?:provide|offer|sponsor)\w*[^.]{0,40}(?:sponsorship|visa)", "no (?:visa )?sponsorship",
        "unable to (?:provide|offer|sponsor)[^.]{0,40}(?:sponsorship|visa)", "does not sponsor", "sponsorship is not (?:available|offered|provided)",
        "without (?:the need for )?(?:current or future )?(?:visa )?sponsorship", r"not (?:currently )?considering candidates (?:who )?requir\w+ sponsorship",
        "must be (?:legally )?authorized to work[^.]{0,60}without sponsorship",
    ],
    "offered": [
        r"(?:we |company )?(?:will |do |can )?(?:provide|offer|sponsor)\w*[^.]{0,30}(?:visa )?sponsorship", "sponsorship (?:is )?available",
        "visa sponsorship (?:is )?(?:offered|provided|available)",
        r"\b(?:we |company )?(?:will |do |can |may )?sponsors?\b[^.]{0,30}\b(?:visas?|h-?1b|opt|cpt|candidates?|students?)\b", "open to sponsoring", "eligible for (?:visa )?sponsorship",
    ],
}
INTERN, COOP = r"(?i)\b(intern|internship|summer analyst|industrial placement)\b", r"(?i)\b(co[\s-]?op)\b"
NEW_GRAD = r"(?i)\b(new grad|university grad|early career|campus hire|graduate program)\b"
PART_TIME, CONTRACT = r"(?i)\bpart[\s-]?time\b", r"(?i)\b(contract|contractor|temporary|temp)\b"
DECLARED = {
    "intern": "internship", "internship": "internship", "co-op": "co_op", "coop": "co_op", "full-time": "full_time", "fulltime": "full_time", "part-time": "part_time",
    "contract": "contract", "temporary": "contract",
}
REMOTE, HYBRID, ONSITE = r"(?i)\b(remote|work from home|wfh|virtual|telecommute)\b", r"(?i)\bhybrid\b", r"(?i)\b(on[\s-]?site|in[\s-]?office|in person)\b"
DEADLINE = (
    r"(?i)(?:appl(?:y|ication|ications)|submit|deadline|closes?|closing)[^.\n]{0,60}?(?:by|before|on|date[:\s]|is)\s*"
    r"((?:[A-Z][a-z]{2,9}\s+\d{1,2},?\s*\d{4})|(?:\d{1,2}/\d{1,2}/\d{2,4})|(?:\d{4}-\d{2}-\d{2})|(?:[A-Z][a-z]{2,9}\s+\d{1,2}(?:st|nd|rd|th)?))"
)
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
COUNTRIES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "america": "US", "united states": "US", "united states of america": "US",
    "ca": "CA", "canada": "CA",
    "uk": "GB", "gb": "GB", "united kingdom": "GB", "england": "GB", "great britain": "GB", "scotland": "GB", "wales": "GB",
    "ie": "IE", "ireland": "IE",
    "de": "DE", "germany": "DE", "deutschland": "DE",
    "nl": "NL", "netherlands": "NL", "the netherlands": "NL",
    "fr": "FR", "france": "FR",
    "es": "ES", "spain": "ES",
    "it": "IT", "italy": "IT",
    "se": "SE", "sweden": "SE",
    "ch": "CH", "switzerland": "CH",
    "pl": "PL", "poland": "PL",
    "in": "IN", "india": "IN",
    "sg": "SG", "singapore": "SG",
    "au": "AU", "australia": "AU",
    "nz": "NZ", "new zealand": "NZ",
    "jp": "JP", "japan": "JP",
    "kr": "KR", "south korea": "KR", "korea": "KR",
    "cn": "CN", "china": "CN",
    "tw": "TW", "taiwan": "TW",
    "hk": "HK", "hong kong": "HK",
    "il": "IL", "israel": "IL",
    "mx": "MX", "mexico": "MX",
    "br": "BR", "brazil": "BR",
    "ae": "AE", "uae": "AE", "united arab emirates": "AE",
}
# Lines that open a section of a description.
SECTIONS = {
    "requirements": (
        r"(?:minimum\s+)?(?:qualifications?|requirements?|what\s+you'?ll?\s+need|what\s+we'?re\s+looking\s+for|basic\s+qualifications?|who\s+you\s+are|skills?\s+(?:and|&)\s+experience)"
    ),
    "preferred": r"(?:preferred\s+qualifications?|nice\s+to\s+have|bonus\s+points?|preferred\s+skills?|desired\s+qualifications?|pluses?)",
    "responsibilities": r"(?:responsibilities|what\s+you'?ll?\s+do|the\s+role|your\s+impact|job\s+description|duties|about\s+the\s+role)",
}
METROS = {
    "bay_area": [
        "san jose", "santa clara", "sunnyvale", "palo alto", "mountain view", "san francisco", "cupertino", "fremont", "milpitas", "menlo park", "redwood city", "bay area",
        "silicon valley", "south san francisco", "san mateo", "foster city", "berkeley", "oakland",
    ],
    "seattle": ["seattle", "bellevue", "redmond", "kirkland", "everett"], "nyc": ["new york", "nyc", "manhattan", "brooklyn", "jersey city"],
    "boston": ["boston", "cambridge, ma", "somerville", "waltham", "burlington, ma", "andover"], "austin": ["austin", "round rock"],
    "dallas": ["dallas", "plano", "richardson", "fort worth", "irving"], "la": ["los angeles", "santa monica", "irvine", "san diego", "pasadena", "el segundo"],
    "pittsburgh": ["pittsburgh"], "chicago": ["chicago", "evanston", "naperville"], "portland": ["portland", "hillsboro", "beaverton"],
    "phoenix": ["phoenix", "chandler", "tempe", "scottsdale", "mesa"], "raleigh": ["raleigh", "durham", "cary", "chapel hill"], "denver": ["denver", "boulder", "louisville, co"],
    "atlanta": ["atlanta", "alpharetta"], "dc": ["washington, dc", "arlington, va", "mclean", "reston", "bethesda", "herndon"],
}


def all_groups(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def salary(text: Column) -> Column:
    """Struct (min, max, currency, period) of the first credible range, or null."""
    # The text is searched once; each short match is then taken apart. A cast of '' would throw and catch an exception.
    def number(m: Column, k: int) -> Column:
        raw = F.regexp_extract(m, SALARY, k)
        return F.when(raw != "", F.regexp_replace(raw, ",", "").try_cast("double"))

    def part(m: Column) -> Column:
        return F.struct(number(m, 2).alias("low"), number(m, 3).alias("high"), F.regexp_extract(m, SALARY, 1).alias("mark"), F.lower(F.regexp_extract(m, SALARY, 4)).alias("per"))

    def read(x: Column) -> Column:
        low, high, per = x["low"], x["high"], x["per"]
        period = F.when(per.rlike("hour|hr"), "hourly").when(F.contains(per, F.lit("month")), "monthly").when(per.rlike("year|annual"), "yearly")
        period = F.coalesce(period, F.when(low < 500, "hourly").otherwise("yearly"))
        currency = F.when(x["mark"] == "$", "USD").when(x["mark"] == "€", "EUR").when(x["mark"] == "£", "GBP")
        return F.struct(low.alias("min"), F.when(high >= low, high).alias("max"), currency.alias("currency"), period.alias("period"))

    def credible(s: Column) -> Column:
        return ~((s["period"] == "yearly") & (s["min"] < 10000)) & ~((s["period"] == "hourly") & ((s["min"] < 7) | (s["min"] > 400)))

    # Matches after the first credible one are not taken apart.
    first = lambda found, m: F.coalesce(found, let(let(part(m), read), lambda s: F.when(credible(s), s)))
    none = F.lit(None).cast("struct<min: double, max: double, currency: string, period: string>")
    return F.aggregate(all_groups(text, SALARY, 0), none, first)


def experience_years(text: Column) -> Column:
    years = F.transform(all_groups(text, YEARS, 1), lambda y: y.cast("double"))
    return F.array_min(F.filter(years, lambda y: y <= 30))


def degrees(text: Column) -> Column:
    found = F.transform(all_groups(text, DEGREE, 1), lambda d: F.regexp_replace(F.lower(d), "[^a-z]", ""))
    table = F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(found, lambda d: F.try_element_at(table, d))))


def terms(text: Column) -> Column:
    """Seasons with their year, distinct, in order."""
    def label(t: Column) -> Column:
        season = F.initcap(F.regexp_extract(t, "^([A-Za-z]+)", 1))
        season = F.when(season == "Autumn", "Fall").otherwise(season)
        year = F.regexp_extract(t, r"(20\d{2})$", 1)
        return F.when(year != "", F.concat(season, F.lit(" "), year)).otherwise(season)

    return F.slice(F.array_distinct(F.transform(all_groups(text, TERM, 1), label)), 1, TERM_LIMIT)


def sponsorship(text: Column) -> Column:
    """The strictest statement found; silence is ``unknown``."""
    out = F.lit("unknown")
    for status in reversed(SPONSORSHIP):
        out = F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in SPONSORSHIP[status])), status).otherwise(out)
    return out


def employment_type(title: Column, body: Column, declared: Column) -> Column:
    title, body, said = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")), F.lower(F.coalesce(declared, F.lit("")))
    out = (
        F.when(title.rlike(COOP), "co_op").when(title.rlike(INTERN), "internship").when(title.rlike(NEW_GRAD), "new_grad").when(body.rlike(INTERN), "internship")
        .when(body.rlike(NEW_GRAD), "new_grad").when(title.rlike(PART_TIME), "part_time").when(title.rlike(CONTRACT), "contract").otherwise("unknown")
    )
    for needle, kind in reversed(DECLARED.items()):
        own = F.when(title.rlike(INTERN), "internship").otherwise(kind) if kind == "full_time" else F.lit(kind)
        out = F.when(F.contains(said, F.lit(needle)), own).otherwise(out)
    return out


def remote_status(text: Column) -> Column:
    return F.when(text.rlike(HYBRID), "hybrid").when(text.rlike(REMOTE), "remote").when(text.rlike(ONSITE), "onsite").otherwise("unknown")


def deadline(text: Column, reference: Column) -> Column:
    """A stated closing date, at the end of its day; none is invented. ``reference`` is the day the year is counted from."""
    raw = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, DEADLINE, 1), r"(?<=\d)(st|nd|rd|th)\b", ""), r"[,\s]+", " ")
    dated = F.when(raw.rlike(r"^[A-Za-z]+ \d{1,2}$"), F.concat(raw, F.lit(" "), F.year(reference).cast("string"))).otherwise(raw)
    short = F.concat(F.initcap(F.substring(dated, 1, 3)), F.regexp_extract(dated, r"^[A-Za-z]+( .*)$", 1))
    day = F.coalesce(F.try_to_date(short, "MMM d yyyy"), F.try_to_date(raw, "M/d/yyyy"), F.try_to_date(raw, "M/d/yy"), F.try_to_date(raw, "yyyy-MM-dd"))
    day = F.when(day < F.date_sub(reference, 180), F.add_months(day, 12)).otherwise(day)
    return F.when((day <= F.date_add(reference, 730)) & (day >= F.date_sub(reference, 30)), F.timestamp_add("SECOND", F.lit(86399), day.cast("timestamp_ntz")))


def metro(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name in reversed(METROS):
        hit = F.lit(False)
        for needle in METROS[name]:
            hit = hit | F.contains(low, F.lit(needle))
        out = F.when(hit, name).otherwise(out)
    return out


def country_code(name: Column) -> Column:
    """Two letters for a country as it is spelled; the unknown stays as it is, in capitals; nothing stated is empty."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.replace(plain, F.lit("."), F.lit(""))), F.upper(F.trim(F.coalesce(name, F.lit("")))))


def parse_location(raw: Column) -> Column:
    """Struct (city, state, country, metro, remote, key) of "City, State, Country" with commas, bars or slashes between.

    A state wins over a country of the same letters; a city that names a state is that state; the key is the metro, else city and
    state, else ``remote``, else empty.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    split = F.filter(F.transform(F.split(text, r"[,|/]"), lambda p: F.trim(p)), lambda p: p != "")

    def read(parts: Column) -> Column:
        states = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
        countries = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
        codes = words_array(sorted(set(STATES.values())))
        low = lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " "))
        start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("country"))

        def step(found: Column, part: Column) -> Column:
            named = F.coalesce(F.when(F.array_contains(codes, F.upper(part)), F.upper(part)), F.try_element_at(states, low(part)))
            known = F.when(named.isNull(), F.try_element_at(countries, low(part)))
            verbatim = F.when(named.isNull() & known.isNull() & (F.length(low(part)) > 3) & found["state"].isNull(), part)
            return F.struct(F.coalesce(named, found["state"]).alias("state"), F.coalesce(known, verbatim, found["country"]).alias("country"))

        rest = F.aggregate(F.slice(parts, 2, 64), start, step)
        first = F.get(parts, F.lit(0))
        city = F.when(~F.coalesce(first.rlike(rf"(?i)^{REMOTE.removeprefix('(?i)')}$"), F.lit(False)), first)
        city_state = F.try_element_at(states, low(city))
        remote, area = text.rlike(REMOTE), metro(text)
        state = F.coalesce(city_state, rest["state"])
        place = F.when(city_state.isNull(), city)
        country = F.coalesce(rest["country"], F.when(rest["state"].isNotNull(), "US"))
        key = F.coalesce(area, F.when(place.isNotNull(), F.concat_ws("|", low(place), F.coalesce(F.lower(state), F.lit("")))), F.when(state.isNotNull() & ~remote, F.concat(F.lit("|"), F.lower(state))), F.when(remote, "remote"), F.lit(""))
        return F.struct(place.alias("city"), state.alias("state"), country.alias("country"), area.alias("metro"), remote.alias("remote"), key.alias("key"))

    return let(split, read)


def split_sections(text: Column) -> Column:
    """Struct (requirements, preferred, responsibilities): what follows the line that opens each, up to the next such line; the first that isn't empty."""
    marked = F.coalesce(text, F.lit(""))
    for name, pattern in SECTIONS.items():
        marked = F.regexp_replace(marked, rf"(?im)^(\s*(?:#+\s*)?{pattern}\s*:?\s*)$", f"\x02{name}\x03$1")

    def read(pieces: Column) -> Column:
        def body(name: str) -> Column:
            own = F.filter(pieces, lambda p: F.startswith(p, F.lit(f"{name}\x03")))
            found = F.transform(own, lambda p: F.regexp_replace(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)$", 1), r"^\s+|\s+$", ""))
            return F.coalesce(F.get(F.filter(found, lambda b: b != ""), F.lit(0)), F.lit(""))

        return F.struct(*[body(n).alias(n) for n in SECTIONS])

    return let(F.slice(F.split(marked, "\x02"), 2, 1 << 30), read)


def locations_compatible(a: Column, b: Column) -> Column:
    """Whether two parsed locations can be one place; the unknown fits everything."""
    states = a["state"].isNotNull() & b["state"].isNotNull()
    one_city = a["city"].isNotNull() != b["city"].isNotNull()
    return (
        F.when((a["key"] == "") | (b["key"] == "") | (a["key"] == b["key"]), True)
        .when(a["metro"].isNotNull() & b["metro"].isNotNull(), a["metro"] == b["metro"])
        .when(a["remote"] & b["remote"], True)
        .when(F.lower(a["city"]) == F.lower(b["city"]), True)
        .when(states & (a["state"] != b["state"]), False)
        .when(one_city, F.when(states, a["state"] == b["state"]).otherwise(True))
        .otherwise(False)
    )
