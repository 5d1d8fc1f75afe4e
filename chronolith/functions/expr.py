"""Scalar functions as Column expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative suffixes, polities and the ids they stand for.
ADMIN_SUFFIX = "(특별자치시|특별자치도|광역시|특별시|[시군구도])$"
POLITY_IDS = {"고구려": "Q28370", "백제": "Q28428", "신라": "Q28456", "통일신라": "Q28456", "발해": "Q28322", "고려": "Q28208", "조선": "Q28179", "대한제국": "Q28233"}

# Classes and label patterns of sports events.
SPORTS_CLASSES = ["Q13406554", "Q18608583", "Q46190676", "Q27020041", "Q16510064", "Q500834", "Q159821", "Q193581", "Q82414", "Q1478437", "Q476300", "Q15991290"]
SPORTS_WORDS = (
    r"올림픽|패럴림픽|아시안\s?게임|아시안컵|월드컵|선수권|유니버시아드|체육\s?대회|체전|베이스볼\s?클래식|프리미어\s?리그|K리그|플레이오프|그랑프리|마스터스|오픈|"
    r"Olympi|Paralympi|\bGames\b|\bCup\b|Championship|Grand\s+Prix|Super\s?Series|UCI\s|Masters|Open\b|League|Season|Tournament|Baseball\s+Classic|FIFA|AFC\b|IAAF|Universiade|"
    r"\b(?:doubles|singles)\b|\sat\s+the\s+\d{4}"
)

# What marks persons, events, catalogue entries and makers in prose.
PERSON_HINT = (
    r"왕|대군|공주|옹주|장군|정승|판서|영의정|좌의정|우의정|관찰사|문신|무신|학자|유학자|승려|스님|화가|서예가|선생|"
    r"급제|출사|사사|피살|유배|배향|시호|본관은|호는|자는|[가-힣]{2,3}(?:이|가)\s*(?:만들|짓|썼|세웠|그렸)"
)
EVENT_HINT = r"전쟁|난\b|왜란|호란|반정|사화|운동|봉기|정변|사건|회군|즉위|건립|중건|창건|소실|이전|복원|피란|천도|개국|축조|중수|처형|폐위|책봉|출병|정벌|조약|항쟁"
CATALOG_HINT = r"크기|규격|\dcm|재질|장정|판심|반곽|행자수|권차|장차|지질|보존상태"
MAKER = r"[가-힣]{2,4}(?:이|가|은|는|의)\s*(?:만들|제작|지었|썼|그렸|새겼|주조|봉안)|(?:만든|제작한|지은|쓴|그린|새긴)\s*(?:이|사람|장인)?\s*[가-힣]{2,4}"
CONFIDENCE = {"certain": 0.9, "probable": 0.7, "possible": 0.5}


def strip(x: Column) -> Column:
    """Unicode white space off both ends; ``trim`` only takes spaces."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_place(label: Column) -> Column:
    bare = strip(label)
    cut = F.regexp_replace(bare, ADMIN_SUFFIX, "")
    return F.when(cut == "", bare).otherwise(cut)


def normalize_period(label: Column) -> Column:
    return F.regexp_replace(strip(label), r"(?U)\s*시대$", "")


def polities(label: Column) -> Column:
    """Polities that a label names, in order; the unified kingdom's name absorbs its part."""
    longest_first = "|".join(sorted(POLITY_IDS, key=lambda k: (-len(k), k)))
    found = F.array_distinct(F.regexp_extract_all(label, F.lit(f"({longest_first})"), F.lit(1)))
    return F.when(F.array_contains(found, "통일신라"), F.array_remove(found, "신라")).otherwise(found)


def polity_id(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in POLITY_IDS.items() for x in kv))[name]


def parse_years(label: Column) -> Column:
    """Years of a label; a year before the common era stands alone, as a negative number."""
    before = F.regexp_extract(label, r"(?U)(?:기원전|서기전|B\.?C\.?)\s*(\d{1,4})", 1)
    runs = F.transform(F.regexp_extract_all(label, F.lit(r"(?<!\d)(\d{3,4})\s*년?"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(before != "", F.array(-F.expr("int(0)") - before.try_cast("int"))).otherwise(F.filter(runs, lambda y: (y >= 100) & (y <= 2100)))


def year_of(date: Column) -> Column:
    """The year of a partial ISO date kept as text; null outside 1 to 2100 either side of the era."""
    bare = strip(date)
    head = F.regexp_extract(bare, r"^-?(\d+)(?:-|$)", 1).try_cast("int")
    year = F.when(head.between(1, 2100), head)
    return F.when(F.startswith(bare, F.lit("-")), -year).otherwise(year)


def designated_date(x: Column) -> Column:
    """Eight digits as an ISO date, without a look at the calendar."""
    return F.when(x.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)))


def is_sports(label: Column, class_id: Column | None = None) -> Column:
    by_label = F.coalesce(label.rlike(f"(?iuU)(?:{SPORTS_WORDS})"), F.lit(False))
    return by_label if class_id is None else F.coalesce(class_id.isin(SPORTS_CLASSES), F.lit(False)) | by_label


def narrative_score(text: Column, person: str = PERSON_HINT, event: str = EVENT_HINT, catalog: str = CATALOG_HINT) -> Column:
    def flag(pattern: str, worth: float) -> Column:
        return F.when(text.rlike(f"(?U)(?:{pattern})"), worth).otherwise(0.0)

    return flag(person, 1.0) + flag(event, 1.0) - flag(catalog, 0.5) + F.least(F.length(text) / 4000, F.lit(0.5))


def hint_density(text: Column, person: str = PERSON_HINT, event: str = EVENT_HINT) -> Column:
    """Marks of persons and events per 1,000 characters."""
    hits = F.regexp_count(text, F.lit(f"(?U)(?:{person})")) + F.regexp_count(text, F.lit(f"(?U)(?:{event})"))
    return F.coalesce(F.try_divide(hits, F.length(text) / 1000), F.lit(0.0))


def evidence_supported(evidence: Column, text: Column, least: int = 8, head: int = 25) -> Column:
    bare = F.regexp_replace(F.coalesce(evidence, F.lit("")), r"(?U)\s+", "")
    return (F.length(bare) >= least) & F.contains(F.regexp_replace(text, r"(?U)\s+", ""), F.left(bare, F.lit(head)))


def split_chunks(text: Column, size: int = 6000, overlap: int = 400) -> Column:
    """Chunks of whole paragraphs, each led by the end of the one before; a long paragraph is not cut.

    The fold carries only where chunks begin and end, so a paragraph costs the same wherever it stands.
    """
    n = F.length(text)
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("at"), F.lit(0).alias("lead"))

    # s, e: where the held text begins and ends; lead: what it repeats of the chunk before, and the line break behind that.
    def step(a: Column, p: Column) -> Column:
        end = a["at"] + p
        held = a["e"] - a["s"] + a["lead"]
        full = (held > 0) & (held + p + 1 > size)
        lead = F.least(F.lit(overlap), held) + 1
        out = F.when(full, F.array_append(a["out"], F.struct((a["s"] - a["lead"]).alias("s"), a["e"].alias("e")))).otherwise(a["out"])
        s = F.when(full | (held <= 0), a["at"]).otherwise(a["s"])
        return F.struct(out.alias("out"), s.alias("s"), end.alias("e"), (end + 1).alias("at"), F.when(full, lead).when(held <= 0, 0).otherwise(a["lead"]).alias("lead"))

    def finish(a: Column) -> Column:
        last = F.struct((a["s"] - a["lead"]).alias("s"), a["e"].alias("e"))
        blank = strip(F.substr(text, last["s"] + 1, last["e"] - last["s"])) == ""
        return F.when(blank, a["out"]).otherwise(F.array_append(a["out"], last))

    cuts = F.aggregate(F.transform(F.split(text, "\n"), lambda p: F.length(p)), start, step, finish)
    return F.when(n <= size, F.array(text)).otherwise(F.transform(cuts, lambda c: F.substr(text, c["s"] + 1, c["e"] - c["s"])))


def redact(x: Column) -> Column:
    return F.regexp_replace(x, r"(?i)((?:serviceKey|apiKey|authKey)=)[^&\s]+", "$1***")


def cache_key(url: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, F.lit("|"), F.coalesce(body, F.lit(""))).cast("binary"), 256), 1, 32)


def last_segment(iri: Column) -> Column:
    return F.substring_index(iri, "/", -1)


def iso_date(x: Column) -> Column:
    return F.nullif(F.substring_index(x, "T", 1), F.lit(""))


def to_double(x: Column) -> Column:
    return strip(x).try_cast("double")


def url_title(x: Column) -> Column:
    """A page title in a URL's form: percent-encoding that leaves slashes and ``~`` alone."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def title_of_url(x: Column) -> Column:
    """The title that a page's URL names: its last part decoded, underscores as spaces."""
    return F.replace(F.try_url_decode(F.replace(F.substring_index(x, "/wiki/", -1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def json_set(props: Column, key: str, value: Column) -> Column:
    """``props`` with one text value put under ``key``."""
    rest = F.map_filter(F.from_json(F.coalesce(props, F.lit("{}")), "map<string,variant>"), lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)))))


def confidence(grade: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[grade], F.lit(0.5))


def relations_json(text: Column) -> Column:
    """Relations in a model's answer: the whole, a fenced part, or what the outermost braces or brackets hold."""
    def part(pattern: str, group: int) -> Column:
        return F.try_parse_json(F.regexp_extract(text, pattern, group))

    v = F.coalesce(F.try_parse_json(strip(text)), part(r"(?s)```(?:json)?\s*(.+?)```", 1), part(r"(?s)\{.*\}", 0), part(r"(?s)\[.*\]", 0))
    kind = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,evidence:string,confidence:string>>"
    one = F.array(F.try_variant_get(v, "$", kind[6:-1]))
    listed = F.try_variant_get(v, "$.relations", kind)
    single = F.try_variant_get(v, "$.subject", "string").isNotNull() & F.try_variant_get(v, "$.relation", "string").isNotNull() & F.try_variant_get(v, "$.object", "string").isNotNull()
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", kind)), listed, F.when(single, one))
