"""Personal data replaced by keyed surrogates of the same kind and form (DataFrame functions only).

Entities are found by one pattern. Each distinct entity gets a surrogate from a keyed hash: the same
entity always gets the same one (coreference), digits stay digits, letters stay in their script and
case, card numbers and IBANs keep valid check digits. Of a name, every given name and surname is an entity by itself,
whatever its title, letter case and neighbours; hyphens and apostrophes stay, and given names keep the gender that their
titles tell. A name that a document has given with a title is found there without it, too. Surrogates that meet, or that
equal an entity of the corpus, are drawn again, and made longer where their form is too narrow, until all are distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Titles before a name, by the gender they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña")
NEUTRAL = ("Dr", "Prof", "Professor")
_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
_INITIALS = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))
_PART = r"\p{Lu}\p{L}{0,40}+(?:['’]\p{Lu}\p{L}{0,40}+)?"
_NAME = rf"{_PART}(?:-{_PART})?"
#: Kind and pattern, the first that matches an entity names its kind. All but names and what follows a keyword start
#: where no ASCII letter or digit stands before; PATTERN checks that once for all of them.
_KEYED = r"(?i:token|secret|passwd|password|api_?key)\s{0,2}[=:]\s{0,2}[\"'][^\s\"']{8,}+[\"']"
_TOLD = r"(?<=(?i:\bssn|social security number|passport|passport number|passport no)[ .:#]{1,3})"
_BARE = r"[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
KINDS = {
    "secret": f"{_KEYED}|{_BARE}",
    # The host is one run of characters: a group that repeats would recurse for every label of a long one.
    "email": r"(?<![._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]+(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9-])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![0-9A-Za-z])|(?<!\()\(\d{3}\) ?\d{3}[ .-]\d{4}(?![0-9A-Za-z])|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?![0-9A-Za-z])|(?<![.-]|\d )\d{3} \d{3} \d{4}(?![0-9A-Za-z]| \d|[.-]\d)"
    r"|(?<![./-])0\d{2,4}[ /-]\d{5,8}(?![0-9A-Za-z]|-\d)|(?<![./-])\d{3}-\d{4}(?![0-9A-Za-z]|-\d)",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9A-Za-z]|\.\d)",
    # Numbers that only a word before them tells; PATTERN asks for it.
    "number": r"[A-Z]{0,2}\d{6,9}(?![0-9A-Za-z])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-\d)",
    "card": r"(?<![.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![0-9A-Za-z]|[.-]\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})?(?!\p{{L}})",
}


def _pattern() -> str:
    """One pattern for all kinds, in their order; cheap checks of a character spare most places the rest."""
    digits = "|".join(KINDS[k] for k in ("phone", "ip", "ssn", "card"))
    start = rf"(?=[0-9A-Za-z._%+(-])(?<![0-9A-Za-z])(?:{_BARE}|{KINDS['email']}|{KINDS['iban']}|(?=[A-Z]{{0,2}}\d{{6}}){_TOLD}{KINDS['number']}|(?=[\d+(])(?:{digits}))"
    return f"(?=[aApPsStT]){_KEYED}|{start}|(?=[{_INITIALS}]){KINDS['name']}"


PATTERN = _pattern()
#: Words that may be a name without its title, and what makes a place before one the beginning of a sentence.
WORD = r"(?<!\p{L})\p{Lu}\p{L}*+"
_BEGIN = r"(?:[.!?…][\"'”’)]{0,2}\s{1,4}[\"'“‘(¿¡]{0,2})"
_TITLE = rf"^(?:{_TITLES})\.? "
#: What a surrogate keeps of each kind: a head that is matched here.
_HEADS = {"secret": r"^(?i:token|secret|passwd|password|api_?key)\s{0,2}[=:]\s{0,2}[\"']", "phone": r"^\+\d{1,3}(?=[ .(-])", "iban": r"^[A-Z]{2}\d{2}", "card": r"^\d"}
#: Scripts: what a letter of one becomes, lower case and upper case.
_SCRIPTS = {
    r"\p{IsCyrillic}": ("абвгдежзийклмнопрстуфхцчшэюя", True),
    r"\p{IsGreek}": ("αβγδεζηθικλμνξοπρστυφχψω", True),
    r"\p{IsHangul}": ("".join(chr(0xAC00 + 588 * i + 28 * v) for i in range(0, 19, 2) for v in (0, 4, 8, 13, 20)), False),
    r"\p{IsHiragana}": ("".join(chr(c) for c in range(0x304B, 0x3063, 2)), False),
    r"\p{IsKatakana}": ("".join(chr(c) for c in range(0x30AB, 0x30C3, 2)), False),
    r"\p{IsHan}": ("".join(chr(0x4E00 + 37 * k) for k in range(200)), False),
}
_LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Drawings of a surrogate before the run gives up, and those of the entity's own length.
DRAWS, SAME_LENGTH = 24, 3


def entities_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(entity: Column) -> Column:
    found = F.lit("name")
    for kind, pattern in reversed(KINDS.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def canonical(entity: Column, kind: Column) -> Column:
    """The form under which mentions are one entity: letter case does not part e-mail addresses or parts of names."""
    return F.when((kind == "email") | of_name(kind), F.lower(entity)).otherwise(entity)


def of_name(kind: Column) -> Column:
    """Kinds of parts of names: surnames, and given names by gender."""
    return kind.isin("surname", "given-f", "given-m", "given-n")


def _pick(alphabet: str, h: Column) -> Column:
    return F.substr(F.lit(alphabet), h % len(alphabet) + 1, F.lit(1))


def _number(seed: Column, i: Column) -> Column:
    """The ``i``-th number (16 bits) of a keyed hash; it has 16 of them."""
    return F.conv(F.substr(F.sha2(seed.cast("binary"), 256), i * 4 + F.lit(1), F.lit(4)), 16, 10).cast("int")


def _drawn(text: Column, seed: Column) -> Column:
    """``text`` with every digit and letter drawn anew from its own kind, by the bytes of keyed hashes."""
    chars = F.split(text, "")
    def one(c: Column, i: Column) -> Column:
        h = _number(F.concat_ws("|", seed, i.cast("string")), F.lit(0))
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", h)).when(c.rlike("[a-z]"), _pick(_LATIN, h)).when(c.rlike("[A-Z]"), _pick(_LATIN.upper(), h))
        for script, (alphabet, cased) in _SCRIPTS.items():
            if cased:
                out = out.when(c.rlike(rf"^(?=\p{{Lu}}){script}"), _pick(alphabet.upper(), h))
            out = out.when(c.rlike(rf"^(?=\p{{L}}){script}"), _pick(alphabet, h))
        return out.when(c.rlike(r"\p{Lu}"), _pick(_LATIN.upper(), h)).when(c.rlike(r"\p{L}"), _pick(_LATIN, h)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _hex_only(text: Column) -> Column:
    """Letters of a hexadecimal secret brought back to a-f."""
    return F.translate(text, "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", ("abcdef" * 4)[:20] + ("ABCDEF" * 4)[:20])


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _doubled(F.try_to_number(c, F.lit("9")).cast("int"), i))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)


def _last_digit(text: Column, digit: Column) -> Column:
    return F.concat(F.regexp_replace(text, r"\d(?=\D*$).*$", ""), digit, F.regexp_extract(text, r"(\D*)$", 1))


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's characters, letters as 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _syllables(seed: Column, n: Column) -> Column:
    """A name of ``n`` syllables, capitalised."""
    def syllable(i: Column) -> Column:
        at = _number(seed, i)
        return F.concat(_pick("bdfghklmnprstvw", at), _pick("aeiou", F.floor(at / 16).cast("int")))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), syllable), ""))


def _name(entity: Column, kind: Column, seed: Column, draw: Column) -> Column:
    """A surname, or a given name of its gender; Latin ones get a syllable more with every further drawing."""
    ending = F.when(kind == "surname", "r").when(kind == "given-f", "na").when(kind == "given-m", "ro").otherwise("ne")
    latin = F.concat(_syllables(seed, F.least(F.lit(16), draw + 2)), ending)
    more = F.repeat(F.substr(entity, F.length(entity), F.lit(1)), F.greatest(draw - F.lit(SAME_LENGTH - 1), F.lit(0)))
    return F.when(entity.rlike(r"^\p{IsLatin}+$"), latin).otherwise(_drawn(F.initcap(F.concat(entity, more)), seed))


def surrogate(entity: Column, kind: Column, key: str, draw: Column) -> Column:
    """The ``draw``-th surrogate of an entity."""
    head = F.coalesce(reduce(lambda a, b: a.when(kind == b[0], F.regexp_extract(entity, b[1], 0)), _HEADS.items(), F.when(F.lit(False), "")), F.lit(""))
    seed = F.concat_ws("|", F.lit(key), kind, entity, draw.cast("string"))
    # A form that is too narrow for all its entities gets longer with every further drawing.
    more = F.repeat(F.lit("0"), F.greatest(draw - F.lit(SAME_LENGTH - 1), F.lit(0)))
    body = F.substr(entity, F.length(head) + 1)
    body = F.when(kind.isin("phone", "ssn", "card", "number"), F.concat(body, more)).otherwise(F.concat(more, body))
    drawn = _drawn(body, seed)
    secret = F.when(body.rlike(r"^[0-9A-Fa-f]+[\"']?$"), _hex_only(drawn)).otherwise(drawn)
    # The part after the last dot of an address stays; its other labels are drawn by themselves, so that hosts keep together.
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    labels = F.substr(host, F.lit(1), F.length(host) - F.length(top))
    email = F.concat(_drawn(F.concat(F.repeat(F.lit("a"), F.length(more)), local), seed), F.lit("@"), _drawn(labels, F.concat_ws("|", F.lit(key), F.lit("host"), labels)), top)
    octets = F.transform(F.split(entity, r"\."), lambda o, i: (_number(seed, i) % 254 + 1).cast("string"))
    digits = F.regexp_replace(F.concat(head, drawn), r"\D", "")
    check = (F.lit(10) - _luhn(F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0")))) % 10
    valid = _luhn(F.regexp_replace(entity, r"\D", "")) == 0
    card = F.when(valid, _last_digit(F.concat(head, drawn), check.cast("string"))).otherwise(F.concat(head, drawn))
    country = F.substr(entity, F.lit(1), F.lit(2))
    plain = F.regexp_replace(drawn, " ", "")
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(plain, country, F.lit("00")))).cast("string"), 2, "0"), drawn)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(of_name(kind), _name(entity, kind, seed, draw))
        .when(kind == "secret", F.concat(head, secret))
        .otherwise(F.concat(head, drawn))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, entity, surrogate``: all distinct within a kind (within all parts of names), and none an entity itself."""
    entities = written(entities.select("kind", "entity").distinct(), "pii-entities")
    family = F.when(of_name(F.col("kind")), "name").otherwise(F.col("kind")).alias("family")
    left = entities.withColumn("draw", F.lit(0))
    done: DataFrame | None = None
    for draw in range(DRAWS):
        drawn = written(left.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), key, F.col("draw"))), "pii-drawn")
        taken = entities.select(family, F.col("entity").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select(family, canonical(F.col("surrogate"), F.col("kind")))).distinct()
        same = canonical(F.col("surrogate"), F.col("kind"))
        first = drawn.groupBy(family, same.alias("surrogate")).agg(F.min(F.struct("kind", "entity")).alias("first"))
        first = first.join(taken, ["family", "surrogate"], "left_anti").select("first.*", F.lit(True).alias("_won"))
        marked = written(drawn.join(first, ["kind", "entity"], "left"), "pii-marked")
        won = marked.where("_won").select("kind", "entity", "surrogate")
        done = won if done is None else written(done.union(won), "pii-surrogates")
        left = marked.where("_won is null").select("kind", "entity", F.lit(draw + 1).alias("draw"))
        if left.isEmpty():
            return done
    raise RuntimeError(f"surrogates still meet after {DRAWS} draws")


def name_parts(names: DataFrame) -> DataFrame:
    """``row, at, pos, gap, part, kind, entity`` of titled names ``row, at, entity``: a row for every run of letters.

    ``gap`` is what stands before it. A single letter before an apostrophe belongs to the form and has no kind. The gender of a
    given name after a neutral title is the one that other titles tell in the same document, else in all documents.
    """
    body = names.select("row", "at", F.regexp_extract("entity", _TITLE, 0).alias("title"), F.regexp_replace("entity", _TITLE, "").alias("body"))
    letters = r"\p{L}+"
    body = body.select(
        "row",
        "at",
        "title",
        F.regexp_extract_all("body", F.lit(letters), F.lit(0)).alias("parts"),
        F.split("body", letters, -1).alias("gaps"),
        F.when(F.contains("body", F.lit(" ")), F.size(F.split(F.substring_index("body", " ", 1), letters, -1)) - 1).otherwise(0).alias("given"),
    )
    told = F.when(F.col("title").rlike(f"^(?:{'|'.join(FEMALE)})[. ]"), "f").when(F.col("title").rlike(f"^(?:{'|'.join(MALE)})[. ]"), "m")
    parts = body.select("row", "at", "title", "gaps", "given", told.alias("told"), F.posexplode("parts").alias("pos", "part"))
    kept = (F.length("part") == 1) & F.get("gaps", F.col("pos") + 1).rlike("^['’]")
    parts = parts.select(
        "row",
        "at",
        "pos",
        F.when(F.col("pos") == 0, F.col("title")).otherwise(F.get("gaps", "pos")).alias("gap"),
        "part",
        "told",
        F.when(kept, None).when(F.col("pos") < F.col("given"), "given").otherwise("surname").alias("kind"),
        F.lower("part").alias("entity"),
    )
    parts = written(parts, "pii-parts")
    votes = parts.where("kind = 'given'").groupBy("row", "entity").agg(F.count_if(F.col("told") == "f").alias("f"), F.count_if(F.col("told") == "m").alias("m"))
    votes = written(votes, "pii-genders")
    most = F.when((F.col("f") >= F.col("m")) & (F.col("f") > 0), "f").when(F.col("m") > 0, "m")
    here = votes.select("row", "entity", most.alias("here"))
    there = votes.groupBy("entity").agg(F.sum("f").alias("f"), F.sum("m").alias("m")).select("entity", most.alias("there"))
    given = parts.where("kind = 'given'").join(here, ["row", "entity"]).join(there, "entity")
    given = given.withColumn("kind", F.concat(F.lit("given-"), F.coalesce("told", "here", "there", F.lit("n"))))
    columns = ["row", "at", "pos", "gap", "part", "kind", "entity"]
    return given.select(columns).union(parts.where("kind is null or kind <> 'given'").select(columns))


def _cased(surrogate: Column, like: Column) -> Column:
    """A part of a name in capitals gets a surrogate in capitals."""
    return F.when(like.rlike(r"^\p{Lu}{2,}$"), F.upper(surrogate)).otherwise(surrogate)


def bare_names(found: DataFrame, known: DataFrame) -> DataFrame:
    """``row, bare, n_bare``: the capitalised words of every gap between a row's entities, with surrogates for known parts of names.

    Words of one or two Latin letters are left as they are, and so are words at the beginning of a sentence that the same
    document also has in lower case. Words meet names by a join on row and word, so cost is linear in both. A part that is both
    given name and surname there takes the smaller surrogate.
    """
    titled = found.where(F.exists("entities", lambda e: e.rlike(_TITLE)))
    lower = titled.select("row", F.explode(F.array_distinct("lower")).alias("entity"), F.lit(True).alias("lower"))
    known = known.where((F.length("entity") > 2) | ~F.col("entity").rlike(r"^\p{IsLatin}+$"))
    known = known.groupBy("row", "entity").agg(F.min("surrogate").alias("surrogate")).join(lower, ["row", "entity"], "left")
    gaps = titled.select("row", F.posexplode("words").alias("gap", "words"))
    words = gaps.select("row", "gap", F.posexplode_outer("words").alias("pos", "found"))
    word = F.regexp_extract("found", r"\p{L}+$", 0)
    words = words.select("row", "gap", "pos", word.alias("word"), F.lower(word).alias("entity"), F.col("found").rlike(rf"^{_BEGIN}").alias("begins"))
    new = F.when(~(F.col("begins") & F.col("lower").isNotNull()), _cased(F.col("surrogate"), F.col("word")))
    words = words.join(known, ["row", "entity"], "left").select("row", "gap", "pos", "word", new.alias("new"))
    listed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("new", "word").alias("new")))))
    of_gap = words.groupBy("row", "gap").agg(listed.alias("words"), F.count("new").alias("n"))
    of_row = of_gap.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("gap", F.col("words.new").alias("new")))).alias("bare"), F.sum("n").alias("n_bare"))
    return of_row.select("row", F.col("bare.new").alias("bare"), "n_bare")


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the personal data in ``text_col`` replaced, and ``n_replaced`` (long).

    Null texts stay null with 0 replaced, empty texts stay empty. Ids may be null or repeat: rows are told apart by 256 bits of
    id and text, and equal rows get equal results. Other columns pass through whatever their names, save ``n_replaced``,
    which is replaced. An empty table gives an empty result. One entity may stand in any share of the rows: surrogates are joined to
    mentions by two plain shuffles, which Spark splits where they are skewed.
    """
    row = F.unhex(F.sha2(F.concat_ws("|", F.col(id_col).cast("string"), F.length(text_col).cast("string"), F.col(text_col)).cast("binary"), 256))
    text = F.col(text_col)
    # Only texts with a title have names to look for between their entities.
    titled = text.rlike(rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}")
    opened = F.transform(F.split(text, PATTERN, -1), lambda p, i: F.when(i == 0, F.concat(F.lit(". "), p)).otherwise(p))
    words = F.transform(opened, lambda p: F.regexp_extract_all(p, F.lit(f"{_BEGIN}?{WORD}"), F.lit(0)))
    begun = F.transform(F.regexp_extract_all(F.concat(F.lit(". "), text), F.lit(_BEGIN + WORD), F.lit(0)), lambda w: F.lower(F.regexp_extract(w, r"\p{L}+$", 0)))
    lower = F.array_intersect(begun, F.split(text, r"[^\p{L}]+"))
    # Written before it is filtered: a filter on top would be pushed below and extract again.
    found = docs.select(row.alias("row"), entities_in(text).alias("entities"), F.when(titled, words).alias("words"), F.when(titled, lower).alias("lower"))
    found = written(found, "pii-found").where(F.size("entities") > 0).dropDuplicates(["row"])
    one = found.select("row", F.posexplode("entities").alias("at", "entity"))
    one = one.withColumn("kind", kind_of(F.col("entity")))
    one = written(one.withColumn("entity", canonical(F.col("entity"), F.col("kind"))), "pii-mentions")
    parts = written(name_parts(one.where("kind = 'name'")), "pii-names")
    others = one.where("kind <> 'name'")
    made = surrogates(others.select("kind", "entity").union(parts.where("kind is not null").select("kind", "entity")), key)
    parts = written(parts.join(made, ["kind", "entity"], "left"), "pii-named")
    spelt = F.concat("gap", F.coalesce(_cased(F.col("surrogate"), F.col("part")), F.col("part"))).alias("spelt")
    names = parts.groupBy("row", "at").agg(F.array_sort(F.collect_list(F.struct("pos", spelt))).alias("parts"))
    mentions = others.join(made, ["kind", "entity"]).select("row", "at", "surrogate").union(names.select("row", "at", F.array_join("parts.spelt", "")))
    # A document's own mentions are bounded by its length.
    of_row = mentions.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("new"))
    bare = bare_names(found, parts.where("surrogate is not null").select("row", "entity", "surrogate"))
    of_row = written(of_row.join(bare, "row", "left").select("row", F.col("new.surrogate").alias("new"), "bare", "n_bare"), "pii-rows")

    # Every row is joined, so no pattern scan tells rows apart here; only rows with entities are split. Merged at every
    # size: rows are shuffled once, in proportion to the input, with or without personal data.
    rest = docs.drop("n_replaced")
    own = {c: f"{c}_{'_' * max(map(len, rest.columns))}" for c in ("row", "new", "bare", "n_bare", "parts")}  # longer than any column of theirs
    joined = rest.withColumn(own["row"], row).join(of_row.withColumnsRenamed({c: own[c] for c in of_row.columns}).hint("merge"), own["row"], "left")
    new, bare, n_bare, between = (F.col(own[c]) for c in ("new", "bare", "n_bare", "parts"))
    joined = joined.withColumn(own["parts"], F.when(new.isNotNull(), F.split(text, PATTERN, -1)))

    def filled(gaps: Column, values: Column) -> Column:
        return F.array_join(F.zip_with(gaps, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    renamed = F.when(bare.isNotNull(), F.zip_with(between, bare, lambda p, ws: filled(F.split(p, WORD, -1), ws)))
    clean = F.when(new.isNull(), text).otherwise(filled(F.coalesce(renamed, between), new))
    count = F.when(new.isNull(), 0).otherwise(F.size(new) + F.coalesce(n_bare, F.lit(0))).cast("long")
    return joined.withColumn("n_replaced", count).withColumn(text_col, clean).select(*rest.columns, "n_replaced")


def op7_pii(spark: SparkSession, sf_dir: str, key: str = "surrogates") -> DataFrame:
    out = replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "n_replaced", "text")
