"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns and replaced by keyed values of the same type and format. The same entity gets the same
surrogate in every document, and different entities get different ones: a table of all distinct entities is
checked for collisions, and those that collide are drawn again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, free_name, written

#: Texts with re-drawn entities up to which their table is broadcast; more of them are joined by shuffling.
BROADCAST_TEXTS = 20_000
#: Rounds of re-drawing before the operator gives up with an error.
ROUNDS = 12

FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Mme", "Mlle", "Madame", "Mademoiselle", "Frau", "Señora", "Señorita", "Sra", "Srta", "госпожа", "г-жа")
MALE_TITLES = ("Mr", "Mister", "Sir", "Monsieur", "Herr", "Señor", "Sr", "господин", "г-н")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor", "Mx")
_TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True))

#: A word of a name: a capital, then letters with hyphens and apostrophes between them.
_NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]{2,}+)*+(?<=[\p{L}\p{M}]{2})"

#: Patterns in order of precedence; each starts where its run of characters starts, so that scanning is linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap test that a text can hold an entity at all.
_HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}"

#: Country calling codes are 1, 7, these of two digits, and three digits else.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro".split(),
    "cyrillic": "ба бе би бо да де ди до га го ка ки ко ла ле ли ма ме ми мо на не ни но ра ре ри ро та те ти то".split(),
}
_ENDING = {"female": {"latin": "na", "cyrillic": "на"}, "male": {"latin": "n", "cyrillic": "н"}, "neutral": {"latin": "s", "cyrillic": "с"}, "family": {"latin": "ner", "cyrillic": "ко"}}


def _byte(h: Column, i: Column | int) -> Column:
    """Byte i of a hex digest of 64 bytes, around and around."""
    at = (F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)) * 2 + 1).cast("int")
    return F.conv(h.substr(at, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), F.pmod(number, F.lit(len(options))) + 1)


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _classed(value: Column, h: Column) -> Column:
    """Each ASCII letter or digit by a keyed one of its class; what else there is stays."""
    digits, lower, upper = list("0123456789"), list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    one = lambda c, i: F.when(c.rlike("^[0-9]$"), _pick(digits, _byte(h, i))).when(c.rlike("^[A-Z]$"), _pick(upper, _byte(h, i))).when(c.rlike(r"^\p{L}$"), _pick(lower, _byte(h, i))).otherwise(c)
    return F.array_join(F.transform(_chars(value), one), "")


def _kind(value: Column) -> Column:
    """Type of a found entity: the first pattern, in order of precedence, that all of it matches."""
    out = F.when(value.contains("@"), "email")
    for kind in list(PATTERNS)[1:]:
        out = out.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), kind)
    return out


def _canonical(kind: Column, value: Column) -> Column:
    """What is equal for all mentions of one entity, however written."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    country = F.regexp_extract(value, _COUNTRY, 1)
    return (
        F.when(kind.isin("email", "secret", "ip6"), F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "phone", F.concat(country, F.lit("-"), digits.substr(F.char_length(country) + 1, F.lit(32))))
        .when(kind.isin("card", "ssn"), digits)
        .otherwise(value)
    )


def _luhn_digit(digits: Column) -> Column:
    """Check digit for a string of digits."""
    n = F.char_length(digits)
    doubled = lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(_chars(digits), doubled), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _syllabled(h: Column, script: Column, ending: str, tries: Column) -> Column:
    """A pronounceable name of four syllables, one more for every re-draw."""
    def of(s: str) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(3) + tries), lambda i: _pick(_SYLLABLES[s], _byte(h, i)))
        return F.initcap(F.concat(F.array_join(parts, ""), F.lit(_ENDING[ending][s])))

    return F.when(script == "cyrillic", of("cyrillic")).otherwise(of("latin"))


def _drawn(kind: Column, canon: Column, tries: Column, secret: str) -> Column:
    """Surrogate in canonical form: a function of key, type, canonical entity and number of re-draws."""
    h = F.sha2(F.concat_ws("|", F.lit(secret), kind, canon, tries.cast("string")), 512)

    def made(h: Column) -> Column:
        letters = F.array_join(F.transform(F.sequence(F.lit(40), F.lit(45) + tries), lambda i: _pick(list("abcdefghijklmnopqrstuvwxyz"), _byte(h, i))), "")
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        host = F.sha2(F.concat_ws("|", F.lit(secret), F.lit("domain"), domain), 256)
        host_name = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _pick(list("abcdefghijklmnopqrstuvwxyz"), F.conv(host.substr((i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))), "")
        email = F.concat(letters, _classed(local, h), F.lit("@"), host_name, F.lit(".example"))
        country, rest = F.substring_index(canon, "-", 1), F.substring_index(canon, "-", -1)
        body = _classed(canon.substr(F.lit(1), F.char_length(canon) - 1), h)
        check = _luhn_digit(body)
        valid = _luhn_digit(canon.substr(F.lit(1), F.char_length(canon) - 1)) == canon.substr(F.char_length(canon), F.lit(1)).cast("int")
        card = F.concat(body, F.when(valid, check).otherwise(F.pmod(check + 1 + F.pmod(_byte(h, 63), F.lit(9)), F.lit(10))).cast("string"))
        hexed = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(canon))), lambda i: h.substr((F.pmod(i - 1, F.lit(128)) + 1).cast("int"), F.lit(1))), "")
        ip6 = F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit(":"), h.substr((i * 4 + 1).cast("int"), F.lit(4)))), ""))
        script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        out = (
            F.when(kind == "email", email)
            .when(kind == "secret", F.when(canon.startswith("akia"), F.concat(F.lit("akia"), _classed(canon.substr(F.lit(5), F.lit(64)), h))).otherwise(hexed))
            .when(kind == "iban", F.concat(canon.substr(F.lit(1), F.lit(2)), _classed(canon.substr(F.lit(3), F.lit(64)), h)))
            .when(kind == "ip", F.concat_ws(".", (F.lit(240) + F.pmod(_byte(h, 0), F.lit(16))).cast("string"), *[_byte(h, i).cast("string") for i in (1, 2, 3)]))
            .when(kind == "ip6", ip6)
            .when(kind == "phone", F.concat(country, F.lit("-"), _classed(rest, h)))
            .when(kind == "ssn", F.concat(F.lit("9"), _classed(canon.substr(F.lit(2), F.lit(8)), h)))
            .when(kind == "card", card)
        )
        for who in _ENDING:
            out = out.when(kind == f"name_{who}", _syllabled(h, script, who, tries))
        return out

    return F.element_at(F.transform(F.array(h), made), 1)


def _rendered(kind: Column, value: Column, drawn: Column) -> Column:
    """The canonical surrogate in the format of this mention: separators and capitals as found."""
    signs = F.regexp_replace(drawn, "[^0-9A-Za-z]", "")
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.when(c.rlike("^[0-9A-Za-z]$"), F.struct((a["at"] + 1).alias("at"), F.concat(a["out"], signs.substr(a["at"], F.lit(1))).alias("out"))).otherwise(F.struct(a["at"].alias("at"), F.concat(a["out"], c).alias("out")))
    filled = F.aggregate(_chars(value), start, step, lambda a: a["out"])
    shown = F.when(kind.isin("phone", "ssn", "card", "iban"), filled).otherwise(drawn)
    capitals = kind.isin("email", "secret", "ip6") & (F.upper(value) == value) & (F.lower(value) != value)
    return F.when(capitals, F.upper(shown)).otherwise(shown)


def _name_units(value: Column) -> Column:
    """Of a titled name, its words after the title as (kind, canonical): given names by gender, then the family name."""
    title = F.regexp_replace(F.substring_index(value, " ", 1), r"\.$", "")
    gender = F.when(title.isin(*FEMALE_TITLES), "name_female").when(title.isin(*MALE_TITLES), "name_male").otherwise("name_neutral")
    words = F.slice(F.split(value, " "), 2, 8)
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "name_family").otherwise(gender).alias("kind"), F.lower(w).alias("canon")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _entity(value: Column) -> Column:
    """(value, kind, units) of a found string; units are (kind, canonical), several in a name and one in other kinds."""
    one = lambda k: F.array(F.struct(k.alias("kind"), _canonical(k, value).alias("canon")))
    units = lambda k: F.when(k == "name", _name_units(value)).otherwise(one(k))
    return _let(_kind(value), lambda k: F.struct(value.alias("value"), k.alias("kind"), units(k).alias("units")))


def _units(spans: Column) -> Column:
    """(kind, canonical) of all entities in an array of found strings."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda v: _entity(v)["units"])))


def _found(text: Column) -> Column:
    """All entities of a text as an array of strings; empty without any."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))), none)


def _surrogate(entity: Column, drawn: Column) -> Column:
    """What stands in the text for an entity: its title and words, or its one surrogate in the mention's format."""
    value = entity["value"]
    words = F.slice(F.split(value, " "), 2, 8)
    capitals = lambda w: (F.upper(w) == w) & (F.char_length(w) > 1)
    shown = F.transform(drawn, lambda d, i: F.when(capitals(F.get(words, i)), F.upper(d)).otherwise(d))
    name = F.concat_ws(" ", F.substring_index(value, " ", 1), F.array_join(shown, " "))
    return F.when(entity["kind"] == "name", name).otherwise(_rendered(entity["kind"], value, F.get(drawn, F.lit(0))))


def draw_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """Surrogates of distinct (kind, canon) rows: adds `drawn` and `tries`, the number of re-draws that it took.

    In every round, of the entities that drew one surrogate the first in order keeps it; a surrogate that is an entity
    of the corpus or that an earlier round gave is kept by none. The others draw again. Work after the first round
    is on colliding entities only. `drawn` is distinct within (kind) and never an entity of that kind. `parts` of the
    result are the written tables that it reads.
    """
    entities = written(entities.select("kind", "canon").distinct(), "pii-entities")
    settled: list[DataFrame] = []
    waiting = entities
    for tries in range(ROUNDS):
        drawn = waiting.select("kind", "canon", _drawn(F.col("kind"), F.col("canon"), F.lit(tries), secret).alias("drawn"))
        first = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        real = entities.select("kind", F.when(F.col("kind").startswith("name_"), F.initcap("canon")).otherwise(F.col("canon")).alias("drawn"))
        free = reduce(lambda a, b: a.join(b, ["kind", "drawn"], "left_anti"), [real, *[s.select("kind", "drawn") for s in settled]], first)
        kept = written(free.select("kind", "canon", "drawn", F.lit(tries).alias("tries")), "pii-drawn")
        settled.append(kept)
        old, waiting = waiting, written(waiting.join(kept, ["kind", "canon"], "left_anti"), "pii-waiting")
        if tries:
            discard(old)
        if waiting.isEmpty():
            discard(entities, waiting)
            out = reduce(DataFrame.unionByName, settled)
            out.parts = settled
            return out
    raise ValueError(f"entities still collide after {ROUNDS} draws: a format has too few values for its entities")


def replace_entities(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """`docs` with a struct column `surrogates`: text (rewritten), n_entities, and entities (kind, surrogate) in order.

    `secret` is the key: other keys give other surrogates. E-mail addresses keep the look of the local part and move to
    hosts below .example, one a domain; IPv4 addresses move to 240.0.0.0/4 and IPv6 ones to 2001:db8::/32; phone
    numbers keep country code and punctuation, card numbers their grouping and whether their check digit is right,
    IBANs their country; secrets stay hexadecimal; titled names keep title, gender and script, and family names are
    replaced the same way with any title and given name.

    A null text stays null with 0 entities; texts without entities come back as they are, and texts of any length are read
    in whole. A null key column, ties and order play no part: equal texts get equal results. An empty table gives no rows.
    A column called `surrogates` is replaced. Names are known by a title before them; names that never have one stay.
    Texts are not shuffled unless more than BROADCAST_TEXTS distinct texts hold an entity that had to be drawn again:
    the surrogate is a function of the entity, and only numbers of re-draws are joined, by the text's digest.
    """
    carried = [c for c in docs.columns if c.lower() != "surrogates"]
    src, again, digest = (free_name(docs, c) for c in ("pii_text", "pii_again", "pii_digest"))
    hinted = docs.select(F.col(text).alias("t")).where(F.col("t").rlike(_HINT))
    seen = hinted.select(F.explode(_units(_found(F.col("t")))).alias("u")).select("u.kind", "u.canon")
    drawn = draw_surrogates(seen, secret)
    redrawn = written(drawn.where("tries > 0").select("kind", "canon", "tries"), "pii-redrawn")
    discard(*drawn.parts)
    rows = docs.select(*carried, F.col(text).alias(src))
    none = F.create_map().cast("map<string,int>")
    if redrawn.isEmpty():
        rows = rows.withColumn(again, none)
        discard(redrawn)
    else:
        by_text = hinted.select(F.sha2("t", 256).alias(digest), F.explode(_units(_found(F.col("t")))).alias("u"))
        mine = by_text.select(digest, "u.kind", "u.canon").join(redrawn, ["kind", "canon"]).distinct()
        pairs = F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "tries"))
        by_text = written(mine.groupBy(digest).agg(F.map_from_entries(pairs).alias(again)), "pii-texts")
        discard(redrawn)
        rows = rows.withColumn(digest, F.when(F.col(src).rlike(_HINT), F.sha2(src, 256)))
        if by_text.count() <= BROADCAST_TEXTS:
            rows = rows.join(F.broadcast(by_text), digest, "left")
        else:
            bare = rows.where(F.col(digest).isNull()).withColumn(again, none)
            rows = rows.where(F.col(digest).isNotNull()).join(by_text, digest, "left").unionByName(bare)

    def drawn_of(units: Column) -> Column:
        tries = lambda u: F.coalesce(F.element_at(again, F.concat_ws("|", u["kind"], u["canon"])), F.lit(0))
        return F.transform(units, lambda u: _drawn(u["kind"], u["canon"], tries(u), secret))

    def replaced(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), _let(drawn_of(e["units"]), lambda d: _surrogate(e, d)).alias("surrogate"))

    def woven(made: Column) -> Column:
        gaps = F.split(src, _ALL, -1)
        parts = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(made, i)["surrogate"], F.lit(""))))
        shown = F.when(F.size(made) == 0, F.col(src)).otherwise(F.array_join(parts, ""))
        return F.struct(shown.alias("text"), F.size(made).cast("bigint").alias("n_entities"), made.alias("entities"))

    made = F.transform(_found(F.col(src)), lambda v: _let(_entity(v), replaced))
    return rows.select(*carried, _let(made, woven).alias("surrogates"))
