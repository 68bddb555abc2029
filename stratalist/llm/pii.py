"""Operator 10 [native]: surrogates for personal data.

Entities (e-mail addresses, telephone, card and social security numbers, IBANs, IP addresses, access keys, secrets and titled person names) are found
by patterns. Each distinct entity gets a surrogate from SHA-256 of a secret key, its type and its canonical form: digits
stay digits, letters keep their case and script, separators stay, card numbers stay Luhn-valid and IBANs keep valid check digits, IP octets stay in range,
person names keep the gender that their title tells. The same entity has the same surrogate in every document, however it is written: an e-mail in
any case, a number with any separators, a secret after any label. A person's given name and surname have a surrogate each, so a person is the same
under any title and with or without the given name; in a text that names a person by title, later mentions of either name without
one are replaced too. Surrogates that
collide with another surrogate, or with an entity of the corpus, are drawn again with the next attempt number until none
does, over the whole corpus and without collecting any. Where a format has too few free forms, late attempts lengthen the surrogate.

A text is searched only if it holds what every match of some pattern needs (``NEEDS``). Texts without an entity are not shuffled; the others
meet their surrogates by row. The key is in no plan, and the tables that hold originals are deleted before the result is returned. A hot entity is one row in the table of distinct entities, combined before its shuffle, and skewed
joins are split at run time. Untitled names and postal addresses are not detected.

Defined results: a null text stays null; an empty one stays empty; repeated rows (same id, same text) give repeated rows;
ties between patterns go to the leftmost match, then to the first pattern listed; an empty table gives an empty result; other
columns are ignored by ``pseudonymize``.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import Scratch, materialize, table

#: The patterns, in order of precedence. None has a capturing group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|ghs)_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}\"?)[A-Za-z0-9_+/.-]{8,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "card": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b|\b3[47][0-9]{13}\b",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "person": r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Mx|Sir|Madam|Dr|Prof|Professor|Herr|Frau|Monsieur|Madame|Señora|Señor|Господин|Госпожа|Κύριος|Κυρία)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: In texts that name a person: capitalised words too, each of which may be one of the person's names.
ANY_OR_NAME = ANY + r"|(?<!\p{L})\p{Lu}\p{L}+"
#: What each match of a pattern contains. Together they are a cheap test of which texts to search; it excludes no match.
NEEDS = {
    "email": "@",
    "key": "AKIA|ASIA|ghp_|gho_|ghs_|sk-",
    "secret": "(?i:password|passwd|pwd|token|secret|api_?key)",
    "iban": "[0-9]",
    "phone": "[0-9]",
    "ssn": "[0-9]",
    "ip": "[0-9]",
    "card": "[0-9]",
    "ipv6": "[0-9A-Fa-f]:[0-9A-Fa-f]",
    "person": "Mr|Mrs|Ms|Miss|Mx|Sir|Madam|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Господин|Госпожа|Κύριος|Κυρία",
}
HINT = "|".join(dict.fromkeys(NEEDS.values()))

#: Given names by gender and script, and the syllables that surnames are made of.
GIVEN = {
    ("f", "latin"): "Alice Clara Diana Edith Flora Greta Hanna Irene Julia Karen Laura Maria Nadia Olive Paula Sonia".split(),
    ("m", "latin"): "Aaron Boris Colin David Edgar Felix Gavin Henry Isaac Jonas Kevin Lucas Mason Nolan Oscar Peter".split(),
    ("n", "latin"): "Alex Ariel Casey Chris Jamie Jordan Kim Morgan Noel Quinn Robin Sam Sasha Taylor Toni Val".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Олег".split(),
    ("n", "cyrillic"): "Валя Женя Никита Саша Слава Шура".split(),
    ("f", "greek"): "Άννα Ελένη Ζωή Ήρα Θάλεια Μαρία Νίκη Σοφία".split(),
    ("m", "greek"): "Άρης Γιώργος Δήμος Ηλίας Κώστας Λουκάς Νίκος Πέτρος".split(),
    ("n", "greek"): "Άγγελος Ειρήνη Φώτης Χάρη Χρυσή Ώρα".split(),
}
SYLLABLES = {
    "latin": "bal dor fen gar hol jan kel lin mor nar pol ren sal tor vin wes".split(),
    "cyrillic": "бал дор фен гар хол жан кел лин мор нар пол рен сал тор вин вес".split(),
    "greek": "βαλ δορ φεν γαρ χολ ζαν κελ λιν μορ ναρ πολ ρεν σαλ τορ βιν ξεσ".split(),
}
FEMALE = r"^(?:Mrs|Ms|Miss|Madam|Frau|Madame|Señora|Госпожа|Κυρία)(?!\p{L})"
NEITHER = r"^(?:Mx|Dr|Prof|Professor)(?!\p{L})"
#: Attempts after which each further one makes a surrogate one character longer.
LONGER_AFTER = 6


def type_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def canonical(entity: Column, kind: Column) -> Column:
    """What one and the same entity has in common however it is written."""
    digits = F.regexp_replace(entity, "[^0-9A-Za-z+]", "")
    value = F.regexp_replace(entity, SECRET_LABEL, "")
    person = F.concat(_gender(entity), F.lit("|"), F.regexp_replace(entity, r"^\S+ ", ""))
    out = F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "iban", "ssn"), digits)
    return out.when(kind == "ipv6", F.lower(entity)).when(kind == "secret", value).when(kind == "person", person).otherwise(entity)


#: What comes before the value of a secret.
SECRET_LABEL = r"^(?i:password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*\"?"


def _gender(entity: Column) -> Column:
    return F.when(entity.rlike(FEMALE), "f").when(entity.rlike(NEITHER), "n").otherwise("m")


def _draw(stream: Column, i: Column, n: int) -> Column:
    """A number below n from the i-th four hexadecimal digits of a keyed stream."""
    four = F.substr(F.get(stream, F.floor(i / 16).cast("int")), (F.pmod(i, F.lit(16)) * 4 + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(four, 16, 10).cast("int"), F.lit(n))


def _stream(seed: Column, count: Column) -> Column:
    """Hexadecimal digits for ``count`` draws: one hash for each sixteen."""
    return F.transform(F.sequence(F.lit(0), F.floor(count / 16).cast("int")), lambda i: F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256))


def _pick(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), at + 1, F.lit(1))


def _like(text: Column, seed: Column, upper: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", lower: str = "abcdefghijklmnopqrstuvwxyz", start: int = 0) -> Column:
    """Each digit a digit, each letter a letter of its case; all else, and the first ``start`` letters and digits, as they are.

    The letters and digits are drawn by their number among themselves, so separators don't matter, and laid between what separates them.
    """

    def drawn(stream: Column) -> Column:
        def new(c: Column, i: Column) -> Column:
            out = F.when(i < start, c).when(c.rlike("[0-9]"), _pick("0123456789", _draw(stream, i, 10)))
            return out.when(c.rlike("[A-Z]"), _pick(upper, _draw(stream, i, len(upper)))).otherwise(_pick(lower, _draw(stream, i, len(lower))))

        signs = F.transform(F.filter(F.split(F.regexp_replace(text, "[^0-9A-Za-z]", ""), ""), lambda c: c != ""), new)
        return F.array_join(F.zip_with(F.split(text, "[0-9A-Za-z]", -1), signs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(_stream(seed, F.length(text)), drawn)


def _luhn(number: Column) -> Column:
    """The number with its last digit set so that the Luhn sum is right."""
    chars = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(i == 0, F.lit(0)).otherwise(F.when(d > 9, d - 9).otherwise(d))

    total = F.aggregate(F.transform(chars, value), F.lit(0), lambda a, b: a + b)
    return F.concat(F.regexp_extract(number, "(?s)^(.*).$", 1), F.pmod(-total, F.lit(10)).cast("string"))


def _iban(number: Column) -> Column:
    """The number with its check digits set so that its remainder by 97 is 1."""
    plain = F.regexp_replace(number, "[^0-9A-Z]", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 2), F.lit("00"))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    check = F.lpad((F.lit(98) - F.aggregate(F.split(turned, ""), F.lit(0), step)).cast("string"), 2, "0")
    return F.concat(F.substring(number, 1, 2), check, F.substr(number, F.lit(5)))


def _name(word: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    """A given name of the gender in ``kind``, or a surname, in the word's script."""
    script = F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def drawn(stream: Column) -> Column:
        out = F.lit(None).cast("string")
        for (g, s), given in GIVEN.items():
            # Later attempts add syllables, so the names never run out.
            made = lambda n, s=s: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.array(*map(F.lit, SYLLABLES[s])), _draw(stream, i, 16))), "")
            first = F.get(F.array(*map(F.lit, given)), _draw(stream, F.lit(0), len(given)))
            first = F.when(attempt < 3, first).otherwise(F.concat(first, made(F.greatest(attempt - 2, F.lit(1)))))
            out = F.when((kind == GIVEN_NAME + g) & (script == s), first).when((kind == SURNAME) & (script == s), F.initcap(made(F.lit(4) + attempt))).otherwise(out)
        return out

    return let(_stream(seed, F.lit(5) + attempt), drawn)


#: Kinds of the parts of a person's name; a given name's has its gender after it.
GIVEN_NAME, SURNAME = "given ", "surname"


def surrogate(entity: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    def of(seed: Column) -> Column:
        more = F.substr(F.translate(F.sha2(seed, 256), "0123456789", "ghijklmnop"), F.lit(1), F.greatest(attempt - LONGER_AFTER, F.lit(0)))
        digits = F.translate(more, "abcdefghijklmnop", "0123456789012345")
        octets = F.transform(F.split(entity, r"\."), lambda _, i: (_draw(_stream(seed, F.lit(4)), i, 254) + 1).cast("string"))
        local, domain, top = (F.regexp_extract(entity, x, 1) for x in ("^([^@]*)", r"@(.*)\.[^.]*$", r"(\.[^.]*)$"))
        email = F.concat(_like(local, seed), more, F.lit("@"), _like(domain, F.concat(seed, F.lit("d"))), top)
        start = F.when(kind == "secret", F.regexp_extract(entity, f"({SECRET_LABEL})", 1)).otherwise(F.regexp_extract(entity, "^(AKIA|ASIA|gh[pos]_|sk-)", 1))
        rest = F.substr(entity, F.length(start) + 1)
        hexed = _like(rest, seed, upper="ABCDEF", lower="abcdef")
        secret = F.concat(start, F.when(rest.rlike("^[0-9a-f]+$"), hexed).otherwise(_like(rest, seed)), more)
        return (
            F.when(kind == "email", email)
            .when(kind.isin("key", "secret"), secret)
            .when(kind == "ip", F.concat(F.array_join(octets, "."), digits))
            .when(kind == "ipv6", F.concat(_like(entity, seed, upper="ABCDEF", lower="abcdef"), digits))
            .when(kind == "card", F.concat(_luhn(_like(entity, seed, start=1)), digits))
            .when(kind == "iban", F.concat(_iban(_like(entity, seed, start=2)), digits))
            .when(kind == "phone", F.concat(_like(entity, seed, start=1), digits))
            .when(kind.startswith(GIVEN_NAME) | (kind == SURNAME), _name(entity, kind, seed, attempt))
            .otherwise(F.concat(_like(entity, seed), digits))
        )

    return let(seed, of)


def distinct_surrogates(entities: DataFrame, key: str, scratch: Scratch | None = None) -> DataFrame:
    """entity, kind, surrogate for distinct (entity, kind, base).

    Settled rows keep their surrogate; of bases that drew the same one, the lowest keeps it and the rest draw again.
    """
    spark = entities.sparkSession
    scratch = scratch or Scratch(spark, "surrogates")
    # The key as a subquery's value, which no plan shows; only hashes with it are written.
    hidden = spark.createDataFrame([(key,)], "key string").scalar()
    seed = F.sha2(F.concat_ws("|", hidden, "kind", "base", F.col("attempt").cast("string")), 256)
    drawn_now = surrogate(F.col("entity"), F.col("kind"), F.col("seed"), F.col("attempt"))
    originals = entities.select(F.col("base").alias("taken")).distinct()
    # A collision is judged on canonical forms, one row for each base.
    bases = entities.groupBy("kind", "base").agg(F.min("entity").alias("entity")).withColumn("attempt", F.lit(0))
    # Few bytes, but much to compute: dealt over all tasks whatever their size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: scratch.keep(df.repartition(parts, "kind", "base").withColumn("seed", seed), "bases")
    bases = dealt(bases)
    while True:
        drawn = scratch.keep(bases.withColumn("drawn", canonical(drawn_now, F.col("kind"))), "drawn")
        # Settled rows win over those drawn anew, then the lowest base.
        first = drawn.groupBy("drawn").agg(F.min(F.struct(-F.col("attempt").alias("a"), "kind", "base")).alias("first"), F.count("*").alias("n")).where("n > 1")
        clash = drawn.join(first, "drawn").where((F.col("kind") != F.col("first.kind")) | (F.col("base") != F.col("first.base"))).select("kind", "base")
        clash = clash.unionByName(drawn.join(originals, F.col("drawn") == F.col("taken"), "left_semi").select("kind", "base")).distinct()
        clash = scratch.keep(clash.withColumn("again", F.lit(1)), "clash")
        if not clash.head(1):
            break
        bases = bases.join(clash, ["kind", "base"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again", "seed")
        bases = dealt(bases)
    own = entities.join(bases.select("kind", "base", "attempt", "seed"), ["kind", "base"])
    return own.select("entity", "kind", drawn_now.alias("surrogate"))


def found_entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _names(entities: DataFrame) -> DataFrame:
    """entity, title, and its parts (word, kind) for persons: the given name, if there is one, and the surname."""
    words = F.split(F.regexp_replace("entity", r"^\S+ ", ""), " ")
    part = lambda i, kind: F.struct(F.get(words, i).alias("word"), kind.alias("kind"))
    given, alone = part(F.lit(0), F.concat(F.lit(GIVEN_NAME), _gender(F.col("entity")))), part(F.lit(0), F.lit(SURNAME))
    parts = F.when(F.size(words) == 2, F.array(given, part(F.lit(1), F.lit(SURNAME)))).otherwise(F.array(alone))
    return entities.where("kind = 'person'").select("entity", F.regexp_extract("entity", r"^(\S+ )", 1).alias("title"), parts.alias("parts"))


def pseudonymize(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (the sorted types found), for each row."""
    scratch = Scratch(docs.sparkSession, "originals")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    # Only texts with an entity are written, with what was found; a number names the row, whatever its id.
    hits = rows.where(has).withColumn("person", text.rlike(PATTERNS["person"]))
    found = F.when(F.col("person"), F.regexp_extract_all(text, F.lit(ANY_OR_NAME), F.lit(0))).otherwise(found_entities(text))
    hits = scratch.keep(hits.withColumns({"found": found, "row": F.expr("uuid()")}), "found")
    each = hits.select("row", F.posexplode("found").alias("at", "entity"))
    entities = each.select("entity").distinct().withColumn("kind", type_of(F.col("entity"))).where("kind is not null")
    entities = scratch.keep(entities.withColumn("base", canonical(F.col("entity"), F.col("kind"))), "entities")
    names = scratch.keep(_names(entities), "names")
    words = names.select(F.explode("parts").alias("p")).select(F.col("p.word").alias("entity"), F.col("p.kind").alias("kind"), F.col("p.word").alias("base")).distinct()
    named = scratch.keep(distinct_surrogates(entities.where("kind <> 'person'").unionByName(words), key, scratch), "named")
    of_word = named.where(F.col("kind").startswith(GIVEN_NAME) | (F.col("kind") == SURNAME)).select(F.col("entity").alias("word"), F.col("kind").alias("part"), F.col("surrogate").alias("new_word"))
    parts = names.select("entity", "title", F.posexplode("parts").alias("i", "p")).select("entity", "title", "i", F.col("p.word").alias("word"), F.col("p.kind").alias("part")).join(of_word, ["word", "part"])
    persons = parts.groupBy("entity", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "new_word"))), lambda x: x["new_word"]), " ").alias("name"))
    persons = persons.select("entity", F.lit("person").alias("kind"), F.concat("title", "name").alias("surrogate"))
    kinds = persons.unionByName(entities.where("kind <> 'person'").select("entity", "kind").join(named, ["entity", "kind"]))
    # Later mentions: capitalised words that are part of a person's name in the same text.
    mentions = each.join(parts.select("entity", "word", "part", "new_word"), "entity").groupBy("row", F.col("word").alias("entity")).agg(F.min_by("new_word", "part").alias("mentioned"))
    each = each.join(kinds, "entity", "left").join(mentions, ["row", "entity"], "left")
    replaced = F.coalesce("surrogate", "mentioned")
    new = each.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce(replaced, "entity").alias("surrogate")))).alias("new"), F.count(replaced).cast("int").alias("n_entities"),
        F.sort_array(F.collect_set(F.coalesce("kind", F.when(F.col("mentioned").isNotNull(), "person")))).alias("kinds"),
    )
    between = F.when(F.col("person"), F.split(text, ANY_OR_NAME, -1)).otherwise(F.split(text, ANY, -1))
    done = hits.select("doc_id", "text", "person", "row").join(new, "row").withColumn("between", between)
    pieces = F.zip_with("between", F.transform("new", lambda x: x["surrogate"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    done = materialize(done.select("doc_id", F.array_join(pieces, "").alias("text"), "n_entities", "kinds"), "pseudonymized")
    scratch.clear()
    return done.unionByName(rows.where(~has).select("doc_id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds")))


#: The session's setting that holds the key; Spark redacts settings with such a name. Without it each run draws a key of its own.
KEY_SETTING = "spark.stratalist.pii.secret"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
