"""PII surrogates (operator 5): DataFrame functions only.

Detected entities get keyed replacements of their own type, format, script and gender. An entity is what its mentions have in
common: an address without its case, a number's digits, a person's names and gender. One entity has one surrogate in all
documents and formats (coreference), two entities never share one, and none is an entity that occurs (distinctness):
surrogates that collide are drawn again with the next attempt's number, from a larger space, until none does. None holds
what it stands for. Persons are found by a title; their names are then replaced wherever the same text repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Titles by gender, and first and family names by script that names are replaced with.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "κα"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κος"], "n": ["Dr", "Prof"]}
FIRST = {
    "latin f": "Alma Beate Carla Dora Elena Frieda Greta Helga Irene Julia Klara Lena Marta Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    "latin m": "Anton Bruno Carlos David Emil Felix Georg Hugo Ivo Jonas Karl Leo Martin Niko Oskar Paul Rafael Simon Tomas Victor".split(),
    "cyrillic f": "Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Раиса Софья Тамара Юлия".split(),
    "cyrillic m": "Антон Борис Виктор Григорий Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан".split(),
    "greek f": "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    "greek m": "Αλέξανδρος Βασίλης Γιάννης Δημήτρης Ευάγγελος Θανάσης Κώστας Λευτέρης Μιχάλης Νίκος Παύλος Σταύρος".split(),
}
LAST = {
    "latin f": "Adler Bauer Castillo Dietrich Engel Fischer Garnier Hoffmann Iglesias Jansen Keller Lambert Moreau Navarro Ortega Perrin Quast Richter Serrano Thomas Ullmann Vidal Weber Ximenes Zeller".split(),
    "cyrillic f": "Андреева Белова Волкова Громова Давыдова Егорова Жукова Зайцева Ильина Карпова Лебедева Морозова Назарова Орлова Павлова".split(),
    "cyrillic m": "Андреев Белов Волков Громов Давыдов Егоров Жуков Зайцев Ильин Карпов Лебедев Морозов Назаров Орлов Павлов".split(),
    "greek f": "Αγγελοπούλου Βλάχου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Λάμπρου Μακρή Νικολάου Οικονόμου Παππά Σταύρου".split(),
    "greek m": "Αγγελόπουλος Βλάχος Γεωργιάδης Δημητριάδης Ιωαννίδης Καραγιάννης Λάμπρος Μακρής Νικολαΐδης Οικονόμου Ράπτης Σταυρίδης".split(),
}
LAST["latin m"] = LAST["latin f"]
#: Letters by script that letters are replaced with, the lower and the upper ones; the last one stands for scripts not named.
ALPHABETS = [
    (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsHebrew}", "אבגדהוזחטילמנסעפצקרשת"), (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHan}", "天地山川日月星雲風雨花木金石火水春夏秋冬東西南北"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
]
#: Characters from which on a secret or address is named by its digest, and its surrogate doesn't follow its shape.
SHAPED = 1024
#: Family names that are added at most; attempt from which other types get longer, by one digit each.
FURTHER, WIDER = 12, 4
WORD, NO_DIGIT, NO_WORD = r"(?<![\p{L}\p{N}_])", r"(?![\p{N}])", r"(?![\p{L}\p{N}])"
TITLE = "|".join(t for ts in TITLES.values() for t in ts)
NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:[\-'’]\p{Lu}\p{Ll}+)?"
GROUPED = r"(?:[ .\-()/]{0,2}[0-9])"  # a digit after signs between groups
DATE = r"(?![0-3]?[0-9][.\-/][0-3]?[0-9][.\-/](?:19|20)[0-9]{2}(?![0-9]|[.\-/][0-9]))"
#: North American numbers; a country code with 7 to 14 digits; a leading 0 with as many; three groups without either;
#: a plus with digits in a row.
PHONES = [
    r"(?<![\p{L}\p{N}])\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}" + NO_DIGIT,
    r"(?<![\p{L}\p{N}])\+[0-9]" + GROUPED + "{7,16}" + NO_DIGIT,
    r"(?<![\p{L}\p{N}])(?<![0-9][.,:/\-])" + DATE + r"(?:\(0[0-9]{1,5}\)" + GROUPED + r"{4,11}|0[0-9]" + GROUPED + "{6,13})" + NO_DIGIT,
    r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{1,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-][0-9]{3,4}" + NO_DIGIT,
    r"\+[0-9]{8,15}" + NO_DIGIT,
]
HEXTET = "[0-9A-Fa-f]{1,4}"
#: Patterns by type, tried in this order at each place. A named person stands after a title. What repeats is bounded or never
#: given back, and starts at one place of a run of its signs, so that no text makes them recurse deeply or read it again and again.
PATTERNS = {
    "email": r"(?=[\p{L}\p{N}])(?<![\p{L}\p{N}])(?<=(?<![\p{L}\p{N}._%+\-])[._%+\-]{0,9})[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,127}[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "credential": r"(?i:(?:password|passwd|secret|token|api_?key) ?[=:] ?\"?)[A-Za-z0-9+/_\-]{8,}+",
    "access_key": WORD + r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?!\.?[\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9]|(?:[A-Fa-f]*:){{3}})(?:(?:{HEXTET}:){{7}}{HEXTET}|(?:{HEXTET}:){{1,6}}(?::{HEXTET}){{1,6}}|(?:{HEXTET}:){{1,7}}:|::(?:{HEXTET}:){{0,6}}{HEXTET})(?!:?[\p{{L}}\p{{N}}]|\.[0-9])",
    "iban": WORD + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\p{N}.\-])[0-9](?:[ \-]?[0-9]){12,18}" + NO_DIGIT,
    "national_id": r"(?<![\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}\-])",
    "phone": "|".join(PHONES),
    "person": WORD + rf"(?:{TITLE})\.?[ ]{NAME}(?: {NAME})?(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A line without any of these has no entity; most lines are told by this at once. No entity goes beyond its line.
FIRST_LETTERS = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
HINT = rf"[0-9@]|[:=] ?\"?[A-Za-z0-9+/_\-]{{8}}|:[A-Fa-f]{{0,4}}:|(?=[{FIRST_LETTERS}]){WORD}(?:{TITLE})\.? "
LABEL = r"(?i:(?:password|passwd|secret|token|api_?key) ?[=:] ?\"?)"
TITLED = rf"^((?:{TITLE})\.? )(.*)$"


def kind_of(value: Column) -> Column:
    """The first type whose pattern the whole value has."""
    return F.coalesce(*(F.when(value.rlike(rf"\A(?:{p})\z"), F.lit(k)) for k, p in PATTERNS.items()), F.lit("phone"))


def gender_of(value: Column) -> Column:
    """f or m by a person's title, else n."""
    title = F.regexp_replace(F.regexp_extract(value, TITLED, 1), r"\.? $", "")
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("n")


def entity_of(value: Column, kind: Column) -> Column:
    """What a mention's entity is called: equal for all its formats. A person's gender is added by persons()."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    digest = F.sha2(F.lower(value), 256)
    return (
        F.when((F.length(value) >= SHAPED) & (kind == "email"), F.concat(digest, F.lit("@x."), F.lower(F.substring_index(value, ".", -1)))).when((F.length(value) >= SHAPED) & (kind == "credential"), F.sha2(F.regexp_replace(value, "^" + LABEL, ""), 256))
        .when(kind.isin("phone", "card", "national_id"), digits).when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "iban", F.upper(F.replace(value, F.lit(" "), F.lit(""))))
        .when(kind == "credential", F.regexp_replace(value, "^" + LABEL, "")).when(kind == "person", F.regexp_extract(value, TITLED, 2)).otherwise(value)
    )


def stream(value: Column, kind: Column, attempt: Column, key: str, blocks: int = 4) -> Column:
    """256 keyed hex digits, from HMAC-like double hashing."""
    def block(i: int) -> Column:
        inner = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), F.lit(str(i)), value), 256)
        return F.sha2(F.concat(F.lit(f"{key}\x1e"), inner), 256)

    return F.concat(*(block(i) for i in range(blocks)))


def number(hex_: Column, at: int) -> Column:
    return F.conv(F.substring(hex_, at, 6), 16, 10).cast("int")


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def reformatted(value: Column, hex_: Column, hexadecimal: Column) -> Column:
    """Each digit becomes a digit (a leading 0 stays), each letter one of its script and case, other signs stay. hexadecimal: letters stay in a-f."""
    def of(c: Column, i: Column) -> Column:
        b = F.conv(F.substring(hex_, (i * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))
        found = F.when((i == 0) & (c == "0"), "0").when((i == 0) & c.rlike("[0-9]"), pick("123456789")).when(c.rlike(r"\p{N}"), pick("0123456789"))
        found = found.when(hexadecimal & c.rlike("[a-f]"), pick("abcdef")).when(hexadecimal & c.rlike("[A-F]"), pick("ABCDEF"))
        for pattern, letters in ALPHABETS:
            found = found.when(c.rlike(pattern), pick(letters))
        return found.otherwise(c)

    return F.array_join(F.transform(characters(value), of), "")


def luhn(digits: Column) -> Column:
    """The sum that is 0 modulo 10 for card numbers."""
    doubled = F.transform(characters(F.reverse(digits)), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10


def mod97(iban: Column) -> Column:
    """The remainder that is 1 for account numbers; letters count as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(characters(turned), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def pools(entity: Column, hex_: Column) -> Column:
    """Struct of the first and last names for "names|gender", of the gender and the names' script."""
    names, gender = F.substring_index(entity, "|", 1), F.substring_index(entity, "|", -1)
    script = F.when(names.rlike(r"\p{IsCyrillic}"), "cyrillic").when(names.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    female = F.when(gender == "n", F.conv(F.substring(hex_, 1, 1), 16, 10).cast("int") < 8).otherwise(gender == "f")
    every = {g: F.struct(F.array(*map(F.lit, FIRST[g])).alias("first"), F.array(*map(F.lit, LAST[g])).alias("last")) for g in FIRST}
    return F.try_element_at(F.create_map(*(x for g, v in every.items() for x in (F.lit(g), v))), F.concat(script, F.when(female, " f").otherwise(" m")))


def person(entity: Column, hex_: Column, attempt: Column) -> Column:
    """As many names as the entity has, from column pools. Each further attempt adds one more family name."""
    def of(pool: str, at: Column) -> Column:
        n = F.conv(F.substring(hex_, at, F.lit(6)), 16, 10).cast("int")
        return F.element_at(F.col("pools")[pool], n % F.size(F.col("pools")[pool]) + 1)

    last = F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(FURTHER))), lambda k: of("last", 9 + 7 * k)), "-")
    return F.when(F.substring_index(entity, "|", 1).contains(" "), F.concat_ws(" ", of("first", F.lit(2)), last)).otherwise(last)


def draw() -> Column:
    """The surrogate entity of columns entity, kind, attempt, hex and pools."""
    entity, kind, attempt, hex_ = F.col("entity"), F.col("kind"), F.col("attempt"), F.col("hex")
    no = F.lit(False)
    local = F.substring_index(entity, "@", 1)
    top = F.substring_index(entity, ".", -1)
    inner = F.substring(entity, F.length(local) + 2, F.length(entity) - F.length(local) - F.length(top) - 2)
    email = F.concat(reformatted(local, hex_, no), F.lit("@"), reformatted(inner, F.reverse(hex_), no), F.lit("."), top)
    octet = lambda at: (number(hex_, at) % 254 + 1).cast("string")
    card = reformatted(entity, hex_, no)
    zero = F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.lit("0"))
    card = F.when(luhn(entity) == 0, F.concat(F.substring(zero, F.lit(1), F.length(zero) - 1), ((10 - luhn(zero)) % 10).cast("string"))).otherwise(card)
    body = reformatted(F.substring(entity, F.lit(5), F.length(entity)), hex_, no)
    check = 98 - mod97(F.concat(F.substring(entity, 1, 2), F.lit("00"), body))
    iban = F.concat(F.substring(entity, 1, 2), F.when(mod97(entity) == 1, F.lpad(check.cast("string"), 2, "0")).otherwise(reformatted(F.substring(entity, 3, 2), F.reverse(hex_), no)), body)
    found = (
        F.when(kind == "email", email).when(kind == "credential", reformatted(entity, hex_, entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))).when(kind == "ip", F.concat_ws(".", *(octet(a) for a in (1, 8, 15, 22))))
        .when(kind == "ipv6", reformatted(entity, hex_, F.lit(True))).when(kind == "access_key", F.concat(F.lit("AKIA"), reformatted(F.substring(entity, 5, 16), hex_, no)))
        .when(kind == "iban", iban).when(kind == "card", card).when(kind == "person", person(entity, hex_, attempt)).otherwise(reformatted(entity, hex_, no))
    )
    more = F.translate(F.substring(F.reverse(hex_), F.lit(1), F.greatest(attempt - WIDER + 1, F.lit(1))), "abcdef", "123456")  # each attempt one digit
    tail = F.concat(F.when(found.endswith("::"), "").otherwise(":"), F.substring(hex_, 250, 4))
    wider = F.when(kind == "email", F.concat(more, found)).when(kind == "ipv6", F.concat(found, tail)).otherwise(F.concat(found, more))
    return F.when((attempt < WIDER) | kind.isin("person", "ip"), found).otherwise(wider)


def void() -> Column:
    """Whether a draw holds something of its entity: itself, one of a person's names, an address's local part or domain."""
    entity, drawn = F.col("entity"), F.col("surrogate")
    names = lambda c: F.split(F.regexp_replace(c, r"\|.$", ""), "[ \\-]")
    sides = lambda c: F.split(c, "@")
    kept = F.when(F.col("kind") == "person", F.arrays_overlap(names(entity), names(drawn))).when(F.col("kind") == "email", F.arrays_overlap(sides(entity), sides(drawn)))
    return drawn.contains(entity) | F.coalesce(kept, F.lit(False))


def one(value: Column) -> Column:
    """value, computed once a row however often it is used: a generator's output is not merged into what uses it."""
    return F.explode(F.array(value))


def assigned(entities: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities (kind, entity): no surrogate twice in a kind, none that is an entity.

    Each round draws for the entities that are left and writes one table; void draws don't count, and of several that drew the same the first
    in order of hash keeps it. known: such a table of earlier runs under the same key, whose surrogates stay.
    """
    both = ["kind", "entity"]
    entities = stored(entities.select(*both), "entities")
    taken = entities.select("kind", F.col("entity").alias("surrogate"))
    done = None
    if known is not None:
        done = stored(known.select(*both, "surrogate"), "known")
        taken, entities = taken.union(done.select("kind", F.col("entity"))), entities.join(done, both, "left_anti")
    taken = taken.distinct().withColumn("taken", F.lit(True))
    left, attempt = entities, 0
    while True:
        drawn = left.withColumn("attempt", F.lit(attempt)).withColumn("hex", one(stream(F.col("entity"), F.col("kind"), F.col("attempt"), key)))
        drawn = drawn.withColumn("pools", one(F.when(F.col("kind") == "person", pools(F.col("entity"), F.col("hex"))))).withColumn("surrogate", one(draw())).withColumn("void", void())
        turn = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("void", F.xxhash64("entity"), "entity"))
        found = drawn.select(*both, "surrogate", "void", turn.alias("turn")).join(taken, ["kind", "surrogate"], "left")
        if done is not None:
            found = found.join(done.select("kind", "surrogate", F.lit(True).alias("given")), ["kind", "surrogate"], "left")
        free = ~F.col("void") & (F.col("turn") == 1) & F.col("taken").isNull() & (F.lit(True) if done is None else F.col("given").isNull())
        found = stored(found.select(*both, "surrogate", free.alias("free")), "drawn")
        new = found.where("free").select(*both, "surrogate")
        done = new if done is None else done.unionByName(new)
        left = found.where("NOT free").select(*both)
        attempt += 1
        if left.isEmpty():
            return done


def rendered() -> Column:
    """The surrogate in the format of a mention: columns value, kind and surrogate."""
    value, kind = F.col("value"), F.col("kind")
    label = F.when(kind == "credential", F.regexp_extract(value, "^" + LABEL, 0)).when(kind == "person", F.regexp_extract(value, TITLED, 1)).otherwise("")
    shape = F.substring(value, F.length(label) + 1, F.length(value))
    signs = F.regexp_replace("surrogate", r"[^\p{L}\p{N}]", "")
    over = F.length(signs) - F.length(F.regexp_replace(shape, r"[^\p{L}\p{N}]", ""))
    front = F.when(kind == "email", over).otherwise(0)

    def step(a: Column, c: Column) -> Column:
        sign = F.substring(signs, a["at"], F.lit(1))
        cased = F.when(kind.isin("credential", "access_key"), sign).when(c != F.lower(c), F.upper(sign)).when(c != F.upper(c), F.lower(sign)).otherwise(sign)
        told = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(a["out"], F.when(told, cased).otherwise(c)).alias("out"), (a["at"] + told.cast("int")).alias("at"))

    walked = F.aggregate(characters(shape), F.struct(F.substring(signs, F.lit(1), front).alias("out"), (front + 1).cast("int").alias("at")), step, lambda a: F.concat(a["out"], F.substring(signs, a["at"], F.length(signs))))
    return F.when(kind.isin("ip", "ipv6", "person") | (F.length(value) >= SHAPED), F.concat(label, "surrogate")).otherwise(F.concat(label, walked))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(HINT))


def found_in(text: Column) -> Column:
    """The entities' mentions in a text in order of place."""
    return F.flatten(F.transform(lines(text), lambda line: F.regexp_extract_all(line, F.lit(f"({ANY})"), F.lit(0))))


def persons(mentions: DataFrame) -> DataFrame:
    """mentions (value, kind, entity) with "|gender" added to persons: names without a gendered title take the only gender that others give them."""
    own = mentions.where("kind = 'person'").withColumn("gender", gender_of(F.col("value")))
    known = own.groupBy("entity").agg(F.min(F.when(F.col("gender") != "n", F.col("gender"))).alias("known"))
    own = own.join(known, "entity").select("value", "kind", F.concat_ws("|", "entity", F.when(F.col("gender") != "n", F.col("gender")).otherwise(F.coalesce("known", F.lit("n")))).alias("entity"))
    return mentions.where("kind <> 'person'").select("value", "kind", "entity").unionByName(own)


def bare_names() -> Column:
    """A titled person's names as a text may repeat them without the title, with what stands for them: all, the last, the first."""
    names, new = F.regexp_extract("value", TITLED, 2), F.col("surrogate")
    pair = lambda a, b: F.struct(a.alias("name"), b.alias("new"))
    one = lambda c, at: F.substring_index(c, " ", at)
    every = F.array(pair(names, new), pair(one(names, -1), one(new, -1)), pair(one(names, 1), one(new, 1)))
    return F.when(F.col("kind") == "person", F.filter(every, lambda p: F.length(p["name"]) > 2)).otherwise(F.array().cast("array<struct<name:string,new:string>>"))


def replaced(documents: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Every row with its columns, text replaced, and n_entities long, entity_kinds array<string>.

    Null and empty texts stay, with no entities. Equal texts share one list of replacements, so a group of copies costs one
    list. Columns named n_entities or entity_kinds are overwritten; others stay as they are. Texts are taken whole. known:
    see assigned(); mapping() gives such a table.
    """
    keep = [c for c in documents.columns if c not in ("n_entities", "entity_kinds")]
    rows = documents.select(*keep)
    held = rows.withColumn("~values", found_in(F.col("text"))).where(F.size("~values") > 0)
    held = stored(held.withColumn("~a", F.xxhash64("text")).withColumn("~b", F.xxhash64("text", F.lit(1))), "held")  # 128 bits name a text
    listed = held.groupBy("~a", "~b").agg(F.first("~values").alias("~values"))
    listed = stored(listed.select("~a", "~b", F.posexplode("~values").alias("at", "value")), "mentions")
    mentions = stored(mapping(listed.select("value"), key, known).select("value", "kind", rendered().alias("new"), bare_names().alias("names")), "surrogates")
    given = listed.join(small(mentions), "value").groupBy("~a", "~b").agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind", "names"))).alias("~given"))
    found = held.drop("~values").join(stored(given, "given"), ["~a", "~b"])
    names = F.flatten(F.transform("~given", lambda g: g["names"]))
    found = found.withColumn("~names", F.array_sort(F.array_distinct(F.transform(names, lambda n: n["name"])), lambda a, b: F.length(b) - F.length(a))).withColumn("~pairs", F.array_distinct(names))
    pattern = F.concat(F.lit(WORD + "("), F.array_join("~names", "|"), F.lit(")" + NO_WORD))
    look = lambda name: F.element_at(F.filter("~pairs", lambda p: p["name"] == name), 1)["new"]
    between = F.split("text", ANY, -1)
    bare = F.transform(between, lambda p: F.struct(F.split(p, pattern, -1).alias("parts"), F.regexp_extract_all(p, pattern, F.lit(1)).alias("names")))
    joined = lambda parts, signs: F.array_join(F.zip_with(parts, signs, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    bare = F.transform(bare, lambda b: F.struct(joined(b["parts"], F.transform(b["names"], look)).alias("text"), F.size(b["names"]).alias("n")))
    plain = F.transform(between, lambda p: F.struct(p.alias("text"), F.lit(0).alias("n")))
    found = found.withColumn("~between", F.when(F.size("~names") > 0, bare).otherwise(plain))
    text = joined(F.transform("~between", lambda b: b["text"]), F.transform("~given", lambda g: g["new"]))
    n = F.size("~given") + F.aggregate("~between", F.lit(0), lambda a, b: a + b["n"])
    kinds = F.array_sort(F.array_distinct(F.transform("~given", lambda g: g["kind"])))
    changed = found.select(*(text.alias(c) if c == "text" else F.col(c) for c in keep), n.cast("long").alias("n_entities"), kinds.alias("entity_kinds"))
    none = ~F.coalesce(F.exists(lines(F.col("text")), lambda line: line.rlike(ANY)), F.lit(False))
    rest = rows.where(none).select(*keep, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_kinds"))
    return rest.unionByName(changed)


def mapping(values: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(value, kind, entity, surrogate) of distinct mentions (value)."""
    kinds = values.select("value").distinct().withColumn("kind", kind_of(F.col("value")))
    mentions = stored(persons(kinds.withColumn("entity", entity_of(F.col("value"), F.col("kind")))), "values")
    return mentions.join(assigned(mentions.select("kind", "entity").distinct(), key, known), ["kind", "entity"])
