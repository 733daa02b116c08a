"""PII surrogates: detected entities become keyed replacements of the same type.

*Detection* is one alternation of patterns (:data:`PATTERNS`) over the whole
text: e-mail and IPv4 addresses, card, phone, social-security and IBAN numbers,
and person names after a title.

*Inventory.*  Every entity is split into parts with a canonical form (an e-mail
in lower case, a phone's last ten digits, a name's given names and surname), so
that two spellings of one entity share a part: coreference.  The distinct parts
form the inventory.

*Surrogates* come from SHA-256 of (key, kind, canonical form, attempt): same
kind, same shape (digit for digit, letter for letter, separators kept), same
country or brand prefix and a valid check digit where the original had one,
given names of the title's gender, names in the original's script.  An initial
becomes another letter, name particles stay.

*Collision check.*  A surrogate must differ from every other surrogate and every
original of its kind; the losers of a round draw again with the next attempt
(longer forms from the second on, so the space never runs out).  Distinct
entities therefore keep distinct surrogates.

Scale: DataFrame functions only.  Texts without an entity never leave their
scan task; for the others (text digest, entity) pairs are made distinct by a
map-side combined aggregate, so a group of copies counts once, and the joins
put the documents or pairs on the side that adaptive execution splits.

Defined results: a null text stays null, an empty one empty; repeated rows and
ties give equal replacements; an empty table gives an empty result; extra
columns are carried by :func:`replace` (``n_chars`` follows the new text).
Names without a title are not detected; behind a title every capitalised word,
initial and name particle up to the next other word belongs to the name, the last
being the surname.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.llm.frames import carry, restore
from haulspark.session import ensure_checkpoint_dir

MAX_ROUNDS = 20

TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "госпожа", "г-жа", "κυρία"),
    "u": ("Dr", "Prof", "Mx"),
}
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_PARTICLES = "(?:(?:de|del|della|di|da|das|do|dos|du|van|von|der|den|ter|ten|zu|zur|la|las|los|le|el|al|bin|ibn|af|av) ){0,3}+"
_INITIALS = r"(?:(?:\p{Lu}\.)++ ?|\p{Lu} )*+"
# a word of a name, none that starts another name or ends this one
_WORD = rf"(?!(?:{_ALL_TITLES}|Jr|Junior|II|III|IV)(?![\p{{L}}]))\p{{Lu}}[\p{{L}}'’-]++"
_NAME = rf"(?:{_INITIALS}{_PARTICLES}{_WORD}|\p{{Lu}}[\p{{L}}'’-]*+)(?: {_INITIALS}{_PARTICLES}{_WORD})*+"

# Each pattern starts at a token start and uses possessive runs: linear time on any text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w+])(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "name": rf"(?<![\w-])(?:(?:{_ALL_TITLES})\.? |M\. ){_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

GIVEN = {
    ("m", "latin"): ("Adrian", "Bruno", "Casper", "Daniel", "Emil", "Felix", "Gustav", "Henrik", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Pablo"),
    ("f", "latin"): ("Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irina", "Julia", "Katia", "Laura", "Maria", "Nora", "Olivia", "Paula"),
    ("u", "latin"): ("Alex", "Charlie", "Dominique", "Eden", "Jordan", "Jules", "Kim", "Lou", "Marion", "Noa", "Robin", "Sam", "Sascha", "Toni", "Val", "Yuki"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "София", "Юлия"),
    ("m", "greek"): ("Άγις", "Βίκτωρ", "Γιώργος", "Δήμος", "Ηλίας", "Θάνος", "Ιάσων", "Κώστας", "Λουκάς", "Μάρκος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Τάσος", "Φάνης"),
    ("f", "greek"): ("Άννα", "Βάσω", "Γωγώ", "Δανάη", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κλειώ", "Λήδα", "Μαρία", "Νίκη", "Όλγα", "Ράνια", "Σοφία"),
}
SYLLABLES = {
    "latin": ("bar", "den", "fer", "gol", "han", "kir", "lor", "mas", "ner", "pol", "ros", "san", "tel", "var", "win", "zel"),
    "cyrillic": ("бар", "ден", "фер", "гол", "хан", "кир", "лор", "мас", "нер", "пол", "рос", "сан", "тел", "вар", "вин", "зел"),
    "greek": ("βαρ", "δεν", "φερ", "γολ", "χαν", "κιρ", "λορ", "μας", "νερ", "πολ", "ρος", "σαν", "τελ", "ζαρ", "ξιν", "ψελ"),
}


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def entities(text: Column) -> Column:
    """Every match of a pattern.  All patterns need a digit, an ``@`` or a title,
    so the long alternation runs only on texts that have one."""
    maybe = text.rlike("[0-9@]") | text.rlike(rf"(?<![\w-])(?:{_ALL_TITLES}|M\.)\.? (?:{_PARTICLES})\p{{Lu}}")
    return F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def kind_of(raw: Column) -> Column:
    out = None
    for kind, pattern in reversed(list(PATTERNS.items())):
        hit = raw.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(kind)) if out is None else F.when(hit, F.lit(kind)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin"))


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*TITLES["f"]), "f").when(bare.isin(*TITLES["m"]) | (bare == "M"), "m").otherwise("u")


def _alnum(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9]", "")


def _pieces(raw: Column) -> Column:
    """The words of a name, each with the space behind it; initials may have none."""
    return F.split(raw, r"(?<= )|(?<=\p{Lu}\.)(?=\p{Lu})")


def _words(raw: Column) -> Column:
    return F.transform(_pieces(raw), lambda w: F.rtrim(w))


def _initial(word: Column, key: str) -> Column:
    """Another letter of the same script for an initial; other words as they are."""
    letter = F.substring(word, 1, 1)
    others = F.when(_script(word) == "cyrillic", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ").when(
        _script(word) == "greek", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    others = F.replace(others, letter, F.lit(""))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(key + "|initial|"), letter), 256), 1, 8), 16, 10).cast("long")
    other = F.substring(others, (drawn % F.length(others)).cast("int") + 1, F.lit(1))
    return F.when(word.rlike(r"^\p{Lu}(?:\.|$)"), F.concat(other, F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


def parts_of(raw: Column, kind: Column) -> Column:
    """array<struct(kind, value, at)>: what is replaced, in canonical form, and a name's word number."""
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    words = _words(raw)
    last = F.element_at(words, -1)
    script = _script(last)
    gender = F.when((script != "latin") & (_gender(words[0]) == "u"), F.lit("m")).otherwise(_gender(words[0]))

    def part(k: Column, v: Column, at: Column = F.lit(0)) -> Column:
        return F.struct(k.alias("kind"), v.alias("value"), at.alias("at"))

    def name(w: Column, i: Column) -> Column:
        """The last word is the surname; initials and particles have no part."""
        is_last = i == F.size(words) - 1
        given = F.concat(F.lit("given_"), gender, F.lit("_"), script)
        return F.when((i > 0) & (is_last | w.rlike(r"^\p{Lu}[\p{L}'’-]")),
                      part(F.when(is_last, F.concat(F.lit("surname_"), script)).otherwise(given), F.initcap(w), i))

    return (F.when(kind == "name", F.filter(F.transform(words, name), lambda x: x.isNotNull()))
            .when(kind == "phone", F.array(part(kind, F.when(F.length(digits) > 10, F.expr("right(regexp_replace(raw, '[^0-9]', ''), 10)")).otherwise(digits))))
            .when(kind == "email", F.array(part(kind, F.lower(raw))))
            .when(kind == "ip", F.array(part(kind, raw)))
            .otherwise(F.array(part(kind, _alnum(raw)))))


def _luhn_total(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(d == "", F.lit(0)).otherwise(
        F.when((n - i) % 2 == 0, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
        .otherwise(d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _surrogate(key: str, attempt: int) -> Column:
    """The surrogate of columns (kind, value); ``_hex`` and ``_digits`` hold the keyed stream."""
    kind, value, hex_, digits = F.col("kind"), F.col("value"), F.col("_hex"), F.col("_digits")
    nth = lambda s, i, n: F.substring(s, (i % n) + 1, F.lit(1))
    consonants = F.translate(hex_, "0123456789abcdef", "bcdfghjklmnprstv")

    def shaped(v: Column) -> Column:
        out = F.transform(F.split(v, ""), lambda c, i: F.when(c.rlike("[0-9]"), nth(digits, i, 60)).when(
            c.rlike("[a-z]"), nth(consonants, i, 64)).when(c.rlike("[A-Z]"), F.upper(nth(consonants, i, 64))).otherwise(c))
        return F.array_join(out, "")

    more = F.substring(hex_, 57, 4 * attempt) if attempt else F.lit("")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(shaped(local), more, F.lit("@h"), F.substring(F.sha2(F.concat(F.lit(key + "|domain|"), domain), 256), 1, 6),
                     F.lit(".example.net"))
    number = lambda at, n: F.conv(F.substring(hex_, at, n), 16, 10).cast("long")
    ip = F.concat_ws(".", (number(1, 4) % 16 + 240).cast("string"), (number(5, 4) % 256).cast("string"),
                     (number(9, 4) % 256).cast("string"), (number(13, 4) % 255).cast("string"))
    body = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(1), F.length(value) - 2))
    check = ((10 - _luhn_total(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    valid = _luhn_total(value) % 10 == 0
    card = F.concat(body, F.when(valid, check).otherwise(((check.cast("int") + 1 + number(20, 4) % 9) % 10).cast("string")))
    # the area code starts 2-9
    phone = F.concat((number(1, 4) % 8 + 2).cast("string"), F.substring(digits, F.lit(2), F.length(value) - 1))
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))  # 9xx: never issued
    iban = F.concat(F.substring(value, 1, 2), shaped(F.expr("substr(value, 3)")))

    def syllable(script: str, at: int) -> Column:
        return F.get(_lit_array(SYLLABLES[script]), (F.conv(F.substring(hex_, at, 1), 16, 10)).cast("int"))

    out = (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
           .when(kind == "ssn", ssn).when(kind == "iban", iban))
    for script in SYLLABLES:
        tail = [syllable(script, 10 + k) for k in range(2 * attempt)]
        out = out.when(kind == f"surname_{script}", F.initcap(F.concat(*[syllable(script, 1 + k) for k in range(3)], *tail)))
        for (gender, s), names in GIVEN.items():
            if s == script:
                pick = F.get(_lit_array(names), F.conv(F.substring(hex_, 1, 1), 16, 10).cast("int"))
                middle = F.initcap(F.concat(*tail)) if tail else None
                out = out.when(kind == f"given_{gender}_{script}", F.concat(pick, F.lit("-"), middle) if tail else pick)
    return out


def assign(inventory: DataFrame, key: str) -> DataFrame:
    """(kind, value) distinct -> (kind, value, surrogate), one-to-one within a kind."""
    ensure_checkpoint_dir(inventory.sparkSession)
    own = ("kind", "value")
    pending, done = inventory, None
    originals = inventory.select("kind", F.col("value").alias("surrogate"))
    for attempt in range(MAX_ROUNDS):
        hexed = pending.withColumn("_hex", F.sha2(F.concat_ws("|", F.lit(key), "kind", "value", F.lit(attempt)), 256))
        chunks = [F.lpad((F.conv(F.substring("_hex", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") % 10 ** 15).cast("string"), 15, "0")
                  for k in range(4)]
        drawn = hexed.withColumn("_digits", F.concat(*chunks)).select(*own, _surrogate(key, attempt).alias("surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        free = first.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.select(*own, "surrogate").checkpoint()
        done = won if done is None else done.unionByName(won)
        pending = pending.join(won.select(*own), list(own), "left_anti").checkpoint()
        if pending.isEmpty():
            return done
    raise ValueError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def _fill(raw: Column, value: Column, slots: str) -> Column:
    """``raw`` with its slot characters replaced, in order, by ``value``'s."""
    gaps = F.split(raw, slots, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(
        i < F.size(gaps) - 1, F.substring(value, i + 1, F.lit(1))).otherwise(F.lit("")))), "")


def mapping(raws: DataFrame, key: str) -> DataFrame:
    """(raw) distinct -> (raw, kind, replacement)."""
    ensure_checkpoint_dir(raws.sparkSession)
    raws = raws.withColumn("entity", kind_of(F.col("raw")))
    parts = raws.select("raw", "entity", F.explode(parts_of(F.col("raw"), F.col("entity"))).alias("part"))
    parts = parts.select("raw", "entity", "part.at", "part.kind", "part.value").checkpoint()
    known = assign(parts.select("kind", "value").distinct(), key)
    found = parts.join(known, ["kind", "value"])
    whole = found.groupBy("raw", "entity").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("s"))
    raw, entity = F.col("raw"), F.col("entity")
    one = F.get("s", F.lit(0))["surrogate"]
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    dialled = F.when(F.length(digits) > 10, F.concat(F.expr("left(regexp_replace(raw, '[^0-9]', ''), length(regexp_replace(raw, '[^0-9]', '')) - 10)"), one)).otherwise(one)
    at = F.map_from_entries("s")
    names = F.array_join(F.transform(_pieces(raw), lambda w, i: F.when(i == 0, w).otherwise(F.concat(
        F.coalesce(F.element_at(at, i), _initial(F.rtrim(w), key)), F.when(w.endswith(" "), " ").otherwise("")))), "")
    text = (F.when(entity.isin("email", "ip"), one).when(entity == "phone", _fill(raw, dialled, "[0-9]"))
            .when(entity == "name", names)
            .otherwise(_fill(raw, one, "[A-Za-z0-9]")))
    return whole.select("raw", entity.alias("kind"), text.alias("replacement"))


def _replaced(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """The carried input plus ``new_text`` and ``kinds`` (null: no entity)."""
    base = carry(docs, text=text_col)
    found = base.withColumn("ents", entities(F.col("text")))
    some = F.coalesce(F.size("ents") > 0, F.lit(False))
    clean = found.filter(~some).drop("ents").withColumns({
        "new_text": F.col("text"), "kinds": F.lit(None).cast("array<string>")})
    dirty = found.filter(some).withColumn("digest", F.sha2("text", 256))
    pairs = dirty.select("digest", F.explode(F.array_distinct("ents")).alias("raw")).distinct().checkpoint()
    known = mapping(pairs.select("raw").distinct(), key)
    by_text = pairs.join(known, "raw").groupBy("digest").agg(
        F.collect_list(F.struct("raw", "replacement", "kind")).alias("known"))
    hit = dirty.join(by_text, "digest", "left")
    table = F.map_from_entries(F.transform("known", lambda x: F.struct(x["raw"], x["replacement"])))
    kinds = F.map_from_entries(F.transform("known", lambda x: F.struct(x["raw"], x["kind"])))
    hit = hit.withColumns({"table": table, "kindmap": kinds, "gaps": F.split("text", ANY, -1)})
    text = F.array_join(F.transform("gaps", lambda g, i: F.concat(
        g, F.coalesce(F.element_at("table", F.get("ents", i)), F.get("ents", i), F.lit("")))), "")
    hit = hit.withColumns({"new_text": text, "kinds": F.transform("ents", lambda e: F.element_at("kindmap", e))})
    return clean.unionByName(hit.drop("ents", "digest", "known", "table", "kindmap", "gaps"))


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with their entities replaced; all columns kept."""
    names = docs.columns
    done = _replaced(docs, key, text_col)
    swap = {text_col: F.col("new_text")}
    if "n_chars" in names:
        at = F.col(f"_in{names.index('n_chars')}")
        swap["n_chars"] = F.when(F.col("kinds").isNull(), at).otherwise(F.length("new_text").cast(docs.schema["n_chars"].dataType))
    return restore(done, names, swap)


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (after replacement), n_entities, kinds (in text order)."""
    done = _replaced(docs, key, text_col)
    at = docs.columns.index(id_col)
    return done.select(F.col(f"_in{at}").alias("doc_id"), F.col("new_text").alias("text"),
                       F.coalesce(F.size("kinds"), F.lit(0)).alias("n_entities"),
                       F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
