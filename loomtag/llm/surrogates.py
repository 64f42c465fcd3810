r"""Personal data replaced by surrogates, in DataFrame expressions only.

One pattern finds e-mail addresses, telephone and card numbers, IPv4
addresses, IBANs, social security numbers, secrets and titled names; numbers
count as cards only with an issuer's prefix and a valid check digit, addresses
only with octets up to 255. Each distinct entity gets a surrogate of its kind,
derived by HMAC-SHA256 from a key: digits for digits, letters for letters of
the same case, with separators, country codes and top-level domains left in
place, and card and IBAN check digits made valid. First names and surnames are
entities of their own, so that a person named once in full and once by surname
stays one; they match the title's gender and the name's script (Latin, Greek,
Cyrillic or Armenian, the scripts that have titles' capitals). A name without a
title isn't found.

Surrogates are checked against each other and against all real entities. Of
those that clash one stays if it may, and only the others are derived anew,
until none clashes, so distinct entities stay distinct. Names and e-mail
addresses grow longer from try to try, so there is always room; other kinds may,
where 64 tries found no room, take the form of another real entity, but never
two the same. Equal entities, however they are written, get the same surrogate throughout, so
references hold.

Null and empty texts stay as they are; very long ones are rewritten whole. Rows
that repeat are rewritten alike. Other columns pass through whatever their
names, null keys among them. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: Titles by gender, and names by gender and script to draw from.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "г-жа", "κυρία"]}
FIRST = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sara", "Vera"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Семён", "Тимур", "Юрий"],
    ("m", "greek"): ["Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"],
    ("f", "greek"): ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("m", "armenian"): ["Արամ", "Գրիգոր", "Դավիթ", "Կարեն", "Հայկ", "Նարեկ", "Սուրեն", "Տիգրան"],
    ("f", "armenian"): ["Աննա", "Գայանե", "Լիլիթ", "Մարիամ", "Նարե", "Շուշան", "Սոնա", "Տաթև"],
    ("f", "cyrillic"): ["Алла", "Белла", "Вера", "Галина", "Дарья", "Ева", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"],
}
SYLLABLES = {
    "latin": ["ber", "dal", "fen", "gar", "hol", "kes", "lin", "mar", "nor", "pel", "ros", "sten", "tor", "val", "win", "zel"],
    "greek": ["βαλ", "γερ", "δαμ", "ζαν", "θεμ", "καρ", "λεν", "μιχ", "νικ", "παλ", "ριζ", "σαρ", "τερ", "φιλ", "χαρ", "ψαλ"],
    "armenian": ["բար", "գեղ", "դան", "զար", "թով", "լեռ", "կար", "հով", "մար", "նար", "շահ", "պար", "սար", "վար", "տեր", "քար"],
    "cyrillic": ["бел", "вер", "гор", "дол", "зим", "кор", "лес", "мор", "нов", "пол", "реч", "сол", "тих", "хол", "чер", "яр"],
}
ENDINGS = {("m", "latin"): "", ("f", "latin"): "", ("m", "cyrillic"): "ов", ("f", "cyrillic"): "ова", ("m", "greek"): "ης", ("f", "greek"): "η", ("m", "armenian"): "յան", ("f", "armenian"): "յան"}
#: The country calling codes of one and two digits; all others have three.
_COUNTRY = r"\+(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|\d{3})"
FIRST_SCRIPTS = tuple(SYLLABLES)

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
#: What each kind looks like; in a text the first that fits at a place counts.
SHAPES = {
    "email": r"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]+)*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?i:password|passwd|pwd|secret|token|api[_-]?key|access_key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_+/-]{8,}=*+|\b(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA|ASIA)[-_]?[A-Za-z0-9_-]{16,}|(?<![A-Za-z0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}(?![A-Za-z0-9])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "name": rf"(?<!\p{{L}}){_TITLE} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())
#: A text without any of these holds no entity.
_HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|api_key|api-key|apikey|access_key)|\b(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA|ASIA)[-_]?[A-Za-z0-9_-]{{16}}|[a-fA-F]{{32}}|(?<!\p{{L}}){_TITLE} \p{{Lu}}"
#: What is secret in a match: its end, without the word before it.
_VALUE = r"[A-Za-z0-9_+/-]{8,}=*\z"
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """Of a string of digits, the last one being the check digit."""
    c = F.reverse(_chars(digits))

    def add(acc: Column, x: Column) -> Column:
        d = x.cast("int") * F.when(acc["i"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + d - F.when(d > 9, 9).otherwise(0)).alias("s"))

    return F.aggregate(c, F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), add, lambda acc: acc["s"])


def kind_of(x: Column) -> Column:
    """The kind of a match, or null for one that turns out not to be personal."""
    whole = lambda k: x.rlike(rf"\A(?:{SHAPES[k]})\z")
    octets = F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)
    card = _digits(x).rlike(_ISSUER) & (luhn_sum(_digits(x)) % 10 == 0) & (F.length(_digits(x)).between(13, 19))
    numeric = x.rlike(r"\A[\d -]+\z")
    return (
        F.when(whole("email"), "email")
        .when(whole("name"), "name")
        .when(whole("ip"), F.when(octets, "ip"))
        .when(whole("ssn"), "ssn")
        .when(whole("phone"), "phone")
        .when(numeric & whole("card"), F.when(card, "card"))
        .when(whole("iban"), F.when(_mod97(x) == 1, "iban"))
        .otherwise("secret")
    )


def _mod97(x: Column) -> Column:
    """The remainder of an IBAN's number, 1 if it is valid."""
    c = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    c = _chars(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4))))
    value = lambda d: F.when(d.between("0", "9"), d.cast("int")).otherwise(F.ascii(d) - 55)
    return F.aggregate(c, F.lit(0), lambda r, d: (r * F.when(value(d) > 9, 100).otherwise(10) + value(d)) % 97)


def canonical(kind: Column, x: Column) -> Column:
    """What is equal for all ways to write one entity."""
    return (
        F.when(kind == "email", F.lower(x))
        .when(kind == "phone", F.regexp_replace(x, r"[^\d+]", ""))
        .when(kind.isin("card", "ssn"), _digits(x))
        .when(kind == "iban", F.replace(x, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_extract(x, _VALUE, 0))
        .otherwise(x)
    )


def entities(kind: Column, x: Column) -> Column:
    """The entities of one match, as an array of (kind, norm, part). Of a name these are the surname (part 0)
    and the first name (part 1); a first name has the title's gender, and so has a Cyrillic surname, by its ending."""
    gender = F.when(x.rlike(rf"\A(?:{'|'.join(TITLES['m'])})\.? "), "m").otherwise("f")
    names = F.split(F.regexp_replace(x, rf"\A{_TITLE} ", ""), " ")
    last = F.element_at(names, -1)
    one = lambda k, norm, part: F.struct(k.alias("kind"), norm.alias("norm"), F.lit(part).alias("part"))
    surname = one(F.lit("last"), F.concat(F.when(last.rlike(r"\p{IsCyrillic}"), gender).otherwise("-"), F.lit(" "), last), 0)
    first = one(F.lit("first"), F.concat(gender, F.lit(" "), F.get(names, 0)), 1)
    return F.when(kind == "name", F.when(F.size(names) > 1, F.array(surname, first)).otherwise(F.array(surname))).otherwise(F.array(one(kind, canonical(kind, x), 0)))


def _stream(key: str, *parts: Column) -> Column:
    """As many keyed hexadecimal digits as any surrogate needs, by position: HMAC-SHA256 of the parts."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    message = F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in secret)), message), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in secret)), F.unhex(inner)), 256)


def _number(stream: Column, i: Column) -> Column:
    """The i-th number of a stream, 0..65535; past its end it is mixed with the position."""
    at = (i % 15) * 4 + 1
    return (F.conv(F.substr(stream, at, F.lit(4)), 16, 10).cast("int") + i * (i % 15 + 7) * F.when(i >= 15, 1).otherwise(0)) % 65536


def _like(x: Column, stream: Column, hex_: Column) -> Column:
    """Every letter and digit for one of its class; in hexadecimal texts for a hexadecimal digit."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        pick = lambda s: F.substr(F.lit(s), n % len(s) + 1, F.lit(1))
        return F.when(c.between("0", "9"), pick(_DIGITS)).when(c.between("a", "z"), F.when(hex_, pick("abcdef")).otherwise(pick(_LOWER))).when(c.between("A", "Z"), F.when(hex_, pick("ABCDEF")).otherwise(pick(_UPPER))).otherwise(c)

    return F.array_join(F.transform(_chars(x), one), "")


def _pick(names: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), n % len(names))


def _name(norm: Column, attempt: Column, stream: Column, first: bool) -> Column:
    """A first name or surname of the script and gender of ``norm``; longer for later attempts."""
    gender, out = F.substr(norm, F.lit(1), F.lit(1)), F.lit(None).cast("string")
    for script in FIRST_SCRIPTS:
        for g in ("m", "f"):
            # from the third attempt on another part for every two attempts
            i = F.sequence(F.lit(1), F.floor(attempt / 2).cast("int") + (1 if first else 3))
            if first:
                made = F.array_join(F.transform(i, lambda k: _pick(FIRST[g, script], _number(stream, k))), "-")  # noqa: B023
            else:
                made = F.concat(F.initcap(F.array_join(F.transform(i, lambda k: _pick(SYLLABLES[script], _number(stream, k))), "")), F.lit(ENDINGS[g, script]))  # noqa: B023
            test = norm.rlike(rf"\p{{Is{script.capitalize()}}}") & ((gender == g) | ((gender == "-") & (g == "m")))
            out = F.when(test, made).otherwise(out)
    return out


def surrogate(kind: Column, norm: Column, attempt: Column, stream: Column) -> Column:
    """Of one canonical entity; a new one for each attempt, by its stream."""
    like = _like(norm, stream, norm.rlike(r"\A[0-9a-f]+\z|\A[0-9A-F]+\z"))
    n = F.length(norm)
    domain = F.concat(F.lit("."), F.substring_index(norm, ".", -1))
    more = _like(F.repeat(F.lit("a"), F.greatest(attempt - 2, F.lit(0))), F.reverse(stream), F.lit(False))
    email = F.concat(more, F.substr(like, F.lit(1), n - F.length(domain)), domain)
    country = F.length(F.regexp_extract(norm, _COUNTRY, 0))
    phone = F.concat(F.substr(norm, F.lit(1), country), F.substr(like, country + 1))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(like, F.lit(2), n - 2))
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    octet = lambda i: (_number(stream, F.lit(i)) % 254 + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    base = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lit("00"), F.substr(like, F.lit(5)))
    iban = F.concat(F.substr(base, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(base)).cast("string"), 2, "0"), F.substr(base, F.lit(5)))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "iban", iban)
        .when(kind == "last", _name(norm, attempt, stream, False)).when(kind == "first", _name(norm, attempt, stream, True)).otherwise(like)
    )


def dressed(kind: Column, raw: Column, made: Column, first: Column) -> Column:
    """A surrogate written as its entity was: separators, spaces, case and title. ``first``: of a first name."""

    def put(acc: Column, c: Column) -> Column:
        sep = F.when(kind == "iban", c == " ").otherwise(~c.between("0", "9"))
        return F.struct(F.when(sep, acc["i"]).otherwise(acc["i"] + 1).alias("i"), F.concat(acc["out"], F.when(sep, c).otherwise(F.substr(made, acc["i"], F.lit(1)))).alias("out"))

    plus = F.when((kind == "phone") & made.startswith("+"), 2).otherwise(1)
    spaced = F.aggregate(_chars(raw), F.struct(plus.alias("i"), F.lit("").alias("out")), put, lambda acc: acc["out"])
    longer = F.length(made) - F.length(raw)
    cased = F.array_join(F.transform(_chars(raw), lambda c, i: F.when(c.between("A", "Z"), F.upper(F.substr(made, longer + i + 1, F.lit(1)))).otherwise(F.substr(made, longer + i + 1, F.lit(1)))), "")
    titled = F.concat(F.regexp_extract(raw, rf"\A({_TITLE} )", 1), F.concat_ws(" ", first, made))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind == "email", F.concat(F.substr(made, F.lit(1), longer), cased)).when(kind == "name", titled).when(kind == "secret", F.concat(F.regexp_replace(raw, _VALUE, ""), made)).otherwise(made)


def distinct_surrogates(found: DataFrame, key: str, rounds: int = 200, broadcast_rows: int = 500_000) -> DataFrame:
    """``found(kind, norm)``, each once -> kind, norm, made: no two alike in a kind, and none a real entity. A
    name's surrogate is held against real names whatever their gender."""
    bare = lambda x: F.when(F.col("kind").isin("first", "last"), F.substr(x, F.lit(3))).otherwise(x)
    real = found.select("kind", bare(F.col("norm")).alias("made"))
    settled, pending = None, found
    for attempt in range(rounds):
        drawn = pending.withColumn("stream", _stream(key, F.col("kind"), F.col("norm"), F.lit(attempt)))
        tried = written(drawn.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), F.col("stream")).alias("made")), "surrogates")
        owner = tried.groupBy("kind", "made").agg(F.min("norm").alias("norm"))
        taken = real if attempt < 64 else real.where(F.col("kind").isin("first", "last", "email"))
        taken = taken if settled is None else taken.unionByName(settled.select("kind", "made"))
        if attempt and tried.count() <= broadcast_rows:  # few are left: only what they meet counts
            taken = taken.join(F.broadcast(tried.select("kind", "made").distinct()), ["kind", "made"], "left_semi")
        stays = written(owner.join(taken, ["kind", "made"], "left_anti").select("kind", "norm", "made"), "settled")
        settled = stays if settled is None else settled.unionByName(stays)
        pending = written(tried.join(stays.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm"), "pending")
        if pending.isEmpty():
            return settled
    raise RuntimeError("surrogates still clash: more entities of a kind than its format has values")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs``, ``text`` rewritten, and n_entities (long; with underscores if ``docs`` has one)."""
    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)  # so that no name can clash
    text = F.col(names[at])
    hint = F.coalesce(text.rlike(_HINT), F.lit(False))
    flagged = own.where(hint).select(*names, F.xxhash64(text).alias("key"))
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    each = flagged.select("key", F.explode(found).alias("raw")).distinct().withColumn("kind", kind_of(F.col("raw")))
    each = each.where(F.col("kind").isNotNull()).select("key", "raw", F.col("kind").alias("shape"), F.explode(entities(F.col("kind"), F.col("raw"))).alias("x"))
    each = written(each.select("key", "raw", "shape", "x.kind", "x.norm", "x.part"), "entities")
    made = distinct_surrogates(each.select("kind", "norm").distinct(), key)
    parts = each.join(made, ["kind", "norm"]).groupBy("key", "raw", "shape")
    put = parts.agg(F.max(F.when(F.col("part") == 0, F.col("made"))).alias("made"), F.max(F.when(F.col("part") == 1, F.col("made"))).alias("first"))
    put = put.select("key", "raw", dressed(F.col("shape"), F.col("raw"), F.col("made"), F.col("first")).alias("new"))
    put = put.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("new"))
    touched = flagged.join(put, "key").select(*names, "new", found.alias("found"), F.split(text, PATTERN).alias("rest"))
    pieces = F.transform("found", lambda x, i: F.concat(F.get("rest", i), F.coalesce(F.try_element_at("new", x), x)))
    whole = F.concat(F.array_join(pieces, ""), F.get("rest", F.size("found")))
    n = F.size(F.filter("found", lambda x: F.try_element_at("new", x).isNotNull())).cast("long").alias("n_entities")
    changed = touched.select(*[whole.alias(c) if c == names[at] else F.col(c) for c in names], n)
    none = F.lit(0).cast("long").alias("n_entities")
    untouched = flagged.join(put, "key", "left_anti").select(*names, none)
    out = changed.unionByName(untouched).unionByName(own.where(~hint).select(*names, none))
    return out.toDF(*docs.columns, unused("n_entities", docs))
