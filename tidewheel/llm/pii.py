"""Personal data and secrets, replaced by keyed surrogates; DataFrame functions only.

Entities are found by one pattern. An entity's identity is its type and normal form (separators don't
count, nor does letter case but in secrets), so one entity has one surrogate all over the corpus.

Surrogates of numbers, addresses and secrets come from a keyed permutation: a Feistel network whose
rounds shift each character within its own alphabet (digits, small and capital letters of a script) by a
hash of the other half. It keeps the shape, so two entities can't get one surrogate; country codes, top
domains, issuer digits and separators stay (of e-mail addresses the letter case only if all are capitals), and check digits fit as well or as badly as before. Dates of
birth are shifted within two centuries. Names get syllables with the title's gender and the script; a
person is known by the name without its title, and once titled it is found in the same text without one.

A surrogate that is itself an entity of the corpus is made again with a higher attempt, in which names
have a syllable more for each word. If a shape is so full that after ROUNDS attempts some still clash, all
of its entities keep the permutation's first attempt: they stay distinct, and some equal another real one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import BROADCAST_BYTES, staged

#: Attempts in which clashes with real entities are looked for.
ROUNDS = 12

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,30}\.\p{L}{2,}"
SECRET_LEAD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
SECRET = r"(?<!\p{L})" + SECRET_LEAD + r"[^\s\"',;]{4,}"
CLOUD_KEY = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
PASSPORT_LEAD = r"(?i:passport)(?i: number| no\.?| nr\.?)?[ ]?[:#]?[ ]?"
PASSPORT = r"(?<!\p{L})" + PASSPORT_LEAD + r"[A-Z]{0,2}\d{6,9}(?![\p{L}\p{N}])"
BIRTH_LEAD = r"(?i:date of birth|born on|dob)[ ]?[:=]?[ ]?"
ISO_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
BIRTH = r"(?<!\p{L})" + BIRTH_LEAD + rf"(?:{ISO_DATE}|(?:0?[1-9]|[12]\d|3[01])[./](?:0?[1-9]|[12]\d|3[01])[./]\d{{4}})(?![\p{{L}}\p{{N}}])"
FEMALE, MALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|госпожа|Κυρία|κυρία", "Mr|Herr|Señor|Sr|Monsieur|Господин|господин|Κύριος|κύριος"
ANY_GENDER = "Dr|Prof"
TITLE = rf"(?:{FEMALE}|{MALE}|{ANY_GENDER})\.?[\x20\xA0]"
NAME = r"(?<!\p{L})" + TITLE + r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\p{{L}}\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}+])(?:\d[ -]?){12,18}\d(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\p{L}\p{N}.-])\+\d{7,15}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}-\d{4}(?![\p{L}\p{N}-])"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, CLOUD_KEY, PASSPORT, BIRTH, NAME, IP, SSN, IBAN, CARD, PHONE))
LEADS = {"secret": SECRET_LEAD, "passport": PASSPORT_LEAD, "birth": BIRTH_LEAD}
#: Country codes of telephone numbers: fixed values of one and two digits; all others have three.
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Alphabets within which characters are shifted.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρσςτυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: Dates of birth from 1900 to 2099 are shifted within so many days; other ones are permuted as digits.
DAYS = 73_049
#: Syllables of surrogate names by script, sixteen each; endings of male and female given names.
SYLLABLES = {
    "latin": ("bar", "del", "fen", "gol", "har", "jun", "kel", "lor", "mar", "nev", "pol", "ras", "sel", "tor", "vin", "zan"),
    "cyrillic": ("бар", "вел", "гор", "дан", "жан", "зол", "кир", "лав", "мир", "нев", "пол", "рад", "сел", "тов", "фед", "яр"),
    "greek": ("αλ", "βασ", "γερ", "δελ", "ζην", "θαλ", "καλ", "λεο", "μαρ", "νικ", "παν", "ραδ", "σελ", "τιμ", "φιλ", "χαρ"),
}
ENDINGS = {"latin": ("en", "a"), "cyrillic": ("ин", "ина"), "greek": ("ος", "α")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once and named once in the plan, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def with_mentions(docs: DataFrame, text: Column, pattern: str = "pattern", mentions: str = "m") -> DataFrame:
    """docs with the pattern of each text's entities and all mentions in order.

    A text without a digit, an at sign, a key's colon or equals sign, or a title has none, which a plain scan
    tells. Names that have a title are looked for without one in the same text, longer ones first.
    """
    some = text.rlike("[0-9@=:]") | text.rlike(TITLE)
    first = F.when(some, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    titled = lambda ms: F.filter(ms, lambda m: m.rlike("^" + TITLE) & ~m.rlike("[0-9@=:]"))
    names = lambda ms: F.reverse(F.array_sort(F.array_distinct(F.transform(titled(ms), lambda m: F.regexp_replace(m, "^" + TITLE, "")))))
    bare = lambda n: F.when(F.size(n) > 0, F.concat(F.lit(r"|(?<![\p{L}'-])(?:"), F.array_join(n, "|"), F.lit(r")(?![\p{L}'-])"))).otherwise("")
    again = lambda p, ms: F.when(p == "", ms).otherwise(F.regexp_extract_all(text, F.concat(F.lit(ENTITY), p), F.lit(0)))
    both = let(first, lambda ms: let(bare(names(ms)), lambda p: F.struct(p.alias("p"), again(p, ms).alias("m"))))  # each part is computed once
    found = docs.withColumn("_found", both)
    return found.withColumns({pattern: F.concat(F.lit(ENTITY), F.col("_found.p")), mentions: F.col("_found.m")}).drop("_found")


def kind_of(match: Column) -> Column:
    leads = F
    for kind, lead in LEADS.items():
        leads = leads.when(match.rlike("(?s)^" + lead), kind)
    return (
        leads.when(match.contains("@"), "email").when(match.rlike("^AKIA[0-9A-Z]{16}$"), "cloud_key").when(match.rlike("^" + TITLE) | ~match.rlike("[0-9]"), "name")
        .when(match.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip").when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(match.rlike("^[A-Z]{2}"), "iban")
        .when(match.rlike(r"^(?:\d[ -]?){12,18}\d$"), "card").otherwise("phone")
    )


def _lead(match: Column, kind: Column) -> Column:
    """What is before the value of a mention: the key of a secret, a name's title."""
    out = F.when(kind == "name", F.regexp_extract(match, "^" + TITLE, 0))
    for k, lead in LEADS.items():
        out = out.when(kind == k, F.regexp_extract(match, "(?s)^" + lead, 0))
    return out.otherwise("")


def identity(match: Column) -> Column:
    """Type and normal form (of a name, the script before it), as one string with line feeds between."""
    return let(kind_of(match), lambda kind: let(F.substr(match, F.length(_lead(match, kind)) + 1), lambda value: F.concat(kind, F.lit("\n"), _form(value, kind))))


def gender(match: Column) -> Column:
    """f or m by the title of a name, u if it tells neither, null for other mentions."""
    titled = lambda titles: match.rlike(rf"^(?:{titles})\.?[\x20\xA0]")
    return F.when(titled(FEMALE), "f").when(titled(MALE), "m").when(titled(ANY_GENDER), "u")


def _parts(date: Column) -> Column:
    """Year, month, day of a date as mentioned; the month comes second unless that can't be."""
    n = F.transform(F.split(date, "[-./]"), lambda x: x.cast("int"))
    return let(n, lambda x: F.when(x[0] > 31, x).when(x[1] > 12, F.array(x[2], x[0], x[1])).otherwise(F.array(x[2], x[1], x[0])))


def _form(value: Column, kind: Column) -> Column:
    def person(name: Column) -> Column:
        script = F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
        return F.concat_ws("\n", script, F.lower(name))

    digits = F.regexp_replace(value, r"\D", "")
    iso = lambda x: F.concat_ws("-", F.lpad(x[0].cast("string"), 4, "0"), F.lpad(x[1].cast("string"), 2, "0"), F.lpad(x[2].cast("string"), 2, "0"))
    return (
        F.when(kind == "email", F.lower(value)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "name", person(value)).when(kind == "birth", let(_parts(value), iso)).otherwise(value)
    )


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "(?!$)"))


def _stream(seed: Column, size: Column) -> Column:
    """Hexadecimal digits of a keyed hash, as many as asked for."""
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / 64).cast("int"))
    return F.substr(F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("\n", seed, i.cast("string")), 256)), ""), F.lit(1), size)


def _shifted(chars: Column, offsets: Column) -> Column:
    """Each character moved on within its alphabet by a hexadecimal number."""

    def one(c: Column, by: Column) -> Column:
        out = F
        for a in ALPHABETS:
            at = F.instr(F.lit(a), c)
            out = out.when(at > 0, F.substr(F.lit(a), (at - 1 + F.conv(by, 16, 10).cast("int")) % len(a) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.zip_with(chars, offsets, one)


def _feistel(text: Column, seed: Column) -> Column:
    """A keyed permutation of the texts of one shape: in four rounds the first half is shifted by a hash of the second, and they change places."""

    def turn(state: Column, r: Column) -> Column:
        size = F.size(state["a"])
        offsets = F.regexp_extract_all(_stream(F.concat_ws("\n", seed, r.cast("string"), F.array_join(state["b"], "")), size * 4), F.lit("[0-9a-f]{4}"), F.lit(0))
        return F.struct(state["b"].alias("a"), _shifted(state["a"], offsets).alias("b"))

    def halves(chars: Column) -> Column:
        n = F.floor(F.size(chars) / 2).cast("int")
        return F.struct(F.slice(chars, F.lit(1), n).alias("a"), F.slice(chars, n + 1, F.size(chars) - n).alias("b"))

    rounds = lambda chars: F.aggregate(F.sequence(F.lit(0), F.lit(3)), halves(chars), turn, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))
    return let(_chars(text), rounds)


def _luhn(digits: Column) -> Column:
    """The check digit for a number without it."""
    worth = F.transform(_chars(F.reverse(digits)), lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")))
    total = F.aggregate(worth, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("int")


def _iban_check(bank: Column, country: Column) -> Column:
    """The check number by remainder 97 for a country and the account without it."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(F.concat(bank, country, F.lit("00"))), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97)
    return F.lit(98) - rest


def surrogate(entity: Column, attempt: Column, key: str, female: Column | None = None) -> Column:
    """The surrogate of an identity, without the separators and letter case of one mention; names have a male ending if not female."""
    female = F.lit(False) if female is None else female
    fields = F.split(entity, "\n")
    return let(F.struct(fields[0].alias("kind"), fields[1].alias("form"), F.get(fields, F.lit(2)).alias("name"), F.concat_ws("\n", F.lit(key), fields[0], attempt.cast("string")).alias("seed"), attempt.alias("attempt"), female.alias("female")), _made)


def _made(x: Column) -> Column:
    """By type: names, addresses and dates; else the middle of the form is permuted, its beginning and end kept or computed."""
    kind, form, n = x["kind"], x["form"], F.length(x["form"])
    kept = (
        F.when(kind == "cloud_key", 4).when(kind == "iban", 4).when(kind == "card", 1)
        .when(kind == "phone", F.when(form.startswith("+"), F.length(F.regexp_extract(form, COUNTRY_CODE, 0))).otherwise(1)).otherwise(0)
    )
    tail = F.when(kind == "card", 1).when(kind == "email", F.length(F.regexp_extract(form, r"\.[^.]*$", 0))).otherwise(0)

    def shaped(k: Column) -> Column:
        head, middle, end = F.substr(form, F.lit(1), k["a"]), F.substr(form, k["a"] + 1, n - k["a"] - k["z"]), F.substr(form, n - k["z"] + 1)
        return let(F.struct(head.alias("head"), middle.alias("old"), _feistel(middle, x["seed"]).alias("new"), end.alias("end")), _joined)

    def _joined(p: Column) -> Column:
        luhn = (_luhn(F.concat(p["head"], p["new"])) + p["end"].cast("int") - _luhn(F.concat(p["head"], p["old"])) + 10) % 10
        country = F.substr(form, F.lit(1), F.lit(2))
        check = (_iban_check(p["new"], country) + F.substr(form, F.lit(3), F.lit(2)).cast("int") - _iban_check(p["old"], country) + 100) % 100
        return (
            F.when(kind == "card", F.concat(p["head"], p["new"], luhn.cast("string"))).when(kind == "iban", F.concat(country, F.lpad(check.cast("string"), 2, "0"), p["new"]))
            .otherwise(F.concat(p["head"], p["new"], p["end"]))
        )

    return (
        F.when(kind == "name", _name(x)).when(kind == "ip", _address(form, x["seed"])).when((kind == "birth") & form.rlike("^(?:19|20)") & F.try_to_date(form).isNotNull(), _birthday(form, x["seed"]))
        .otherwise(let(F.struct(kept.alias("a"), tail.alias("z")), shaped))
    )


def _birthday(form: Column, seed: Column) -> Column:
    start = F.lit("1900-01-01").cast("date")
    by = F.conv(F.substr(F.sha2(seed, 256), F.lit(1), F.lit(7)), 16, 10).cast("long") % 50_000 + 10_000
    return F.date_add(start, F.pmod(F.datediff(F.try_to_date(form), start) + by, F.lit(DAYS)).cast("int")).cast("string")


def _address(form: Column, seed: Column) -> Column:
    """A permutation of the four numbers; the first stays within 1 to 223, or outside."""

    def shift(value: Column, by: Column, first: bool) -> Column:
        plain = (value + by) % 256
        if not first:
            return plain
        rest = F.when(value == 0, 0).otherwise(value - 223)
        return F.when(value.between(1, 223), (value - 1 + by) % 223 + 1).otherwise(let((rest + by) % 33, lambda r: F.when(r == 0, 0).otherwise(r + 223)))

    def turn(v: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("\n", seed, r.cast("string"), v[2].cast("string"), v[3].cast("string")), 256)
        by = lambda i: F.conv(F.substr(digest, F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int")
        return F.array(v[2], v[3], F.when(r % 2 == 0, shift(v[0], by(0), True)).otherwise(shift(v[0], by(0), False)), shift(v[1], by(1), False))

    numbers = F.transform(F.split(form, r"\."), lambda v: v.cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), numbers, turn, lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), "."))


def _name(x: Column) -> Column:
    syllables = x["attempt"] + 3
    tables = F.create_map(*(y for script, table in SYLLABLES.items() for y in (F.lit(script), F.array(*map(F.lit, table)))))
    endings = F.create_map(*(y for script, (male, woman) in ENDINGS.items() for y in (F.lit(script), F.when(x["female"], woman).otherwise(male))))

    def words(y: Column) -> Column:
        def word(i: Column) -> Column:
            each = F.transform(_chars(F.substr(y["figures"], i * syllables + 1, syllables)), lambda d: F.get(y["table"], F.conv(d, 16, 10).cast("int")))
            return F.initcap(F.concat(F.array_join(each, ""), F.when(i == 0, endings[x["form"]]).otherwise("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), y["n"] - 1), word), " ")

    seed = F.concat_ws("\n", x["seed"], x["name"])
    return let(F.size(F.split(x["name"], " ")), lambda n: let(F.struct(n.alias("n"), tables[x["form"]].alias("table"), _stream(seed, n * syllables).alias("figures")), words))


def normal_of_surrogate(entity: Column, found: Column) -> Column:
    """The surrogate as the normal form that an entity of the same type would have."""
    lead = F.regexp_extract(entity, r"(?s)^(.*\n)", 1)
    return F.concat(lead, F.when(entity.startswith("name\n"), F.lower(found)).otherwise(found))


def shape(entity: Column) -> Column:
    """The entity with a mark for each character's alphabet in place of the character."""
    kind = F.split(entity, "\n")[0]
    form = F.substr(entity, F.length(kind) + 2)
    for a in ALPHABETS:
        form = F.translate(form, a, a[0] * len(a))
    return F.concat_ws("\n", kind, F.when(~kind.isin("name", "ip"), form))


def _fill(match: Column, digits: Column) -> Column:
    """The digits in the places of the mention's letters and digits, its separators kept."""
    gaps, each = F.split(match, "[0-9A-Z]", -1), _chars(digits)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(each, i), F.lit("")))), "")


def _cased(match: Column, found: Column) -> Column:
    """found, in capitals if all letters of the mention are."""
    return F.when((match == F.upper(match)) & (match != F.lower(match)), F.upper(found)).otherwise(found)


def _dated(value: Column, found: Column) -> Column:
    """An ISO date in the form of one mention."""

    def shown(x: Column) -> Column:
        wide = lambda n, old: F.when(F.length(old) > 1, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        mark, old = F.regexp_extract(value, "[./]", 0), F.split(value, "[./]")
        first, second = F.when(old[1].cast("int") > 12, x[1]).otherwise(x[2]), F.when(old[1].cast("int") > 12, x[2]).otherwise(x[1])
        return F.concat(wide(first, old[0]), mark, wide(second, old[1]), mark, F.lpad(x[0].cast("string"), 4, "0"))

    return F.when(value.rlike("^\\d{4}"), found).otherwise(let(F.transform(F.split(found, "-"), lambda p: p.cast("int")), shown))


def dress(match: Column, found: Column) -> Column:
    """The surrogate in the form of one mention."""

    def one(x: Column) -> Column:
        value = F.substr(match, F.length(x["lead"]) + 1)
        body = (
            F.when(x["kind"] == "email", _cased(match, found)).when(x["kind"].isin("phone", "card", "ssn", "iban"), _fill(match, F.replace(found, F.lit("+"), F.lit(""))))
            .when(x["kind"] == "birth", _dated(value, found)).otherwise(found)
        )
        return F.concat(x["lead"], body)

    return let(kind_of(match), lambda kind: let(F.struct(kind.alias("kind"), _lead(match, kind).alias("lead")), one))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct identities of a corpus, one row each (entity), and whether mentions have female, male and other titles (f, m, u)."""
    found = with_mentions(docs.select(docs[text_col].alias("text")), F.col("text")).select(F.explode("m").alias("m"))
    each = found.select(identity(F.col("m")).alias("entity"), gender(F.col("m")).alias("gender"))
    return each.groupBy("entity").agg(*(F.coalesce(F.bool_or(F.col("gender") == g), F.lit(False)).alias(g) for g in "fmu"))


def attempts(known: DataFrame, key: str) -> DataFrame:
    """(entity, attempt) of the staged identities whose first surrogate isn't used; no two have one surrogate with these."""
    known = known.select("entity")
    state = known.withColumn("attempt", F.lit(0))
    made, woman = (normal_of_surrogate(F.col("entity"), surrogate(F.col("entity"), F.col("attempt"), key, F.lit(female))) for female in (False, True))
    for _ in range(ROUNDS):
        state = staged(state.withColumn("made", made).withColumn("other", F.when(F.col("entity").startswith("name\n"), woman)), "surrogates")
        shared = state.groupBy("made").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1").select("made", "first")
        shown = state.select("made", F.explode(F.array_compact(F.array("made", "other"))).alias("shown"))
        taken = shown.join(known.select(F.col("entity").alias("shown")), "shown", "left_semi").select("made", F.lit(None).cast("string").alias("first")).distinct()
        clash = staged(shared.join(taken, "made", "left_anti").unionByName(taken), "clashes")
        if clash.isEmpty():
            break
        joined = state.join(clash.withColumnRenamed("first", "keeper").withColumn("hit", F.lit(True)), "made", "left")
        moves = F.coalesce(F.col("hit") & ~F.col("entity").eqNullSafe(F.col("keeper")), F.lit(False))
        state = joined.select("entity", (F.col("attempt") + moves.cast("int")).alias("attempt"), moves.alias("moved"))
    else:  # shapes that are too full: all of their entities go back to the permutation
        state = staged(state.withColumn("shape", shape(F.col("entity"))), "surrogates")
        full = staged(state.where("moved").select("shape").distinct(), "full")
        state = state.join(full, "shape", "left_anti")
    return state.where("attempt > 0").select("entity", "attempt")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A staged table, marked for broadcast if the sum of its rows' sizes is within the limit."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with each detected entity of the text replaced, all columns as they are; count_col, if given, is added, or
    takes the place of a column of that name.

    A null text stays null and has no entities, an empty one stays empty; repeated rows are treated
    each and alike; rows with a null id are treated like others; an empty table gives an empty result.
    """
    known = staged(entities(docs, text_col), "entities")
    female = known.where("f and not m").select("entity", F.lit(True).alias("female"))
    how = F.struct(F.coalesce("attempt", F.lit(0)).alias("attempt"), F.coalesce("female", F.lit(False)).alias("female")).alias("how")
    moved = staged(attempts(known, key).join(female, "entity", "full").select("entity", how), "moved")
    columns = [c for c in docs.columns if c != count_col]
    plain = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(columns)))
    text = F.col(f"c{columns.index(text_col)}")
    again = F.create_map().cast("map<string,struct<attempt:int,female:boolean>>")
    if not moved.isEmpty():
        mentions = with_mentions(plain.select(text), text).select(F.xxhash64(text).alias("at"), F.explode(F.array_distinct(F.transform("m", identity))).alias("entity")).distinct()
        entries = mentions.join(_small(moved, F.octet_length("entity") + 48), "entity").groupBy("at")
        tables = staged(entries.agg(F.map_from_entries(F.collect_set(F.struct("entity", "how"))).alias("again"), F.sum(F.octet_length("entity") + 48).alias("bytes")), "attempts")
        plain = plain.withColumn("at", F.xxhash64(text)).join(_small(tables, F.col("bytes") + 64).drop("bytes"), "at", "left").drop("at")
        again = F.coalesce(F.col("again"), again)
    found = with_mentions(plain, text).withColumn("again", again)

    def swap(match: Column) -> Column:
        def made_by(x: Column) -> Column:
            told = F.coalesce(gender(match), F.lit("u"))
            return surrogate(x["entity"], F.coalesce(x["how"]["attempt"], F.lit(0)), key, F.coalesce((told == "f") | ((told == "u") & x["how"]["female"]), F.lit(False)))

        made = let(identity(match), lambda entity: let(F.struct(entity.alias("entity"), F.col("again")[entity].alias("how")), made_by))
        return let(made, lambda found: dress(match, found))

    new = F.transform("m", swap)
    joined = F.array_join(F.transform(F.split(text, F.col("pattern"), -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col("new"), i), F.lit("")))), "")
    out = found.withColumn("new", new).withColumn("out", F.when(F.size("m") > 0, joined).otherwise(text))
    shown = {c: (F.col("out") if c == text_col else F.col(f"c{i}")) for i, c in enumerate(columns)} | ({count_col: F.size("m")} if count_col else {})
    order = [*docs.columns, *([count_col] if count_col and count_col not in docs.columns else [])]
    return out.select(*(shown[c].alias(c) for c in order))
