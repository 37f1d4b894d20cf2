"""Surrogates for personal data. DataFrame functions only.

Each detected entity gets a replacement of its type that depends on a key and the entity alone, so all mentions of an
entity, in any document, get the same one (coreference).

Digits and addresses: a keyed permutation of all values of the entity's format (its separators, prefix and number of
digits). Different originals so stay different, however many of a format's values occur, and none stays as it is; a
replacement may be a value that occurs elsewhere, which in a dense format can't be avoided. Card numbers with a valid
check digit get a valid one.

Names are replaced word by word, with title, gender, script, initials and capitals kept: first names of the fixed
lists by others of their list, other first names and surnames by syllables. A word has one replacement wherever it
stands, so "Mr Smith", "John Smith" and "Dr J. Smith" stay one family. E-mails get a name and a host under a reserved
domain. A check over all distinct words and e-mails finds replacements that two of them share, or that are themselves
one of them; those go to their next attempt, which has one syllable more, until none is left.

Names are found behind titles, by a first name of the lists, behind words that announce one, and before honorifics.
"""

from __future__ import annotations

import hashlib
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import cut, once

#: Titles by gender (n: any), first names by gender and script, letters of syllables, endings by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "госпожа", "г-жа", "Κυρία"),
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "господин", "г-н", "Κύριος", "Κύριε"),
    "n": ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Judge", "Senator", "Captain", "Доктор", "Профессор"),
}
FIRST = {
    ("f", "latin"): (
        "Alice Amelia Anna Barbara Camille Carmen Caroline Catherine Charlotte Clara Claire Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jane "
        "Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucy Maria Marie Mary Nora Olivia Patricia Sarah Sofia Sophie Susan Ursula"
    ).split(),
    ("m", "latin"): (
        "Adam Alexander Andrew Anthony Carlos Charles Christopher Daniel David Edward Felix Francisco Frank George Hans Henry Hugo Jack James Jean "
        "John José Juan Kevin Klaus Louis Luis Martin Matthew Michael Miguel Oscar Paul Peter Pierre Richard Robert Simon Thomas William"
    ).split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος".split(),
}
SYLLABLES = {"latin": ("bdfghklmnprstvwz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфхц", "аеиоу"), "greek": ("βγδζθκλμνπρστφχψ", "αειου"), "han": ("安宝晨达恩芳国海佳康立明宁平清荣书天文新", "")}
ENDINGS = {
    "latin": {"f": "a", "m": "o", "n": "en"},
    "cyrillic": {"f": "а", "m": "ан", "n": "ен"},
    "greek": {"f": "α", "m": "ος", "n": "ι"},
    "han": {"f": "", "m": "", "n": ""},
}
CAPITALS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
HONORIFICS = {"m": "先生", "f": "女士|小姐|太太"}
ANNOUNCED = ("my name is", "My name is", "name:", "Name:", "signed", "Signed", "signed by", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут")

_any = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
_INITIAL = r"\p{Lu}\."
_TITLE = _any({y for x in TITLES.values() for t in x for y in (t, t.upper())})
_GIVEN = _any({y for x in FIRST.values() for n in x for y in (n, n.upper())})
_HEAD = rf"(?:(?:{_TITLE})\.? )"
_NAME = (
    rf"(?<!\p{{L}})(?=[\p{{Lu}}г])(?:"
    rf"{_HEAD}{{1,3}}(?:(?:{_WORD}|{_INITIAL}) ){{0,2}}{_WORD}"
    rf"|(?:{_GIVEN})(?: (?:{_INITIAL}|{_WORD}))?+ {_WORD}"
    rf"|(?:{_GIVEN}) {_WORD}"
    rf"|(?<=(?:{_any(ANNOUNCED)}) )(?:{_WORD}|{_INITIAL})(?: (?:{_WORD}|{_INITIAL}))?+ {_WORD}"
    rf"|(?<=(?:{_any(ANNOUNCED)}) ){_WORD} {_WORD}"
    rf")"
)
_HAN = rf"[{HAN_SURNAMES}]\p{{IsHan}}{{0,2}}?(?:{'|'.join(HONORIFICS.values())})"
_DIGITS = (
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])"),
    ("card", r"(?<![\w])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|(?<!\w)\d{13,19}(?!\w)"),
)
#: Type and pattern, first one first. Nothing backtracks over more than a few dozen characters.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
TYPES = (("email", _EMAIL), *_DIGITS, ("name", f"{_NAME}|{_HAN}"))
#: All types, and those of texts without an @ or an honorific.
_LEAN = f"(?=[0-9+(])(?:{'|'.join(p for _, p in _DIGITS)})|{_NAME}"
ENTITY = f"{_EMAIL}|{_LEAN}|{_HAN}"
COLUMNS = tuple(name for name, _ in TYPES)
#: Private-use characters around entities; one that stands in a text itself is escaped.
_MARK, _BEGIN, _END, _SELF = "\ue000", "\ue000\ue001", "\ue000\ue002", "\ue000\ue003"


def type_of(entity: Column) -> Column:
    """The type whose pattern found the entity; what stands around it in the text is not asked for again."""
    out = F.lit("name")
    for name, p in reversed(_DIGITS):
        out = F.when(entity.rlike("^(?:" + p + ")$"), name).otherwise(out)
    return F.when(entity.contains("@"), "email").otherwise(out)


def _keyed(key: str, *parts: Column) -> Column:
    """Hex digits of a keyed hash: two nested SHA-256, each begun with the key."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts)), 256)
    return F.sha2(F.concat_ws("\x1f", F.lit(key), inner), 256)


def _permuted(left: Column, right: Column, left_size: Column, right_size: Column, key: str, salt: list[Column]) -> Column:
    """struct(l, r): the pair (left < left_size, right < right_size), permuted without a fixed point.

    A Feistel network p is keyed; the next pair after p(x) goes back through it. As "next" moves each pair, so does this.
    """
    hashed = lambda k, x, size: F.pmod(F.conv(F.substring(_keyed(key, F.lit(k), x, *salt), 1, 15), 16, 10).cast("long"), size)

    def turn(k: int, sign: int):
        if k % 2 == 0:
            return lambda s: F.struct(F.pmod(s["l"] + sign * hashed(k, s["r"], left_size), left_size).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * hashed(k, s["l"], right_size), right_size).alias("r"))

    after = lambda s: F.struct(F.pmod(s["l"] + (s["r"] + 1 == right_size).cast("long"), left_size).alias("l"), F.pmod(s["r"] + 1, right_size).alias("r"))
    state = F.struct(left.alias("l"), right.alias("r"))
    for step in [*(turn(k, 1) for k in range(4)), after, *(turn(k, -1) for k in reversed(range(4)))]:
        state = once(state, step)
    return state


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def _permuted_digits(digits: Column, key: str, salt: list[Column]) -> Column:
    half = F.floor(F.length(digits) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    bound = F.struct(digits.alias("d"), half.alias("a"), (F.length(digits) - half).alias("b"))

    def mixed(x: Column) -> Column:
        new = _permuted(_number(F.substr(x["d"], F.lit(1), x["a"])), _number(F.substr(x["d"], x["a"] + 1)), power(x["a"]), power(x["b"]), key, salt)
        return once(new, lambda s: F.concat(F.when(x["a"] > 0, F.lpad(s["l"].cast("string"), x["a"], "0")).otherwise(""), F.lpad(s["r"].cast("string"), x["b"], "0")))

    return once(bound, mixed)


def _check_digit(payload: Column) -> Column:
    """The digit that makes payload and digit pass Luhn's check."""
    doubled = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _filled(form: Column, digits: Column) -> Column:
    """form with its zeros replaced, one by one, by the digits."""
    begun = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    put = lambda s, c: F.when(c == "0", F.struct(F.concat(s["s"], F.substr(digits, s["i"], F.lit(1))).alias("s"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["i"].alias("i")))
    return F.aggregate(F.split(form, ""), begun, put, lambda s: s["s"])


def _digits(kind: Column, value: Column, key: str) -> Column:
    """Permutes the digits behind a country's prefix; all other characters stay where they are."""
    head = F.when(kind == "phone", F.regexp_extract(value, r"^(?:\+\d{1,3}(?=\D))?", 0)).otherwise("")

    def parted(h: Column) -> Column:
        rest = F.substr(value, F.length(h) + 1)
        return F.struct(h.alias("head"), F.regexp_replace(rest, r"\D", "").alias("d"), F.regexp_replace(rest, r"\d", "0").alias("form"))

    def replaced(x: Column) -> Column:
        salt = [kind, x["head"], x["form"]]
        payload = F.substr(x["d"], F.lit(1), F.length(x["d"]) - 1)
        checked = lambda p: F.concat(p, F.pmod(_check_digit(p) + F.right(x["d"], F.lit(1)).cast("int") - _check_digit(payload), F.lit(10)).cast("string"))
        new = once(_permuted_digits(F.when(kind == "card", payload).otherwise(x["d"]), key, salt), lambda p: F.when(kind == "card", checked(p)).otherwise(p))
        return F.concat(x["head"], once(new, lambda d: _filled(x["form"], d)))

    return once(once(head, parted), replaced)


def _address(value: Column, key: str) -> Column:
    octet = lambda k: F.element_at(F.split(value, r"\."), k).try_cast("long")
    size = F.lit(65536).cast("long")
    mixed = _permuted(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), size, size, key, [F.lit("ipv4")])
    return once(mixed, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))


def _email(value: Column, attempt: Column, key: str) -> Column:
    letters = F.translate(_keyed(key, F.lit("email"), value, attempt), "0123456789abcdef", "abcdefghijkmnpqr")
    return once(letters, lambda x: F.concat(F.substring(x, 1, 9), F.lit("."), F.translate(F.substring(x, 10, 2), "abcdefghijkmnpqr", "0123456789012345"), F.lit("@"), F.substring(x, 20, 6), F.lit(".example.net")))


def _cycle(values, key: str, salt: str) -> dict[str, str]:
    """A keyed permutation of a small list that moves each value: one cycle through all."""
    order = list(values)
    random.Random(hashlib.sha256(f"{key}\x1f{salt}".encode()).digest()).shuffle(order)
    return dict(zip(order, order[1:] + order[:1]))


def _lookup(table: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.str_to_map(F.lit(",".join(f"{k}={v}" for k, v in table.items())), F.lit(","), F.lit("=")), value)


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsHan}"), "han").when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _made(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A word of syllables. kind: last_n_<script> or first_<gender>_<script>. Each attempt has one syllable more."""
    code = _keyed(key, kind, value, attempt)
    size = F.when(kind.startswith("last"), 4).otherwise(3) + attempt

    def spelled(script: str, x: Column) -> Column:
        consonants, vowels = SYLLABLES[script]
        each = [c + v for c in consonants for v in vowels] if vowels else list(consonants)
        syllables = F.split(F.lit(",".join(each)), ",")
        n = size - 2 if script == "han" else size
        # four hex digits a syllable; behind the end of the hash, those of a hash of the hash
        at = lambda k: F.conv(F.substr(F.sha2(F.concat(x, F.floor(k / 15).cast("string")), 256), F.pmod(k, F.lit(15)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        word = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.element_at(syllables, F.pmod(at(k), F.lit(len(each))) + 1)), "")
        ending = F.lit("")
        for g, e in ENDINGS[script].items():
            ending = F.when(kind.startswith(f"first_{g}"), e).otherwise(ending)
        return F.initcap(F.concat(word, ending))

    return once(code, lambda x: reduce(lambda e, s: F.when(kind.endswith(s), spelled(s, x)).otherwise(e), SYLLABLES, F.lit(None).cast("string")))


def _words(name: Column) -> Column:
    """The words of a name: struct(kind, key, w) each; kind title, initial, list or one of _made's; key: what is equal for all mentions."""
    lists = {n: g for (g, _), names in FIRST.items() for n in names}
    listed = lambda w: _lookup(lists, w)
    head = F.regexp_extract(name, f"^{_HEAD}*", 0)
    of_head = F.lit("n")
    for g in ("m", "f"):
        of_head = F.when(head.rlike(rf"(?:^| )(?:{_any({y for t in TITLES[g] for y in (t, t.upper())})})\.? "), g).otherwise(of_head)

    def worded(h: Column) -> Column:
        rest = F.split(F.substr(name, F.length(h["head"]) + 1), " ")

        def one(w: Column, i: Column, n: Column) -> Column:
            tidy = F.initcap(F.lower(w))
            gender = F.coalesce(listed(tidy), h["gender"])
            kind = F.when(w.rlike(f"^{_INITIAL}$"), "initial").when(i == n - 1, F.concat(F.lit("last_n_"), _script(w))).when(listed(tidy).isNotNull(), "list").otherwise(F.concat_ws("_", F.lit("first"), gender, _script(w)))
            return F.struct(kind.alias("kind"), F.lower(w).alias("key"), w.alias("w"))

        words = once(rest, lambda r: F.transform(r, lambda w, i: one(w, i, F.size(r))))
        title = F.array(F.struct(F.lit("title").alias("kind"), F.lit("").alias("key"), F.rtrim(h["head"]).alias("w")))
        return F.when(h["head"] == "", words).otherwise(F.concat(title, words))

    honorific = F.regexp_extract(name, f"(?:{'|'.join(HONORIFICS.values())})$", 0)
    given = F.substr(name, F.lit(2), F.length(name) - 1 - F.length(honorific))
    of_honorific = F.when(honorific.rlike(HONORIFICS["m"]), "m").otherwise("f")
    part = lambda k, w: F.struct(k.alias("kind"), w.alias("key"), w.alias("w"))
    han = F.filter(F.array(part(F.lit("han"), F.left(name, F.lit(1))), part(F.concat_ws("_", F.lit("first"), of_honorific, F.lit("han")), given), part(F.lit("title"), honorific)), lambda x: x["w"] != "")
    return F.when(name.rlike(f"^{_HAN}$"), han).otherwise(once(F.struct(head.alias("head"), of_head.alias("gender")), worded))


def _word(x: Column, attempt, key: str) -> Column:
    """The replacement of a word; attempt: a function of (kind, key)."""
    moved = {n: m for (g, s), names in FIRST.items() for n, m in _cycle(names, key, f"{g}/{s}").items()}
    letters = {c + ".": d + "." for s, a in CAPITALS.items() for c, d in _cycle(a, key, s).items()}
    cased = lambda new: F.when((F.length(x["w"]) > 1) & (x["w"] == F.upper(x["w"])) & (x["w"] != F.lower(x["w"])), F.upper(new)).otherwise(new)
    return (
        F.when(x["kind"] == "title", x["w"])
        .when(x["kind"] == "initial", F.coalesce(_lookup(letters, x["w"]), F.lit("X.")))
        .when(x["kind"] == "list", cased(_lookup(moved, F.initcap(x["key"]))))
        .when(x["kind"] == "han", _lookup(_cycle(HAN_SURNAMES, key, "han"), x["w"]))
        .otherwise(cased(_made(x["kind"], x["key"], attempt(x["kind"], x["key"]), key)))
    )


def surrogate(kind: Column, value: Column, key: str, attempt) -> Column:
    words = F.transform(_words(value), lambda x: _word(x, attempt, key))
    name = once(words, lambda w: F.when(value.rlike(f"^{_HAN}$"), F.array_join(w, "")).otherwise(F.array_join(w, " ")))
    email = once(F.lower(value), lambda v: _email(v, attempt(F.lit("email"), v), key))
    return F.when(kind == "email", email).when(kind == "name", name).when(kind == "ipv4", _address(value, key)).otherwise(_digits(kind, value, key))


def _marked(text: Column) -> Column:
    """A text's pieces: all but the first are an entity, _END, and what follows it."""
    escaped = F.when(text.contains(_MARK), F.replace(text, F.lit(_MARK), F.lit(_SELF))).otherwise(text)
    wrap = lambda p: F.regexp_replace(escaped, p, f"{_BEGIN}$0{_END}")
    rare = reduce(lambda a, b: a | b, (text.contains(x) for x in ["@", *(h for x in HONORIFICS.values() for h in x.split("|"))]))
    return F.split(F.when(rare, wrap(ENTITY)).otherwise(wrap(_LEAN)), _BEGIN, -1)


def entities(text: Column) -> Column:
    """array(struct(kind, e, rest)): a text's entities, each with what follows it; the first has no entity."""

    def split(piece: Column, i: Column) -> Column:
        e = F.when(i > 0, F.substring_index(piece, _END, 1))
        return F.struct(F.when(i > 0, type_of(e)).alias("kind"), e.alias("e"), F.when(i > 0, F.substr(piece, F.length(e) + len(_END) + 1)).otherwise(piece).alias("rest"))

    return F.transform(_marked(text), split)


def checked_words(found: Column) -> Column:
    """The distinct (kind, key) of entities whose replacement has to be checked. Made distinct as strings, which are hashed: structs are compared pair by pair."""
    joined = lambda kind, k: F.concat_ws("\x1f", kind, k)
    words = lambda x: F.transform(F.filter(_words(x["e"]), lambda w: w["kind"].rlike("^(?:first|last)_")), lambda w: joined(w["kind"], w["key"]))
    named = F.filter(found, lambda x: x["kind"].isin("email", "name"))
    each = F.transform(named, lambda x: F.when(x["kind"] == "email", F.array(joined(F.lit("email"), F.lower(x["e"])))).otherwise(words(x)))
    return F.transform(F.array_distinct(F.flatten(each)), lambda s: F.struct(F.substring_index(s, "\x1f", 1).alias("kind"), F.substring_index(s, "\x1f", -1).alias("key")))


def later_attempts(rows: DataFrame, key: str) -> DataFrame:
    """(kind, key, attempt) of the words and e-mails whose first replacement clashes, from rows with a column `text`.

    Distinct ones only are shuffled. Each attempt is drawn from a larger set than the one before, so rounds end.
    """
    known = cut(rows.select(F.explode(checked_words(entities(F.col("text")))).alias("x")).select("x.*").distinct().withColumn("attempt", F.lit(0)))
    fixed = rows.sparkSession.createDataFrame([(n.lower(),) for names in FIRST.values() for n in names], "given string")
    while True:
        attempt = F.col("attempt")
        made = F.when(F.col("kind") == "email", _email(F.col("key"), attempt, key)).otherwise(_made(F.col("kind"), F.col("key"), attempt, key))
        given = cut(known.withColumn("given", F.lower(made)))
        # of the kinds that share a word, the same word may be replaced twice
        shared = given.groupBy("given").agg(F.min(F.struct("kind", "key")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        second = given.join(shared, "given").where(F.struct("kind", "key") != F.col("owner")).select("kind", "key")
        real = given.join(known.select(F.col("key").alias("given")).unionAll(fixed), "given", "left_semi").select("kind", "key")
        clash = cut(second.unionAll(real).distinct())
        if not clash.limit(1).count():
            return known.where("attempt > 0")
        known = cut(known.join(clash.withColumn("more", F.lit(1)), ["kind", "key"], "left").select("kind", "key", (attempt + F.coalesce("more", F.lit(0))).alias("attempt")))


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, text with replacements, and the number of entities of each type in COLUMNS.

    Null texts stay null, with no entities; texts without entities come back as they are. Repeated rows are rows like
    others. Extra columns are not read. An empty table gives no rows. Only where a replacement clashed do documents
    meet a table, by a hash of the text: that of the words with a later attempt.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    later = later_attempts(rows, key)
    if later.limit(1).count():
        rows = rows.withColumn("tid", F.xxhash64("text"))
        each = rows.select("tid", F.explode(checked_words(entities(F.col("text")))).alias("x")).select("tid", "x.*").distinct().join(later, ["kind", "key"])
        each = each.groupBy(F.col("tid").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "key"), "attempt"))).alias("later"))
        rows = rows.join(each, F.col("tid") == F.col("of"), "left").select("id", "text", "later")
        attempt = lambda kind, k: F.coalesce(F.try_element_at("later", F.concat_ws("\x1f", kind, k)), F.lit(0))
    else:
        attempt = lambda kind, k: F.lit(0)
    rows = rows.withColumn("x", entities(F.col("text")))
    new = F.transform("x", lambda x: F.when(x["e"].isNull(), x["rest"]).otherwise(F.concat(surrogate(x["kind"], x["e"], key, attempt), x["rest"])))
    text = F.array_join(new, "")
    text = F.when(F.col("text").contains(_MARK), F.replace(text, F.lit(_SELF), F.lit(_MARK))).otherwise(text)
    counts = [F.coalesce(F.size(F.filter("x", lambda x: x["kind"] == c)), F.lit(0)).cast("long").alias(f"n_{c}") for c in COLUMNS]  # noqa: B023
    return rows.select(F.col("id").alias(id_col), F.when(F.size("x") > 1, text).otherwise(F.col("text")).alias("text"), *counts)
