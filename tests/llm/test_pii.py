"""Surrogates against what plain Python finds in the same texts."""

import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from gneiss.llm import pii
from tests.llm.test_texts import make

PATTERN = regex.compile(pii.ENTITY.replace(r"\p{IsHan}", r"\p{Han}"))


def replaced(old, new):
    """(entity, surrogate) of a text; what stands between the entities must have stayed."""
    at, pairs, end = 0, [], 0
    found = list(PATTERN.finditer(old))
    for m, after in zip(found, [*found[1:], None]):
        between = old[end : m.start()]
        assert new.startswith(between, at), (old, new)
        at += len(between)
        end = m.end()
        following = old[end : after.start() if after else len(old)]
        stop = new.index(following, at) if following and after else len(new) - len(following)
        pairs.append((m[0], new[at:stop]))
        at = stop
    assert new[at:] == old[end:]
    return pairs


def luhn(digits):
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def test_surrogates(spark):
    text = "Mr. John Smith met Mrs Smith at 10.1.2.3, mail Bob.X@a.com or bob.x@A.com; call +1 (555) 123-4567, 123-45-6789, 4111 1111 1111 1111, г-жа Анна Иванова"
    rows = [(1, text), (2, None), (3, ""), (4, "nothing here"), (1, text), (None, text), (5, " and  a@b.de "), (6, "x " * 300_000 + "a@b.de")]
    got = {x.doc_id: x for x in pii.pseudonymize(make(spark, rows), "k").collect()}
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing here"
    one = got[1]
    assert one.text == got[None].text
    assert [one[f"n_{c}"] for c in pii.COLUMNS] == [2, 1, 1, 1, 1, 3]
    for private in ("John", "Smith", "10.1.2.3", "bob", "Bob", "123-4567", "123-45-6789", "4111 1111", "Анна", "Иванова"):
        assert private not in one.text
    m = re.fullmatch(
        r"Mr\. (\w+) (\w+) met Mrs (\w+) at \d+\.\d+\.\d+\.\d+, mail (\S+) or (\S+); call \+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d\d-\d{4}, (\d{4} \d{4} \d{4} \d{4}), г-жа ([А-Яа-я]+) ([А-Яа-я]+)", one.text
    )
    assert m and m[1] in pii.FIRST["m", "latin"] and m[2] == m[3] and m[4] == m[5] and m[7] in pii.FIRST["f", "cyrillic"]
    assert luhn(m[6].replace(" ", ""))
    mail = got[6].text[600_000:]
    assert got[5].text == f" and  {mail} " and mail.endswith(".example.net")


def test_names_without_titles_and_in_other_scripts(spark):
    texts = ["John Smith was here", "Dr Alice Jones", "MR JOHN SMITH", "Prof. Dr. J. Smith", "my name is Zoltan Kovacs.", "请王伟先生来", "Κυρία Ελένη Παππά", "The Apache License of General Public", "Ms Zoltan Smith"]
    got = [x.text for x in pii.pseudonymize(make(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    john, smith = got[0].split()[:2]
    assert john in pii.FIRST["m", "latin"] and john != "John" and smith != "Smith"
    assert re.fullmatch(rf"Dr (?!Alice)({'|'.join(pii.FIRST['f', 'latin'])}) (?!Jones)[A-Z][a-z]+", got[1])
    assert got[2] == f"MR {john.upper()} {smith.upper()}"
    assert re.fullmatch(rf"Prof\. Dr\. (?!J)[A-Z]\. {smith}", got[3])
    assert re.fullmatch(r"my name is (?!Zoltan)[A-Z][a-z]+ (?!Kovacs)[A-Z][a-z]+\.", got[4])
    assert re.fullmatch(rf"请(?!王)[{pii.HAN_SURNAMES}].先生来", got[5])
    assert re.fullmatch(r"Κυρία (?!Ελένη)[Α-Ωα-ωά-ώΆ-Ώ]+ (?!Παππά)[Α-Ωα-ω]+", got[6])
    assert got[7] == texts[7]
    assert got[8].endswith(f"a {smith}")


def test_dense_formats_and_many_names(spark):
    """All values of a format, and more names than there are short surrogates: distinct, and none its own."""
    r = random.Random(4)
    rows = [(0, ", ".join(f"+1 {a:02} {b:02}" for a in range(100) for b in range(100)))]
    rows += [(1, ", ".join(f"10.{a}.{b}.7" for a in range(40) for b in range(40)))]
    rows += [(2 + k, f"Mr {a}{b}{c} Smith met Ms {c.upper()}{b}{a.lower()} {a}{c}{b}dson, 4{r.randrange(10**14):014}7") for k, (a, b, c) in enumerate((a, b, c) for a in "ABCDEFG" for b in "aeiou" for c in "lmnrst")]
    old = dict(rows)
    maps = {}
    for x in pii.pseudonymize(make(spark, rows), "k").collect():
        for e, s in replaced(old[x.doc_id], x.text):
            assert e != s and maps.setdefault(e, s) == s
    assert len(maps) == len(set(maps.values())) > 12_000
    assert {len(s) for e, s in maps.items() if e[0] == "+"} == {8} and {s for e, s in maps.items() if e[0] == "+"} == {e for e in maps if e[0] == "+"}
    smith = {s.split()[-1] for e, s in maps.items() if e.endswith("Smith")}
    assert len(smith) == 1 and smith != {"Smith"}
    cards = [(e, s) for e, s in maps.items() if e.isdigit()]
    assert len(cards) > 100 and all(luhn(e) == luhn(s) for e, s in cards)


def test_clashing_surrogates_get_another(spark, monkeypatch):
    real = pii._email
    monkeypatch.setattr(pii, "_email", lambda value, attempt, key: F.when(attempt == 0, F.lit("x@y.example.net")).otherwise(real(value, attempt, key)))
    got = pii.pseudonymize(make(spark, [(1, "a@b.com c@d.com"), (2, "c@d.com A@b.com"), (None, None), (None, "c@d.com")]), "k").where("text is not null").orderBy(F.col("doc_id").asc_nulls_last()).collect()
    a, c = got[0].text.split()
    assert a != c and got[1].text.split() == [c, a] and got[2].text == c


@pytest.mark.parametrize("key", ["a", "b"])
def test_another_key_gives_others(spark, key):
    rows = make(spark, [(1, "John Smith, 123-45-6789, a@b.de")])
    assert pii.pseudonymize(rows, key).first().text != pii.pseudonymize(rows, key + "x").first().text


def test_many_distinct_entities_in_one_text(spark):
    """The distinct words of a text are found in time linear in it: 40,000 e-mails, then 20,000 names, all different."""
    mails = [f"user{k}.x@host{k % 97}.org" for k in range(40_000)]
    names = [f"Mr Ab{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000 % 10]}{'op'[k // 10000]}" for k in range(20_000)]
    df = spark.createDataFrame([(1, " , ".join(mails)), (2, " , ".join(names))], "doc_id long, text string")
    began = time.monotonic()
    found = {x.doc_id: x for x in df.select("doc_id", F.size(pii.checked_words(pii.entities(F.col("text")))).alias("n")).collect()}
    assert (found[1].n, found[2].n) == (40_000, 20_000)
    assert time.monotonic() - began < 60
