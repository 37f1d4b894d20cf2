"""Planted random tokens of each encoding, bare and behind names and paths."""

import random
import string

from gneiss.llm import secrets
from tests.llm.test_texts import make

ALPHABETS = {"hex": string.digits + "abcdef", "HEX": string.digits + "ABCDEF", "base32": string.ascii_uppercase + "234567", "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_"}


def test_random_tokens_of_each_encoding(spark):
    r = random.Random(2)
    rows, want = [], {}
    for name, a in ALPHABETS.items():
        for n in (20, 32, 40, 64):
            for _ in range(12):
                t = "".join(r.choice(a) for _ in range(n))
                want.setdefault((name, n), []).append((len(rows), 4, 4 + n))
                rows.append(f"see {t} here")
    for front in ("AWS_KEY=", "sig=", "x/hook/T0/"):
        for _ in range(12):
            t = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
            want.setdefault(front, []).append((len(rows), len(front), len(front) + 40))
            rows.append(front + t + ("_a-b" if "/" in front else ""))
    plain = len(rows)
    rows += ["INTERNATIONALIZATION2 and getUserNameFromDatabase2 at src/Main/java/Handlers/Request_Handler"] * 5
    got = {x.doc_id: x for x in secrets.scan(make(spark, list(enumerate(rows)))).collect()}
    for what, spans in want.items():
        hit = sum(any(s.start <= end - 8 and begin + 8 <= s.end for s in [*got[i].base, *got[i].added]) for i, begin, end in spans)
        assert hit >= 9, (what, hit)
    assert not any(got[i].added for i in range(plain, len(rows)))
