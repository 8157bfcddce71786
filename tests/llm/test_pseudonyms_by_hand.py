"""Pseudonyms against networks written in plain Python, and texts that held the patterns' old bounds."""

import contextlib
import datetime
import io
import random
from hashlib import sha256, sha512

import pytest

from fathom.llm import pseudonyms, queries

KEY = "some key"
ROUNDS = 6


def digest(kind, r, half, size):
    return (sha512 if size == 512 else sha256)(f"{pseudonyms.KEY_MARK}{KEY}|{kind}|{r}|{half}".encode()).hexdigest()


def moved(half, by):
    out = ""
    for i, c in enumerate(half):
        first, n = next((a, n) for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)) if a <= c <= z)
        out += chr(ord(first) + (ord(c) - ord(first) + int(by[2 * (i % 64) : 2 * (i % 64) + 2], 16)) % n)
    return out


def characters(text, kind):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(1, ROUNDS + 1):
        a, b = b, moved(a, digest(kind, r, b, 512))
    return a + b


def numbers(a, b, m, n, kind):
    for r in range(1, ROUNDS + 1):
        if r % 2 == 0:
            a = (a + int(digest(kind, r, b, 256)[:12], 16)) % m
        else:
            b = (b + int(digest(kind, r, a, 256)[:12], 16)) % n
    return a, b


def filled(text, fresh, takes):
    fresh = iter(fresh)
    return "".join(next(fresh) if takes(c) else c for c in text)


def plain(c):
    return c.isascii() and c.isalnum()


def email(m):
    front, end = m[: m.rindex(".")], m[m.rindex(".") :]
    return filled(front, characters("".join(filter(plain, front)), "email"), plain) + end


def card(m):
    head = characters("".join(filter(str.isdigit, m))[:-1], "card")
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(head)))
    return filled(m, head + str(-total % 10), str.isdigit)


def ip(m):
    o = list(map(int, m.split(".")))
    a, b = numbers(256 * o[0] + o[1], 256 * o[2] + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def day(m, form="%Y-%m-%d"):
    first = datetime.date(1900, 1, 1)
    n = (datetime.datetime.strptime(m, form).date() - first).days
    a, b = numbers(n // 517, n % 517, 142, 517, "date")
    return (first + datetime.timedelta(days=517 * a + b)).strftime(form)


def ssn(m):
    areas = [x for x in range(1, 900) if x != 666]
    a, b = numbers(99 * areas.index(int(m[:3])) + int(m[4:6]) - 1, int(m[7:]) - 1, 898 * 99, 9999, "ssn")
    return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def phone(m):
    return m[:2] + filled(m[2:], characters("".join(filter(str.isdigit, m[2:])), "phone"), str.isdigit)


def run(spark, texts, key=KEY):
    rows = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).collect()
    return [(r.text, tuple(r[2:])) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_networks(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases = []
    for _ in range(40):
        cases.append((email, f"{rng.choice('aBc')}{digits(3)}.x_{rng.choice('qrs')}@mail{digits(2)}.example.org"))
        cases.append((ip, ".".join(str(rng.randrange(256)) for _ in range(4))))
        cases.append((day, str(datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(142 * 517)))))
        cases.append((ssn, f"{rng.choice([1, 665, 667, 899, rng.randint(1, 600)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"))
        cases.append((phone, f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"))
        body = digits(15)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        cases.append((card, body + str(-total % 10)))
    got = run(spark, [f"a {m} b" for _, m in cases])
    assert [t for t, _ in got] == [f"a {make(m)} b" for make, m in cases]
    assert all(sum(n) == 1 for _, n in got)


def test_days_that_no_month_has(spark):
    stay = ["30/02/2020", "2021-02-29", "31.04.1999", "1900-02-29", "2100/02/29"]
    assert run(spark, stay) == [(t, (0, 0, 0, 0, 0, 0)) for t in stay]
    go = ["2100-05-05", "2100-12-31", "1900-01-01", "29.02.2000"]
    for t, (fresh, n) in zip(go, run(spark, go)):
        assert fresh != t and n == (0, 0, 1, 0, 0, 0)


@pytest.mark.parametrize("n", [63, 64, 65, 66, 5000])
def test_long_addresses(spark, n):
    texts = [f"x {'a' * n}@host.org y", f"x a@{'b' * n}.org y", f"x a@b.{'c' * n} y", f"a@{'d.' * min(n, 126)}net", "to: m@пример.xn--p1ai", "m@host.xn--p1ai.", "see m@b.com. Then m@b.org, or m@b.com.9"]
    got = run(spark, texts)
    assert [c[0] for _, c in got] == [1, 1, 1, 1, 0, 1, 3]
    assert got[5][0] != texts[5] and got[5][0].endswith(".xn--p1ai.") and got[0][0].endswith(".org y")
    assert all(len(a) == len(t) for (a, _), t in zip(got, texts))


def test_long_texts(spark):
    rng = random.Random(6)
    texts = ["a@" * 500_000, "1234-" * 200_000, "a." * 500_000 + "@", "@" + "b." * 500_000, "9" * 1_000_000, "".join(rng.choice("ab.@- /") for _ in range(1_000_000))]
    assert [len(t) for t, _ in run(spark, texts)] == [len(t) for t in texts]


def test_the_key_is_hidden(spark):
    out = queries.op5_pseudonyms(spark, "/root/testdata/sf0.001")
    try:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            out.explain("formatted")
        assert queries.PSEUDONYM_KEY not in shown.getvalue()
    finally:
        spark.conf.unset("spark.sql.redaction.string.regex")
