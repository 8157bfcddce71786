"""Operator 5: format-preserving pseudonyms by keyed Feistel networks, in SQL expressions only.

Addresses, numbers and dates are found by patterns, validated, and replaced by another value of the same form: a
permutation keyed by a secret.  Equal values get equal pseudonyms in every document, different ones different
pseudonyms, and whoever holds the key can invert them.

* Mail addresses and phone numbers: the letters and digits are cut in two halves, and each round moves every
  character of one half within its class (digit, lower or upper case) by amounts hashed from the key and the other half.
* Card numbers, in one run or in groups (4-4-4-4, 4-6-5): all but the last digit go through the same network, and the
  last one is set so that the Luhn sum is right again.  Numbers whose sum is wrong are left.
* Social security numbers: the number among those with allowed parts (area not 000, 666 or 9xx, group not 00, serial not
  0000), as a pair below 88902 x 9999, goes through a network; others are left.
* IPv4 addresses: the two 16-bit halves are added to each other's hashes.
* Dates from 1900 to 2100: the day's number, as a pair below 142 x 517, goes through such a network; the result is a
  real date of these years in the same notation.  Two numbers and a year between slashes are day and month, or month and day where only
  that can be; of the latter, which have days from 13 on, each becomes another such date.  Digits that form no real date
  (30 February) are left and not counted.

A text is cut at the matches with one pattern, to which the valid card numbers in the text are added; no text is taken
apart row by row, and there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: What a key begins with in the plan, and the pattern that hides it there.
KEY_MARK, KEY_REDACTION = "pseudonym-key:", "pseudonym-key:[^|']*"
#: Days that dates are permuted in: all 142 x 517 from 1900-01-01 to 2100-12-31.
DAYS_A, DAYS_B, FIRST_DAY = 142, 517, "1900-01-01"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_MONTH, _DAY, _YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:19[0-9]{2}|20[0-9]{2}|2100)"
#: Kinds in the order in which they are tried.  The patterns have no group that captures, and what can be long is taken
#: without going back, so their time is linear; a domain has at most 127 parts by its standard.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}(?:xn--[A-Za-z0-9-]++|[A-Za-z]{2,}+)",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9./-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_YEAR}/{_MONTH}/{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_MONTH}/{_YEAR}|{_MONTH}/{_DAY}/{_YEAR})(?![0-9]|[./-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
}
#: What is found without looking at a check digit.
PATTERN = "|".join(p for name, p in PATTERNS.items() if name != "card")
NAMES = list(PATTERNS)
#: Areas, groups and serials of social security numbers.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999
#: Steps in which a date with a day from 13 on comes back to such a one.  0.39 of all dates aren't, so more are needed with a
#: probability of about 1e-26; such a date would end on a day below 13.
WALK = 64


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, kind: str, round_: str, half: str, size: int = 256) -> str:
    """Keyed digest of a half, in hex digits."""
    return f"sha2(concat({literal(key)}, '|', {kind}, '|', cast({round_} as string), '|', {half}), {size})"


def _number(digest: str) -> str:
    return f"cast(conv(substring({digest}, 1, 12), 16, 10) as bigint)"


def _shifted(half: str, digest: str) -> str:
    """Every character of a half moved within its class, by two hex digits of the digest (which has 128)."""
    by = "cast(conv(substring(h.d, 1 + 2 * (i % 64), 2), 16, 10) as int)"
    moved = " ".join(f"when c between '{a}' and '{z}' then chr({ord(a)} + (ascii(c) - {ord(a)} + {by}) % {n})" for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)))
    # the digest is bound once, as the only element of an array
    return f"element_at(transform(array(named_struct('d', {digest})), h -> array_join(transform(split({half}, ''), (c, i) -> case {moved} else c end), '')), 1)"


def permuted(text: str, key: str, kind: str) -> str:
    """SQL: letters and digits of a string without anything else, permuted within their classes."""
    half = "cast(length(t) div 2 as int)"
    start = f"named_struct('a', substring(t, 1, {half}), 'b', substring(t, {half} + 1))"
    step = f"named_struct('a', s.b, 'b', {_shifted('s.a', _hash(key, kind, 'r', 's.b', 512))})"
    return _bind(text, "t", f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> concat(s.a, s.b))")


def _paired(first: str, second: str, m: int, n: int, key: str, kind: str, done: str) -> str:
    """SQL: a pair of numbers below m and n, permuted; ``done`` makes the result of ``s.a`` and ``s.b``."""
    start = f"named_struct('a', cast({first} as bigint), 'b', cast({second} as bigint))"
    a = f"if(r % 2 = 0, pmod(s.a + {_number(_hash(key, kind, 'r', 'cast(s.b as string)'))}, {m}L), s.a)"
    b = f"if(r % 2 = 1, pmod(s.b + {_number(_hash(key, kind, 'r', 'cast(s.a as string)'))}, {n}L), s.b)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> named_struct('a', {a}, 'b', {b}), s -> {done})"


def _bind(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _filled(text: str, chars: str, fresh: str) -> str:
    """SQL: the characters of a class in a text replaced, in order, by those of ``fresh``."""
    before = f"length(regexp_replace(substring({text}, 1, i), '[^{chars}]', ''))"
    return f"array_join(transform(split({text}, ''), (c, i) -> if(c rlike '[{chars}]', substring({fresh}, 1 + {before}, 1), c)), '')"


def _in_place(text: str, chars: str, key: str, kind: str) -> str:
    only = f"regexp_replace({text}, '[^{chars}]', '')"
    return _bind(permuted(only, key, kind), "p", _filled(text, chars, "p"))


def _luhn_digit(digits: str) -> str:
    """SQL: the last digit that makes the Luhn sum of the digits and it divisible by ten."""
    value = "cast(c as int)"
    doubled = f"if({value} < 5, 2 * {value}, 2 * {value} - 9)"
    odd = "(i % 2) = ((length(q) - 1) % 2)"
    total = f"aggregate(transform(split(q, ''), (c, i) -> if({odd}, {doubled}, {value})), 0, (x, y) -> x + y)"
    return _bind(digits, "q", f"(10 - {total} % 10) % 10")


def email(m: str, key: str) -> str:
    """The part before the last dot; the top-level domain stays."""
    end = f"regexp_extract({m}, '[.][A-Za-z0-9-]+$', 0)"
    front = f"substring({m}, 1, length({m}) - length({end}))"
    return f"concat({_bind(front, 'f', _in_place('f', '0-9A-Za-z', key, literal('email')))}, {end})"


def phone(m: str, key: str) -> str:
    """All digits but a country code's."""
    code = f"regexp_extract({m}, '^[+](?:1|7|[0-9]{{1,2}})', 0)"
    rest = f"substring({m}, length({code}) + 1)"
    return f"concat({code}, {_bind(rest, 'f', _in_place('f', '0-9', key, literal('phone')))})"


def card(m: str, key: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    head = "substring(d, 1, length(d) - 1)"
    whole = _bind(permuted(head, key, literal("card")), "p", f"concat(p, cast({_luhn_digit('p')} as string))")
    return _bind(digits, "d", _bind(whole, "w", _filled(m, "0-9", "w")))


def ssn(m: str, key: str) -> str:
    """A pair of area and group, and of serials; all three have gaps that no number falls into."""
    area = f"cast(substring({m}, 1, 3) as int)"
    first = f"({area} - if({area} > 666, 2, 1)) * {SSN_GROUPS} + cast(substring({m}, 5, 2) as int) - 1"
    fresh = f"s.a div {SSN_GROUPS} + if(s.a div {SSN_GROUPS} >= 665, 2, 1)"
    padded = lambda x, n: f"lpad(cast({x} as string), {n}, '0')"
    done = f"concat({padded(fresh, 3)}, '-', {padded(f's.a % {SSN_GROUPS} + 1', 2)}, '-', {padded('s.b + 1', 4)})"
    return _paired(first, f"cast(substring({m}, 8) as int) - 1", SSN_AREAS * SSN_GROUPS, SSN_SERIALS, key, literal("ssn"), done)


def ip(m: str, key: str) -> str:
    octet = lambda k: f"cast(o[{k}] as bigint)"
    done = "concat_ws('.', cast(s.a div 256 as string), cast(s.a % 256 as string), cast(s.b div 256 as string), cast(s.b % 256 as string))"
    return _bind(f"split({m}, '[.]')", "o", _paired(f"256 * {octet(0)} + {octet(1)}", f"256 * {octet(2)} + {octet(3)}", 65536, 65536, key, literal("ip"), done))


def _month_first(m: str, key: str) -> str:
    """A date with a day from 13 on: permuted until it has such a day again, so its notation stays clear."""
    form, shown = "MM/dd/yyyy", f"date_add(date'{FIRST_DAY}', cast(n as int))"
    step = _paired(f"n div {DAYS_B}", f"n % {DAYS_B}", DAYS_A, DAYS_B, key, literal("month-first"), f"s.a * {DAYS_B} + s.b")
    walk = f"aggregate(sequence(1, {WALK}), cast(n as bigint), (n, w) -> if(w > 1 and day({shown}) > 12, n, {step}), n -> date_format({shown}, '{form}'))"
    known = f"if(n is null or n < 0 or n >= {DAYS_A * DAYS_B}, {m}, {walk})"
    return _bind(f"datediff(try_to_date({m}, '{form}'), date'{FIRST_DAY}')", "n", known)


def date(m: str, key: str) -> str:
    cases = []
    for form, like in (("yyyy-MM-dd", "____-__-__"), ("yyyy/MM/dd", "____/__/__"), ("dd.MM.yyyy", "__.__.____"), ("dd/MM/yyyy", "__/__/____")):
        shown = f"date_format(date_add(date'{FIRST_DAY}', cast(s.a * {DAYS_B} + s.b as int)), '{form}')"
        fresh = _paired(f"n div {DAYS_B}", f"n % {DAYS_B}", DAYS_A, DAYS_B, key, literal("date"), shown)
        known = f"if(n is null or n < 0 or n >= {DAYS_A * DAYS_B}, {m}, {fresh})"
        if form == "dd/MM/yyyy":
            cases.append(f"when {m} like '{like}' and substring({m}, 4, 2) > '12' then {_month_first(m, key)}")
        cases.append(f"when {m} like '{like}' then {_bind(f"datediff(try_to_date({m}, '{form}'), date'{FIRST_DAY}')", 'n', known)}")
    return f"case {' '.join(cases)} else {m} end"


def valid_card(m: str) -> str:
    """SQL: whether the last digit is the one that the others ask for."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return _bind(digits, "d", f"cast(substring(d, -1) as int) = {_luhn_digit('substring(d, 1, length(d) - 1)')}")


def valid_date(m: str) -> str:
    """SQL: whether there is such a day."""
    read = " ".join(f"when {m} like '{like}' then try_to_date({m}, '{form}')" for form, like in (("yyyy-MM-dd", "____-__-__"), ("yyyy/MM/dd", "____/__/__"), ("dd.MM.yyyy", "__.__.____")))
    return f"case {read} else coalesce(try_to_date({m}, 'dd/MM/yyyy'), try_to_date({m}, 'MM/dd/yyyy')) end is not null"


def kind_of(m: str) -> str:
    """SQL: number of the kind of a match; null for what has the form of a date but is none."""
    tests = " ".join(f"when {m} rlike {literal('^(?:' + p + ')$')} then {f'if({valid_date(m)}, {n}, null)' if name == 'date' else n}" for n, (name, p) in enumerate(PATTERNS.items()))
    return f"case {tests} end"


def pseudonym(m: str, k: str, key: str) -> str:
    made = {"email": email, "ip": ip, "date": date, "phone": phone, "ssn": ssn, "card": card}
    return f"case {k} {' '.join(f'when {n} then {made[name](m, key)}' for n, name in enumerate(NAMES))} else {m} end"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_email, n_ip, n_date, n_phone, n_ssn, n_card)`` of every document.

    ``text`` has the pseudonyms in the places of the values; counts are of values found (long).  Card numbers with a wrong
    Luhn sum are left and not counted, and so are social security numbers with parts that aren't allowed and days that no
    month has.  The key stands in the plan behind ``KEY_MARK``; a session that sets ``spark.sql.redaction.string.regex`` to
    ``KEY_REDACTION`` keeps it out of what ``explain`` and the user interface show.  A null text
    stays null with counts of 0; a text without a match stays as it is.  Repeated rows each give a row.
    """
    key, text = KEY_MARK + key, F.col("text")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at every place, since a number with a wrong sum may overlap one with a right sum
    cards = F.expr(f"array_distinct(filter(regexp_extract_all(text, {literal(f'(?=({PATTERNS["card"]}))')}, 1), m -> {valid_card('m')}))")
    picked = picked.withColumn("cards", F.when(text.rlike(PATTERNS["card"]), cards))
    pattern = f"concat({literal(PATTERN)}, if(coalesce(size(cards), 0) > 0, concat('|(?<![0-9A-Za-z])(?:', array_join(cards, '|'), ')(?![0-9A-Za-z])'), ''))"
    picked = picked.withColumn("pattern", F.expr(pattern))
    found = picked.withColumn("found", F.when(text.rlike(PATTERN) | (F.size("cards") > 0), F.expr("regexp_extract_all(text, pattern, 0)")))
    kinds = found.withColumn("kinds", F.expr(f"transform(found, m -> {kind_of('m')})"))
    fresh = f"zip_with(found, kinds, (m, k) -> {pseudonym('m', 'k', key)})"
    joined: Column = F.expr(f"if(found is null, text, array_join(zip_with(split(text, pattern, -1), {fresh}, (gap, value) -> concat(gap, coalesce(value, ''))), ''))")
    counts = [F.expr(f"cast(if(kinds is null, 0, size(filter(kinds, k -> k = {n}))) as bigint)").alias(f"n_{name}") for n, name in enumerate(NAMES)]
    return kinds.select(F.col("id").alias(id_col), joined.alias(text_col), *counts)
