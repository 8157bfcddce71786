"""Elements, comments, and texts of a megabyte that a lexer could go over again and again."""

import random
import time

import pytest

from fathom.llm import secrets

VALUE = "s3cr3T-Xy9Kq27LmP0"


def found(text):
    return [text[a:b] for a, k, b in secrets.all_spans(text)[1] if k == 3]


@pytest.mark.parametrize(
    "text, want",
    [
        (f"<auth_key>{VALUE}</auth_key>", [VALUE]),
        (f"<db:password type='x'>\n  {VALUE}\n</db:password>", [VALUE]),
        (f'<property name="db.password" value="{VALUE}"/>', [VALUE]),
        (f"<add key='signing_key'  value='{VALUE}' />", [VALUE]),
        (f"<name>{VALUE}</name>", []),
        (f"<auth_key>{VALUE}</other>", []),
        ("<password></password><password>changeme</password>", []),
        (f'db_passphrase /* of the store */ = "{VALUE}"', [VALUE]),
        (f'db_passphrase = # of the store\n  "{VALUE}"', [VALUE]),
        (f'db_passphrase = // of the store\n  "{VALUE}";', [VALUE]),
        (f'/* db_passphrase = "{VALUE}" */', [VALUE]),
        (f'# db_passphrase = "{VALUE}"', [VALUE]),
        (f"it's so: db_passphrase = \"{VALUE}\"", [VALUE]),
        (f"'\" db_passphrase = \"{VALUE}\"\nkey_salt = '{VALUE}'", [VALUE]),
        ("= x", []),
    ],
)
def test_forms(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text",
    [
        'x = "' + '\\"' * 500_000,
        "x = '" + "\\'\\\"" * 250_000,
        "token=" + "ab12cd" * 170_000,
        'password = "abc123xyz"\n' * 45_000,
        "f(" * 500_000,
        "<a>" * 333_000,
        "<a b" * 250_000,
        'name="' * 170_000,
        "/*" * 500_000,
        "a: |\n b: >\n" * 90_000,
        '"""' * 333_000,
        'x = """a"""\n' * 80_000,
        "[{(" * 333_000,
        "x = y +\n" * 125_000,
        "0123456789abcdef" * 60_000,
        "key = " * 170_000,
        "".join(random.Random(1).choice("ab=:'\"\\\n(<>+{# ") for _ in range(1_000_000)),
    ],
    ids=lambda t: t[:8],
)
def test_a_megabyte_takes_seconds(text):
    began = time.process_time()
    secrets.redact(text, secrets.all_spans(text)[1])
    assert time.process_time() - began < 15
