"""Operator 1: values of many parts, and assignments that run over line ends."""

import random
import time

import pytest

from fathom.llm import secrets


def found(text):
    return [text[a:b] for a, _, b in secrets.lexed_spans(text)]


def test_all_parts_of_a_constant_are_followed():
    parts = [f"Qz{n:02d}$" for n in range(40)]
    text = "x = " + " + ".join(f'"{p}"' for p in parts) + "\npassword = x"
    assert found(text) == parts
    clean = secrets.redact(text, secrets.all_spans(text)[1])
    assert not any(p in clean for p in parts)


def test_names_of_any_length():
    assert found("a" * 200 + '_password = "hunter2-Ab9zz"') == ["hunter2-Ab9zz"]


def test_chains_stay_linear():
    n = 20_000
    text = 'x = "Ab1$"\n' + 'x = x + "Zq8"\n' * n + "y = x + x\n" + "y = y + y\n" * 3000 + "password = y\n" * 1000
    began = time.monotonic()
    assert len(found(text)) == n + 1
    assert time.monotonic() - began < 20


def test_points_of_joined_literals():
    rng = random.Random(8)
    pieces = ["x" * 40, "X", "*" * 200, "Ab1$", "exam", "ple", "your", "<", ">", "q" * 130, "${", "}", " ", "a1B2c3D4" * 9, "%", "é"]  # a literal has no line end
    for _ in range(3000):
        parts = [rng.choice(pieces) for _ in range(rng.randint(1, 6))]
        value = secrets.Value([(parts[0], 0, 1)])
        for p in parts[1:]:
            value = secrets.Value([value, (p, 0, 1)])
        assert value.points() == pytest.approx(secrets.value_points("".join(parts)))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('password =\n    "hunter2-Ab9zz"', ["hunter2-Ab9zz"]),
        ('String password\n    = "hunter2-Ab9zz";', ["hunter2-Ab9zz"]),
        ("password:\n  hunter2-Ab9zz\nnext: 1", ["hunter2-Ab9zz"]),
        ("a:\n  secret: >\n    Ab12Cd34\n    Ef56Gh78\n  next: Zz99Yy88xx", ["Ab12Cd34", "Ef56Gh78"]),
        ('private_key = "-----BEGIN PRIVATE KEY-----\\n" +\n  "MIIEvQIBAD4N" +\n  "BgkqhkiG9w0B"', ["-----BEGIN PRIVATE KEY-----\\n", "MIIEvQIBAD4N", "BgkqhkiG9w0B"]),
        ('private_key = "MIIEvQIBAD4N"\n  + "BgkqhkiG9w0B"', ["MIIEvQIBAD4N", "BgkqhkiG9w0B"]),
        ("private_key: |\n  -----BEGIN RSA PRIVATE KEY-----\n  MIIEvQIBAD4N\n  -----END RSA PRIVATE KEY-----\n", ["-----BEGIN RSA PRIVATE KEY-----", "MIIEvQIBAD4N", "-----END RSA PRIVATE KEY-----"]),
        ('token = (\n  "MIIEvQIBAD4N"\n  "BgkqhkiG9w0B"\n)', ["MIIEvQIBAD4N", "BgkqhkiG9w0B"]),
        ('token = [\n  "MIIEvQIBAD4N",\n  "BgkqhkiG9w0B",\n]', ["MIIEvQIBAD4N", "BgkqhkiG9w0B"]),
        ('token = """\nMIIEvQIBAD4N\n  BgkqhkiG9w0B\n"""', ["MIIEvQIBAD4N", "BgkqhkiG9w0B"]),
        ('x = """\npassword = "hunter2-Ab9zz"\n"""', ["hunter2-Ab9zz"]),
        ('setPassword(\n  "hunter2-Ab9zz"\n)', ["hunter2-Ab9zz"]),
        ('part = "MIIEvQ" +\n "IBAD4N"\nprivate_key =\n part', ["MIIEvQ", "IBAD4N"]),
        ('secrets:\n  title: "Xy9$kLmn0pQ2rS8t"', []),
        ('secrets = {\n  "Title99x": "Xy9$kLmn0pQ2rS8t"}', []),
        ("The password:\nPlease see the next page for it", []),
        ('password = x\ny = "Xy9$kLmn0pQ2rS8t"', []),
    ],
)
def test_assignments_over_line_ends(text, want):
    assert found(text) == want
