"""Rules by captures and counts: the expressions in the JVM against the functions in Python, on random lines and files."""

import random
from collections import Counter

from fathom.operators.counted_rules import KEYS, ON_FILES, ON_LINES
from fathom.operators.file_pass import source_hits
from fathom.operators.line_engine import all_hits
from fathom.sources.catalog import load

LINES = [
    "public boolean equals(Object o) {", "boolean equals ( Foo x )", "public boolean equals(Größe g)", "a = a;", "  x=y; y = y ;z = z;", "this.a = a;", "é = é;", "wörter = wörter;", "if (a == a && b != b) c = d + d;", "null == null", "x * x / y % y", "list.addAll(list); m.removeAll(n); m.retainAll( m )",
    "for (int i = 0; i < n; i--) {", "for (int i = 9; i > n; i++)", "for (;;)", "catch (E e) { throw e;", "catch (E e) { throw f;", "public static final class A", "// public static final int B", "public static final int C = 1;", "class A extends B implements A, C", "class Ab extends B implements Cd", "volatile int x", "volatile List l",
    "BCrypt cost = 4", "Argon2 cost: 12 iterations", "PBKDF2 cost=99999999999999999999999999999999999999999999", "BCrypt cost = ٣", "set(Calendar.MONTH, 12); set(Calendar.MONTH,3); set(Calendar.DAY_OF_MONTH, 0)", "Calendar.DAY_OF_MONTH , 32", "a / a", "b - b + c-c", "x * 0", "0 * y", "10 * 0.5",
    "a & b", "a | b || c", "s.executeQuery(q + x)", '"select * from t " + x', 'x = "where ß" + y', "Pattern.compile(a+b+c*d?e?f*)", "int hashcode()", "INT HASHCODE ( String tostring (boolean equal(", "@Override int hashcode()", "// if (x)", "// a.b (", "// a = b", "/* for", "a && b && c || d || e", "a && b",
    "package a.b;", "  package c;", "// Copyright", "import a.b;", "case 1: case 2:", "class Q extends R {", "static void f() {", "public Foo ( )", "int hashCode()", "boolean equals(Object", "new X()", "", "\t", "a = a;", "K = K;", "x = x ; // \U0001f600",
]


def found(rows):
    return Counter((r.path, r.line, r.column, r.rule_ord, r.trimmed) for r in rows)


def test_both_forms_agree(spark):
    rng, rules = random.Random(1), [r for r in load() if r.key in KEYS]
    texts = [line + "\n" for line in LINES]
    texts += ["".join(rng.choice(LINES) + rng.choice(["\n", "\n", "\r\n", " "]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += ["import a;\n" * 30, "import a;\n" * 31, "case 1:\n" * 30, "case 2: case 3:\n" * 16, "x\n" * 1000, "x\n" * 1001, "class A extends B\n" * 5, "class A extends B " * 6]
    files = spark.createDataFrame([(f"f{n}", t) for n, t in enumerate(texts)] + [("none", None)], "path string, src string").repartition(4)
    want, got = found(source_hits(files, rules).collect()), found(all_hits(files, [], counted=rules).collect())
    keys = {r.ordinal: r.key for r in rules}
    assert {keys[k[3]] for k in want} == KEYS
    assert got == want, ([(keys[k[3]], k, n) for k, n in (got - want).items()][:5], [(keys[k[3]], k, n) for k, n in (want - got).items()][:5])
    assert any(n > 1 for n in want.values()) and len(ON_LINES) + len(ON_FILES) == len(KEYS) == 28
