import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.functions import naming, text
from fathom.functions.predicates import DuckDialect, NotAPredicate, SparkDialect, needed_pieces, parse
from fathom.functions.samples import sample
from fathom.operators import java_syntax
from fathom.operators.line_engine import file_lines, line_hits, line_rules
from fathom.operators.source_rules import RULES, Limits, SourceFile, cognitive_score
from fathom.plans import oracles
from fathom.plans.analysis import Config, active_rules, all_issues, described
from fathom.sources.catalog import catalog, load
from fathom.sources.custom_rules import custom_rule, parse_custom_rules


def files(spark, **sources):
    return spark.createDataFrame(list(sources.items()), "path string, src string")


def found(key, src, **limits):
    return [(f.line, f.column) for f in RULES[key](SourceFile("A.java", src, Limits(**limits)))]


def test_catalogue():
    rules = load()
    assert len(rules) == 987 and len({r.rule_id for r in rules}) == 963
    count = lambda c: sum(r.category == c for r in rules)
    assert [count(c) for c in ("Naming", "Security", "Bug", "CodeSmell", "Complexity")] == [53, 136, 239, 494, 65]
    assert sum(r.kind == "MAC" for r in rules) == 746
    assert all(r.owasp and r.cwe for r in rules if r.category == "Security")
    assert all(r.debt > 0 for r in rules)


def test_every_rule_has_a_home():
    """A predicate, a function, or a registration that finds nothing."""
    for r in load():
        assert (r.predicate() is not None) + (r.key in RULES) + (r.kind == "NOP") == 1, r.key


def test_predicate_notation():
    node = parse('src∋"a" AND NOT (line~P OR line∋"it\\"s") AND free; where free := NOT ltrim starts "//"', {"P": r"x\d"})
    assert DuckDialect().render(node) == "(contains(src, 'a') AND (NOT (regexp_matches(text, 'x\\d') OR contains(text, 'it\"s'))) AND (NOT starts_with(trimmed, '//')))"
    facts = []
    assert "fact_0" in SparkDialect(facts).render(node) and len(facts) == 1
    for bad in ("line~Q", "line and", "(line~P", "x"):
        with pytest.raises(NotAPredicate):
            parse(bad, {"P": "x"})


def test_pieces_are_needed():
    rng = random.Random(1)
    for r in load():
        if r.kind != "MAC":
            continue
        pieces, ignore = needed_pieces(r.detection)
        line = sample(r.detection)
        for _ in range(3):
            if line and re.search(r.detection, line) and pieces:
                probe = line.lower() if ignore else line
                assert any(p in probe for p in pieces), r.key
            if line:
                at = rng.randint(0, len(line))
                line = line[:at] + rng.choice(["x", " ", "1", "("]) + line[at:]


def test_line_rules_on_their_samples(spark):
    """Each pattern rule finds its sample, and not where that is a comment."""
    rules = [r for r in line_rules() if r.kind == "MAC" and sample(r.detection)]
    rows = [(r.key, s) for r in rules for s in (sample(r.detection),)]
    df = spark.createDataFrame(rows + [("c" + k, "// " + s.lstrip()) for k, s in rows], "path string, src string")
    hit = {(r.path, r.rule_ord) for r in line_hits(df.repartition(4), rules).collect()}
    ordinals = {r.key: r.ordinal for r in rules}
    missing = [k for k, s in rows if (k, ordinals[k]) not in hit and not s.strip().startswith(("//", "*"))]
    assert not missing
    assert not [h for h in hit if h[0].startswith("c")]


@pytest.mark.parametrize(("src", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n\n", ["a", "b", ""]), ("\n", [""]), ("a\r", ["a\r"])])
def test_lines(spark, src, lines):
    assert text.split_lines(src) == lines
    rows = file_lines(files(spark, f=src)).orderBy("line").collect()
    assert [r.text for r in rows] == lines and [r.line for r in rows] == list(range(1, len(lines) + 1))


def test_unicode_lines(spark):
    rules = [r for r in line_rules() if r.key == "Naming:S1701"]
    hits = line_hits(files(spark, a="public boolean getÄrger()", b="   // public boolean getX()", c="public boolean getX()"), rules).collect()
    assert {r.path for r in hits} == {"a", "c"}


@pytest.mark.parametrize(
    ("key", "src", "want"),
    [
        ("Naming:S115", "  private static final int maxSize = 1;", [(1, 28)]),
        ("Naming:S115", "static final int MAX_SIZE = 1;\nstatic final long serialVersionUID = 1;\nstatic final Logger logger = x;", []),
        ("Naming:S116", "private int Bad_name;\nprivate static final int BAD = 1;", [(1, 13)]),
        ("Naming:S1312", "Logger audit = x;\nLogger LOG = x;", [(1, 8)]),
        ("Bug:S1656", "a = a; b = c; d = d;", [(1, 1), (1, 1)]),
        ("Bug:S1764", "a == a\na + a\nnull == null\na != b", [(1, 1)]),
        ("Bug:S2110", "cal.set(Calendar.MONTH, 12);\ncal.set(Calendar.MONTH, 11);\ncal.set(Calendar.DAY_OF_MONTH, 0);", [(1, 1), (3, 1)]),
        ("Bug:S2114", "x.addAll(x);\nx.addAll(y);", [(1, 1)]),
        ("Bug:S2185", "a * 0\n0 * a\na - a\na - b", [(1, 1), (2, 1), (3, 1)]),
        ("Bug:S2251", "for (int i = 0; i < n; i--) {\nfor (int i = 0; i < n; i++) {\nfor (int i = 9; i > n; i++) {", [(1, 1), (3, 1)]),
        ("Bug:S2275", 'String.format("%s %d", a)\nString.format("%s", a)\nString.format("%s")', [(1, 1), (3, 1)]),
        ("CodeSmell:S109", "int x = 42 ;\nint y = 10 ;\nstatic final int z = 42 ;", [(1, 9)]),
        ("CodeSmell:S1104", "public int open;\npublic static final int OK = 1;", [(1, 12)]),
        ("CodeSmell:S112", "  throw new Exception()", [(1, 13)]),
        ("CodeSmell:S1181", "} catch (Throwable t) {", [(1, 10)]),
        ("CodeSmell:S2178", "if (a & b)\nif (a && b | c)", [(1, 1)]),
        ("CodeSmell:S4165", "a = a;", [(1, 1)]),
        ("Bug:S1206", "\nclass A {\npublic boolean equals(Object o) {}\n}", [(2, 1)]),
        ("CodeSmell:S1210", "int hashCode() {}", [(1, 1)]),
        ("CodeSmell:S1220", "class A {}", [(1, 1)]),
        ("CodeSmell:S1451", "package a;", [(1, 1)]),
        ("CodeSmell:S1451", "// Copyright", []),
        ("Security:S2089", 'c = new Cookie("a");\nc.setHttpOnly(true);', []),
        ("Security:S2092", 'c = new Cookie("a");', [(1, 1)]),
        ("Security:S2095", "x = new FileReader(f);", [(1, 1)]),
        ("Security:S2095", "try (Reader r =\n new FileReader(f))", []),
        ("Bug:S2699", "@Test\nvoid t() {\n run();\n}", [(1, 1)]),
        ("Bug:S2699", "@Test\nvoid t() {\n assertTrue(x);\n}", []),
        ("Bug:S5413", "for (A a : list) {\n list.remove(a);\n}", [(2, 1)]),
        ("Bug:S1751", "while (x) {\n\n return 1;\n}", [(1, 1)]),
        ("CodeSmell:S1488", "int x = f();\nreturn x;", [(1, 1)]),
        ("CodeSmell:S128", "case 1: f();\ncase 2: g(); break;\ncase 3:", [(1, 1)]),
        ("Bug:S1114", "void finalize() {\n f();\n}", [(1, 1)]),
        ("Bug:S2097", "public boolean equals(Object o) {\n return o == this;\n}", [(1, 1)]),
        ("CodeSmell:S131", "switch (x) {\n case 1:\n}\nswitch (y) {\n default: f();\n}", [(1, 1)]),
        ("CodeSmell:S135", "for (;;) {\n break;\n continue;\n}", [(1, 1)]),
        ("CodeSmell:S1142", "public int f() {\n" + "return 1;\n" * 4 + "}", [(1, 1)]),
        ("CodeSmell:S134", "if (a) {\n" * 5, [(5, 1)]),
        ("Bug:S1862", "if (a) {\n} else if (b) {\n} else if (a) {\n}", [(3, 1)]),
        ("Bug:S2273", "synchronized (x) {\n x.wait();\n}\nx.notify();", [(4, 1)]),
        ("Bug:S1226", "public void f(int a, int b) {\n b = 2;\n c = 3;\n}", [(2, 1)]),
        ("Bug:S1850", "Widget v = f();\nif (v instanceof Widget)", [(2, 1)]),
        ("Bug:S2696", "static int n = 0;\npublic void f() {\n n++;\n}", [(3, 1)]),
        ("Bug:S4973", 'String s = f();\nif (s == t)\nif (x == null)', [(2, 1)]),
        ("CodeSmell:S1144", "private int lonely;\nprivate int used;\nused = 1;", [(1, 1)]),
        ("CodeSmell:S3047", "for (A a : xs)\nfor (A b : xs)", [(2, 1)]),
        ("CodeSmell:S1192", 'a = "same";\nb = "same";\nc = "same";\nd = "abc";', [(1, 1)]),
        ("CodeSmell:S1066", "if (a) {\n  if (b) {", [(1, 1)]),
        ("CodeSmell:S1186", " public void f() {}", [(2, 1)]),
        ("CodeSmell:S107", "public void f(int a, int b, int c, int d, int e, int f, int g, int h)", [(1, 1)]),
        ("Bug:S2190", "public int f(int n) {\n return f(n);\n}", [(1, 1)]),
        ("Complexity:S1067", "a && b && c && d && e", [(1, 1)]),
        ("Complexity:S104", "x\n" * 1001, [(1, 1)]),
        ("Bug:S1201", "boolean equals(Widget w)\nboolean equals(Object o)\nboolean equalsTo(Widget w)", [(1, 1)]),
        ("Bug:S1221", "int hashcode()\nint hashCode() // as it is spelled\n@Override int hashcode()\nboolean equal(x)\nboolean equals(x)", [(1, 1), (2, 1), (4, 1)]),
        ("Bug:S2095", "x = new Scanner(f);\ny = new Scanner(f) + new Socket(s);\nz = new FileReader(f);", [(1, 1), (2, 1), (2, 1)]),
        ("Bug:S2095", "try (Scanner r = new Scanner(f)) {\n}\nnew Widget();", []),
        ("Bug:S2272", "class A implements Iterator {\npublic T next() {\nreturn x;\n}\n}", [(2, 1)]),
        ("Bug:S2272", "class A implements Iterator {\npublic T next() {\nthrow new NoSuchElementException();\n}\n}", []),
        ("Bug:S2272", "class A {\npublic T next() {\n}\n}", []),
        ("Bug:S2276", "while (x) {\nlock.wait();\n}", [(2, 1)]),
        ("Bug:S2276", "while (x) {\nif (y) {\nlock.wait();\n}\n}\nlock.wait();", []),
        ("Bug:S2689", "@Override\npublic boolean equals(Widget w)", [(1, 1)]),
        ("Bug:S2689", "@Override\npublic boolean equals(Object o)\npublic boolean equals(Widget w)", []),
        ("CodeSmell:S108", "\ntry { }", [(2, 1)]),
        ("CodeSmell:S108", "if (a) { b(); } void f() { }", []),
        ("CodeSmell:S1151", "case 1:\n" + "x();\n" * 10 + "case 2:\nx();\ndefault:", [(1, 1)]),
        ("CodeSmell:S1151", "case 1:\n" + "x();\n" * 9 + "case 2:", []),
        ("Complexity:S1151", "case 1:\n" + "x();\n" * 5 + "  case 2:\nx(\"case 3:\");", [(1, 1)]),
        ("Complexity:S1151", "case 1:\n" + "x();\n" * 4 + "case 2:", []),
        ("CodeSmell:S1164", "catch (E e) { throw e;\ncatch (E e) { throw f;", [(1, 1)]),
        ("CodeSmell:S1165", "class OddException {\nprivate int a;\nprivate final int b;\n}\nprivate int c;", [(2, 1)]),
        ("CodeSmell:S1170", "public static final int A = 1;\n// public static final int B = 1;\nprivate static final int C = 1;\npublic static final class D {", [(1, 1)]),
        ("CodeSmell:S1219", "switch (x) {\nlabel: f();\ncase: g();\ndefault: h();\n}\nother: f();", [(2, 1)]),
        ("CodeSmell:S1223", "class A {\npublic int A() {\npublic void A() {\npublic int B() {", [(2, 1)]),
        ("CodeSmell:S1226", "public void f(int a, int b) {\na = 1;\nb = 1;\na == 2;\n}", [(2, 1)]),
        ("CodeSmell:S1694", "abstract class A {\nint x;\n}", [(1, 1)]),
        ("CodeSmell:S1694", "abstract class A {\nabstract int f();\n}", []),
        ("CodeSmell:S1700", "class A {\nprivate int A;\nprivate int B;\n}\nclass B {\nprivate static int B = 1;", [(2, 1), (6, 1)]),
        ("CodeSmell:S2176", "class Shape extends Base implements ShapeApi {\nclass Dot extends Base implements ShapeApi {", [(1, 1)]),
        ("CodeSmell:S3923", "if (a) { go } else { go }\nif (a) { go } else { stop }", [(1, 1)]),
        ("CodeSmell:S5958", "@Test\nclass Checks {\nclass CheckTest {\nclass MoreTests {", [(2, 1)]),
        ("CodeSmell:S5958", "class Checks {", []),
        ("CodeSmell:S5967", "void a()\nvoid b()\nvoid a()", [(3, 1)]),
        ("CodeSmell:S6301", "@Test\nvoid a() {\nf();\n}\n@Test\nvoid b() {\nassertTrue(x);\n}", [(1, 1)]),
        ("Complexity:S1200", "package p;\nclass A { }\n" + "".join(f"import p.C{n};\n" for n in range(21)), [(2, 1)]),
        ("Complexity:S1200", "class A { }\n" + "".join(f"import p.C{n % 20};\n" for n in range(40)), []),
        ("Complexity:S1448", "class A {\n" + "public int f() { return 1; }\n" * 36, [(1, 1)]),
        ("Complexity:S1448", "class A {\n" + "public int f() { return 1; }\n" * 35, []),
        ("Security:S5344", "BCrypt cost=4\nBCrypt cost: 12\ncost=4\nBCrypt rounds=4", [(1, 1)]),
        ("Naming:S114", "interface bad_one { }\ninterface Good { }\nclass bad_two { }", [(1, 11)]),
        ("Naming:S117", "class A { void f() { int Bad_x = 1; int good = 2; } int Field_y; }", [(1, 26)]),
        ("Naming:S119", "class A<T, bad> { <K> void f() { } }", [(1, 12)]),
        ("CodeSmell:S135", "for (;;) {\n break;\n}\nwhile (x) {\n}", []),
        ("Complexity:S138", "public int f(int n) {\n" + "x();\n" * 98 + "}\n", []),
        ("Complexity:S138", "public int f(int n) {\n" + "x();\n" * 101 + "}\n", [(1, 1)]),
    ],
)
def test_source_rules(key, src, want):
    assert found(key, src) == want


@pytest.mark.parametrize(
    ("key", "src", "want"),
    [
        ("Bug:S1114", "  void finalize() {\n}", None),
        ("CodeSmell:S131", "switch (x) {\n}", None),
        ("CodeSmell:S1144", "private int lonely;", None),
        ("CodeSmell:S1192", 'a("same");\na("same");\na("same");', None),
        ("Complexity:S1541", "public int f() {" + "if (a) { }" * 12 + "}", None),
        ("CodeSmell:S108", "  try { }", "try { }"),
        ("Naming:S1312", "  Logger audit = x;", "audit"),
        ("CodeSmell:S112", "  throw new Exception();", "throw new Exception();"),
    ],
)
def test_shown_code(key, src, want):
    assert [f.snippet for f in RULES[key](SourceFile("A.java", src))] == [want]


def test_rules_in_sql_by_the_other_pass():
    """Every rule on files that is written out in SQL finds the same in the corpus, and each of them finds something."""
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM read_parquet('/root/testdata/sf0.01/part.parquet')")
    con.execute(f"CREATE TABLE files AS WITH {oracles.corpus_cte('part', 'p_partkey')} SELECT path, src FROM files")
    sources = [SourceFile(p, s) for p, s in con.execute("SELECT path, src FROM files").fetchall()]
    assert len(oracles.sql_rules()) == 86
    for key, sql in oracles.sql_rules().items():
        got = Counter(map(tuple, con.execute(f"WITH {oracles.lines_cte()} SELECT path, line::INT, col::INT FROM ({sql})").fetchall()))
        want = Counter((s.path, f.line, f.column) for s in sources for f in RULES[key](s))
        assert got == want and want, key


def test_messages_of_the_catalogue(spark, tmp_path):
    text = "## Bugs\n\n| Id | Severity | Title | Class | Detection | Message |\n|---|---|---|---|---|---|\n| S1 | Major | A title | MAC | `foo` | Say this. |\n| S2 | Minor | Another | MAC | `foo` | |\n"
    (tmp_path / "c.md").write_text(text)
    rules = load(str(tmp_path / "c.md"))
    found = described(line_hits(files(spark, a="foo"), list(rules)), catalog(spark, path=str(tmp_path / "c.md")))
    assert {(r.rule_id, r.message) for r in found.collect()} == {("S1", "Say this."), ("S2", "Another")}


def test_cognitive_score_reads_the_starts_of_lines():
    assert cognitive_score("if (a) {\nif (b) {\n}\n}\n} else {") == 3
    assert cognitive_score("double x = 1;") == 1  # as it starts like a loop
    assert cognitive_score("a && b || c ? d : e") == 3


def test_method_complexity():
    body = "public int f(int n) {\n" + "if (n > 1) { n++; }\n" * 11 + "return n;\n}\n"
    assert found("Complexity:S1541", body) and found("Complexity:S138", body) == []
    assert found("Complexity:S3776", body, complexity=10)


def test_names_in_syntax():
    src = "package com.Acme.x;\npublic class bad_name<K, VALUE> {\n  interface iface {}\n  <T> void Do_it(String p) { String Local = null; for (int Idx = 0; ; ) {} Runnable r = new Runnable() { public void Run_me() {} }; }\n  bad_name() { }\n  /* void Not_me() {} */ String s = \"void Nor_me() {}\";\n}\n"
    names = {(d.kind, d.name) for d in java_syntax.Scanner(src).found}
    assert {("package", "com.Acme.x"), ("class", "bad_name"), ("interface", "iface"), ("type_parameter", "VALUE"), ("method", "Do_it"), ("method", "Run_me"), ("local", "Local"), ("local", "Idx"), ("constructor", "bad_name")} <= names
    assert not any("me" in n and k == "method" and n in ("Not_me", "Nor_me") for k, n in names)
    assert found("Naming:S101", src) == [(2, 14)] and found("Naming:S120", src) == [(1, 1)]
    assert found("Naming:S100", "class A { void main() {} void testX_y() {} void ok() {} }") == []


def test_null_flow():
    flow = lambda body, params="String p": [(f.line, f.severity) for f in RULES["Bug:S2259"](SourceFile("A", f"class A {{ void f({params}) {{\n{body}\n}} }}"))]
    assert flow("String s = null;\ns.length();") == [(3, "blocker")]
    assert flow('String s = "a";\ns.length();') == []
    assert flow("p.length();") == [(2, "major")]
    assert flow("if (p == null) { return; }\np.length();") == []
    assert flow("if (p != null) { p.length(); }") == []
    assert flow("String s = null;\nif (p == q) { s = new String(); }\ns.length();") == [(4, "major")]
    assert flow("String s = new String();\nwhile (a) { s.trim(); s = null; }") == [(3, "major")]


def test_broken_sources_do_not_stop_a_run():
    rng = random.Random(1)
    pieces = [t.text for t in java_syntax.tokens("class A < T > { int f ( String s ) { for ( ; ; ) { new A ( ) { } ; } return a [ 0 ] ; } @X ( y ) enum E { A , B ; } }")]
    for _ in range(400):
        source = SourceFile("A", " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 50))))
        for check in RULES.values():
            list(check(source))


def test_suppression(spark):
    src = 'System.out.println("a");\nSystem.out.println("b"); // NOSONAR\nSystem.out.println("c"); // NOSONAR S106: known\nSystem.out.println("d"); // NOSONAR S105\nSystem.out.println("e"); // NOSONAR false positive\n'
    issues = all_issues(files(spark, **{"A.java": src}), Config(enabled_rules=("S106",)))
    assert sorted(r.line for r in issues.collect()) == [1, 4, 5]


def test_selection():
    assert {r.severity for r in active_rules(Config(min_severity="critical"))} == {"critical", "blocker"}
    assert len(active_rules(Config(enabled_rules=("S1226",)))) == 2
    assert not [r for r in active_rules(Config(disabled_rules=("S106",))) if r.rule_id == "S106"]


GOOD = """rules:
  - id: CUSTOM-1
    title: "No prints"
    severity: major
    category: CodeSmell
    pattern: 'print\\('
    negative_pattern: "//"
    message: "Don't print"
  - id: CUSTOM-2
    title: Wide
    severity: info
    category: documentation
    pattern: é
    message: m
    debt_minutes: 2
"""


def test_custom_rules(spark):
    rules = parse_custom_rules(GOOD)
    assert [r.category for r in rules] == ["CodeSmell", "Documentation"] and rules[1].debt_minutes == 2
    src = "é print(print(\n// print(\n"
    got = all_issues(files(spark, f=src), Config(enabled_rules=(), custom_rules=rules)).collect()
    assert sorted((r.rule_id, r.line, r.column, r.end_column) for r in got) == [("CUSTOM-1", 1, 4, 10), ("CUSTOM-1", 1, 10, 16), ("CUSTOM-2", 1, 1, 3)]


@pytest.mark.parametrize("change", [{"id": "X-1"}, {"severity": "loud"}, {"category": "Other"}, {"pattern": "["}, {"message": ""}])
def test_bad_custom_rules(change):
    with pytest.raises(ValueError):
        custom_rule({"id": "CUSTOM-1", "title": "t", "severity": "major", "category": "Bug", "pattern": "x", "message": "m"} | change)


def test_unreadable_files_have_no_issues(spark):
    assert all_issues(files(spark, a=None, b="")).where("file = 'a'").count() == 0


def test_names_of_cases():
    assert [naming.to_camel_case(n) for n in ("Do_it", "DoIt", "do_the_thing", "")] == ["doIt", "doIt", "doTheThing", ""]
    assert [naming.to_pascal_case(n) for n in ("do_it", "doIt", "bad_NAME")] == ["DoIt", "DoIt", "BadName"]
    assert [naming.to_upper_snake_case(n) for n in ("maxSize", "APIKey", "a1B", "MAX_SIZE")] == ["MAX_SIZE", "APIKEY", "A1_B", "MAX_SIZE"]


def test_rules_on_lines_that_matter_find_the_same():
    """What a line needs leaves no finding out, on the corpus' lines in many orders."""
    from fathom.operators.file_pass import finder
    from fathom.operators.source_rules import NEEDS, RULES, SourceFile
    from fathom.plans.corpus import lines as corpus_lines

    rng, texts = random.Random(3), corpus_lines()
    rules = [r for r in load() if r.key in RULES]
    find = finder(rules)
    for _ in range(60):
        src = "\n".join(rng.choice(["", "// ", "  ", "\u2003"]) + t for t in rng.choices(texts[-130:] + ("@Test", "x = y;", "int next() {", "\x1ccase 2:"), k=80))
        source = SourceFile("a", src)
        plain = sorted((r.ordinal, f.line, f.column, f.message or "") for r in rules for f in RULES[r.key](source))
        assert sorted((row[7], row[0], row[1], row[3] or "") for row in find("a", src)) == plain
    assert len(NEEDS) > 50


def test_a_line_is_judged_once(spark):
    """However many files have it: 200 files of the same lines are judged as one file's lines, for all facts of the files."""
    from fathom.operators import line_engine
    from fathom.plans.corpus import lines as corpus_lines

    texts = "\n".join(corpus_lines()[:200])
    rows = [(f"p{n}", texts + ("\nnormalize setHttpOnly" if n % 2 else "")) for n in range(40)]
    seen, distinct = [], line_engine.judged_lines

    def counted(texts, *rest):
        out = distinct(texts, *rest)
        seen.append(out.select("text").distinct().count())
        return out

    line_engine.judged_lines = counted
    try:
        hits = Counter((r.path, r.line, r.rule_ord) for r in line_hits(spark.createDataFrame(rows, "path string, src string"), line_rules()).collect())
    finally:
        line_engine.judged_lines = distinct
    assert seen[0] <= 201 and max(hits.values()) == 1
    alone = {n: {(x, o) for p, x, o in hits if p == f"p{n}"} for n in range(40)}
    assert all(alone[n] == alone[n % 2] for n in alone) and len(alone[0]) > 150


def test_rules_of_one_line_run_once_for_a_line(monkeypatch):
    """However many files have it, and however long it is."""
    from fathom.operators import source_rules
    from fathom.operators.file_pass import finder

    plain, calls = RULES["CodeSmell:S109"], []
    monkeypatch.setitem(source_rules.RULES, "CodeSmell:S109", lambda source: [calls.append(source.lines), *plain(source)][1:])
    find = finder([r for r in load() if r.key == "CodeSmell:S109"])
    lines = [f"judged = once + 77{n} ;" for n in range(5)] + ["judged = 7777 ; " + "long " * 400]
    for k in range(6):
        got = sorted((row[0], row[1]) for row in find("a", "\n".join(["{"] * k + lines)))
        assert got == [(k + n + 1, 17 if n < 5 else 10) for n in range(6)]
    assert len(calls) == 6


def test_methods_are_found_from_their_ends():
    """The heads and bodies are those of a search of the whole text."""
    from fathom.operators.source_rules import METHOD, METHOD_END, ended

    def body(text, at):
        depth, start = 0, None
        for n in range(at, len(text)):
            if text[n] in "{}":
                start = n if start is None and text[n] == "{" else start
                depth += 1 if text[n] == "{" else -1
                if depth == 0:
                    return text[start : n + 1]

    rng, seen = random.Random(7), 0
    parts = ["int f", "public ", "static ", "void\ng ", "(", "(", ")", ")", ") {", ")\n throws A, B {", "{", "}", "}", " ", "\n", ",", ";", "a b", "throws ", "xpublic f("]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 40)))
        source, heads = SourceFile("a", text), list(METHOD.finditer(text))
        assert [m.regs for m in ended(text, METHOD, METHOD_END)] == [m.regs for m in heads]
        assert [source.body_from(at) for at in range(len(text))] == [body(text, at) for at in range(len(text))]
        seen += len(heads)
    assert seen > 500


def test_trim_takes_all_white_space(spark):
    """Each character of the basic plane at both ends, against the pattern; a pattern isn't what does it."""
    from fathom.functions.text import trim

    texts = spark.range(1, 0x10000).where("id not between 55296 and 57343").selectExpr("decode(encode(char(0), 'utf-8'), 'utf-8') as z", "decode(unhex(lpad(hex(id), 4, '0')), 'utf-16be') as c")
    texts = texts.selectExpr("c", "concat(c, ' ', c, 'a', c, 'b ', c, c) as t")
    by_pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert texts.where(trim(F.col("t")) != by_pattern).count() == 0 and texts.where(by_pattern == F.concat(F.lit("a"), "c", F.lit("b"))).count() == 25
    assert "regexp" not in texts.select(trim(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_heads_are_found_once_and_with_two_words_only():
    from fathom.operators.source_rules import METHOD, METHOD_END, SourceFile, ended

    text = "f(a) {\nif (b) {\n} else if (c) {\nx.y (d) {\nint g(\nint e) throws X {\npublic static void h_1 () { }\n"
    source = SourceFile("", text)
    assert [text[close:] for _, close in source.heads] == [text[text.index(end) :] for end in (") {\nx.y", ") throws", ") { }")]
    assert source.heads is source.heads
    assert [m[1] for m in ended(text, METHOD, METHOD_END, source.heads)] == [m[1] for m in METHOD.finditer(text)] == ["if", "g", "h_1"]


def test_marks_are_looked_at_where_something_is_found(monkeypatch):
    from fathom.operators import file_pass

    looked = []
    mark = file_pass.line_mark
    monkeypatch.setattr(file_pass, "line_mark", lambda line: looked.append(line) or mark(line))
    rules = [r for r in load() if r.key == "Bug:S1656"]
    found = file_pass.finder(rules, suppress=True)("p", "a = a; // NOSONAR\nb = b; // NOSONAR S1\nc = d; // NOSONAR\n")
    assert [row[0] for row in found] == [2] and len(looked) == 2


def test_methods_and_series_of_lines_that_come_again_are_judged_once(monkeypatch):
    """In whatever file and at whatever line: a method's head and score, and the lines that matter to a rule."""
    from fathom.operators import source_rules
    from fathom.operators.file_pass import finder

    plain, calls, scored = RULES["Bug:S1862"], [], []
    monkeypatch.setitem(source_rules.RULES, "Bug:S1862", lambda source: [calls.append(source.lines), *plain(source)][1:])
    score = source_rules._scored
    monkeypatch.setattr(source_rules, "_scored", lambda line: scored.append(line) or score(line))
    find = finder([r for r in load() if r.key in ("Bug:S1862", "Complexity:S3776")], source_rules.Limits(complexity=0))
    method = "public int comesAgain(int n) {\nif (n > 812) {\nreturn 1;\n} else if (n > 812) {\n}\n}"
    for k in range(6):
        got = sorted((row[0], row[3]) for row in find("a", f"other{k}();\n" * k + method) if row[3])
        assert got == [(k + 1, "Cognitive complexity of 'comesAgain' is 1.")]
        assert sorted(row[0] for row in find("a", f"other{k}();\n" * k + method) if not row[3]) == [k + 4]
    assert len(calls) == 1 and len(scored) == 8  # six lines of the method, and two of the else branch, which looks like one


def test_empty_blocks_are_looked_for_where_they_are():
    """The matches are those of a search of the whole text."""
    from fathom.operators.source_rules import EMPTY_BLOCK, around_empty_blocks

    pattern = re.compile(r"(?:if|else|for|while|try|catch|finally|switch)\s*(?:\([^)]*\))?\s*\{\s*\}")
    rng, seen = random.Random(11), 0
    for _ in range(4000):
        text = "".join(rng.choices(["if", "else ", "try", "(", ")", ") {", "{", "}", "{ }", " ", "\n", "a;", "for (x {} y) {}"], k=rng.randint(1, 25)))
        want = [m.span() for m in pattern.finditer(text)]
        assert [m.span() for m in pattern.finditer(text, *around_empty_blocks(SourceFile("a", text)))] == want
        assert not want or EMPTY_BLOCK.search(text)
        seen += len(want)
    assert seen > 500


def test_the_corpus_is_the_same_in_both_engines(spark, tmp_path):
    """Of keys with each ending, mark and length, and the text stands once in the Spark plan."""
    from fathom.plans.corpus import corpus, corpus_sql

    duckdb.sql(f"COPY (SELECT range * 7 AS p_partkey FROM range(1500)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    part = duckdb.read_parquet(f"{tmp_path}/part.parquet")  # noqa: F841  the table that the SQL names
    want = sorted(duckdb.sql(corpus_sql("duckdb")).fetchall())
    assert sorted((r.path, r.src) for r in corpus(spark, str(tmp_path)).collect()) == want
    assert corpus_sql("spark").count("package com.acme.tool.k1") == 1
