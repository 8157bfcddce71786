"""A corpus of source files made from a key table, the same in Spark and in other SQL engines.

Every rule with a pattern gives a line that it finds; further lines are written out below.  File ``k`` holds each
``STRIDE``-th line from the ``k % STRIDE``-th on; some lines are turned into comments or carry a suppression mark, by the sum of key and
line number.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.predicates import DuckDialect, Node, SparkDialect
from fathom.functions.samples import sample
from fathom.sources.catalog import load

STRIDE = 37

#: Lines besides those made from patterns.
LINES = """package com.acme.tool.k1;
import java.util.List;
public class Widget extends Base implements Comparable {
    private int count = 0;
    public boolean equals(Object o) { return o == this; }
    public int hashCode() { return 7; }
    public boolean equals(Widget w) { return w == w; }
    private String name = "alpha";
    int total = total;
    if (a == b) { c = c; }
    x = y - y;
    int big = 12345 ;
    for (int i = 0; i < n; i--) { sum += i; }
    list.addAll(list);
    cal.set(Calendar.MONTH, 12);
    String.format("%s and %d", a);
    throw new RuntimeException("boom");
    throw new Exception("why");
    catch (Throwable t) {
    catch (IOException e) { throw e; }
    public static final String NAME = "x";
    public int exposed = 5;
    private static final int maxSize = 10;
    private String Bad_Name = null;
    private static final Logger audit = LoggerFactory.getLogger(A.class);
    volatile Map cache;
    static final String K = "literal one";
    // if (done) { return; }
    // see the list for more
    /* TODO later */
    return null;
    }
    {
    while (x > 0) {
    switch (mode) {
        case 1: run();
        case 2: stop(); break;
        default: wait();
    values.stream().map(f).toList();
    a && b && c && d && e
    void run() throws Exception {
    @Override
    @Test
    void testThing() {
    Cookie c = new Cookie("a", "b");
    c.setHttpOnly(true);
    new FileInputStream(path);
    try (Reader r = new FileReader(p)) {
    text.trim();
    int hashcode() {
    Pattern.compile("(a+)+b*c?d*e?f+g*");
    String sql = "select x from y where z = " + id;
    ctx.executeQuery("SELECT 1" + v);
    Calendar.DAY_OF_MONTH, 32
    a & b | c
    abstract class Shape {
    class Inner extends Outer implements InnerApi {
    copyright 2020 acme
    static int counter = 0;
    counter = 5;
    counter++;
    hash_cost=4 BCrypt cost=4 rounds
    v instanceof Widget
    Widget v = make();
    String s1 = "x";
    s1 == "y"
class Own extends MessageDigest {
class Hears extends BroadcastReceiver {
class Works extends Thread {

  """.split("\n")


def _numbered(line: str, n: int, before: str = "", after: str = "") -> str:
    return before + "".join(line.replace("#", str(k)) + "\n" for k in range(1, n + 1)) + after


#: Runs of lines that stay together, for the rules that look at more than one.
BLOCKS = [
    "int made = build();\nreturn made;",
    'log("alpha beta");\nlog("alpha beta");\nlog("alpha beta");',
    "items.stream().count();\nitems.stream().toList();",
    "for (Item it : stock) {\nstock.remove(it);\n}",
    "for (Item a : shelf)\nfor (Item b : shelf)",
    "while (going) {\n\nbreak;\n}",
    "case 1: first();\ncase 2: second(); break;",
    "void finalize() {\nclean();\n}",
    "public int grade(int n) {\nif (n > 1) return 1;\nreturn 2;\nreturn 3;\nreturn 4;\n}",
    "class Mirror {\nprivate int Mirror = 1;\npublic Mirror Mirror() { go(); }\n}",
    "switch (kind) {\nhere: go();\n}",
    "class OddException extends Exception {\nprivate int code;\n}",
    _numbered("step#();", 12, "switch (n) {\ncase 1:\n", "case 2:\nbreak;\n}"),
    "if (a) {\nfor (;;) {\nwhile (b) {\ntry {\nif (c) {\nswitch (d) {\n}\n}\n}\n}\n}\n}",
    "if (p1) {\n} else if (p2) {\n} else if (p1) {\n}",
    "Gear gear = next();\nif (gear instanceof Gear) {\n}",
    "static int tally = 0;\npublic void bump() {\ntally++;\n}",
    "void twice() { go(); }\nvoid twice() { go(); }",
    "public void set(int a, int b) {\nb = 2;\nc = 3;\n}",
    "synchronized (lock) {\nlock.wait();\n}\nlock.notify();",
    "while (w) {\nlock.wait();\n}",
    "for (;;) {\nbreak;\ncontinue;\n}",
    "@Test\nvoid works() {\nrun();\n}",
    "@Test\nvoid holds() {\nassertTrue(x);\n}",
    "@Override\npublic boolean equals(Widget w) { return true; }",
    "if (q) { go } else { go }",
    "if (outer) {\n  if (inner) {\n}\n}",
    "try { }",
    "public void noop() { }",
    "public void wide(int a, int b, int c, int d, int e, int f, int g, int h) { go(); }",
    "public int loop(int n) {\nreturn loop(n);\n}",
    _numbered("if (n > #) { n++; }", 16, "public int deep(int n) {\n", "return n;\n}"),
    _numbered("x#();", 101, "public int tall(int n) {\n", "}"),
    "String s2 = null;\ns2.length();",
    _numbered("class Sub# extends Base# { }", 6),
    _numbered("import org.acme.p#.C#;", 31, "", "class Busy { }"),
    _numbered("case # -> go();", 31),
    _numbered("private int field#;", 21, "class Fat {\n", "}"),
    _numbered("public int get#() { return #; }", 36, "class Tall {\n", "}"),
]
#: What few files hold: more lines than a file should have.
MANY_LINES, RARE = 1001, 499


def _literals(node: Node) -> list[Node]:
    """Positive leaves of a conjunction or of a disjunction's first part."""
    if node.kind == "and":
        return [x for p in node.parts for x in _literals(p)]
    if node.kind == "or":
        return _literals(node.parts[0])
    return [] if node.kind == "not" else [node]


@lru_cache(maxsize=1)
def lines() -> tuple[str, ...]:
    """All lines of the corpus: those of the rules in the order of the catalogue, then the written ones and the blocks."""
    out: list[str] = []
    for r in load():
        node = r.predicate()
        if node is None or r.kind == "FILE":
            continue
        parts = [sample(x.text) if x.kind == "like" else x.text for x in _literals(node) if x.subject != "src"]
        parts += [x.text for x in _literals(node) if x.subject == "src" and x.kind == "has"]
        line = " ".join(p for p in parts if p)
        if line and line.isascii() and line.isprintable() | ("\t" in line) and "\n" not in line and len(line) < 4000:
            out.append(line)
    return tuple(dict.fromkeys(out)) + tuple(LINES) + tuple(BLOCKS)


def corpus_sql(dialect: str, table: str = "part", key: str = "p_partkey") -> str:
    """``SELECT path, src`` over a key table."""
    all_lines = lines()
    quote = (SparkDialect() if dialect == "spark" else DuckDialect()).text
    array = ", ".join(map(quote, all_lines))
    path = f"concat('/work/src/m', cast({key} % 5 AS {'STRING' if dialect == 'spark' else 'VARCHAR'}), '/F', cast({key} AS {'STRING' if dialect == 'spark' else 'VARCHAR'}), '.java')"
    ending = f"CASE WHEN {key} % 3 = 0 THEN '' ELSE chr(10) END"
    if dialect == "spark":
        # in one array and with each line's text in one place: what isn't compiled costs by the array and by the expression
        before = f"CASE WHEN ({key} + n) % 23 = 0 THEN '// ' ELSE '' END"
        after = f"CASE WHEN ({key} + n) % 23 = 0 THEN '' WHEN ({key} + n) % 29 = 0 THEN ' // NOSONAR' WHEN ({key} + n) % 31 = 0 THEN ' // NOSONAR S106, S105: known' ELSE '' END"
        body = f"array_join(transform(sequence(cast({key} % {STRIDE} AS INT), {len(all_lines) - 1}, {STRIDE}), n -> concat({before}, element_at(array({array}), n + 1), {after})), chr(10))"
        src = f"CASE WHEN {key} % 97 = 0 THEN '' ELSE concat({body}, CASE WHEN {key} % {RARE} = 3 THEN repeat(concat(chr(10), 'more();'), {MANY_LINES}) ELSE '' END, {ending}) END"
        return f"SELECT {path} AS path, {src} AS src FROM {table}"
    marked = f"CASE WHEN ({key} + n) % 23 = 0 THEN concat('// ', t) WHEN ({key} + n) % 29 = 0 THEN concat(t, ' // NOSONAR') WHEN ({key} + n) % 31 = 0 THEN concat(t, ' // NOSONAR S106, S105: known') ELSE t END"
    body = f"array_to_string(list_transform(list_transform(range(cast({key} % {STRIDE} AS BIGINT), {len(all_lines)}, {STRIDE}), lambda n: {{'n': n, 't': ([{array}])[n + 1]}}), lambda l: {marked.replace('+ n)', '+ l.n)').replace(', t)', ', l.t)').replace('(t,', '(l.t,').replace('ELSE t', 'ELSE l.t')}), chr(10))"
    src = f"CASE WHEN {key} % 97 = 0 THEN '' WHEN {key} % {RARE} = 3 THEN concat({body}, repeat(concat(chr(10), 'more();'), {MANY_LINES}), {ending}) ELSE concat({body}, {ending}) END"
    return f"SELECT {path} AS path, {src} AS src FROM {table}"


def corpus(spark: SparkSession, sf_dir: str, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """``files(path, src)``.

    The keys are dealt out before texts are made of them: a small table of keys is one partition, the texts aren't.
    """
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    keys.repartition(2 * spark.sparkContext.defaultParallelism, key).createOrReplaceTempView("corpus_keys")
    # a filter on a generated column isn't pushed below the dealing, where one task would make all texts for it
    return spark.sql(corpus_sql("spark", "corpus_keys", key)).select(F.explode(F.array(F.struct("path", "src"))).alias("file")).select("file.*")
