from fathom.operators import declarations as d

SRC = """package a.b;
import java.util.List;
import static java.lang.Math.max;
import java.io.*;
@Deprecated
public abstract class Outer<T> extends Base {
    private static final int MAX = 3, MIN = 1;
    volatile int[] counts;
    @Inject protected List<Map<String, T>> rows = new ArrayList<>();
    public Outer(int a) { this.a = a; }
    public static <K> K find(final List<K> from, String[] names, int... rest) throws E {
        int local = 3;
        Runnable r = new Runnable() { public void run() { go("x \\" y"); } };
        return null;
    }
    interface Inner { void f(int x, int y); }
    static class Nested { synchronized native void g(); }
    enum Kind { A, B; int code; }
}
class Last { }
"""


def test_declarations(spark):
    files = spark.createDataFrame([("O.java", SRC), ("bad.java", "class { ( }"), ("none.java", None), ("empty.java", "")], "path string, src string")
    rows = {(r.kind, r.name): r for r in d.declarations(files).where("path = 'O.java'").collect()}
    assert set(rows) == {("class", "Outer"), ("field", "MAX"), ("field", "counts"), ("field", "rows"), ("constructor", "Outer"), ("method", "find"), ("method", "run"), ("interface", "Inner"), ("method", "f"), ("class", "Nested"), ("method", "g"), ("enum", "Kind"), ("field", "code"), ("class", "Last")}
    assert rows["class", "Outer"].modifiers == ["public", "abstract"] and rows["class", "Outer"].line == 6
    assert rows["field", "MAX"].modifiers == ["private", "static", "final"] and rows["field", "counts"].modifiers == ["volatile"]
    assert rows["method", "find"].parameters == ["from", "names"] and rows["method", "find"].modifiers == ["public", "static"]
    assert rows["constructor", "Outer"].parameters == ["a"] and rows["method", "f"].parameters == ["x", "y"]
    assert rows["method", "run"].enclosing_method == "find" and rows["method", "run"].enclosing_class == "Outer"
    assert rows["method", "g"].enclosing_class == "Nested" and rows["method", "g"].modifiers == ["synchronized", "native"]
    assert rows["class", "Last"].enclosing_class is None and rows["class", "Outer"].enclosing_method is None


def test_class_info(spark):
    files = spark.createDataFrame([("O.java", SRC)], "path string, src string")
    rows = {r.name: r for r in d.class_info(files).collect()}
    assert rows["Outer"].methods == ["find", "run", "f"] and rows["Outer"].fields == ["MAX", "counts", "rows", "code"]
    assert rows["Nested"].methods == ["g"] and rows["Last"].methods == [] and rows["Last"].fields == []


def test_imports_and_literals(spark):
    files = spark.createDataFrame([("O.java", SRC), ("none.java", None)], "path string, src string")
    assert [r.name for r in d.imports(files).collect()] == ["java.util.List", "java.io.*"]
    used = files.where("src is not null").select(d.uses_import(files.src, "java.io").alias("a"), d.uses_import(files.src, "javax").alias("b")).first()
    assert tuple(used) == (True, False)
    assert [(r.line, r.literal) for r in d.string_literals(files).collect()] == [(13, '"x \\" y"')]
    assert d.modifiers_of("@A public static") == ["public", "static"]
