import glob
import os
import subprocess
import time
import zipfile

import pytest

from ripplegraph.operators import bytecode, java, mappers
from ripplegraph.operators.analyzers import analyse
from ripplegraph.plans import java_queries, registered  # noqa: F401  queries register as they are imported

STORE = """package org.demo.stock;
import java.util.List;
import org.springframework.stereotype.*;

/** A bracket in a comment: { */
@Service
public class Store<T extends Comparable<T>> extends Base implements Runnable {
    private static final String PART = "}";
    @Autowired private Shelf shelf;
    private List<java.util.Map<String, int[]>> rows = new java.util.ArrayList<>(), more;
    static { int boot = 1; }
    Store(Ledger ledger) { super(ledger); }
    <X> T pick(T item, X other, long... sizes) throws Exception {
        if (sizes.length > 3) { note(item, 'c'); }
        Runnable r = () -> shelf.lift(item);
        return new Finder(item).find(item);
    }
    private boolean note(Object a, char c) { return a.hashCode() < c && this.note(a, c); }
    enum Kind { A(1) { void own() {} }, B; private int v; Kind(int... v) { this.v = v.length; } int v() { return v; } }
    static class Inner { Kind kind; Shelf.Board[] boards; }
    record Pair(int a, String b) { int sum() { return a; } }
    @interface Mark { String value() default "x"; }
    interface Port { void open(long[] xs); default void shut() { open(null); } }
}
"""
SHELF = "package org.demo.stock; class Shelf { void lift(Object x) { } void lift(Object x, int n) { } static class Board { } }"


def rows_of(reader, text, *columns):
    return [tuple(r.get(c) for c in columns) for r in reader("F.java", text)]


def test_declarations_and_calls():
    got = rows_of(java.java, STORE, "kind", "owner", "method", "descriptor")
    own = "org.demo.stock.Store"
    assert [x[1] for x in got if x[0] == "class"] == [own, *[f"{own}${x}" for x in ("Kind", "Inner", "Pair", "Mark", "Port")]]
    assert {(o, m, d) for k, o, m, d in got if k == "method"} == {
        (own, "<init>", "(Lorg/demo/stock/Ledger;)V"),
        (own, "pick", "(Ljava/lang/Object;Lorg/demo/stock/X;[J)Ljava/lang/Object;"),
        (own, "note", "(Ljava/lang/Object;C)Z"),
        (f"{own}$Kind", "<init>", "([I)V"),
        (f"{own}$Kind", "v", "()I"),
        (f"{own}$Pair", "sum", "()I"),
        (f"{own}$Mark", "value", "()Ljava/lang/String;"),
        (f"{own}$Port", "open", "([J)V"),
        (f"{own}$Port", "shut", "()V"),
    }
    assert {(o, m, d) for k, o, m, d in got if k == "field"} == {
        (own, "PART", "Ljava/lang/String;"), (own, "shelf", "Lorg/demo/stock/Shelf;"), (own, "rows", "Ljava/util/List;"), (own, "more", "Ljava/util/List;"),
        (f"{own}$Kind", "v", "I"), (f"{own}$Inner", "kind", f"L{own.replace('.', '/')}$Kind;"), (f"{own}$Inner", "boards", "[Lorg/demo/stock/Shelf$Board;"),
        (f"{own}$Pair", "a", "I"), (f"{own}$Pair", "b", "Ljava/lang/String;"),
    }
    calls = [x for x in java.java("F.java", STORE) if x["kind"] == "call"]
    seen = {(x["method"], x["target_owner"], x["target_method"], x["n_arguments"], x["target_descriptor"]) for x in calls}
    assert ("pick", own, "note", 2, "(Ljava/lang/Object;C)Z") in seen and ("note", own, "note", 2, "(Ljava/lang/Object;C)Z") in seen
    assert ("pick", "org.demo.stock.Shelf", "lift", 1, None) in seen and ("pick", "org.demo.stock.Finder", "find", 1, None) in seen
    assert ("shut", f"{own}$Port", "open", 1, "([J)V") in seen and not any(x[2] in ("Finder", "super", "if") for x in seen)
    assert [x for x in rows_of(java.java, STORE, "kind", "method", "line") if x[1] == "pick" and x[0] == "method"] == [("method", "pick", 13)]


def test_calls_to_other_files_are_joined(spark):
    files = spark.createDataFrame([("a/Store.java", STORE), ("a/Shelf.java", SHELF), ("bad.java", "class X { void m( { }"), ("empty.java", None)], "path string, content string")
    rows = java.java_rows(files)
    assert [x.target_descriptor for x in rows.where("target_method = 'lift'").collect()] == ["(Ljava/lang/Object;)V"]
    assert "bracket" in rows.where("file = 'bad.java'").first().error and rows.where("file = 'empty.java'").count() == 0
    facts = mappers.java_source(rows, mappers.Context())
    assert facts.where("relation_type = 'CALLS' and target_identity_id like '%Shelf#lift(Ljava/lang/Object;)V'").count() == 1


def test_methods_of_all_files_are_never_broadcast(spark, sf):
    files = spark.createDataFrame([(f"a/{k}.java", f"package p; class A{k} {{ void f(int a) {{ B{k}.g(a); }} }} class C{k} {{ static void h(long x) {{ }} }}") for k in range(20)] + [(f"b/{k}.java", f"package p; class B{k} {{ static void g(long x) {{ }} }}") for k in range(0, 20, 2)], "path string, content string")
    rows = analyse(files, java.flows, java.TRACES)
    found = java.flow_rows(rows, rows, "web")
    assert sorted((x.owner, x.target_owner, x.target_type) for x in found.collect()) == sorted((f"p.A{k}", f"p.B{k}", "J") for k in range(0, 20, 2))
    calls = java.java_rows(files).where("kind = 'call'")
    assert {x.target_owner: x.target_descriptor for x in calls.collect()} == {f"p.B{k}": None if k % 2 else "(J)V" for k in range(20)}
    for df in (found, calls, registered.QUERIES["variable_facts"](spark, sf), registered.QUERIES["java_facts"](spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["variable_facts", "java_facts"])
def test_each_file_is_read_once(spark, sf, name):
    assert "MapInArrow" not in registered.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_spring_parts():
    text = """package p; @RestController @RequestMapping(method = RequestMethod.GET) class A {
      @Inject B b; @Resource(name="x") C[] c; A(B b, int n) { } @Autowired void set(D d) { }
      @PatchMapping void one() { } @org.springframework.web.bind.annotation.RequestMapping(path = {"/x", "y"}, method = POST) void two(java.util.List<String> l) { } @Other void three() { } }
      @Component class E { E() { } E(B b) { } } @Controller class F { @RequestMapping("/all") void all() { } } class G { @GetMapping("/no") void no() { } @Autowired int z; }"""
    got = rows_of(java.spring, text, "kind", "owner", "method", "component", "type", "method_paths", "http_methods")
    assert [x[1:4] for x in got if x[0] == "component"] == [("p.A", None, "REST_CONTROLLER"), ("p.E", None, "COMPONENT"), ("p.F", None, "CONTROLLER")]
    assert [x[1:5] for x in got if x[0] == "injection"] == [("p.A", "b", "FIELD", "p.B"), ("p.A", "c", "FIELD", "p.C[]"), ("p.A", "<init>", "CONSTRUCTOR", "p.B"), ("p.A", "<init>", "CONSTRUCTOR", "int"), ("p.A", "set", "METHOD", "p.D"), ("p.G", "z", "FIELD", "int")]
    assert [(x[2], x[5], x[6]) for x in got if x[0] == "route"] == [("one", [""], ["GET", "PATCH"]), ("two", ["/x", "y"], ["GET", "POST"]), ("all", ["/all"], java.ALL_VERBS)]


def test_jdbc_statements():
    text = '''package p; import java.sql.*; import java.sql.Connection; import java.sql.Statement; import java.sql.PreparedStatement;
    class Q { Connection con; final String shared = "x";
      void run(Connection c, String name) throws Exception {
        final String from = " from bin";
        String loose = "select 1";
        PreparedStatement a = c.prepareStatement("select *" + (from + " where n = ?"));
        a.setString(1, name); a.setInt(2, 3); a.setNull(0, 1); a.setInt(i, 3); other.setInt(3, 4);
        Statement s = con.createStatement();
        s.executeUpdate("""
            delete from bin
             where n = 1""");
        s.execute(loose); s.executeQuery("select " + name); c.prepareCall("{call p()}"); name.execute("select 2"); prepareStatement("select 3");
        this.con.prepareStatement("select 4");
      } }'''
    got = rows_of(java.jdbc, text, "sql", "parameter", "method")
    assert got == [("select * from bin where n = ?", 1, "run"), ("select * from bin where n = ?", 2, "run"), ("delete from bin\n where n = 1", None, "run"), ("{call p()}", None, "run"), ("select 4", None, "run")]


def test_jpa_entities():
    text = 'package p; @Entity @Table(schema = "wh", name = " T_BIN ") class Bin { @Id @Column(name = "BIN_ID", nullable = false) Long id; String label; static int n; @Transient int x; transient int y; int[] codes; } @Entity class Plain { String a; } class No { String b; }'
    got = rows_of(java.jpa, text, "owner", "table_name", "field", "column_name", "type")
    assert got == [("p.Bin", "T_BIN", None, None, None), ("p.Bin", "T_BIN", "id", "BIN_ID", "Ljava/lang/Long;"), ("p.Bin", "T_BIN", "label", "label", "Ljava/lang/String;"), ("p.Bin", "T_BIN", "codes", "codes", "[I"), ("p.Plain", "Plain", None, None, None), ("p.Plain", "Plain", "a", "a", "Ljava/lang/String;")]


def test_variable_traces():
    text = """package p; class V { void act(HttpServletRequest request, BinActionForm form, int n) {
        String raw = request.getParameter("code");
        String again = raw;
        again = again;
        String title = form.getTitle();
        Shelf shelf = new Shelf();
        shelf.setName(title);
        keep(again, n);
        int m = n; m = m + 1;
        keep("x", m);
        again = "new";
        keep(again, 1);
        request.setAttribute("out", raw);
        if (form.isOpen()) { String note = (String) form.get("note"); }
      } void keep(String s, int k) { } }"""
    got = list(java.traces("V.java", text))
    of = lambda kind, *columns: [tuple(x.get(c) for c in columns) for x in got if x["kind"] == kind]
    assert of("request", "property", "name", "variable", "source") == [("getParameter", "code", "", ""), ("setAttribute", "out", "raw", "raw")]
    assert of("form", "object", "property", "type") == [("form", "title", "p.BinActionForm"), ("form", "open", "p.BinActionForm"), ("form", "note", "p.BinActionForm")]
    assert of("bean", "object", "property", "name", "variable", "source") == [("form", "title", "shelf", "name", "title")]
    assert of("request_argument", "target_method", "target_index", "name", "target_descriptor") == [("keep", 0, "code", "(Ljava/lang/String;I)V"), ("setAttribute", 1, "code", None)]
    assert of("parameter_argument", "target_method", "target_index", "index", "type") == [("keep", 1, 2, "I")]
    assert ("again", "raw", "raw") in of("def", "variable", "source", "name") and ("m", "n", "n") in of("def", "variable", "source", "name") and ("m", "m", "m") in of("def", "variable", "source", "name")


def test_long_files_take_time_in_proportion():
    body = "".join(f"@Mark(a = {{1, 2}}) int m{k}(int a) {{ final String s{k} = \"x\"; int b = a; b = this.m{k}(b).n().o(a, b); return b; }}\n" for k in range(3000))
    began = time.perf_counter()
    for reader in (java.java, java.spring, java.jdbc, java.jpa, java.traces):
        list(reader("L.java", f"class L {{ {body} }}"))
    assert time.perf_counter() - began < 20


def test_bytecode_is_what_javap_says(tmp_path):
    """Members and calls of compiled classes, against the disassembler's text."""
    (tmp_path / "Store.java").write_text("""package q; import java.util.*; public class Store implements Runnable { static long total; private final int[] xs = new int[3];
      public void run() { switch (xs.length) { case 1: helper("a", 2L); break; case 2: System.out.println(); break; case 900: total++; } wide(); }
      private static String helper(String s, long n) { Runnable r = () -> s.trim(); r.run(); return s + n; }
      native int low(); void wide() { int a = 0; for (int k = 0; k < 70000; k++) a += k; a += 1000; List.of(a).size(); } }""")
    subprocess.run(["javac", "-g", "-d", str(tmp_path), str(tmp_path / "Store.java")], check=True, timeout=120)
    found = bytecode.read("q/Store.class", (tmp_path / "q" / "Store.class").read_bytes())
    told = subprocess.run(["javap", "-c", "-p", "-s", str(tmp_path / "q" / "Store.class")], check=True, capture_output=True, text=True, timeout=120).stdout
    calls = {(x["target_owner"], x["target_method"], x["target_descriptor"]) for x in found if x["kind"] == "call" and "$" not in x["method"]}
    for owner, name, descriptor in calls:
        inside = "" if owner == "q.Store" else f"{owner.replace('.', '/')}."
        shown = f'"{name}"' if name == "<init>" else name
        assert f"Method {inside}{shown}:{descriptor}" in told, (owner, name)
    assert ("q.Store", "helper", "(Ljava/lang/String;J)Ljava/lang/String;") in calls and ("java.util.List", "size", "()I") in calls
    assert [x["interfaces"] for x in found if x["kind"] == "class"] == [["java.lang.Runnable"]] and {x["method"] for x in found if x["kind"] == "field"} == {"total", "xs"}
    assert {x["method"] for x in found if x["kind"] == "method"} == {"<init>", "run", "helper", "low", "wide"} and told.count("descriptor: ") >= 7
    assert next(x for x in found if x.get("method") == "low")["modifiers"] == ["native"] and next(x for x in found if x.get("method") == "run" and x["kind"] == "method")["line"] == 2
    assert "error" in bytecode.read("x.class", b"\xca\xfe\xba\xbe\0")[0] and "error" in bytecode.read("x.class", b"text")[0] and "error" in bytecode.read("x.jar", b"text")[0]


def test_jars_are_read_whole(spark):
    import pyspark

    jar = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "commons-lang3*.jar"))
    if not jar:
        pytest.skip("no jar at hand")
    rows = bytecode.bytecode_rows(spark.read.format("binaryFile").load(f"file://{jar[0]}"))
    with zipfile.ZipFile(jar[0]) as z:
        n = sum(x.endswith(".class") for x in z.namelist())
    assert rows.where("error is not null").count() == 0 and rows.where("kind = 'class'").count() == n
    assert rows.where("kind = 'call' and owner = 'org.apache.commons.lang3.BooleanUtils' and target_owner = owner").count() > 10


def test_diagnostics_of_source_files(spark):
    files = spark.createDataFrame([("a", 'class A { String s = "unclosed; }'), ("b", "}")], "path string, content string")
    assert analyse(files, java.spring, java.SPRING).where("error is not null").count() >= 1
