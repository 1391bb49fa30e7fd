import zipfile

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import analyzers, html, joins, jsp, mappers, sqlscan, workspace


def scanned(sql):
    got = sqlscan.scan(sql)
    return {(t, a) for t, c, a, _ in got if c is None}, {(t, c, a) for t, c, a, _ in got if c is not None}, any(x[3] for x in got)


def test_sql():
    assert scanned("select u.id, o.total from users u join shop.orders as o on o.user_id = u.id where u.name = ?") == ({("users", "READ"), ("shop.orders", "READ")}, {("users", "id", "READ"), ("shop.orders", "total", "READ"), ("shop.orders", "user_id", "READ"), ("users", "name", "READ")}, False)
    assert scanned("SELECT id, name AS n, count(x) FROM users WHERE status IN (?) AND age >= 3 ORDER BY id") == ({("users", "READ")}, {("users", c, "READ") for c in ("id", "name", "status", "age")}, False)
    assert scanned("select * from a x, b y where x.i = y.j")[0] == {("a", "READ"), ("b", "READ")}
    assert scanned("insert into logs (a, b) select p, q from src where r = 1") == ({("logs", "WRITE"), ("src", "READ")}, {("logs", "a", "WRITE"), ("logs", "b", "WRITE")}, False)
    assert scanned("update t set a = f(x, y), b = 2 where c = 1") == ({("t", "WRITE")}, {("t", "a", "WRITE"), ("t", "b", "WRITE"), ("t", "c", "READ")}, False)
    assert scanned("delete from t where id in (select id from gone)")[0] == {("t", "WRITE"), ("gone", "READ")}
    assert scanned("with c as (select id from base) select id from c")[0] == {("base", "READ")}
    assert scanned("select a from t where (b = 1") == ({("t", "READ")}, set(), True)
    assert scanned("select 'from x' from t -- from y\n where a = 'b''c'")[0] == {("t", "READ")}
    assert sqlscan.scan("vacuum t") == [] and sqlscan.scan(None) == []


def test_sql_rows(spark):
    rows = spark.createDataFrame([("s1", "<if test='x'>SELECT id FROM users</if> WHERE id = #{id}", False), ("s2", "SELECT id FROM t", True)], "statement string, sql string, unsure boolean")
    got = sqlscan.accesses(rows, fallback="unsure").collect()
    assert {(x.statement, x.table_name, x.column_name, x.fallback) for x in got} == {("s1", "users", None, False), ("s1", "users", "id", False), ("s2", "t", None, True)}
    facts = mappers.sql_accesses(sqlscan.accesses(rows).withColumn("statement", F.concat(F.lit("sql-statement://shop/_root/r/x#"), "statement")), mappers.Context())
    assert {x.relation_type for x in facts.collect()} == {"READS_TABLE", "READS_COLUMN"} and facts.where("relation_family <> 'DATABASE'").count() == 0


PAGE = """<html><!-- <form action="no"> -->
<form action="/crates/put.do" method="post"><input name="crate"><input type="hidden" name="id"/><select name='label'></select></form>
<input name="loose"><a href="shelf.html?x=1">n</a><a href="#in">i</a>
<script src="code/desk.js"></script><script>
// fetch('/no')
fetch('/feed/crates', {method: 'POST'}); var s = "<a href='no'>";
</script>
<script type="text/x-panel"><a href="panel.html"></a></script>
<button onclick="location.href='/leave.do'">x</button><b onclick="fetch('/feed/beat')">y</b></html>"""


def test_html(spark):
    rows = html.analyse("web/index.html", PAGE)
    assert [(r[1], r[4], r[5], r[6]) for r in rows if r[1] != "page"] == [
        ("form", "/crates/put.do:post:2:0", "/crates/put.do", "post"), ("input", "crate", "text", ""), ("input", "id", "hidden", ""), ("input", "label", "select", ""), ("input", "loose", "text", ""), ("link", "", "shelf.html?x=1", ""), ("link", "", "#in", ""),
        ("script", "", "code/desk.js", ""), ("request", "", "/feed/crates", "POST"), ("event", "onclick", "/leave.do", "NAVIGATES_TO"), ("event", "onclick", "/feed/beat", "GET"),
    ]
    df = html.html_rows(spark.createDataFrame([("web/index.html", PAGE), ("e.html", None)], "path string, html string"))
    facts = html.html_facts(df, mappers.Context(root="src/main/webapp")).collect()
    by = {}
    for x in facts:
        by.setdefault(x.relation_type, set()).add(x.target_identity_id)
    assert by["SUBMITS_TO"] == {"action-path://shop/_root/_actions/crates/put"}
    assert by["NAVIGATES_TO"] == {"html-page://shop/_root/src/main/webapp/web/shelf.html", "action-path://shop/_root/_actions/leave"}
    assert by["CALLS_HTTP"] == {"api-endpoint://shop/_root/_api/POST:/feed/crates", "api-endpoint://shop/_root/_api/GET:/feed/beat"}
    assert by["LOADS_SCRIPT"] == {"script-resource://shop/_root/src/main/webapp/web/code/desk.js"}
    assert by["BINDS_TO"] == {f"request-param://shop/_root/src/main/webapp/{n}" for n in ("crate", "id", "label")} and len(by["RENDERS_INPUT"]) == 3
    assert len({x.fact_key for x in facts}) == len(facts) and mappers.evidence_of(html.html_facts(df, mappers.Context())).count() > 3


def test_mybatis(spark):
    xml = '<?xml version="1.0"?>\n<!DOCTYPE mapper PUBLIC "-//x//DTD Mapper" "http://x">\n<mapper namespace="a.B">\n<sql id="cols">id, name<include refid="cols"/></sql>\n<select id="find">select <include refid="cols"/> from users <where><if test="x">id = #{id}</if></where></select>\n<delete id="gone">delete from users</delete></mapper>'
    got = {x.statement_id: x for x in analyzers.analyse(spark.createDataFrame([("B.xml", xml), ("bad.xml", "<mapper"), ("o.xml", "<other/>")], "path string, content string"), analyzers.mybatis, analyzers.MYBATIS).collect()}
    assert got["find"].sql == "select id, name from users id = #{id}" and got["find"].dynamic and not got["gone"].dynamic and got["gone"].line == 6
    assert got[None].file == "bad.xml" and "ParseError" in got[None].error


def test_other_xml(spark):
    struts = '<struts-config><form-beans><form-bean name="f" type="a.F"><form-property name="p" type="String"/></form-bean></form-beans><global-forwards><forward name="g" path="/g.jsp"/></global-forwards><action-mappings><action path="/save" type="a.SaveAction" name="f"><forward name="ok" path="/ok.jsp"/><forward name="next" path="/next.do"/></action><action path="/d" type="a.MyDispatchAction" parameter="method"/></action-mappings><plug-in className="a.P"/></struts-config>'
    rows = analyzers.analyse(spark.createDataFrame([("s.xml", struts)], "path string, content string"), analyzers.struts, analyzers.STRUTS)
    assert {(x.kind, x.dispatch) for x in rows.where("kind = 'action'").collect()} == {("action", "none"), ("action", "dispatch")}
    facts = mappers.struts_actions(rows.where("kind = 'action'"), mappers.Context()).collect()
    assert {(x.relation_type, x.target_identity_id) for x in facts} >= {("FORWARDS_TO", "jsp-page://shop/_root/src/main/webapp/ok.jsp"), ("FORWARDS_TO", "action-path://shop/_root/_actions/next"), ("ROUTES_TO", "method://shop/_root/src/main/java/a.SaveAction#execute"), ("DECLARES_ENTRYPOINT", "entrypoint://shop/_root/_entrypoints/struts/save")}
    dicon = '<components namespace="app"><include path="base.dicon"/><component name="svc" class="a.Svc"><property name="dao">x</property><aspect>tx</aspect></component><component class="a.LogInterceptor"/></components>'
    d = analyzers.analyse(spark.createDataFrame([("app.dicon", dicon)], "path string, content string"), analyzers.dicon, analyzers.DICON)
    assert sorted(x.kind for x in d.collect()) == ["aspect", "component", "component", "include", "interceptor", "namespace", "property"]
    assert {x.relation_type for x in mappers.dicon_components(d, mappers.Context()).collect()} == {"DECLARES", "INCLUDES", "AUTO_BINDS_TO", "CONFIGURES_PROPERTY", "INTERCEPTS"}
    web = '<web-app xmlns="http://x"><servlet><servlet-name>a</servlet-name><servlet-class>A</servlet-class><init-param><param-name>config/m</param-name><param-value>/a.xml, /b.xml</param-value></init-param></servlet><servlet-mapping><servlet-name>a</servlet-name><url-pattern>*.do</url-pattern></servlet-mapping><jsp-config><jsp-property-group><url-pattern>*.jsp</url-pattern><page-encoding>UTF-8</page-encoding></jsp-property-group></jsp-config></web-app>'
    w = analyzers.analyse(spark.createDataFrame([("web.xml", web)], "path string, content string"), analyzers.web_xml, analyzers.WEB_XML)
    assert {(x.kind, x.name, x.value) for x in w.collect()} == {("servlet", "a", "A"), ("struts-config", "m", "/a.xml"), ("struts-config", "m", "/b.xml"), ("servlet-mapping", "a", "*.do"), ("page-encoding", "*.jsp", "UTF-8")}
    svf = '<report name="r1"><field name="total" column="orders.total"/><field name="note"/><parameter name="p"/></report>'
    r = analyzers.analyse(spark.createDataFrame([("x.svf.xml", svf), ("x.txt", "")], "path string, content string"), analyzers.report, analyzers.REPORT)
    assert {(x.format, x.kind, x.name, x.table_name, x.column_name) for x in r.collect()} == {("svf", "field", "total", "orders", "total"), ("svf", "field", "note", None, None), ("svf", "parameter", "p", None, None)}
    assert {x.relation_type for x in mappers.report_definitions(r, mappers.Context()).collect()} == {"CONTAINS", "MAPS_TO_COLUMN", "READS_TABLE", "READS_COLUMN"}


def test_jsp(spark):
    page = '<%@ page import="a.B" %>\n<%-- <form action="no"> --%><%@ include file="h.jsp" %>\n<html:form action="/crates/put.do" method="post"><html:text property="crate"/><input type="hidden" name="id"></html:form>\n<jsp:forward page="/shelf.jsp"/><% request.getParameter("q"); %>${param.z}<%@ taglib prefix="c" uri="http://c" %>'
    rows = analyzers.analyse(spark.createDataFrame([("web/a.jsp", page)], "path string, content string"), jsp.jsp, jsp.JSP)
    got = {(x.kind, x.name, x.value) for x in rows.collect()}
    assert {("include", "directive", "h.jsp"), ("input", "crate", "text"), ("input", "id", "hidden"), ("forward", "jsp:forward", "/shelf.jsp"), ("param", "q", ""), ("param", "z", ""), ("taglib", "c", "http://c"), ("directive", "page", "import=a.B")} <= got
    facts = {(x.relation_type, x.target_identity_id) for x in mappers.jsp_pages(rows, mappers.Context()).collect()}
    assert {("SUBMITS_TO", "action-path://shop/_root/_actions/crates/put"), ("FORWARDS_TO", "jsp-page://shop/_root/src/main/webapp/shelf.jsp"), ("INCLUDES", "jsp-page://shop/_root/src/main/webapp/web/h.jsp"), ("READS_REQUEST_PARAM", "request-param://shop/_root/src/main/webapp/q")} <= facts


def test_java_mappers(spark):
    x = mappers.Context()
    rows = spark.createDataFrame(
        [("class", "A.java", 1, "a.A", None, None, None, None, None, None, None, False), ("method", "A.java", 3, "a.A", "main", "([Ljava/lang/String;)V", [], ["static"], None, None, None, False), ("method", "A.java", 5, "a.A", "tick", "()V", ["org.Scheduled"], [], None, None, None, True), ("call", "A.java", 6, "a.A", "main", "([Ljava/lang/String;)V", [], [], "a.B", "go", "()V", False), ("call", "A.java", 7, "a.A", "main", "([Ljava/lang/String;)V", [], [], "a.B", "go", "()V", False), ("call", "A.java", 8, "a.A", "main", "()V", [], [], "x.Y", "no", None, False), ("field", "A.java", 2, "a.A", "f", None, None, None, None, None, None, False)],
        "kind string, file string, line int, owner string, method string, descriptor string, annotations array<string>, modifiers array<string>, target_owner string, target_method string, target_descriptor string, no_classpath boolean",
    )
    got = mappers.java_source(rows, x).collect()
    assert sorted(r.relation_type for r in got) == ["CALLS", "DECLARES", "DECLARES", "DECLARES", "DECLARES", "DECLARES_ENTRYPOINT", "DECLARES_ENTRYPOINT"]
    assert next(r for r in got if r.relation_type == "CALLS").location == "line:6" and any(r.confidence == "LIKELY" for r in got)
    routes = spark.createDataFrame([("A.java", 1, "a.A", "get", "()V", ["/api"], ["/{id:\\d+}", "/all"], ["GET", "POST"])], "file string, line int, owner string, method string, descriptor string, class_paths array<string>, method_paths array<string>, http_methods array<string>")
    assert {r.source_identity_id for r in mappers.spring_routes(routes, x).where("relation_type = 'ROUTES_TO'").collect()} == {f"api-endpoint://shop/_root/_api/{m}:/api/{p}" for m in ("GET", "POST") for p in ("{id}", "all")}
    native = spark.createDataFrame([("A.java", 1, "a.A", "n", "()V", True, None), ("A.java", 2, "a.A", "init", "()V", False, "lib1")], "file string, line int, owner string, method string, descriptor string, is_native boolean, loads string")
    assert {r.relation_type for r in mappers.native_methods(native, x).collect()} == {"HAS_NATIVE_BOUNDARY", "CALLS_NATIVE"}
    jdbc = spark.createDataFrame([("A.java", 1, "a.A", "q", "()V", "s1", 1), ("A.java", 1, "a.A", "q", "()V", "s1", 2)], "file string, line int, owner string, method string, descriptor string, statement_id string, parameter int")
    assert sorted(r.relation_type for r in mappers.jdbc_statements(jdbc, x).collect()) == ["BINDS_TO", "HAS_PARAM", "HAS_PARAM"]
    jpa = spark.createDataFrame([("A.java", 1, "a.A", "users", None, None), ("A.java", 2, "a.A", "users", "id", "id")], "file string, line int, owner string, table_name string, field string, column_name string")
    assert {r.relation_type for r in mappers.jpa_entities(jpa, x).collect()} == {"BINDS_TO", "MAPS_TO_COLUMN"}
    flow = spark.createDataFrame([("A.java", 1, "web", "q", None, None, None, None, None, "a.B", "go", "(I)V", 0, "I"), ("A.java", 2, "web", None, "a.A", "m", "(I)V", 0, "I", "a.B", "go", "(I)V", 0, "I")], "file string, line int, scope string, parameter string, owner string, method string, descriptor string, index int, type string, target_owner string, target_method string, target_descriptor string, target_index int, target_type string")
    assert {r.source_identity_id.split("://")[0] for r in mappers.variable_flows(flow, x).collect()} == {"request-param", "param-slot"}
    bound = joins.mapper_bindings(spark.createDataFrame([("a.M", "f", "M.xml", 1)], "namespace string, statement_id string, file string, line int"), spark.createDataFrame([("a.M", "f", "()V"), ("a.M", "g", "()V"), ("a.M", "g", "(I)V")], "owner string, method string, descriptor string"))
    assert mappers.mybatis_bindings(bound, x).first().target_identity_id == "sql-statement://shop/_root/src/main/resources/M.xml#f"


def test_workspace(spark, tmp_path):
    made = {"app/pom.xml": "<p/>", "app/src/main/java/A.java": "class A { public static void main(String[] a) {} }", "app/src/main/webapp/i.jsp": '<form action="/x">', "app/lib/l.jar": None, "cob/p.cbl": "PROGRAM-ID. PAY1.", "raw/x.bin": "?", "top.sh": "java -jar a.jar\nmvn x", "app/src/main/java/bad.java": b"\xff\xfe\xfa"}
    for p, text in made.items():
        f = tmp_path / "w" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            zipfile.ZipFile(f, "w").close()
        else:
            f.write_bytes(text if isinstance(text, bytes) else text.encode())
    files = workspace.inventory(spark, f"file://{tmp_path}/w").cache()
    by = {x.path: x for x in files.collect()}
    assert set(by) == set(made) and by["app/src/main/java/bad.java"].diagnostic == "DECODE_FAILED" and by["app/lib/l.jar"].diagnostic == "BINARY" and by["raw/x.bin"].level == "L5_SKIPPED"
    reviewed = workspace.review(files).cache()
    got = {x.root: x for x in reviewed.collect()}
    assert got["app"].layout_type == "MAVEN" and got["app"].status == "READY" and got["app"].source_roots == ["app/src/main/java"] and got["app"].web_roots == ["app/src/main/webapp"]
    assert got["cob"].status == "BOUNDARY_ONLY"
    assert {(x.path, x.kind) for x in workspace.clues(files).collect()} >= {("app/src/main/java/A.java", "MAIN_METHOD"), ("app/src/main/webapp/i.jsp", "HTML_FORM"), ("top.sh", "SHELL_JAVA_COMMAND"), ("top.sh", "BUILD_SCRIPT"), ("app/pom.xml", "BUILD_SCRIPT")}
    assert ("cob/p.cbl", "PAY1") in {(x.path, x.symbol) for x in workspace.boundaries(files).collect()}
    assert {(x.severity, x.code) for x in workspace.gate(files, reviewed, True, "a/x.tar").collect()} == {("BLOCKING", "UNREADABLE_PATH"), ("BLOCKING", "UNSAFE_ARCHIVE")}
    assert workspace.gate(files, reviewed, False).count() == 0
    scopes = {x.root: x.disposition for x in workspace.decide_scopes(reviewed, shared=["ext"]).collect()}
    assert scopes["app"] == "INCLUDED" and scopes["cob"] == "UNANALYZABLE" and scopes["ext"] == "SHARED_LIBRARY"
    assert {(x.root, x.analyzer) for x in workspace.recommended(files, reviewed).collect()} >= {("app", "java-source"), ("app", "java-bytecode"), ("app", "jsp-web"), ("cob", "boundary")}
    assert workspace.confirmation_items(reviewed, files, True).count() > 1 and workspace.confirmation_items(reviewed, files, False).count() == 0
    adapters = {"svf": F.col("path").endswith(".svf.xml"), "xml": F.col("path").endswith(".xml")}
    assert [(x.path, x.format) for x in workspace.definition_files(files, adapters, ["target"], 3, 1).collect()] == [("app/pom.xml", "xml")]


def test_roots_and_files(spark):
    cases = {"src/main/java/A.java": ".", "m/src/A.java": "m", "m/lib/a.jar": "m", "m/target/classes/A.class": "m", "WEB-INF/web.xml": ".", "s/web/WEB-INF/web.xml": "s", "a/b.txt": "a", "b.txt": ".", "x/build/libs/a.jar": "x", "w/WEB-INF/lib/a.jar": "."}
    df = spark.createDataFrame([(x,) for x in cases], "path string")
    assert {x.path: x.r for x in df.select("path", workspace.project_root(F.col("path")).alias("r")).collect()} == cases
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    paths = spark.createDataFrame([("a/b/c/x",), ("a/x",), ("z/y",), ("q",)], "path string")
    assert {x.path: x.root for x in joins.owner_roots(paths, roots).collect()} == {"a/b/c/x": "a/b", "a/x": "a", "z/y": "z", "q": "."}
    old = spark.createDataFrame([("A.java", "1"), ("B.java", "2")], "path string, sha256 string")
    new = spark.createDataFrame([("A.java", "1"), ("B.java", "3"), ("C.txt", "1")], "path string, sha256 string")
    assert {x.path: x.cached for x in joins.changed_files(new, old).collect()} == {"A.java": True, "B.java": False, "C.txt": False}
    assert joins.changed_java(new, new.select("path")).count() == 2
    calls = spark.createDataFrame([(1, "o", "m", ""), (2, "o", "m", "(J)V"), (3, "o", "x", "")], "call_id int, target_owner string, target_method string, signature string")
    methods = spark.createDataFrame([("o", "m", "(I)V", 1), ("o", "m", "(J)V", 2)], "owner string, method string, descriptor string, ord int")
    assert {x.call_id: x.target_descriptor for x in joins.resolve_calls(calls, methods).collect()} == {1: "(I)V", 2: "(J)V", 3: None}
    classes = spark.createDataFrame([("a.M", True, ["x.Mapper"]), ("a.N", True, []), ("a.O", True, []), ("a.P", False, ["Mapper"])], "owner string, is_interface boolean, annotations array<string>")
    assert {x.owner for x in joins.mapper_interfaces(classes, spark.createDataFrame([("a.N",), ("a.P",)], "namespace string")).collect()} == {"a.M", "a.N"}


def test_unreadable_reader_rows_are_kept(spark):
    def reader(path, text):
        raise ValueError("nope")
        yield {}

    got = analyzers.analyse(spark.createDataFrame([("p", "x")], "path string, content string"), reader, "a string").first()
    assert (got.file, got.error, got.a) == ("p", "ValueError: nope", None)
    assert pytest


@pytest.mark.parametrize(
    ("js", "want"),
    [
        ("fetch('/a')", [("GET", "/a")]),
        ("api.fetch('/no'); window.fetch('/a'); x.window.fetch('/no'); self . fetch(`/b`)", [("GET", "/a"), ("GET", "/b")]),
        ("fetch('/a/' + id); fetch(url); fetch(`/a/${id}`); fetch('/a'.concat(b))", []),
        ("fetch('/a', {method: 'put'}); fetch('/b', { headers: {method: 'X'}, 'method' : `delete` , })", [("PUT", "/a"), ("DELETE", "/b")]),
        ("fetch('/a', options); fetch('/b', {...base, method: 'POST'}); fetch('/c', {method: verb}); fetch('/d', {method: 'A' + b}); fetch('/e', {method})", []),
        ("fetch('/a', {body: `x ${y} method: 'PUT'`, method: 'POST'})", [("POST", "/a")]),
        ("fetch(\n  // a comment )\n  '/a', /* { */ {\n body: f({q: [1, 2]}),\n method: 'PATCH'\n })", [("PATCH", "/a")]),
        ("fetch /* why */ ('/a',)", [("GET", "/a")]),
        ("var s = \"fetch('/no')\"; // fetch('/no')\n/* fetch('/no') */ prefetch('/no'); fetch('/a\\'b')", [("GET", "/a'b")]),
        ("fetch('')", [("GET", "?")]),
        ("const t = '</script>'; fetch('/a')", [("GET", "/a")]),
    ],
)
def test_requests_of_scripts(js, want):
    assert [x[1:] for x in html.Script(js).requests()] == want


def test_pages_by_case():
    def rows(page, kind, path="a/b.html"):
        return [(r[4], r[5], r[6]) for r in html.analyse(path, page) if r[1] == kind]

    go = lambda code: rows(f'<button onclick="{code}">x</button>', "event")
    assert go("location.href='/x/' + id") == [] and go("state.location.href='/no'; window.location.href='/x'") == [("onclick", "/x", "NAVIGATES_TO")]
    assert go("// location.href='/no'\n location='/x'; document.location.replace(`/y`); window.open('/z', 'n')") == [("onclick", u, "NAVIGATES_TO") for u in ("/x", "/y", "/z")]
    assert go("fetch('/log'); location.href=''") == [("onclick", "?", "NAVIGATES_TO"), ("onclick", "/log", "GET")]
    assert go("if (a > b) { fetch('/c') }") == [("onclick", "/c", "GET")]
    assert rows("<p data-onclick=\"fetch('/no')\" title=\"onclick='fetch(1)'\">onclick='fetch(2)'</p><form ONSUBMIT=\"fetch('/x')\">", "event") == [("onsubmit", "/x", "GET")]
    assert rows("<p>fetch('/no')</p><script type='text/plain'>fetch('/no')</script><script src='x.js'>fetch('/no')</script><script type='module; x'>fetch('/a')</script >fetch('/no')", "request") == [("", "/a", "GET")]
    assert rows("<script>var x = '<form action=no><a href=no>';</script ><!-- <form action='no'> --><form-box action='no'><a-b href='no'><input-x name='no'><form\n action=/go\n METHOD=Post>", "form")[0][1:] == ("/go", "Post")
    assert [r[1] for r in rows("<form action='a > b' method=get></form ><form action=c>", "form")] == ["a > b", "c"]
    assert rows("<form action=x><textarea name=t></textarea><select NAME='s'></select><input name=u type=Hidden></form><input name=v>", "input") == [("t", "textarea", ""), ("s", "select", ""), ("u", "Hidden", ""), ("v", "text", "")]
    got = html.analyse("code/desk.JS", "var t = '</script><form action=no>';\nfetch('/a', {method: 'POST'});")
    assert [(r[1], r[2], r[5], r[6]) for r in got] == [("page", 1, "", ""), ("request", 2, "/a", "POST")]


@pytest.mark.parametrize(
    ("page", "kind", "want"),
    [
        ("<html:form action='/a'><html:text property='p'/></html:form ><form action=b><input name=q></form><input name=r type=Hidden>", "form", [("/a", "post"), ("b", "get")]),
        ("<html:form action='/a'><html:text property='p'/></html:form ><form action=b><input name=q></form><input name=r type=Hidden>", "input", [("text", ""), ("text", ""), ("Hidden", "")]),
        ("<jsp:include page='<%= x %>'/><jsp:include page=\"/h.jsp\" flush='true'/><c:import url='${u}'/>", "include", [("/h.jsp", "")]),
        ("<jsp:forward page='<%= x %>'/><c:redirect url='/x.jsp'/>", "forward", [("/x.jsp", "")]),
        ("<%-- <form action=no> --%><% out.print(\"<form action='no'>\"); %><!-- <form action=no> --><script>var s = '<form action=no>';</script><jsp:scriptlet>String f = \"<form action=no>\";</jsp:scriptlet><form\n action='a > b'\n>", "form", [("a > b", "get")]),
        ("<form-x action=no><formx action=no><inputs name=no><form:forms action=no><form action=yes>", "form", [("yes", "get")]),
        ("<% String s = \"<%@ include file='no.jsp' \"; %><%@\n include\n file = 'h.jspf' %>", "include", [("h.jspf", "")]),
        ("<%@ taglib prefix='t' tagdir='/WEB-INF/tags' %>", "taglib", [("/WEB-INF/tags", "")]),
    ],
)
def test_jsp_by_case(page, kind, want):
    assert [(r["value"], r["method"]) for r in jsp.jsp("a.jsp", page) if r["kind"] == kind] == want


def test_jsp_request_parameters():
    of = lambda page: [r["name"] for r in jsp.jsp("a.jsp", page) if r["kind"] == "param"]
    assert of('request.getParameter("no") <% // request.getParameter("no")\n/* request.getParameter("no") */ String s = "request.getParameter(1)"; request . getParameter("a"); %><%= request.getParameterValues("b") %>') == ["a", "b"]
    assert of("<script>var x = '${param.a}'; </script>${empty param['b'] ? 1 : param[\"c\"]} <%-- ${param.no} --%><% String s = \"${param.no}\"; %> param.no ${myparam.no} #{param.d}") == ["a", "b", "c", "d"]
    assert [r["line"] for r in jsp.jsp("a.jsp", "x\n<%\nrequest.getParameter(\"q\");\n%>") if r["kind"] == "param"] == [3]
