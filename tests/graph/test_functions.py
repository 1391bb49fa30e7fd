import hashlib

from pyspark.sql import functions as F

from ripplegraph.functions import ids, text, web
from ripplegraph.operators import analyzers


def one(spark, column, *values):
    names = [f"v{k}" for k in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names)).alias("x")).first().x


def test_keys(spark):
    want = "fact:" + hashlib.sha256(b"a\0b\0CALLS\0q\0").hexdigest()[:32]
    assert one(spark, ids.fact_key, "a", "b", "CALLS", "q") == want


def test_parse_and_validate(spark):
    cases = {
        "method://shop/core/src/main/java/com.A#run(I)V": ("SYMBOL_ID", "src/main/java", "com.A", "run(I)V"),
        "param-slot://shop/core/src/main/java/com.A#run(I)V:param[0:I]": ("FLOW_ID", "src/main/java", "com.A#run(I)V", "param[0:I]"),
        "method-summary://shop/core/src/main/java/a@b.C#m()V@v1": ("FLOW_ID", "src/main/java", "a@b.C#m()V", "v1"),
        "api-endpoint://shop/core/_api/GET:/users/{id}": ("SYMBOL_ID", "_api", "GET:/users/{id}", None),
        "api-endpoint://shop/core/_api/GET:/": ("SYMBOL_ID", "_api", "GET:/", None),
        "datasource://shop/main": ("SYMBOL_ID", "", "", None),
        "saved-query://shop/core/a/b": ("ARTIFACT_ID", "", "a/b", None),
        "request-param://shop/core/scope#name": ("FLOW_ID", "", "scope", "name"),
        "db-column://shop/ds/public/users#id": ("SYMBOL_ID", "public", "users", "id"),
    }
    df = spark.createDataFrame([(x,) for x in cases], "id string").select("id", ids.parse_symbol(F.col("id")).alias("p"), ids.symbol_errors(F.col("id")).alias("e"))
    for x in df.select("*", ids.canonical(F.col("p")).alias("c")).collect():
        assert (x.p.identity_type, x.p.source_root, x.p.owner_path, x.p.fragment) == cases[x.id], x.id
        assert x.e == [] and x.c == x.id
    bad = {
        "": "blank", "no-scheme": "scheme", "nope://a/b/c/d": "kind", "class://a/b/src/main/java/A#x": "fragment", "class://a/b/src/main/java/é": "unsafe", "class://a/b/src/main/java/a b": "unsafe", "class://a/b/../x/y": "relative",
        "class://a/b": "parts", "datasource://a/b/c": "parts", "class://a/b/src/main/java//A": "owner", "class://a/b/r/C:/x": "separator", "api-endpoint://a/b/_api/users": "separator", "class://a/b/c": "root", "class://a/b/r/x?y": "unsafe", "class://a\\b/c/d": "unsafe",
    }
    got = {x.id: x.e for x in spark.createDataFrame([(x,) for x in bad], "id string").select("id", ids.symbol_errors(F.col("id")).alias("e")).collect()}
    for k, v in bad.items():
        assert v in got[k], (k, got[k])


def test_small_id_functions(spark):
    assert one(spark, ids.table_of, "db-column://s/d/p/t#c") == "db-table://s/d/p/t"
    assert one(spark, ids.table_of, "db-column://s/d/p/t") == "db-table://s/d/p/t"
    assert one(spark, ids.owner_method, "param-slot://s/m/src/main/java/A#r(I)V:param[0:I]") == "method://s/m/src/main/java/A#r(I)V"
    assert one(spark, ids.owner_method, "method://x") == ""
    split = one(spark, ids.split_root, "core/src/main/java/com/A.java")
    assert (split.root, split.owner) == ("src/main/java", "com/A.java")
    assert one(spark, lambda p: ids.relative(p, "C:\\work"), "C:\\work\\src\\A.java") == "src/A.java"
    assert one(spark, lambda t: ids.sql_table("shop", "ds", "public", t), "PUBLIC.users") == "db-table://shop/ds/public/users"
    assert one(spark, lambda b, i, d: ids.slot("param-slot", b, "param[%s:%s]", i, d), "method://s/m/r/A#x(I)V", "0", "I") == "param-slot://s/m/r/A#x(I)V:param[0:I]"


def test_text(spark):
    assert one(spark, text.redact, "mail a.b@c.org token: abc; Bearer x.y") == "mail [REDACTED_EMAIL] token=[REDACTED_SECRET]; Bearer [REDACTED_SECRET]"
    assert one(spark, text.audit_redact, "bearer x secret=1") == "bearer x secret=[REDACTED_SECRET]"
    assert one(spark, text.tokenize, "Foo foo, BAR/é-x #1") == ["foo", "bar/", "-x", "#1"]
    assert one(spark, text.java_hash, "hello") == 99162322
    long = "polygenelubricants"
    h = 0
    for c in long:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert one(spark, text.java_hash, long) == h - (1 << 32) * (h >> 31)
    v = one(spark, lambda t: text.token_embedding(t, 8), "a b c")
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-12
    assert one(spark, lambda t: text.token_embedding(t, 4), "") == [0.0] * 4
    assert one(spark, text.cosine, [1.0, 0.0, 5.0], [1.0, 0.0]) == 1.0 and one(spark, text.cosine, [0.0], [1.0]) == 0.0
    assert one(spark, lambda t: text.decrypt_key(text.encrypt_key(t, b"k"), b"k"), "secret") == "secret"
    assert one(spark, text.snake_case, "SqlBranchCondition") == "sql_branch_condition"


def test_web(spark):
    assert one(spark, web.attributes, 'HREF="/a" href=\'b\' x=1 title="t > u"') == {"href": "/a", "x": "1", "title": "t > u"}
    page = "<!-- <a href=no> --><a href='/x'>x</a><script><a href=no></script><a  class=c href=\"y?z\">y</a><a href=''>n</a><area href=q>"
    assert one(spark, web.hrefs, page) == ["/x", "y?z"]
    for args, want in {
        ("a/b.html", "c.html?q#f"): "a/c.html", ("a/b.html", "../c/./d"): "c/d", ("a/b.html", "/x//y/"): "x/y", ("a/b.html", ""): "a/b.html", ("b.html", "?q"): "b.html", ("b.html", "http://h/p?q"): "http://h/p", ("b.html", "mailto:x"): "mailto:x", ("b.html", "../../x"): "x",
    }.items():
        assert one(spark, web.resolve, *args) == want, args
    assert one(spark, web.route, "https://h.x:80/a b?c") == "external/https/h.x-80/a-b" and one(spark, web.route, "//cdn/x.js") == "external/protocol-relative/cdn/x.js" and one(spark, web.route, "/") == "_root"
    assert one(spark, web.ascii_path, "für?x#y z") == "f%C3%BCr%3Fx%23y%20z"
    target = lambda p, h: web.navigation_target("shop", "m", "web", p, h)
    assert one(spark, target, "a/b.html", "c.htm") == "html-page://shop/m/web/a/c.htm"
    assert one(spark, target, "a/b.html", "/go.do?x=1") == "action-path://shop/m/_actions/go"
    assert one(spark, target, "a/b.html", "/api/x") == "api-endpoint://shop/m/_api/GET:/api/x"
    assert one(spark, lambda m: web.http_method(m), " post ") == "POST" and one(spark, web.http_method, "weird") == "GET"
    assert one(spark, web.join_paths, "/api/", "users/{id:\\d+}/") == "/api/users/{id}"
    assert [one(spark, web.is_navigable, x) for x in ("#a", "mailto:a", "http://a", "a/b", " ")] == [False, False, True, True, False]
    assert one(spark, web.is_executable, "", "text/javascript; charset=x") and not one(spark, web.is_executable, "a.js", "")


def test_descriptors(spark):
    assert one(spark, analyzers.type_descriptor, "java.util.Map<String, int[]>[]") == "[Ljava/util/Map;"
