"""Workspaces: file inventory, layout, clues, boundaries, review, import gate, scope decisions and task plans.

Files: path (relative), size, sha256, level, diagnostic[, content]. All of it is column functions and joins on derived
folders; only the inventory reads files, with Spark's own binary source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.joins import owner_roots, prefixes

# Capability levels by file name and extension, binary extensions, the size limit.
L1 = ".java .class .jar .xml .properties .yml .yaml .sql .jsp .jspx .tag .tagx".split()
L2 = ".sh .bat .cmd .ps1 .gradle .classpath .project .css".split()
L3 = ".exe .dll .so .a .lib .c .h .cpp .hpp .cbl .cob .cpy .jcl".split()
L4 = ".txt .md .csv .json .html .htm .js .png .jpg .jpeg .gif .svg .pdf .doc .docx .xls .xlsx .ppt .pptx".split()
BINARY = ".class .jar .exe .dll .so .a .lib .png .jpg .jpeg .gif .pdf .doc .docx .xls .xlsx .ppt .pptx".split()
BUILD_NAMES = "pom.xml build.xml build.gradle settings.gradle Makefile CMakeLists.txt".split()
MAX_BYTES = 20 * 1024 * 1024
# What marks a project's root, in the order asked.
STARTS = "src/main/java/ src/test/java/ src/main/resources/ src/test/resources/ src/ src/main/webapp/ WebRoot/ WebContent/ WEB-INF/".split()
WITHIN = "src/main/java/ src/test/java/ src/main/resources/ src/test/resources/ src/ src/main/webapp/ WebRoot/ WebContent/".split()
OUTPUT_STARTS = "target/classes/ target/test-classes/ build/classes/".split()
OUTPUT_WITHIN = "target/classes/ target/test-classes/ build/classes/ build/libs/ target/".split()
# Patterns of clues and boundaries.
FETCH = r"\b(?:fetch|axios\.(?:get|post|put|delete|patch))\s*\(\s*['\"]([^'\"]+)['\"]"
FORM_ACTION = r"(?i)<form\b[^>]*\baction\s*=\s*['\"]?([^'\" >]+)"
STRUTS_ACTION = r"(?i)<action\b[^>]*\bpath\s*=\s*['\"]([^'\"]+)['\"]"
JAVA_COMMAND = r"\bjava\s+(?:-jar\s+\S+|[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)"
COBOL = r"(?i)\bPROGRAM-ID\.\s*([A-Za-z0-9_-]+)"
JCL = r"(?i)\bPGM=([A-Za-z0-9_.$#@-]+)"
C_FUNCTION = r"\b[A-Za-z_][\w\s\*]*\s+([A-Za-z_][\w]*)\s*\([^;]*\)\s*\{"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"(\.[^.]*)$", 1))


def ends(path: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.lower(path).endswith(s)
    return out


def capability(path: Column, size: Column, max_bytes: int = MAX_BYTES) -> Column:
    e = extension(path)
    return (
        F.when(e.isin(".class", ".jar"), "L1_STRUCTURED")
        .when(size > max_bytes, "L5_SKIPPED")
        .when(name_of(path).isin(*BUILD_NAMES), "L2_SEMI_STRUCTURED")
        .when(e.isin(*L3), "L3_BOUNDARY")
        .when(e.isin(*L1), "L1_STRUCTURED")
        .when(e.isin(*L2), "L2_SEMI_STRUCTURED")
        .when(e.isin(*L4), "L4_INVENTORY")
        .otherwise("L5_SKIPPED")
    )


def diagnostic(path: Column, size: Column, level: Column, content: Column, max_bytes: int = MAX_BYTES) -> Column:
    return (
        F.when((level == "L5_SKIPPED") & (size > max_bytes), "FILE_TOO_LARGE")
        .when(level == "L5_SKIPPED", "UNSUPPORTED_FILE_TYPE")
        .when(extension(path).isin(*BINARY), "BINARY")
        .when(F.is_valid_utf8(content.cast("string")), "TEXT")
        .otherwise("DECODE_FAILED")
    )


def inventory(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below a folder. Spark skips what it can't read if spark.sql.files.ignoreCorruptFiles says so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", ""), f"^{base.replace('.', chr(92) + '.')}/", "")
    f = files.select(path.alias("path"), F.col("length").alias("size"), "content")
    f = f.withColumn("level", capability(F.col("path"), F.col("size"), max_bytes)).withColumn("diagnostic", diagnostic(F.col("path"), F.col("size"), F.col("level"), F.col("content"), max_bytes))
    text = F.when(F.col("diagnostic") == "TEXT", F.col("content").cast("string"))
    return f.select("path", "size", F.sha2("content", 256).alias("sha256"), "level", "diagnostic", text.alias("content"))


def definition_files(files: DataFrame, adapters: dict[str, Column], ignored, max_depth: int, max_files: int) -> DataFrame:
    """Report definitions with the first adapter (name -> test) that supports each; a bounded listing by path."""
    out = F.lit(None).cast("string")
    for name, test in reversed(adapters.items()):
        out = F.when(test, F.lit(name)).otherwise(out)
    deep = F.size(F.split("path", "/"))
    hidden = F.exists(F.split("path", "/"), lambda p: p.isin(*ignored)) if ignored else F.lit(False)
    return files.where((deep <= max_depth) & ~hidden).withColumn("format", out).where("format is not null").orderBy("path").limit(max_files)


# --- layout ---


def is_bytecode(path: Column) -> Column:
    return ends(path, ".jar", ".class")


def project_root(path: Column) -> Column:
    """The root of the project that a file belongs to."""
    top, parent = F.lit("."), F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    before = lambda marker: F.substring(path, F.lit(1), F.instr(path, f"/{marker}") - 1)
    within = lambda marker: F.instr(path, f"/{marker}") > 1
    web = F.substring(path, F.lit(1), F.instr(path, "/WEB-INF/") - 1)
    out = F.when(F.instr(path, "/WEB-INF/") > 1, F.when(F.instr(web, "/") > 0, F.regexp_replace(web, "/[^/]*$", "")).otherwise(top)).otherwise(parent)
    for m in reversed(WITHIN):
        out = F.when(within(m), before(m)).otherwise(out)
    for m in reversed(STARTS):
        out = F.when(path.startswith(m), top).otherwise(out)
    made = F.lit(None).cast("string")
    for m in ("target/", "build/libs/"):
        made = F.when(path.startswith(m), top).otherwise(made)
    for m in reversed(OUTPUT_WITHIN):
        made = F.when(within(m), before(m)).otherwise(made)
    for m in reversed(OUTPUT_STARTS):
        made = F.when(path.startswith(m), top).otherwise(made)
    made = F.when(path.startswith("lib/"), top).when(F.instr(path, "/lib/") > 1, before("lib/")).otherwise(made)
    under_web = path.startswith("WEB-INF/") | path.contains("/WEB-INF/")
    return F.when(is_bytecode(path) & ~under_web, F.coalesce(made, out)).otherwise(out)


def is_signal(path: Column, level: Column) -> Column:
    """Whether a file tells of a project: build files, code and web folders, bytecode and boundary files."""
    named = name_of(path).isin(*BUILD_NAMES, ".project", ".classpath")
    placed = path.rlike(r"(^|/)(src|WebRoot|WebContent|WEB-INF)/")
    return (level != "L5_SKIPPED") & (is_bytecode(path) | named | placed | (level == "L3_BOUNDARY"))


def layouts(files: DataFrame) -> DataFrame:
    """root, layout_type, source_roots, resource_roots, web_roots, classpath, evidence: a row a project."""
    path = F.col("path")
    f = files.where(is_signal(path, F.col("level"))).select("path", project_root(path).alias("root")).withColumn("name", name_of(path))
    below = F.when(F.col("root") == ".", path).otherwise(F.substring(path, F.length("root") + 2, F.lit(1_000_000)))
    f = f.withColumn("below", below)
    at = lambda child: F.when(F.col("below").startswith(f"{child}/"), F.when(F.col("root") == ".", F.lit(child)).otherwise(F.concat("root", F.lit(f"/{child}"))))
    resources = F.coalesce(at("src/main/resources"), at("src/test/resources"))
    inf = F.when(path.startswith("WEB-INF/"), F.lit(".")).when(F.instr(path, "/WEB-INF/") > 1, F.substring(path, F.lit(1), F.instr(path, "/WEB-INF/") - 1))
    webs = F.coalesce(at("src/main/webapp"), at("WebRoot"), at("WebContent"), inf)
    std = F.coalesce(at("src/main/java"), at("src/test/java"))
    source = F.coalesce(std, F.when(resources.isNull() & webs.isNull(), at("src")))
    kind = F.when(F.col("name").isin("build.gradle", "settings.gradle"), 1).when(F.col("name") == "pom.xml", 2).when(F.col("name") == "build.xml", 3).when(F.col("name").isin(".project", ".classpath"), 4)
    sets = lambda c: F.array_sort(F.collect_set(c))
    g = f.groupBy("root").agg(
        F.min(kind).alias("kind"),
        sets(source).alias("source_roots"),
        sets(resources).alias("resource_roots"),
        sets(webs).alias("web_roots"),
        sets(F.when((F.col("name") == ".classpath") | is_bytecode(path), path)).alias("classpath"),
        sets(F.when(kind.isNotNull(), path)).alias("evidence"),
    )
    shape = F.when(F.size("source_roots") > 0, "SOURCE_ONLY").otherwise("UNKNOWN_LEGACY")
    named = F.when(F.col("kind") == 1, "GRADLE").when(F.col("kind") == 2, "MAVEN").when(F.col("kind") == 3, "ANT_LIKE").when(F.col("kind") == 4, "ECLIPSE_IDE_ONLY").otherwise(shape)
    return g.select("root", named.alias("layout_type"), "source_roots", "resource_roots", "web_roots", "classpath", "evidence")


# --- clues and boundaries ---


def clues(files: DataFrame) -> DataFrame:
    """path, kind, value, source of what may start a program."""
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    one = lambda ok, kind, source, value="": F.when(ok, F.array(F.struct(F.lit(kind).alias("kind"), (F.lit(value) if isinstance(value, str) else value).alias("value"), F.lit(source).alias("source"))))
    many = lambda ok, kind, source, pattern: F.when(ok, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(source).alias("source"))))
    has = lambda *words: F.coalesce(F.greatest(*[text.contains(w) for w in (*words, words[0])]), F.lit(False))
    readable = (F.col("level") != "L5_SKIPPED") & (F.col("diagnostic") != "BINARY")
    java, jsp = readable & ends(path, ".java"), readable & ends(path, ".jsp", ".jspx")
    page, script = readable & ends(path, ".html", ".htm"), readable & ends(path, ".js")
    shell, struts = readable & ends(path, ".sh", ".bat", ".cmd", ".ps1"), readable & ends(path, "struts-config.xml")
    found = [
        one(name_of(path).isin("build.gradle", "settings.gradle", "pom.xml", "build.xml"), "BUILD_SCRIPT", "static-build-script", name_of(path)),
        one(java & has("static void main(", "static void main ("), "MAIN_METHOD", "java-main"),
        one(java & has("@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping"), "SPRING_REQUEST_MAPPING", "spring-mapping"),
        one(java & has("@Scheduled"), "SCHEDULER", "spring-scheduled"),
        one(java & has("@JmsListener", "@KafkaListener", "@RabbitListener", "@MessageMapping"), "MESSAGE_LISTENER", "message-listener"),
        many(struts, "STRUTS_ACTION", "struts-config", STRUTS_ACTION),
        one(jsp, "JSP_PAGE", "jsp"),
        many(jsp, "HTML_FORM", "jsp-form", FORM_ACTION),
        many(page, "HTML_FORM", "html-form", FORM_ACTION),
        many(script, "STATIC_JS_HTTP", "static-js", FETCH),
        one(shell & text.rlike(JAVA_COMMAND), "SHELL_JAVA_COMMAND", "shell-java"),
        one(shell & has("ant -f", "ant -buildfile", "mvn ", "gradle "), "BUILD_SCRIPT", "shell-build-command"),
    ]
    empty = F.array().cast("array<struct<kind:string,value:string,source:string>>")
    return files.select("path", F.explode(F.concat(*[F.coalesce(x, empty) for x in found])).alias("c")).select("path", "c.*")


def boundaries(files: DataFrame) -> DataFrame:
    """path, boundary, symbol, reason of what isn't analysed."""
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    base = F.regexp_replace(name_of(path), r"(?<!^)\.[^.]*$", "")
    first = lambda p: F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1)).otherwise(base)
    row = lambda kind, symbol, reason: F.struct(F.lit(kind).alias("boundary"), symbol.alias("symbol"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    b = (
        F.when(F.col("level") == "L5_SKIPPED", row("UNSUPPORTED", F.lit(""), F.col("diagnostic")))
        .when(ends(path, ".dll", ".so", ".a", ".lib", ".exe"), row("NATIVE", base, "native library boundary"))
        .when(ends(path, ".c", ".h", ".cpp", ".hpp"), row("C_BOUNDARY", first(C_FUNCTION), "C/C++ boundary"))
        .when(ends(path, ".cbl", ".cob", ".cpy"), row("COBOL_BOUNDARY", first(COBOL), "COBOL boundary"))
        .when(ends(path, ".jcl"), row("JCL_BOUNDARY", first(JCL), "JCL boundary"))
        .when(name_of(path).isin("Makefile", "CMakeLists.txt"), row("EXTERNAL", base, "external build boundary"))
    )
    return files.select("path", b.alias("b")).where("b is not null").select("path", "b.*")


JAVA_CLUES = ("MAIN_METHOD", "SPRING_REQUEST_MAPPING", "SCHEDULER", "MESSAGE_LISTENER")
WEB_CLUES = ("JSP_PAGE", "HTML_FORM", "STRUTS_ACTION", "STATIC_JS_HTTP")


def review(files: DataFrame) -> DataFrame:
    """root, layout_type, status, n_clues, n_boundaries, and the layout's roots: a row a project."""
    lay = layouts(files)
    roots = lay.select("root")
    c = owner_roots(clues(files), roots).groupBy("root").agg(F.count("*").alias("n_clues"), F.bool_or(F.col("kind").isin(*JAVA_CLUES)).alias("java_clue"), F.bool_or(F.col("kind").isin(*WEB_CLUES)).alias("web_clue"))
    b = owner_roots(boundaries(files).where("boundary <> 'UNSUPPORTED'"), roots).groupBy("root").agg(F.count("*").alias("n_boundaries"))
    whole = lay.join(c, "root", "full_outer").join(b, "root", "full_outer")
    none = F.array().cast("array<string>")
    whole = whole.withColumns({x: F.coalesce(x, none) for x in ("source_roots", "resource_roots", "web_roots", "classpath", "evidence")} | {x: F.coalesce(x, F.lit(0)) for x in ("n_clues", "n_boundaries")} | {x: F.coalesce(x, F.lit(False)) for x in ("java_clue", "web_clue")})
    whole = whole.withColumn("layout_type", F.coalesce("layout_type", F.lit("UNKNOWN_LEGACY")))
    return whole.withColumn("status", project_status()).drop("java_clue", "web_clue")


def project_status() -> Column:
    java = (F.size("source_roots") > 0) | F.col("java_clue")
    code = F.size("classpath") > 0
    web = (F.size("web_roots") > 0) | F.col("web_clue")
    build = F.col("layout_type").isin("GRADLE", "MAVEN", "ANT_LIKE")
    return (
        F.when((F.col("n_boundaries") > 0) & ~java & ~code & ~web & ~build, "BOUNDARY_ONLY")
        .when(java | code, "READY")
        .when(web | build | (F.col("n_clues") > 0), "PARTIAL")
        .when(F.col("n_boundaries") > 0, "BOUNDARY_ONLY")
        .otherwise("UNKNOWN")
    )


def coverage(files: DataFrame) -> DataFrame:
    """area: the capabilities that the files call for."""
    path, name = F.col("path"), F.lower(name_of(F.col("path")))
    open_ = F.col("level") != "L5_SKIPPED"
    tests = {
        "JAVA_SOURCE": open_ & ends(path, ".java"),
        "JAVA_BYTECODE": open_ & is_bytecode(path),
        "JSP_WEB": open_ & ends(path, ".jsp", ".jspx"),
        "HTML_JS": open_ & ends(path, ".html", ".htm", ".js"),
        "SHELL": open_ & ends(path, ".sh", ".bat", ".cmd", ".ps1"),
        "BUILD_SYSTEM": open_ & name.isin("build.gradle", "settings.gradle", "pom.xml", "build.xml", "makefile", "cmakelists.txt"),
        "UNSUPPORTED": ~open_,
    }
    own = files.select(F.explode(F.array_compact(F.array(*[F.when(t, F.lit(a)) for a, t in tests.items()]))).alias("area"))
    of = F.when(F.col("boundary").isin("NATIVE", "C_BOUNDARY"), "C_NATIVE").when(F.col("boundary") == "COBOL_BOUNDARY", "COBOL").when(F.col("boundary") == "JCL_BOUNDARY", "JCL").when(F.col("boundary") == "EXTERNAL", "BUILD_SYSTEM").otherwise("UNSUPPORTED")
    return own.unionByName(boundaries(files).select(of.alias("area"))).distinct()


def overview(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def confirmation_items(reviewed: DataFrame, files: DataFrame, assisted: bool) -> DataFrame:
    """item: what a user has to confirm in an assisted import."""
    a = reviewed.where("status <> 'READY'").select(F.concat("root", F.lit(" requires confirmation: "), "status").alias("item"))
    b = boundaries(files).where("boundary = 'UNSUPPORTED'").select(F.concat("path", F.lit(" requires confirmation: "), "boundary").alias("item"))
    return a.unionByName(b).where(F.lit(assisted))


# --- gate, scopes, plan ---

SAFE_ARCHIVES = (".zip", ".jar", ".war", ".ear")


def gate(files: DataFrame, reviewed: DataFrame, direct: bool, archive: str | None = None) -> DataFrame:
    """severity, code, path of what stands against a direct import; nothing in other modes."""
    spark = files.sparkSession
    issue = lambda severity, code, path: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"))
    bad = F.when(F.col("diagnostic").isin("DECODE_FAILED", "UNREADABLE_PATH"), issue("BLOCKING", "UNREADABLE_PATH", F.col("path"))).when(F.col("diagnostic") == "FILE_TOO_LARGE", issue("WARNING", "FILE_TOO_LARGE", F.col("path")))
    out = files.select(bad.alias("i")).where("i is not null").select("i.*")
    areas = coverage(files).agg(F.count_if(F.col("area").isin("JAVA_SOURCE", "JAVA_BYTECODE", "JSP_WEB")).alias("java"), F.count_if(F.col("area").isin("C_NATIVE", "COBOL", "JCL")).alias("other"))
    shape = F.when((F.col("java") == 0) & (F.col("other") > 0), issue("BLOCKING", "NON_JAVA_WORKSPACE", F.lit(""))).when(F.col("java") == 0, issue("BLOCKING", "NO_JAVA_CONTENT", F.lit("")))
    out = out.unionByName(areas.select(shape.alias("i")).where("i is not null").select("i.*"))
    out = out.unionByName(reviewed.where("status = 'READY' and layout_type = 'SOURCE_ONLY'").select(issue("WARNING", "LEGACY_JAVA_LAYOUT", F.col("root")).alias("i")).select("i.*"))
    if archive is not None and not archive.lower().endswith(SAFE_ARCHIVES):
        out = out.unionByName(spark.createDataFrame([("BLOCKING", "UNSAFE_ARCHIVE", archive.rpartition("/")[2])], "severity string, code string, path string"))
    return out.where(F.lit(direct))


def decide_scopes(reviewed: DataFrame, include=(), exclude=(), shared=()) -> DataFrame:
    """root, disposition, reason, for each project and each shared library outside."""
    root, status = F.col("root"), F.col("status")
    of = lambda items: root.isin(*items) if items else F.lit(False)
    taken = of(include) | (F.lit(not include) & (status == "READY"))
    row = lambda d, r: F.struct(F.lit(d).alias("disposition"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    d = (
        F.when(of(exclude), row("EXCLUDED", "user excluded project"))
        .when(of(shared), row("SHARED_LIBRARY", "project marked as shared library"))
        .when(taken, row("INCLUDED", "project selected for analysis"))
        .when(status.isin("BOUNDARY_ONLY", "UNSUPPORTED", "UNKNOWN"), row("UNANALYZABLE", status))
        .otherwise(row("DEGRADED", status))
    )
    own = reviewed.select("root", d.alias("d")).select("root", "d.*")
    more = reviewed.sparkSession.createDataFrame([(x, "SHARED_LIBRARY", "external shared library") for x in shared], "root string, disposition string, reason string")
    return own.unionByName(more.join(reviewed.select("root"), "root", "left_anti"))


def recommended(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """root, analyzer: the analyses a project's own files call for."""
    deepest = owner_roots(files.where("level <> 'L5_SKIPPED'").select("path"), reviewed.select("root"))
    kind = F.when(ends(F.col("path"), ".java"), "java-source").when(is_bytecode(F.col("path")), "java-bytecode").when(ends(F.col("path"), ".jsp", ".jspx"), "jsp-web")
    own = deepest.select("root", kind.alias("analyzer")).where("analyzer is not null").distinct()
    got = own.join(reviewed.select("root", "status"), "root").where((F.col("status") == "READY") | (F.col("analyzer") == "jsp-web")).select("root", "analyzer")
    return got.unionByName(reviewed.where("status = 'BOUNDARY_ONLY'").select("root", F.lit("boundary").alias("analyzer")))


def plan_tasks(scopes: DataFrame, included: DataFrame, diff: DataFrame, cached: DataFrame) -> DataFrame:
    """analyzer, root, scope_key, queue, reason, priority of scopes (root, analyzer) in included (root). diff: path; cached: scope_key.

    A path is under a root if the root is one of its folders, so the test is an equality on folders.
    """
    s = scopes.join(included.select("root").distinct(), "root", "left_semi").withColumn("scope_key", F.concat_ws(":", "analyzer", "root"))
    p = F.col("path")
    fits = F.filter(
        F.array(
            F.when(ends(p, ".java"), F.lit("java-source")),
            F.when(is_bytecode(p), F.lit("java-bytecode")),
            F.when(ends(p, ".jsp", ".jspx", ".html", ".htm", ".js"), F.lit("jsp-web")),
            F.lit("boundary"),
        ),
        lambda x: x.isNotNull(),
    )
    touched = diff.select(F.explode(prefixes(p)).alias("root"), fits.alias("a")).select("root", F.explode("a").alias("analyzer")).distinct().withColumn("changed", F.lit(True))
    known = cached.select("scope_key").distinct().withColumn("hit", F.lit(True))
    t = s.join(touched, ["root", "analyzer"], "left").join(known, "scope_key", "left")
    row = lambda q, r, n: F.struct(F.lit(q).alias("queue"), F.lit(r).alias("reason"), F.lit(n).alias("priority"))
    what = F.when(F.col("changed"), row("FAST_REPORT", "CHANGED_SCOPE", 0)).when(F.col("hit").isNull(), row("FAST_REPORT", "CACHE_MISS", 1)).otherwise(row("BACKGROUND_DEEP", "CACHED_BACKGROUND_REFRESH", 10))
    return t.select("analyzer", "root", "scope_key", what.alias("w")).select("analyzer", "root", "scope_key", "w.*")


def ordered_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy("priority", "queue", "analyzer", "root")


def changed_symbols(diff: DataFrame, symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """id, path, origin of what a diff (path, change_type) touches: symbols (path, id, start_line, end_line) under its hunks, all
    symbols of files without hunks or deleted; the first origin of an id counts."""
    from ripplegraph.operators.joins import hunk_symbols

    gone = diff.where("change_type = 'DELETE'").select("path")
    under = hunk_symbols(symbols, hunks.join(gone, "path", "left_anti"), diff.where("change_type <> 'DELETE'")).withColumn("origin", F.lit("changed"))
    dead = symbols.join(gone.distinct(), "path", "left_semi").withColumn("origin", F.lit("deleted"))
    both = under.select("id", "path", "origin").unionByName(dead.select("id", "path", "origin"))
    w = Window.partitionBy("id").orderBy("origin", "path")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
