"""Joins over info rows. Prefix and overlap conditions become equalities on derived keys wherever there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mapper_bindings(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """statements (namespace, statement_id, ...) with the one method (owner, method, ...) of that name; none if there are several."""
    g = methods.groupBy("owner", "method").agg(F.count("*").alias("n"), F.first(F.struct(*methods.columns)).alias("m")).where("n = 1").select("m.*")
    return statements.join(g, (F.col("namespace") == F.col("owner")) & (F.col("statement_id") == F.col("method")))


def mapper_interfaces(classes: DataFrame, namespaces: DataFrame, annotations=("Mapper",)) -> DataFrame:
    """Interfaces with a mapper's annotation, or whose name is an XML namespace."""
    own = classes.where(F.col("is_interface"))
    marked = own.where(F.exists("annotations", lambda a: F.substring_index(a, ".", -1).isin(*annotations)))
    named = own.join(namespaces.select(F.col("namespace").alias("owner")).distinct(), "owner", "left_semi")
    return marked.unionByName(named).dropDuplicates(["owner"])


def hunk_symbols(symbols: DataFrame, hunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Symbols (path, id, start_line, end_line) that a hunk (path, start, count) overlaps; with `files` (path), all symbols of
    changed files without hunks too. Equal paths join; the overlap filters within a file."""
    s = symbols.withColumn("last_line", F.greatest("start_line", "end_line"))
    h = hunks.select("path", "start", (F.col("start") + F.greatest("count", F.lit(1)) - 1).alias("stop"))
    hit = s.join(h, "path").where("start_line <= stop and last_line >= start").drop("start", "stop")
    if files is not None:
        bare = files.select("path").distinct().join(hunks.select("path").distinct(), "path", "left_anti")
        hit = hit.unionByName(s.join(bare, "path", "left_semi"))
    return hit.drop("last_line").distinct()


def origin_merge(source: DataFrame, bytecode: DataFrame) -> DataFrame:
    """kind, key, from_source, from_bytecode of symbols (kind, key) found either way."""
    a = source.select("kind", "key").distinct().withColumn("s", F.lit(True))
    b = bytecode.select("kind", "key").distinct().withColumn("b", F.lit(True))
    both = a.join(b, ["kind", "key"], "full_outer")
    return both.select("kind", "key", F.col("s").isNotNull().alias("from_source"), F.col("b").isNotNull().alias("from_bytecode"))


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (call_id, target_owner, target_method, signature) with the first matching method's descriptor; null without one.
    A blank signature matches any. methods: owner, method, descriptor, ord."""
    keyed = methods.select(F.col("owner").alias("target_owner"), F.col("method").alias("target_method"), "descriptor", "ord")
    any_ = keyed.groupBy("target_owner", "target_method").agg(F.min_by("descriptor", "ord").alias("any_descriptor"))
    exact = keyed.groupBy("target_owner", "target_method", F.col("descriptor").alias("signature")).agg(F.min_by("descriptor", "ord").alias("exact_descriptor"))
    c = calls.withColumn("signature", F.coalesce(F.trim("signature"), F.lit("")))
    c = c.join(any_, ["target_owner", "target_method"], "left").join(exact, ["target_owner", "target_method", "signature"], "left")
    found = F.when(F.col("signature") == "", F.col("any_descriptor")).otherwise(F.col("exact_descriptor"))
    return c.withColumn("target_descriptor", found).drop("any_descriptor", "exact_descriptor")


def prefixes(path: Column) -> Column:
    """All folders of a path, '.' for the top, and the path itself."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def owner_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with the deepest root (root) above each, else the first folder, else '.'."""
    at = paths.select("path").distinct().select("path", F.posexplode(prefixes(F.col("path"))).alias("depth", "root"))
    best = at.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("root"))
    fallback = F.when(F.instr("path", "/") > 1, F.substring_index("path", "/", 1)).otherwise(".")
    return paths.join(best, "path", "left").withColumn("root", F.coalesce("root", fallback))


def redirects(ids: DataFrame, moved: DataFrame) -> DataFrame:
    """ids (id) with what each is now, by moved (from_id, to_id) that are legal."""
    legal = moved.where(is_redirect(F.col("from_id"), F.col("to_id"))).groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    return ids.join(legal, F.col("id") == F.col("from_id"), "left").select("id", F.coalesce("to_id", "id").alias("now"))


def is_redirect(old: Column, new: Column) -> Column:
    """From an id with an unresolved descriptor, '(U<hash>)U', to one of the same owner and name with a resolved one."""
    stem = lambda x: F.regexp_replace(x, r"\(.*$", "")
    open_ = lambda x: x.rlike(r"\(U[0-9a-f]{12}\)U$")
    return (old != new) & (stem(old) == stem(new)) & open_(old) & ~open_(new)


def smap_lines(smap: DataFrame) -> DataFrame:
    """smap (class_name, text) to ranges: class_name, file, in_line, repeat, out_line, out_step, of the line sections.

    A line is in[#file][,repeat]:out[,step]; a file number counts until the next one.
    """
    section = F.regexp_extract("text", r"(?s)\*F\s*\n(.*?)\*L\s*\n(.*?)\*E", 1)
    lines = F.regexp_extract("text", r"(?s)\*F\s*\n(.*?)\*L\s*\n(.*?)\*E", 2)
    names = F.regexp_extract_all(section, F.lit(r"(?m)^(?:\+\s*)?(\d+)\s+\S"), F.lit(1))
    plain = F.regexp_extract_all(section, F.lit(r"(?m)^\d+\s+(\S+)|^\+\s*\d+\s+\S+\n(\S+)"), F.lit(0))
    path = F.transform(plain, lambda x: F.regexp_extract(x, r"(\S+)$", 1))
    files = F.map_from_arrays(names, path)
    s = smap.select("class_name", files.alias("files"), F.posexplode(F.filter(F.split(lines, r"\n"), lambda x: F.trim(x) != "")).alias("n", "l"))
    p = r"^(\d+)(?:#(\d+))?(?:,(\d+))?:(\d+)(?:,(\d+))?$"
    part = lambda k: F.regexp_extract(F.trim("l"), p, k)
    number = lambda k, d: F.when(part(k) == "", F.lit(d)).otherwise(part(k).try_cast("int"))
    s = s.where(F.trim("l").rlike(p)).withColumn("f", F.when(part(2) == "", F.lit(None)).otherwise(part(2)))
    s = s.withColumn("f", F.coalesce(F.last("f", ignorenulls=True).over(Window.partitionBy("class_name").orderBy("n")), F.lit("1")))
    return s.select("class_name", F.try_element_at("files", F.col("f")).alias("file"), number(1, 0).alias("in_line"), number(3, 1).alias("repeat"), number(4, 0).alias("out_line"), number(5, 1).alias("out_step"))


def map_lines(generated: DataFrame, ranges: DataFrame) -> DataFrame:
    """generated (class_name, line) with file and source line: the first range that holds the line."""
    stop = F.col("out_line") + F.greatest(F.col("repeat") * F.col("out_step"), F.lit(1)) - 1
    hit = generated.join(ranges, "class_name").where((F.col("line") >= F.col("out_line")) & (F.col("line") <= stop))
    at = F.col("in_line") + F.floor((F.col("line") - F.col("out_line")) / F.greatest("out_step", F.lit(1))).cast("int")
    return hit.groupBy("class_name", "line").agg(F.min_by(F.struct("file", at.alias("source_line")), F.struct("out_line", "in_line")).alias("m")).select("class_name", "line", "m.*")


def changed_files(files: DataFrame, before: DataFrame) -> DataFrame:
    """files (path, sha256) with `cached`: the same content was analysed before."""
    hit = before.select("path", "sha256").distinct().withColumn("cached", F.lit(True))
    return files.join(hit, ["path", "sha256"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def changed_java(files: DataFrame, diff: DataFrame) -> DataFrame:
    """Java files of the diff."""
    return files.where(F.lower("path").endswith(".java")).join(diff.select("path").distinct(), "path", "left_semi")
