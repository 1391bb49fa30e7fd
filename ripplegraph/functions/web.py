"""Web functions as columns: markup masking, attributes, URL resolution and route typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplegraph.functions.ids import let
from ripplegraph.functions.registry import API_ROOT, HTTP_METHODS

ACTION_ROOT = "_actions"
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script(?:[\s/][^>]*)?>.*?</script\s*>"
ANCHOR = r"(?i)<a[\s/]((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
ATTRIBUTE = r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))"
EXECUTABLE_TYPES = ("", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript")


def masked(html: Column) -> Column:
    """Without comments and scripts; offsets change."""
    return F.regexp_replace(F.regexp_replace(html, COMMENT, ""), SCRIPT, "")


def attributes(tag: Column) -> Column:
    """map of lower-case names to values; the first of a name counts."""
    whole = F.regexp_extract_all(tag, F.lit(f"({ATTRIBUTE})"), F.lit(1))
    name = lambda x: F.lower(F.regexp_extract(x, ATTRIBUTE, 1))
    value = lambda x: F.concat(*[F.regexp_extract(x, ATTRIBUTE, k) for k in (2, 3, 4)])
    pairs = F.transform(whole, lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))
    firsts = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, F.lit(1), i), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(firsts)


def hrefs(html: Column) -> Column:
    """The non-blank href of each anchor outside comments and scripts, in page order."""
    tags = F.regexp_extract_all(masked(html), F.lit(ANCHOR), F.lit(1))
    found = F.transform(tags, lambda t: F.try_element_at(attributes(t), F.lit("href")))
    return F.filter(found, lambda h: F.trim(F.coalesce(h, F.lit(""))) != "")


def is_executable(src: Column, kind: Column) -> Column:
    """Whether a script element's own text runs: it has no src, and its type, without parameters, is one of a script."""
    bare = F.lower(F.trim(F.substring_index(F.coalesce(kind, F.lit("")), ";", 1)))
    return (F.coalesce(F.trim(src), F.lit("")) == "") & bare.isin(*EXECUTABLE_TYPES)


def strip(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "[?#].*$", "")


def collapsed(path: Column) -> Column:
    """Segments joined, without '.', '..' and blanks."""
    segments = F.split(F.regexp_replace(path, r"\\", "/"), "/", -1)
    start = F.array().cast("array<string>")
    step = lambda a, x: F.when(F.trim(x).isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(segments, start, step), "/")


def is_external(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit(""))).rlike(r"^(//|[A-Za-z0-9+.\-]+://)")


def has_scheme(url: Column) -> Column:
    return strip(url).rlike(r"^[A-Za-z0-9+.\-]+:")


def is_navigable(href: Column) -> Column:
    """Neither within the page nor of a scheme other than http."""
    h = F.trim(F.coalesce(href, F.lit("")))
    other = strip(h).rlike(r"^[A-Za-z0-9+.\-]+:") & ~strip(h).rlike("(?i)^https?:")
    return (h != "") & ~h.startswith("#") & ~other


def external_route(url: Column) -> Column:
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9/._~\-]", "-")

    def of(s: Column) -> Column:
        scheme = F.when(s.startswith("//"), F.lit("protocol-relative")).otherwise(F.lower(F.substring_index(s, "://", 1)))
        path = collapsed(safe(F.regexp_replace(s, r"^(//|[A-Za-z0-9+.\-]+://)", "")))
        return let(path, lambda p: F.concat(F.lit("external/"), scheme, F.lit("/"), F.when(p == "", F.lit("_root")).otherwise(p)))

    return let(strip(url), of)


def resolve(page: Column, target: Column) -> Column:
    """A target against its page's path: local paths lose query and dots, external ones stay."""

    def of(x: Column) -> Column:
        t, s, own = x["t"], x["s"], x["page"]
        folder = F.when(own.rlike("^.+/"), F.regexp_replace(own, "/[^/]*$", "")).otherwise("")
        local = F.when(s.startswith("/"), s).otherwise(F.concat(folder, F.lit("/"), s))
        return F.when((t == "") | t.startswith("?"), own).when(is_external(s) | s.rlike(r"^[A-Za-z0-9+.\-]+:"), s).otherwise(collapsed(local))

    return let(F.struct(F.trim(F.coalesce(target, F.lit(""))).alias("t"), strip(target).alias("s"), strip(page).alias("page")), of)


def route(url: Column) -> Column:
    """A route's path without leading slashes; '_root' for none."""

    def of(x: Column) -> Column:
        bare = F.ltrim(x["s"], F.lit("/"))
        return F.when(is_external(x["u"]), external_route(x["u"])).when(F.trim(bare) == "", F.lit("_root")).otherwise(bare)

    return let(F.struct(url.alias("u"), strip(url).alias("s")), of)


def ascii_path(text: Column) -> Column:
    """Characters that an id may not hold, percent-encoded."""
    part = lambda c: F.when(c.rlike(r"^[!-~]$") & ~c.isin("\\", "?", "#", "%"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1"))
    return let(text, lambda t: F.when(t.rlike(r"^[!-~]*$") & ~t.rlike(r"[\\?#%]"), t).otherwise(F.array_join(F.transform(F.split(t, ""), part), "")))


def http_method(method: Column) -> Column:
    """In upper case; GET for what isn't a method."""
    return let(F.upper(F.trim(F.coalesce(method, F.lit("")))), lambda m: F.when(m.isin(*HTTP_METHODS), m).otherwise("GET"))


def api_endpoint(project, module, method: Column, url: Column) -> Column:
    path = let(route(url), lambda r: F.concat(F.lit("/"), F.when(r == "_root", F.lit("")).otherwise(ascii_path(r))))
    return F.concat(F.lit(f"api-endpoint://{project}/{module}/{API_ROOT}/"), http_method(method), F.lit(":"), path)


def action_path(project, module, url: Column) -> Column:
    return F.concat(F.lit(f"action-path://{project}/{module}/{ACTION_ROOT}/"), ascii_path(F.regexp_replace(route(url), r"\.do$", "")))


def is_action(url: Column) -> Column:
    return ~is_external(url) & strip(url).endswith(".do")


def request_target(project, module, page: Column, method: Column, url: Column) -> Column:
    """The action or endpoint that a request or form goes to."""
    return let(resolve(page, url), lambda to: F.when(is_action(to), action_path(project, module, to)).otherwise(api_endpoint(project, module, method, to)))


def navigation_target(project, module, root: str, page: Column, href: Column) -> Column:
    """The page, action or endpoint that a link goes to."""

    def of(to: Column) -> Column:
        own = ~is_external(to) & to.rlike(r"\.html?$")
        return (
            F.when(own, F.concat(F.lit(f"html-page://{project}/{module}/{root}/"), ascii_path(route(to))))
            .when(is_action(to), action_path(project, module, to))
            .otherwise(api_endpoint(project, module, F.lit("GET"), to))
        )

    return let(resolve(page, href), of)


def join_paths(a: Column, b: Column) -> Column:
    """A class's and a method's route as one endpoint path: {name:pattern} loses its pattern, a trailing slash goes."""
    both = F.concat_ws("/", F.btrim(F.coalesce(a, F.lit("")), F.lit("/")), F.btrim(F.coalesce(b, F.lit("")), F.lit("/")))
    path = F.concat(F.lit("/"), F.btrim(both, F.lit("/")))
    return F.regexp_replace(F.regexp_replace(path, r"\{([^}:]+):[^}]*\}", "{$1}"), "/+", "/")
