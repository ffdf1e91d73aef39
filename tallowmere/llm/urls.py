"""URL filters: rules by host and path, and block decisions that reach the aliases of a blocked url.

Urls that redirect to each other or name one another as canonical are one component, found over all
such edges at once; a page without a rule of its own takes its component's decision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, ascii_lower

#: Rules up to this number are compared with each url in place; more are joined by host.
IN_PLACE = 100


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(verdict, host.lower(), "/" + path)


#: The rules of the registered query.
RULES = tuple(Rule.parse(*r) for r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))

#: What a browser doesn't read as tags; a tag that may link, with quoted values whole; an attribute; the url of a refresh.
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|$)"
_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?is)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
_URL = r"""(?is)(?:^|[\s;,])url\s*=\s*["']?([^\s"']+)"""
#: A character reference, and the names of those that urls are written with.
_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});"
_NAMED = {"amp": "&", "AMP": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "quest": "?", "num": "#", "equals": "=", "period": ".", "percnt": "%", "plus": "+", "commat": "@", "lowbar": "_"}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def scheme_of(url: Column) -> Column:
    """The scheme, lower-cased, before ``://``."""
    return ascii_lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def query_of(url: Column) -> Column:
    """From the first ``?`` on up to ``#`` or the end."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def node_of(url: Column) -> Column:
    """What tells urls apart: the whole url without its fragment, scheme and host lower-cased, without the scheme's own port (80 of http, 443 of
    https), an empty path as ``/``.  Null without a host.

    Nothing else is made equal: variants are aliases only if a redirect or a canonical link says so.
    """
    path = path_of(url)
    scheme, host = scheme_of(url), host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), query_of(url))
    return F.when(host_of(url) != "", whole)


def without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` resolved."""
    closed = F.regexp_replace(path, r"/(\.\.?)$", r"/$1/")
    parts = F.split(closed, "/")
    step = lambda so_far, part: F.when(part == "..", F.regexp_replace(so_far, r"/[^/]*$", "")).when(part == ".", so_far).otherwise(F.concat(so_far, F.lit("/"), part))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), step)


def resolved(url: Column, to: Column) -> Column:
    """The absolute url that ``to`` names on the page ``url``; null where it names no place with a host.

    With a scheme ``to`` stands for itself; ``//host`` takes the page's scheme, ``/path`` its host too, ``?query``
    its path too, anything else is relative to its path up to the last slash.
    """
    site = F.concat(scheme_of(url), F.lit("://"), host_of(url))
    base = F.when(path_of(url) == "", F.lit("/")).otherwise(F.regexp_extract(path_of(url), r"^(.*/)", 1))
    local = F.when(to.startswith("/"), to).otherwise(F.concat(base, to))
    dotless = F.concat(without_dots(F.regexp_extract(local, r"^([^?#]*)", 1)), F.regexp_extract(local, r"^[^?#]*(.*)$", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(to.contains("://"), to))
        .when(to.startswith("//"), F.concat(scheme_of(url), F.lit(":"), to))
        .when(host_of(url) == "", F.lit(None))
        .when(to.startswith("?"), F.concat(site, path_of(url), to))
        .when((to == "") | to.startswith("#"), F.lit(None))
        .otherwise(F.concat(site, dotless))
    )


def _best(found: Column) -> Column:
    """Of structs (length, rule, verdict) the longest, of equally long ones the last in order; null of none."""
    return F.array_max(found)


def with_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``pages(page_id, url, host, path, ...)`` with ``rule`` and ``own`` (its verdict), both null where no rule fits.

    Few rules are compared in place; more become a table that is joined with the suffixes of each distinct
    host, and Spark chooses how by the table's size.
    """
    if len(rules) <= IN_PLACE:
        each = [F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("own"))) for r in rules]
        best = _best(F.array(*each)) if each else F.lit(None).cast("struct<n:int,rule:string,own:string>")
        return pages.withColumn("__r", best).select("*", F.col("__r.rule").alias("rule"), F.col("__r.own").alias("own")).drop("__r")
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, len(r.host + r.path), r.host + r.path, r.verdict) for r in rules], "rh string, rp string, n int, rule string, own string")
    urls = pages.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = urls.withColumn("suffix", F.explode(suffixes)).join(table, (F.col("suffix") == F.col("rh")) & F.col("path").startswith(F.col("rp")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("n", "rule", "own")).alias("r")).select(F.col("host").alias("__h"), F.col("path").alias("__p"), "r.rule", "r.own")
    return pages.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")


def _once(value: Column, name: str) -> Column:
    """The value as a column that later expressions refer to; else Spark would write it into each of them, again and again."""
    return F.explode(F.array(value)).alias(name)


def decoded(text: Column) -> Column:
    """The text with its character references as characters: numeric ones, and :data:`_NAMED`; others stay as they are."""
    found, between = F.regexp_extract_all(text, F.lit(_REFERENCE), 1), F.split(text, _REFERENCE, -1)

    def one(ref: Column) -> Column:
        digits = F.when(ref.rlike("^#[xX]"), F.substr(ref, F.lit(3))).when(ref.startswith("#"), F.conv(F.substr(ref, F.lit(2)), 10, 16))
        code = F.conv(digits, 16, 10).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        # big-endian, a character every four bytes
        value = F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        for name, what in _NAMED.items():
            value = value.when(ref == name, what)
        return F.coalesce(value, F.concat(F.lit("&"), ref, F.lit(";")))

    whole = F.transform(between, lambda part, i: F.concat(part, F.coalesce(one(F.get(found, i)), F.lit(""))))
    return F.when(text.contains("&"), F.array_join(whole, "")).otherwise(text)


def page_edges(pages: DataFrame) -> DataFrame:
    """``(u, v)``: the node of a page and one that its html names, an edge for each canonical link and each refresh.

    What stands in comments, scripts and styles is no tag.  Values may be quoted or not, and only quotes end quoted ones; of an attribute that
    is there twice the first counts.  Character references are decoded, relative urls resolved.
    """
    html = F.when(F.col("html").rlike("(?i)<!--|<script|<style"), F.regexp_replace("html", _HIDDEN, " ")).otherwise(F.col("html"))
    tags = pages.select("url", F.explode(F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))).alias("tag"))
    inside = F.regexp_replace("tag", "(?i)^<(link|meta)|>$", " ")
    parts = [F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(i)) for i in (1, 2, 3, 4)]
    found = F.struct(F.lower(F.substr("tag", F.lit(2), F.lit(4))).alias("kind"), F.transform(parts[0], F.lower).alias("names"), *[p.alias(f"v{i}") for i, p in enumerate(parts[1:])])
    tags = tags.select("url", _once(found, "x")).select("url", "x.*")

    def value(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int") - 1
        return F.when(at >= 0, F.concat(*[F.get(f"v{i}", at) for i in range(3)]))

    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.lower(F.trim(value("http-equiv"))) == "refresh")
    named = F.when(canonical, value("href")).when(refresh, F.regexp_extract(value("content"), _URL, 1))
    e = tags.select("url", _once(named, "raw")).where("raw <> ''").select("url", _once(decoded(F.col("raw")), "text"))
    e = e.select("url", _once(F.regexp_replace("text", r"^\s+|\s+$", ""), "to")).where("`to` <> ''")
    e = e.select("url", _once(resolved(F.col("url"), F.col("to")), "target"))
    return e.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).where("u <> v")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule and verdict (allow or block) of every row of ``pages(page_id, url, html)``.

    The longest rule that fits decides.  A page without one is an alias of all urls that are linked to its
    own, directly or through others, by canonical links, refreshes or the rows of
    ``redirects(from_url, to_url)``: if one of these is allowed by a rule the page is allowed, else if
    one is blocked it is blocked; else it is allowed.  Urls are told apart as :func:`node_of` says.  Null and malformed urls
    have empty host and path, no rule and no aliases, and are allowed.  Rows stay as many as they are; no
    rows give no rows.
    """
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = with_rules(p, rules).withColumn("node", node_of(F.col("url")))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")))
    with Scratch(pages.sparkSession) as scratch:
        roots, paths = connected_components(edges)
        scratch.paths += paths
        # a rule's verdict is the url's own, whether the url has a page or is only named by one
        named = roots.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node")))
        judged = with_rules(named, rules).where("own is not null")
        rooted = judged.groupBy("root").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
        blocked = rooted.where("block and not allow").select("root")
        nodes = scratch.keep(roots.hint("merge").join(blocked, "root", "left_semi").select(F.col("node").alias("__node")))
    out = p.join(nodes.hint("merge"), F.col("node") == F.col("__node"), "left")
    verdict = F.coalesce("own", F.when(F.col("__node").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))
