"""URL block and allow rules, carried over redirects and canonical links.

Native: DataFrame functions only. Every url that a rule fits has that rule's verdict. Urls that no rule fits take
the verdict of their aliases: redirect and canonical-link edges join urls into components, and a component that holds
an explicitly allowed url is allowed, else one that holds a blocked url is blocked, else it is allowed. An explicit
rule on the url itself always comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.graph import connected_components
from scriptoria.llm.shared import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: What holds no tags: comments, and elements whose content is text.
NO_TAGS = r"(?is)<!--.*?(?:--!?>|\z)|<(script|style|textarea|title)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
#: An attribute after white space (or a slash), its value bare or in quotation marks, and a tag as a run of attributes.
ATTRIBUTE = r"""[\s/]+([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
TAG = rf"(?is)<(?:link|meta|base)(?:{ATTRIBUTE.replace('([^', '(?:[^').replace('("[^', '(?:"[^')})*[\s/]*>"
#: Character references by name; numeric ones are taken by their code points, and the ampersand comes last.
NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&colon;", ":"), ("&sol;", "/"), ("&period;", "."), ("&num;", "#"), ("&quest;", "?"), ("&equals;", "="))
#: Names that the SQL below knows.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or a url without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or a url without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as a node of the alias graph: without scheme and fragment, the host lower-cased; null if it has no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does. Of two equally long, allow wins.

    A rule `name/path` fits the host `name` and all its subdomains where the url's path starts with `/path`.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _character(point: Column) -> Column:
    """A code point's character; one that is none becomes U+FFFD."""
    high, low = F.shiftright(point - 0x10000, 10) + 0xD800, (point - 0x10000).bitwiseAND(0x3FF) + 0xDC00
    units = F.when(point < 0x10000, F.lpad(F.hex(point), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    none = point.isNull() | (point <= 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF)
    return F.decode(F.unhex(F.when(none, "FFFD").otherwise(units)), "UTF-16BE")


def unescaped(text: Column) -> Column:
    """Character references as their characters: numeric ones, and those names that stand in addresses."""
    point = lambda r: F.when(F.length(r) > 12, -1).otherwise(F.coalesce(F.conv(F.regexp_extract(r, "(?i)&#x0*([0-9a-f]+)", 1), 16, 10).try_cast("int"), F.regexp_extract(r, "&#0*([0-9]+)", 1).try_cast("int")))
    numeric = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(&#(?:x[0-9a-f]+|[0-9]+);)"), F.lit(1)))
    ampersand = lambda r: F.coalesce(point(r) == 38, F.lit(False))
    out = F.aggregate(F.filter(numeric, lambda r: ~ampersand(r)), text, lambda t, r: F.replace(t, r, _character(point(r))))
    for name, char in NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(out, "(?i)&(?:amp|#0*38|#x0*26);", "&")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, null if there is none."""
    of = F.filter(F.regexp_extract_all(tag, F.lit(f"(?s){ATTRIBUTE}"), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, f"(?s){ATTRIBUTE}", 1)) == name)
    value = F.regexp_extract(F.try_element_at(of, F.lit(1)), f"(?s){ATTRIBUTE}", 2)
    return F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def resolved(base: Column, to: Column) -> Column:
    """The address that a reference names on a page at `base`: absolute ones as they are, others on base's host and, if
    they have no path of their own, its path; dot segments are taken out. Null for another kind of scheme, for a mere
    fragment, and where base has no ://."""
    folder = F.regexp_replace(path_of(base), r"[^/]*\z", "")
    path = F.when(to.startswith("/"), F.regexp_extract(to, r"(?s)^([^?#]*)", 1)).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_extract(to, r"(?s)^([^?#]*)", 1))
    )
    parts = F.split(path, "/")
    walk = lambda at, x: F.when(x == "..", F.regexp_replace(at, r"/[^/]*\z", "")).when(x == ".", at).otherwise(F.concat(at, F.lit("/"), x))
    straight = F.concat(
        F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), walk), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    )
    start = F.concat(F.lit("http://"), host_of(base))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|\z)"), None)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(F.instr(base, "://") == 0, None)
        .when(to.startswith("?"), F.concat(start, path_of(base), to))
        .otherwise(F.concat(start, straight, F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) urls: a page and the addresses that its canonical links and its refreshes name, as resolved() takes
    them on the page's base, which is that of its first base tag or its url. Comments, scripts, styles and text areas hold no
    tags; attribute names stand after white space, and rel is a list of words. Html of any length is read whole."""
    stated = pages.where(f"instr(lower({html}), 'canonical') > 0 or instr(lower({html}), 'refresh') > 0")
    tags = F.regexp_extract_all(F.regexp_replace(html, NO_TAGS, " "), F.lit(TAG), F.lit(0))
    found = stated.select(F.col(url).alias("src"), tags.alias("tags"))
    base = F.filter("tags", lambda t: t.rlike("(?i)^<base") & attribute(t, "href").isNotNull())
    found = found.select("src", unescaped(attribute(F.try_element_at(base, F.lit(1)), "href")).alias("base"), F.explode("tags").alias("tag")).where("not lower(tag) like '<base%'")
    named = found.select("src", "base", F.lower(F.substring("tag", 1, 5)).alias("kind"), *(attribute(F.col("tag"), n).alias(c) for c, n in (("rel", "rel"), ("href", "href"), ("equiv", "http-equiv"), ("content", "content"))))
    # Written, so that conditions further on do not repeat what they stand on.
    named = materialize(named, "tags")
    link = (F.col("kind") == "<link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    meta = (F.col("kind") == "<meta") & (F.lower(F.trim("equiv")) == "refresh")
    refresh = F.regexp_extract(unescaped(F.col("content")), r"""(?is)^[\s\d.]*[;,]?\s*url\s*=\s*["']?([^"'\s]+)""", 1)
    found = named.where(link | meta).select("src", F.trim(F.coalesce("base", F.lit(""))).alias("base"), F.when(link, F.trim(unescaped(F.col("href")))).otherwise(refresh).alias("to"))
    found = materialize(found, "references").where("to <> ''")
    found = found.select("src", F.coalesce(resolved(F.col("src"), F.col("base")), F.col("src")).alias("base"), "to")
    return found.select("src", resolved(F.col("base"), F.col("to")).alias("dst")).where("src is not null and dst is not null")


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """pages (page_id, url, html) to (page_id, host, path, rule, verdict, n_aliases), a row a page.

    edges (src, dst) are further redirect pairs of urls, for example from a crawl log; those that the pages' own html
    states are added. Null urls, and urls without ://, have an empty host, no rule and no alias, and are allowed.
    Repeated pages keep a row each. Null html states no edge. An empty table gives an empty result. Rules also hold
    for aliases that are no page themselves. n_aliases counts the urls of the component, 1 if there is no edge.
    """
    url = F.col("url")
    base = pages.select("page_id", node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    stated = alias_edges(pages)
    if edges is not None:
        stated = stated.unionByName(edges.select("src", "dst"))
    links = materialize(
        stated.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src is not null and dst is not null").distinct(),
        "aliases",
    )
    nodes = connected_components(links)
    # A node is host and path without a scheme; its rule is found as a page's is.
    again = F.concat(F.lit("x://"), F.col("node"))
    judged = nodes.withColumn("own", rule_for(host_of(again), path_of(again), rules))
    votes = judged.groupBy("root").agg(
        F.max((F.col("own.verdict") == "allow").cast("int")).alias("allows"),
        F.max((F.col("own.verdict") == "block").cast("int")).alias("blocks"),
        F.count("*").alias("n_aliases"),
    )
    carried = materialize(
        nodes.join(votes, "root").select(
            "node", F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow").alias("carried"), "n_aliases"
        ),
        "carried",
    )
    return base.join(carried, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"),
        F.coalesce("n_aliases", F.lit(1)).cast("long").alias("n_aliases"),
    )


def op2_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def with_macros(sql: str) -> str:
    """Write out unescape_(x) and RESOLVED(base|to), which the SQL below uses for unescaped() and resolved()."""
    out = sql
    while (at := out.find("RESOLVED(")) >= 0:
        base, to = out[at + 9 : out.index(")", at)].split("|")
        host = f"translate(regexp_extract({base}, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
        own = f"regexp_extract({base}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
        folder = f"coalesce(nullif(regexp_replace({own}, '[^/]*$', ''), ''), '/')"
        parts = f"string_split(CASE WHEN {to} LIKE '/%' THEN '' ELSE {folder} END || regexp_extract({to}, '^([^?#]*)', 1), '/')"
        walk = f"list_reduce({parts}, lambda x, y: CASE y WHEN '..' THEN regexp_replace(x, '/[^/]*$', '') WHEN '.' THEN x ELSE x || '/' || y END)"
        straight = f"{walk} || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END"
        full = (
            f"CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {to} WHEN {to} = '' OR regexp_matches({to}, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN NULL"
            f" WHEN {to} LIKE '//%' THEN 'http:' || {to} WHEN NOT contains({base}, '://') THEN NULL WHEN {to} LIKE '?%' THEN 'http://' || {host} || {own} || {to}"
            f" ELSE 'http://' || {host} || {straight} || regexp_extract({to}, '^[^?#]*((?s).*)', 1) END"
        )
        out = out[:at] + full + out[out.index(")", at) + 1 :]
    while (at := out.find("unescape_(")) >= 0:
        depth, end = 1, at + 10
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        text = out[at + 10 : end - 1]
        for name, char in ENTITIES:
            text = f"replace({text}, '{name}', '{char if char != "'" else "''"}')"
        out = out[:at] + text + out[end:]
    return out


#: Rules, then edges, then the reachable urls of each url, then votes. For small graphs; DuckDB.
OP2_SQL = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) END AS node
  FROM pages),
tag AS (
  SELECT node, host, url, coalesce(unescape_(regexp_extract(html, '(?is)<base\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)), '') AS first,
    unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM page WHERE node IS NOT NULL AND html IS NOT NULL),
target AS (
  SELECT node, url, first, unescape_(CASE
    WHEN regexp_matches(t, '(?is)^<link') AND regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(t, '(?is)^<meta') AND regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    END) AS a FROM tag),
based AS (SELECT node, a, coalesce(RESOLVED(url|first), url) AS base FROM target WHERE a IS NOT NULL AND a <> ''),
aim AS (SELECT node AS u, RESOLVED(base|a) AS b FROM based),
edge AS (
  SELECT u, translate(regexp_extract(b, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(b, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS v
  FROM aim WHERE b IS NOT NULL),
both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach AS (
  SELECT u AS node, u AS other FROM both_ways
  UNION
  SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
split AS (
  SELECT node, other, regexp_extract(other, '^([^/?#]*)', 1) AS host, regexp_extract(other, '^[^/?#]*([^?]*)', 1) AS path FROM reach),
vote AS (
  SELECT node, count(*) AS n,
    max(CASE WHEN VERDICT_SQL = 'allow' THEN 1 ELSE 0 END) AS allows, max(CASE WHEN VERDICT_SQL = 'block' THEN 1 ELSE 0 END) AS blocks
  FROM split GROUP BY node)
SELECT page_id, host, path, RULE_SQL AS rule,
  coalesce(VERDICT_SQL, CASE WHEN allows = 1 THEN 'allow' WHEN blocks = 1 THEN 'block' END, 'allow') AS verdict,
  coalesce(n, 1) AS n_aliases
FROM page LEFT JOIN vote USING (node)
"""
OP2_SQL = with_macros(OP2_SQL).replace(
    "VERDICT_SQL",
    """CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' END""",
).replace(
    "RULE_SQL",
    """CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END""",
)
