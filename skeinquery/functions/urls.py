"""URLs and robots rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^\s*(https?)://([^/:]*)(?::([^/]*))?(/.*)?$"
HREF = r'(?is)<[a-z][^>]*\shref\s*=\s*"([^"]*)"'


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def is_url(url: Column) -> Column:
    """Whether a trimmed URL has scheme http or https and at least 8 characters; null is not."""
    u = F.trim(url)
    return F.coalesce((F.length(u) >= 8) & (u.startswith("http://") | u.startswith("https://")), F.lit(False))


def parsed(url: Column) -> Column:
    """scheme, host, port, path of a URL, or null for a malformed one.

    The port is the scheme's own (80, 443) where none or no number is given; the path includes the query and is `/` at
    least; the host keeps its case.
    """
    u = F.trim(url)
    scheme = part(u, 1)
    own = F.when(scheme == "https", 443).otherwise(80)
    port = F.coalesce(F.trim(part(u, 3)).try_cast("int"), own)
    path = F.when(part(u, 4) == "", "/").otherwise(part(u, 4))
    return F.when(is_url(url), F.struct(scheme.alias("scheme"), F.trim(part(u, 2)).alias("host"), port.alias("port"), path.alias("path")))


def base_url(url: Column) -> Column:
    """Scheme and host, without the port; null for a malformed URL."""
    return F.when(is_url(url), F.concat(part(F.trim(url), 1), F.lit("://"), F.trim(part(F.trim(url), 2))))


def hrefs(html: Column) -> Column:
    """The href values of all elements, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), F.array().cast("array<string>"))


def resolved(page_url: Column, link: Column) -> Column:
    """A link in absolute form, against the page it is on: absolute, scheme-relative, root-relative, or relative to the page's folder."""
    origin = F.regexp_extract(page_url, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(page_url, "[?#].*$", ""), r"^https?://[^/]*(/(?:.*/)?)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page_url, "^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?") | link.startswith("#") | (link == ""), F.concat(F.regexp_replace(page_url, "[?#].*$", ""), link))
        .otherwise(F.concat(origin, folder, link))
    )


def passes_blacklist(url: Column) -> Column:
    """Whether a URL may be crawled: not null or empty, no encyclopedia but the English one, none of three hosting sites."""
    wiki = url.contains("wiki") & ~url.contains("en.wikipedia")
    hosted = url.contains("wordpress") | url.contains("stackexchange") | url.contains("tumblr")
    return F.coalesce((url != "") & ~wiki & ~hosted, F.lit(False))


def robots_rules(text: Column, agent: str) -> Column:
    """disallowed (paths) and delay (seconds, null without one) of a robots file for an agent.

    Comments go; the first block for the agent counts, else the first for `*`; a block runs to the next empty line; a
    value ends at a second colon; an empty Disallow and a delay that is no integer are left out.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    blocks = F.split(F.array_join(lines, "\n"), "\n{2,}")

    def first_for(name: str) -> Column:
        named = F.filter(blocks, lambda b: F.exists(F.split(b, "\n"), lambda x: (field(x, 0) == "user-agent") & (F.lower(field(x, 1)) == name.lower())))
        return F.get(named, F.lit(0))

    def field(line: Column, k: int) -> Column:
        v = F.trim(F.coalesce(F.get(F.split(line, ":"), F.lit(k)), F.lit("")))
        return F.lower(v) if k == 0 else v

    rules = F.split(F.coalesce(first_for(agent), first_for("*"), F.lit("")), "\n")
    paths = F.filter(F.transform(F.filter(rules, lambda x: field(x, 0) == "disallow"), lambda x: field(x, 1)), lambda p: p != "")
    delays = F.filter(F.transform(F.filter(rules, lambda x: field(x, 0) == "crawl-delay"), lambda x: field(x, 1).try_cast("int")), lambda d: d.isNotNull())
    return F.struct(paths.alias("disallowed"), F.get(delays, F.lit(0)).alias("delay"))


def robots_allow(path: Column, disallowed: Column) -> Column:
    """Whether a path starts with none of the disallowed ones; no rules allow all."""
    return ~F.exists(F.coalesce(disallowed, F.array().cast("array<string>")), lambda p: path.startswith(p))


def delay_passed(now_ms: Column, last_ms: Column, delay_s: Column) -> Column:
    """Whether a host may be asked again: no delay, never asked, or that many whole seconds have passed."""
    waited = F.floor((now_ms - last_ms) / 1000)
    return (F.coalesce(delay_s, F.lit(0)) == 0) | last_ms.isNull() | (waited >= delay_s)
