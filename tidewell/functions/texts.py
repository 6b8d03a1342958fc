"""Text helpers: blanks, user agents, device specs, object keys."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"

# User-agent names in the order they are tried, each with the
# words that show it; for browsers also the pattern of the version.  A subset
# of browsers and systems.
BROWSERS = [
    ("Internet Explorer", ("MSIE ", "Trident/"), "(?:MSIE |rv:)([.0-9]+)"),
    ("Edge", ("Edge/", "Edg/", "EdgiOS/", "EdgA/"), "Edg(?:e|iOS|A)?/([.0-9]+)"),
    ("Opera", ("OPR/", "Opera"), "(?:OPR|Opera)[/ ]([.0-9]+)"),
    ("Firefox", ("FxiOS/", "Firefox/"), "(?:FxiOS|Firefox)/([.0-9]+)"),
    ("Chrome", ("Chrome/", "CrMo/", "CriOS/"), "(?:Chrome|CrMo|CriOS)/([.0-9]+)"),
    ("Safari", ("Safari/",), "Version/([.0-9]+)"),
]
SYSTEMS = [
    ("Windows 10", "Windows NT 10.0"),
    ("Windows 8.1", "Windows NT 6.3"),
    ("Windows 8", "Windows NT 6.2"),
    ("Windows 7", "Windows NT 6.1"),
    ("Windows Vista", "Windows NT 6.0"),
    ("Windows XP", "Windows NT 5.1"),
    ("iPhone", "iPhone"),
    ("iPad", "iPad"),
    ("iPod", "iPod"),
    ("Mac OSX", "Mac OS X"),
    ("Android", "Android"),
    ("ChromeOS", "CrOS"),
    ("Linux", "Linux"),
]


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def non_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def same_text(left: Column, right: Column) -> Column:
    """Case-insensitive equality; null on either side is a mismatch."""
    return F.coalesce(F.lower(left) == F.lower(right), F.lit(False))


def _shows(agent: Column, words: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(agent, F.lit(word)) for word in words])


def user_agent(agent: Column) -> Column:
    """``struct(agent, ver, system, raw)``; null stays null.

    Plain word searches pick the browser, so only one pattern runs per row.
    """
    name, pattern_of, system = F, F, F
    for label, words, pattern in BROWSERS:
        shown = _shows(agent, words)
        name = name.when(shown, label)
        found = F.nullif(F.regexp_extract(agent, pattern, 1), F.lit(""))
        pattern_of = pattern_of.when(shown, F.coalesce(found, F.lit(UNKNOWN)))
    for label, word in SYSTEMS:
        system = system.when(F.contains(agent, F.lit(word)), label)
    parsed = F.struct(
        name.otherwise(UNKNOWN).alias("agent"),
        pattern_of.otherwise(UNKNOWN).alias("ver"),
        system.otherwise(UNKNOWN).alias("system"),
        agent.alias("raw"),
    )
    return F.when(agent.isNotNull(), parsed)


def user_agent_json(agent: Column) -> Column:
    """The parsed user agent as JSON text; null stays null."""
    return F.to_json(user_agent(agent))


def device_spec_json(spec: Column) -> Column:
    """A JSON object with every value as text; ``{}`` when there is none."""
    return F.coalesce(F.to_json(F.from_json(spec, "map<string,string>")), F.lit("{}"))


def object_key(url: Column) -> Column:
    """The storage key inside a download address.

    ``http`` addresses carry scheme, host and container before the key (four
    parts when split at slashes), others only scheme and host (three parts).
    """
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    skipped = F.when(F.contains(url, F.lit("http")), 4).otherwise(3)
    return F.array_join(F.slice(parts, skipped + 1, F.greatest(F.size(parts) - skipped, F.lit(0))), "/")


def file_day(path: Column) -> Column:
    """The first ``yyyy-MM-dd`` in a path, else ``default``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), F.lit("default"))


def cdn_url(host: str, key: Column) -> Column:
    return F.concat(F.lit(host + "/"), key)


def has_key(json_text: Column, key: str) -> Column:
    """True when a JSON object has the key; a missing object has none."""
    return F.coalesce(F.array_contains(F.json_object_keys(json_text), key), F.lit(False))
