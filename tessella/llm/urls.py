"""URL filters by temporal list join: each capture is held against the lists as they stood at its time.

A list is a log of revisions (entry, since, verdict): from since on, the entry says block or allow, or nothing where verdict
is null (withdrawn), until its next revision. An entry is a host, which stands for its subdomains too, or a host and a path,
which stands for what is below it. Of the entries in force at a capture's time the one with the longest host decides,
then the one with the longest path; without any the verdict is null and the capture stays.

Revisions become validity intervals: each holds from its time on until the next revision of the same entry. A capture meets
an interval by equal keys, its host and parent hosts, each with every prefix of the path, and by its time; as intervals of
an entry do not overlap, it meets one an entry, however often that was revised. Hosts are held against the listed hosts
first, so that only captures of these are told by path. Expressions and joins only; intervals are broadcast where they are
few, otherwise a host with many captures is a skewed join, which adaptive execution splits.

Defined results: the interval of a revision holds its start and not its end; of revisions of an entry at one time block
comes before allow and allow before null; revisions without entry or time are ignored; captures without URL, host or time
get no verdict; repeated captures are judged each; other columns are kept; an empty table or list is fine. Scheme, user,
port, a trailing dot, query and fragment do not count; hosts compare in lower case, paths as they are but for repeated and
trailing slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import few, scratch, settle, unused

NONE = "cast(null as struct<entry:string,since:timestamp,verdict:string>)"


def host(url: Column) -> Column:
    """Host in lower case, without user, port and trailing dot."""
    rest = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.$", ""))


def path(url: Column) -> Column:
    """Path without query, fragment and trailing slash, repeated slashes as one; empty for the root."""
    rest = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    whole = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+", "/")
    return F.regexp_replace(whole, "/$", "")


def _joined(parts: Column, first: Column | int, size: Column, by: str) -> Column:
    return F.array_join(F.slice(parts, first, size), by)


def hosts(url: Column) -> Column:
    """Array of the host and its parents; addresses have no parents."""
    name = host(url)
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _joined(labels, i, F.size(labels) - i + 1, "."))
    return F.when(name == "", F.array().cast("array<string>")).when(name.rlike(r"^[0-9.]+$|:"), F.array(name)).otherwise(parents)


def prefixes(url: Column) -> Column:
    """Array of the path and the paths above it, the root's empty one among them."""
    parts = F.split(path(url), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: _joined(parts, 1, i, "/"))


def intervals(revisions: DataFrame) -> DataFrame:
    """(host, path, since, until, verdict, entry) of every revision that holds for some time; until is null for the last of an entry."""
    entry = F.regexp_replace(F.trim("entry"), r"^\*?\.", "")
    rank = F.when(F.col("verdict") == "block", 2).when(F.col("verdict") == "allow", 1).otherwise(0)
    rows = revisions.where("entry is not null and since is not null").select(host(entry).alias("host"), path(entry).alias("path"), F.col("since").cast("timestamp").alias("since"), rank.alias("rank"), "verdict", "entry").where("host <> ''")
    after = Window.partitionBy("host", "path").orderBy("since", "rank", "verdict", "entry")
    rows = rows.withColumn("until", F.lead("since").over(after)).where("until is null or since < until")
    return rows.select("host", "path", "since", "until", "verdict", "entry")


def judge(captures: DataFrame, revisions: DataFrame, url: str = "url", at: str = "at") -> DataFrame:
    """captures with rule: (entry, since, verdict) of the revision that decides, or null."""
    u, t = unused(captures, "url", "at")
    with scratch():
        listed = settle(intervals(revisions).where("verdict is not null"), "url-intervals", keep=True)
    asked = captures.select(F.col(url).alias(u), F.col(at).cast("timestamp").alias(t)).where(F.col(u).isNotNull() & F.col(t).isNotNull()).distinct()
    known = asked.select(u, t, F.explode(hosts(F.col(u))).alias("host")).join(few(listed.select("host").distinct()), "host", "left_semi")
    met = known.select(u, t, "host", F.explode(prefixes(F.col(u))).alias("path")).join(few(listed), ["host", "path"])
    met = met.where((F.col("since") <= F.col(t)) & (F.col("until").isNull() | (F.col(t) < F.col("until"))))
    decided = met.groupBy(u, t).agg(F.max_by(F.struct("entry", "since", "verdict"), F.struct(F.length("host"), F.length("path"))).alias("rule"))
    found = captures.join(decided, (captures[f"`{url}`"] == decided[u]) & (captures[f"`{at}`"].cast("timestamp") == decided[t]), "left")
    return found.select(*[captures[f"`{c}`"] for c in captures.columns], F.coalesce("rule", F.expr(NONE)).alias("rule"))
