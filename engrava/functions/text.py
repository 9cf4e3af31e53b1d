"""Column functions over text and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text, limit: int) -> Column:
    """At most ``limit`` code points, an ellipsis in place of what was cut."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def normalize_tags(tags) -> Column:
    """Trimmed, lower-cased, without blanks and repeats, in order of first appearance; null gives an empty array."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x) > 0))


#: The named entities of HTML's core and the two numeric forms of the apostrophe.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_unescape(text) -> Column:
    """Core entities replaced once; the ampersand last, so nothing is unescaped twice."""
    text = F.col(text) if isinstance(text, str) else text
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def compact_age(seconds) -> Column:
    """12s, 5m, 3h: the largest whole unit."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    whole = lambda n: F.floor(s / n).cast("string")
    return F.when(s < 60, F.concat(whole(1), F.lit("s"))).when(s < 3600, F.concat(whole(60), F.lit("m"))).otherwise(F.concat(whole(3600), F.lit("h")))


def parse_duration(text) -> Column:
    """Seconds of '90', '90s', '10m', '2h' or '1h30m'; null for anything else."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")), F.lit("999999999999")), F.lit(0)).cast("double")
    spelled = part("h") * 3600 + part("m") * 60 + part("s")
    return F.when(text.rlike(r"^\d+$"), text.cast("double")).when(text.rlike(r"^(?=\d)(\d+h)?(\d+m)?(\d+s)?$"), spelled)


def slug(url) -> Column:
    """Last path segment of a repository address, without '.git'."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.regexp_replace(url, r"(\.git)?/*$", ""), r"([^/:]+)$", 1)


def is_deploy(command, service: str = r"[\w.-]+") -> Column:
    """Whether a shell command restarts the service, or merges, copies or pushes a release."""
    command = F.col(command) if isinstance(command, str) else command
    ways = (rf"systemctl\s+(?:restart|reload)\s+{service}", r"gh\s+pr\s+merge", r"git\s+merge", rf"scp\s+.*{service}", r"git\s+push\s+.*(?:main|deploy)")
    return command.rlike("|".join(f"(?:{w})" for w in ways))


def message_line(text) -> Column:
    """Fields of a rendered message '#SEQ [KIND] FROM→TGT @AREA: TEXT'; nulls where it isn't one."""
    text = F.col(text) if isinstance(text, str) else text
    shape = r"^#(\d+) \[([^\]]*)\] ([^→@\s]+)(?:→(\S+))? @([^:]+): (.*)$"
    take = lambda n: F.when(text.rlike(shape), F.regexp_extract(text, shape, n))
    return F.struct(take(1).cast("long").alias("seq"), take(2).alias("kind"), take(3).alias("sender"), take(4).alias("target"), take(5).alias("area"), take(6).alias("text"))


def task_suffix(state, holder, lease_until, deadline) -> Column:
    """'  ⟨claimed by x · lease 12:40 · due 12:55⟩' of a task (times in UTC); '' without a state."""
    state, holder, lease, due = (F.col(c) if isinstance(c, str) else c for c in (state, holder, lease_until, deadline))
    clock = lambda ns: F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "HH:mm")
    held = state.isin("claimed", "overdue")
    first = F.when(held & (F.coalesce(holder, F.lit("")) != ""), F.concat(state, F.lit(" by "), holder)).otherwise(state)
    parts = F.array_compact(F.array(
        first,
        F.when(held & (lease > 0), F.concat(F.lit("lease "), clock(lease))),
        F.when((due > 0) & ~state.isin("done", "cancel"), F.concat(F.lit("due "), clock(due))),
    ))
    return F.when(F.coalesce(state, F.lit("")) == "", "").otherwise(F.concat(F.lit("  ⟨"), F.array_join(parts, " · "), F.lit("⟩")))


#: Fixed value: bytes of a composed recall query.
QUERY_BYTES = 500


def capped(text, limit: int = QUERY_BYTES) -> Column:
    """At most ``limit`` bytes; a code point cut in two is dropped."""
    text = F.col(text) if isinstance(text, str) else text
    fits = F.octet_length(text) <= limit
    cut = F.regexp_replace(F.decode(F.substring(F.encode(text, "UTF-8"), 1, limit), "UTF-8"), "\ufffd+$", "")
    return F.when(fits, text).otherwise(cut)


def intro(readme) -> Column:
    """Heading and first paragraph of a readme as one line, without marks; at most ``QUERY_BYTES`` bytes."""
    text = F.col(readme) if isinstance(readme, str) else readme
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^[#> ]+", ""), r"^\s+|\s+$", ""))
    start = lambda ls: F.coalesce(F.nullif(F.array_position(F.transform(ls, lambda x: x != ""), True), F.lit(0)), F.size(ls) + 1)
    cut = lambda ls: F.slice(ls, start(ls).cast("int"), F.greatest(F.size(ls), F.lit(1)))
    body = cut(lines)
    rest = cut(F.slice(body, 2, F.greatest(F.size(body), F.lit(1))))
    end = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda x: x == ""), True), F.lit(0)), F.size(rest) + 1)
    paragraph = F.slice(rest, 1, (end - 1).cast("int"))
    return capped(F.trim(F.regexp_replace(F.concat_ws(" ", F.slice(body, 1, 1), paragraph), r"\s+", " ")))


def recall_query(slug_, intro_, fallback) -> Column:
    """What a session is recalled by: 'slug: intro', one of them, or the fallback."""
    slug_, intro_, fallback = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (slug_, intro_, fallback))
    both = F.when((slug_ != "") & (intro_ != ""), F.concat(slug_, F.lit(": "), intro_))
    return capped(both.when(slug_ != "", slug_).when(intro_ != "", intro_).otherwise(fallback))


def owner_slug(url) -> Column:
    """'org/repo' of a repository address over https or ssh; '' if it has fewer than two parts."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    plain = F.regexp_replace(url, r"\.git$", "")
    path = F.when(plain.startswith("git@"), F.regexp_extract(plain, r"([^:]*)$", 1)).otherwise(F.regexp_extract(plain, r"^(?:[a-z+]+://)?[^/]*/(.*)$", 1))
    return F.regexp_extract(F.regexp_replace(path, r"^/+|/+$", ""), r"([^/]+/[^/]+)$", 1)


def wake_decision(max_seq, cursor, stopping, tool_uses, every: int) -> Column:
    """What a session does at the end of a turn: 'wake' on news, else 'reflect' when due; 'alert' on news while stopping; else 'close'."""
    max_seq, cursor, stopping, tool_uses = (F.col(c) if isinstance(c, str) else c for c in (max_seq, cursor, stopping, tool_uses))
    news = F.coalesce(max_seq, F.lit(0)) > cursor
    return F.when(~stopping & news, "wake").when(~stopping & (tool_uses >= every), "reflect").when(stopping & news, "alert").otherwise("close")
