"""Scalar helpers over columns. All are built-in expressions; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def normalize_remote(url: Column) -> Column:
    """host/owner/repo in lower case, whatever way the remote was written."""
    s = F.regexp_replace(F.regexp_replace(F.trim(url), r"\.git$", ""), "/$", "")
    scp = F.regexp_replace(F.regexp_replace(s, "^git@", ""), "^([^:]*):", "$1/")
    ssh = F.regexp_replace(s, "^ssh://(git@)?", "")
    web = F.regexp_replace(s, "^https?://", "")
    return F.lower(F.when(s.startswith("git@"), scp).when(s.startswith("ssh://"), ssh).otherwise(web))


def strip_userinfo(url: Column) -> Column:
    """The url without user and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)?[^/@]*@", "$1")


def split_namespaced(ticket: Column) -> tuple[Column, Column]:
    """(namespace or empty, bare id) of ``namespace/id``."""
    has = F.instr(ticket, "/") > 0
    return F.when(has, F.substring_index(ticket, "/", 1)).otherwise(F.lit("")), F.when(has, F.regexp_replace(ticket, "^[^/]*/", "")).otherwise(ticket)


def split_worktree(slug: Column) -> tuple[Column, Column]:
    """(project slug, worktree or empty)."""
    mark = "--claude-worktrees-"
    at = F.instr(slug, mark)
    return F.when(at > 0, F.substring_index(slug, mark, 1)).otherwise(slug), F.when(at > 0, F.regexp_extract(slug, f"{mark}(.*)$", 1)).otherwise(F.lit(""))


def title_case(name: Column) -> Column:
    """The first character in upper case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.regexp_replace(name, "^.", ""))


def truncate_bytes(text: Column, most: int, mark: str = "…") -> Column:
    """At most ``most`` bytes of UTF-8, with ``mark`` after a cut; a cut character is replaced."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(mark))).otherwise(text)


def ordered_distinct(order: Column, value: Column) -> Column:
    """N7 (aggregate): the distinct non-empty values in the order of their first sight."""
    pairs = F.collect_list(F.when(value.isNotNull() & (value != ""), F.struct(order.alias("o"), value.alias("v"))))
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda p: p["v"]))


def first_non_empty(*values: Column) -> Column:
    """N8"""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def round_usd(x: Column) -> Column:
    """To a millionth, half away from zero."""
    return F.round(x, 6)


def parse_time(text: Column) -> Column:
    """An RFC 3339 time, or null. The shape is tested first: Spark's cast also takes words and bare dates."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(text.isNotNull(), F.coalesce(F.get(lines, 0), F.lit("")))


def safe_component(text: Column) -> Column:
    """A name that is safe as one path component."""
    return text.rlike(r"^[A-Za-z0-9._-]+$") & ~text.isin(".", "..") & ~text.startswith(".")


def artifact_id_ok(text: Column) -> Column:
    """A note's id: word characters, dots and dashes, opening with a letter or digit."""
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def scope_name_ok(text: Column) -> Column:
    """A scope's name."""
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def subject_names_ticket(subject: Column, ticket: Column) -> Column:
    """The subject opens with ``[ticket]`` or ``[namespace/ticket]``."""
    found = F.regexp_extract(subject, r"^\[([^\]]*)\]", 1)
    return (ticket != "") & subject.startswith("[") & (F.instr(subject, "]") > 0) & ((found == ticket) | F.endswith(found, F.concat(F.lit("/"), ticket)))


def ticket_marker(subject: Column) -> Column:
    """C4: the id in a leading ``[id]``, else in a trailing one; null if none."""
    head = F.regexp_extract(subject, r"^\[([^\] \t]+)\]", 1)
    tail = F.regexp_extract(subject, r"\[([^\[\] \t]+)\]$", 1)
    return first_non_empty(head, tail)


def friction_signature(message: Column) -> Column:
    """The first line with uuids, pids, paths and long numbers replaced, in that order."""
    s = F.substring_index(message, "\n", 1)
    for pattern, to in (
        (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
        (r"(?i)\bpid[ =:]*\d+", "pid <pid>"),
        (r"(^|[^A-Za-z0-9_.~-])(~?/[^\s\"')]+)", "$1<path>"),
        (r"\d{3,}", "<n>"),
        (r"\s+", " "),
    ):
        s = F.regexp_replace(s, pattern, to)
    return truncate_bytes(F.trim(s), 300, "")


def sanitize_controls(text: Column) -> Column:
    """C0, C1 and DEL as ``\\xNN``."""
    code = lambda c: F.ascii(c)
    shown = lambda c: F.when((code(c) < 32) | code(c).between(127, 159), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(code(c)), 2, "0")))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), shown), "")


def flatten_controls(text: Column) -> Column:
    """L6, one line: control characters to spaces, runs of spaces to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " "), " +", " "))
