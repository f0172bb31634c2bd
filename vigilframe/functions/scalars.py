"""Scalar functions on raw fields, all as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*values: Column) -> Column:
    """A stable key of several values."""
    return F.sha2(F.to_json(F.array(*values)), 256)


def clean_text(text: Column) -> Column:
    """Trimmed, without one pair of equal quotes around it."""
    t = F.trim(text)
    quoted = (F.length(t) >= 2) & (F.substring(t, 1, 1) == F.substring(t, -1, 1)) & F.substring(t, 1, 1).isin("'", '"')
    return F.when(quoted, F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)


def epoch(text: Column) -> Column:
    """Seconds from a 10-digit number, ``/Date(ms)/`` or an ISO time (UTC where no zone is named); null otherwise."""
    number = F.when(text.rlike(r"^\d{10}(\.\d+)?$"), text.try_cast("double"))
    dotnet = F.regexp_extract(text, r"^\s*/?Date\(([-+]?\d+)(?:[-+]\d{4})?\)/?\s*$", 1)
    millis = F.when(dotnet != "", dotnet.try_cast("double") / 1000)
    iso = F.unix_micros(F.try_to_timestamp(F.trim(text))) / 1e6
    return F.coalesce(number, millis, F.when(text.rlike(r"^\s*\d{4}-\d\d-\d\d"), iso))


def location(image: Column) -> Column:
    """The place of an executable, in order of precedence."""
    p = F.translate(F.lower(image), "/", "\\")
    has = lambda s: F.contains(p, F.lit(s))
    return (
        F.when(F.startswith(p, F.lit("\\\\")), "network-share")
        .when(has("\\temp\\") | has("\\tmp\\"), "temporary")
        .when(has("\\downloads\\"), "downloads")
        .when(has("\\users\\") | has("\\appdata\\"), "user-profile")
        .when(has("\\windows\\"), "windows")
        .when(has("\\program files"), "program-files")
        .when(p != "", "other")
        .otherwise("unknown")
    )


def redact_path(image: Column) -> Column:
    return F.substring(F.regexp_replace(image, r"(?i)(\\users\\)[^\\]+", "$1<user>"), 1, 1024)


def basename(path: Column) -> Column:
    """The last part of a path in lower case, 255 characters at most; ``unknown`` if there is none."""
    return F.coalesce(F.nullif(F.substring(F.lower(F.trim(F.regexp_extract(path, r"([^\\/]*)$", 1))), 1, 255), F.lit("")), F.lit("unknown"))


#: What the flags of a command line look for.
FLAG_PATTERNS = {
    "remote_reference": r"https?://",
    "encoded_argument": r"(?:^|\s)-(?:e|en|enc|enco|encodedcommand)\s+\S+",
    "download_primitive": r"downloadstring|downloadfile|invoke-webrequest|\biwr\b|\bcurl(?:\.exe)?\b|start-bitstransfer",
    "execution_primitive": r"\biex\b|invoke-expression|start-process|javascript:|vbscript:",
}
#: Applications that run what they fetch, and applications that run scripts.
FETCH_AND_RUN = ("mshta.exe", "regsvr32.exe")
SCRIPT_APPS = ("powershell.exe", "pwsh.exe", "mshta.exe", "regsvr32.exe", "cmd.exe", "cscript.exe", "wscript.exe", "rundll32.exe")


def command_flags(command: Column, app: Column) -> dict[str, Column]:
    """Flags of a command line; only its first 32,768 characters count."""
    text = F.substring(F.lower(command), 1, 32768)
    flags = {name: text.rlike(pattern) for name, pattern in FLAG_PATTERNS.items()}
    flags["execution_primitive"] = flags["execution_primitive"] | (app.isin(*FETCH_AND_RUN) & flags["remote_reference"])
    flags["shell_chain"] = F.contains(text, F.lit("&&")) | F.contains(text, F.lit("|"))
    return flags


def sha256_of(hashes: Column) -> Column:
    """The SHA-256 of a ``NAME=hex,NAME=hex`` list in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(hashes, F.lit("")), r"(?i)(?:^|,)\s*SHA256=([0-9a-f]{64})(?![0-9a-f])", 1))


def guid(text: Column) -> Column:
    """A GUID without braces in lower case, null if it is none."""
    g = F.lower(F.regexp_replace(F.trim(text), r"^\{|\}$", ""))
    return F.when(g.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), g)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def name_shape(image: Column) -> Column:
    """A file's name with ``{number}`` for runs of digits, if five letters or more anchor it; null without a name."""

    def shape(name: Column) -> Column:
        def of(stem: Column) -> Column:
            letters = F.length(F.regexp_replace(stem, r"[^\p{L}]", ""))
            numbered = F.concat(F.regexp_replace(stem, "[0-9]+", "{number}"), name.substr(F.length(stem) + 1, F.length(name)))
            return F.when((letters >= 5) & stem.rlike("[0-9]"), numbered).otherwise(name)

        return F.when(~name.isin("unknown", "-"), let(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), of))

    return let(basename(image), shape)


def csv_safe(text: Column) -> Column:
    return F.when(text.rlike("^[\\ufeff \\t\\r\\n]*[=+\\-@]") | text.rlike("^[\\t\\r\\n\\ufeff]"), F.concat(F.lit("'"), text)).otherwise(text)


def symbol(text: Column) -> Column:
    """Upper snake case."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def shown(value: Column, fallback: str = "—") -> Column:
    """A value as shown: the fallback where it is missing or empty."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) == "", fallback).otherwise(value.cast("string"))


def glob_pattern(glob: str) -> str:
    """A file name pattern (``*``, ``?``, ``[a-z]``, ``[!a-z]``) as a regular expression for whole names, letter case and all."""
    out, k = [], 0
    while k < len(glob):
        c, k = glob[k], k + 1
        end = glob.find("]", k + (glob[k : k + 1] == "!") + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = glob[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[{'^' + inside[1:] if inside.startswith('!') else inside}]")
            k = end + 1
        else:
            out.append(c if c.isalnum() or c == "_" else "\\" + c)
    return f"(?s)^{''.join(out)}\\z"


def matches_glob(name: Column, glob: str) -> Column:
    return name.rlike(glob_pattern(glob))


def contains_ignoring_case(name: Column, text: str) -> Column:
    """A search as the inbox has it: ``%`` and ``_`` of the text stand for any letters."""
    return name.ilike(f"%{text[:100]}%")


def is_domain_name(query: Column) -> Column:
    """A DNS question that names a domain."""
    return F.contains(query, F.lit("."))


def next_span(current: Column, ceiling: Column, received: Column, maximum: Column, attempts: Column, fill: float = 0.65) -> Column:
    """The span of the next slice: smaller where the last one was nearly full or had to be cut, twice as long where it was
    nearly empty, never beyond the ceiling. fill: how full a slice should be."""
    span, top = F.greatest(F.lit(1), current), F.greatest(F.lit(1), ceiling)
    share = received / maximum
    same = F.least(span, top)
    smaller = F.least(top, F.greatest(F.lit(1), F.floor(span * fill / share)))
    return (
        F.when(maximum <= 0, same)
        .when((attempts > 1) | (share > 0.75), F.when(received <= 0, same).otherwise(smaller))
        .when((share < 0.45) & (span < top), F.least(top, F.greatest(span + 1, span * 2)))
        .otherwise(same)
        .cast("long")
    )
