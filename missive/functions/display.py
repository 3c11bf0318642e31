"""Values as they are shown or checked, all as column expressions in the JVM."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_LENGTH = 4096
#: Names that Windows keeps for devices.
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def size_text(n: Column) -> Column:
    """Bytes in units of 1,024, with one decimal from kilobytes on."""
    out = F.format_string("%d B", n)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def utc_seconds(seconds: Column) -> Column:
    """Whole seconds since 1970 as ``YYYY-MM-DDTHH:MM:SSZ``, by integers alone, so whatever the session's time zone is.
    Years from 10,000 on have no sign either."""
    seconds = seconds.cast("long")
    rest = F.pmod(seconds, F.lit(86_400)).cast("long")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds - rest) / 86_400).cast("int")).cast("string")
    return F.concat(F.ltrim(day, F.lit("+")), F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def utc_text(at: Column) -> Column:
    """A timestamp as whole seconds in UTC."""
    return utc_seconds(F.unix_seconds(at))


def zoned(text: Column) -> Column:
    """The instant of a text; one without a zone is UTC, whatever the session's is.  Null for what is no time."""
    return F.try_to_timestamp(F.when(text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)\s*$"), text).otherwise(F.concat(F.trim(text), F.when(F.length(F.trim(text)) <= 10, F.lit("T00:00:00Z")).otherwise(F.lit("Z")))))


def local_text(utc: Column, zone: str) -> Column:
    """A UTC text as minutes on the clocks of ``zone``."""
    clock = utc_seconds(F.unix_seconds(F.from_utc_timestamp(zoned(utc), zone)))
    return F.replace(F.substring(clock, 1, 16), F.lit("T"), F.lit(" "))


def masked(text: Column) -> Column:
    """Local parts of addresses cut to two characters, values of secrets hidden."""
    addresses = F.regexp_replace(text, r"([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+)", "$1***@$2")
    return F.regexp_replace(addresses, r"(?i)\b(password|token|secret)(\s*[=:]\s*)\S+", "$1$2***")


def short_subject(text: Column) -> Column:
    return F.when(F.length(text) > 20, F.concat(F.substring(text, 1, 20), F.lit("..."))).otherwise(text)


def has_flag(flags: Column, flag: str) -> Column:
    return F.array_contains(F.split(F.coalesce(flags, F.lit("")), r"\s+"), flag)


def status(remote_state: Column, flags: Column) -> Column:
    """Deleted before unread before flagged before none."""
    unread, flagged = ~has_flag(flags, "\\Seen"), has_flag(flags, "\\Flagged")
    return F.when(remote_state == "deleted", "deleted").when(unread, "unread").when(flagged, "flagged").otherwise("none")


def shown_subject(subject: Column, local_state: Column, failure_class: Column) -> Column:
    subject = F.coalesce(subject, F.lit(""))
    large = F.when(failure_class == "oversize", F.concat(subject, F.lit(" [oversize]"))).otherwise(subject)
    return F.when(local_state == "purged", "(purged)").otherwise(large)


def allowed_url(url: Column) -> Column:
    """Web addresses that may be opened: no control or formatting characters, no user, a host,
    and a port that can be one."""
    form = r"(?i)^https?://([^/?#@:\[\]\s]+|\[[0-9a-f:.]+\])(:[0-9]{0,5})?([/?#].*)?$"
    port = F.nullif(F.regexp_extract(url, r"(?i)^https?://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1), F.lit(""))
    plain = ~url.rlike(r"[\p{Cc}\p{Cf}\p{Cs}]")
    return F.coalesce((F.length(url) <= URL_LENGTH) & plain & url.rlike(form) & F.coalesce(port.cast("long") <= 65535, F.lit(True)), F.lit(False))


def valid_account(account: Column) -> Column:
    """Whether an account id can name a folder anywhere."""
    bad = account.isin("", ".", "..") | account.rlike(r'[\p{Cc}<>:"/\\|?*]') | account.rlike(r"[. ]$") | account.rlike(DEVICES)
    return F.coalesce(~bad & (F.octet_length(account) <= 255), F.lit(False))


def attachment_names(attachments: Column) -> Column:
    shown = F.filter(attachments, lambda a: ~a["is_inline"] & a["filename"].isNotNull())
    return F.array_join(F.transform(shown, lambda a: a["filename"]), "\n")


def message_path(account: Column, internal_date: Column, sha256: Column) -> Column:
    """Where a message's file is: by account, month and content."""
    month = F.coalesce(F.replace(F.substring(utc_text(zoned(internal_date)), 1, 7), F.lit("-"), F.lit("/")), F.lit("unknown"))
    return F.concat_ws("/", F.lit("eml"), account, month, F.concat(F.substring(sha256, 1, 32), F.lit(".eml")))


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def seconds_left(done: Column, total: Column, elapsed: Column) -> Column:
    """At the rate so far; null without one."""
    rate = done / F.nullif(elapsed, F.lit(0.0))
    return (total - done) / F.nullif(rate, F.lit(0.0))


def retry_wait(base: float, attempt: Column, draw: Column) -> Column:
    """``retry_delay`` of a table's rows; ``draw`` is from 0 to 1."""
    return base * F.pow(F.lit(2.0), attempt) * (1 + draw / 10)


def retry_delay(base: float, attempt: int, rng: random.Random | None = None) -> float:
    """Seconds before try ``attempt`` (from 0): doubling, with up to a tenth more."""
    wait = base * 2**attempt
    return wait + (rng or random).uniform(0, wait / 10)
