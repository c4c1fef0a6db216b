"""Functions over usage, task and catalog records: normal forms, buckets, states, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def wire_usage(u: Column) -> Column:
    """(prompt, completion, cache_hit) of a usage struct in any of three wire forms; null if it counts nothing or is estimated.

    Fields: prompt_tokens, completion_tokens, prompt_cache_hit_tokens, cached_tokens, input_tokens, output_tokens,
    cache_creation_input_tokens, cache_read_input_tokens, estimator.
    """
    parts = _zero(u["input_tokens"]) + _zero(u["cache_creation_input_tokens"]) + _zero(u["cache_read_input_tokens"])
    prompt = F.when(_zero(u["prompt_tokens"]) != 0, u["prompt_tokens"]).otherwise(parts)
    completion = F.when(_zero(u["completion_tokens"]) != 0, u["completion_tokens"]).otherwise(_zero(u["output_tokens"]))
    hit = F.coalesce(*[F.nullif(u[c], F.lit(0)) for c in ("prompt_cache_hit_tokens", "cached_tokens", "cache_read_input_tokens")], F.lit(0))
    nothing = u.isNull() | (F.coalesce(u["estimator"], F.lit("")) != "") | ((prompt == 0) & (completion == 0) & (hit == 0))
    return F.when(~nothing, F.struct(prompt.cast("long").alias("prompt"), completion.cast("long").alias("completion"), hit.cast("long").alias("cache_hit")))


#: Aliases of currencies. Fixed values.
CURRENCIES = {
    "CNY": ("CNY", "RMB", "CNH", "YUAN", "RENMINBI", "¥", "￥"),
    "USD": ("USD", "US$", "DOLLAR", "DOLLARS", "$"),
    "EUR": ("EUR", "EURO", "EUROS", "€"),
    "GBP": ("GBP", "POUND", "POUNDS", "STERLING", "£"),
    "JPY": ("JPY", "YEN"),
}


def currency(c: Column) -> Column:
    """The code of a currency's name or sign; other three-letter codes in upper case; else as it is."""
    value = F.trim(F.coalesce(c, F.lit("")))
    out = F.when(value.rlike("^[A-Za-z]{3}$"), F.upper(value)).otherwise(value)
    for code, names in CURRENCIES.items():
        out = F.when(F.upper(value).isin(*names), code).otherwise(out)
    return out


def significant(c: Column, digits: int = 12) -> Column:
    """A number in its shortest form of at most so many significant digits, with an exponent below -4 or from `digits` on."""
    form = F.format_string(f"%.{digits - 1}e", c.cast("double"))
    mantissa, power = F.substring_index(form, "e", 1), F.substring_index(form, "e", -1).cast("int")
    sign, number = F.when(c < 0, "-").otherwise(""), F.regexp_replace(mantissa, "[-.]", "")
    strip = lambda t: F.regexp_replace(t, "\\.?0+$", "")
    fraction = lambda head, tail: strip(F.concat(head, F.lit("."), tail))
    small = fraction(F.lit("0"), F.concat(F.repeat(F.lit("0"), -power - 1), number))
    whole = fraction(F.substring(number, F.lit(1), power + 1), F.concat(F.substring(number, power + 2, F.lit(digits)), F.lit("0")))
    signed = F.concat(F.when(power < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(power)))
    large = F.concat(fraction(F.substring(number, 1, 1), F.substring(number, 2, digits)), F.lit("e"), signed)
    return F.when(c == 0, "0").otherwise(F.concat(sign, F.when((power < -4) | (power >= digits), large).when(power < 0, small).otherwise(whole)))


def pricing_fingerprint(code: Column, hit: Column, miss: Column, output: Column) -> Column:
    """The first eight bytes of the SHA-256 of a rate card, in hex."""
    return F.substring(F.sha2(F.concat_ws("|", currency(code), *map(significant, (hit, miss, output))), 256), 1, 16)


def cache_bucket(hit: Column, miss: Column) -> Column:
    percent = F.floor(hit * 100 / F.when(hit + miss > 0, hit + miss))
    return F.when(percent.isNull(), "unknown").when(percent == 0, "0").when(percent < 25, "1_24").when(percent < 50, "25_49").when(percent < 75, "50_74").when(percent < 90, "75_89").otherwise("90_100")


def tool_error_bucket(message: Column) -> Column:
    v = F.lower(F.coalesce(message, F.lit("")))
    return F.when(v.rlike("permission|blocked|denied"), "permission").when(v.rlike("timeout|deadline"), "timeout").when(v.contains("cancel"), "cancelled").when(v.rlike("not found|no such"), "not_found").otherwise("other")


#: Names of permission modes, by bucket. Fixed values.
PERMISSIONS = {"ask": ("manual", "ask"), "auto": ("auto", "acceptedits"), "dont_ask": ("dontask",), "plan": ("plan",), "yolo": ("bypasspermissions", "yolo")}


def permission_bucket(value: Column) -> Column:
    v, out = F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("other")
    for bucket, names in PERMISSIONS.items():
        out = F.when(v.isin(*names), bucket).otherwise(out)
    return out


def safe_bucket(value: Column, fallback: str, most: int = 96) -> Column:
    """A name of a-z, 0-9 and single underscores for the rest, cut to `most`; the fallback for an empty one."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(name == "", fallback).otherwise(F.substring(name, 1, most))


def language_bucket(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.startswith("zh"), "zh").when(v.startswith("en"), "en").when(v.isin("", "auto"), "auto").otherwise("other")


#: Upper bounds of latencies in milliseconds, by bucket. Fixed values.
LATENCIES = {"lt_1s": 1000, "s_1_5": 5000, "s_5_15": 15_000, "s_15_60": 60_000, "m_1_5": 300_000, "m_5_15": 900_000}


def latency_bucket(ms: Column) -> Column:
    out = F.lit("m_15_plus")
    for bucket, bound in reversed(LATENCIES.items()):
        out = F.when(ms < bound, bucket).otherwise(out)
    return out


def exit_bucket(cancelled: Column, paused: Column, error: Column) -> Column:
    """How a turn ended; null flags are false, an error is its message."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(cancelled), "cancelled").when(yes(paused), "recovery_paused").when(error.isNotNull(), "error").otherwise("success")


def provider_error_bucket(kind: Column, status: Column) -> Column:
    """The bucket of a provider's error by its kind (auth, api, timeout, cancelled, network, interrupted) and, of an API's, its
    status; empty for others and none."""
    api = F.when(status == 429, "rate_limit").when(status >= 500, "server").when(status >= 400, "request").otherwise("http")
    return F.when(kind == "api", api).when(kind.isin("auth", "timeout", "cancelled", "network", "interrupted"), kind).otherwise("")


def finish_bucket(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v == "", "unknown").when(v.isin("stop", "tool_calls", "length", "content_filter", "repetition_truncation"), v).otherwise("other")


#: Terminal task states, and the states that may follow the others. Fixed values.
TERMINAL = ("succeeded", "failed", "cancelled", "stale")
NEXT = {"queued": ("running", "cancelled", "stale"), "running": ("waiting", *TERMINAL), "waiting": ("running", *TERMINAL)}


def valid_transition(now: Column, following: Column) -> Column:
    """Whether a task may go from one state to another; unknown states may follow any but a terminal one."""
    known = following.isin("queued", "running", "waiting", *TERMINAL)
    allowed = F.lit(True)
    for state, after in NEXT.items():
        allowed = F.when(now == state, following.isin(*after)).otherwise(allowed)
    return ~((now == following) | now.isin(*TERMINAL)) & (~known | allowed)


def reconciled(state: Column, runtime: Column, lease: Column, now: Column) -> Column:
    """(state, runtime) as seen now: a lease that has run out ends the runtime and leaves an unfinished task stale."""
    over = (runtime == "alive") & lease.isNotNull() & (now >= lease)
    return F.when(over, F.struct(F.when(state.isin(*TERMINAL), state).otherwise("stale").alias("state"), F.lit("exited").alias("runtime"))).otherwise(F.struct(state.alias("state"), runtime.alias("runtime")))


def active_since(activity: Column, what: str, now: Column) -> Column:
    """Whether a time passes a filter: all, today, yesterday, older, day, week, month or hours such as 36h."""
    day, value = F.date_trunc("day", now), what.strip().lower()
    if value in ("", "all"):
        return F.lit(True)
    if value == "today":
        return activity >= day
    if value == "yesterday":
        return (activity >= day - F.expr("interval 1 day")) & (activity < day)
    if value == "older":
        return activity < day - F.expr("interval 1 day")
    hours = {"day": 24, "week": 168, "7d": 168, "month": 720, "30d": 720}.get(value)
    if hours is None and value.endswith("h") and value[:-1].isdigit():
        hours = int(value[:-1])
    return activity >= now - F.expr(f"interval {hours} hours") if hours else F.lit(True)


def format_usd(v: Column) -> Column:
    """Up to four decimals, halves away from zero, no trailing zeros."""
    n = F.floor(F.abs(v) * 10000 + 0.5).cast("long")
    whole, rest = F.floor(n / 10000).cast("string"), F.lpad((n % 10000).cast("string"), 4, "0")
    text = F.when(n % 10000 > 0, F.concat(whole, F.lit("."), F.regexp_replace(rest, "0+$", ""))).otherwise(whole)
    return F.when((v < 0) & (n > 0), F.concat(F.lit("-"), text)).otherwise(text)


def format_duration(seconds: Column) -> Column:
    """42s, 1m23s or 1h2m."""
    n = F.floor(seconds + 0.5).cast("long")
    part = lambda x: x.cast("string")
    minutes = F.concat(part(F.floor(n / 60)), F.lit("m"), part(n % 60), F.lit("s"))
    return F.when(n < 60, F.concat(part(n), F.lit("s"))).when(n < 3600, minutes).otherwise(F.concat(part(F.floor(n / 3600)), F.lit("h"), part(F.floor(n % 3600 / 60)), F.lit("m")))


def strip_head(text: Column, markers: tuple[str, ...]) -> Column:
    """Without the leading lines that start with a marker, and the blank ones after them."""
    one = "|".join("\\Q" + m + "\\E" for m in markers)
    return F.regexp_replace(text, f"\\A(?:[^\\S\\n]*(?:{one})[^\\n]*(?:\\n|\\z)(?:[^\\S\\n]*(?:\\n|\\z))*?(?=[^\\n]*\\S|\\z))+", "")
