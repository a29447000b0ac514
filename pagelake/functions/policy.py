"""Page policy as CASE expressions: bot walls, need for a browser, retries, charset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.transforms import col

#: vendor -> (what its wall says, weight). Signs are matched in the body.
WALLS = {
    "datadome": (r"datadome|captcha-delivery\.com", 0.7),
    "hcaptcha": (r"hcaptcha\.com|\bh-captcha\b", 0.8),
    "recaptcha": (r"google\.com/recaptcha|\bg-recaptcha\b", 0.8),
    "turnstile": (r"challenges\.cloudflare\.com|\bcf-turnstile\b", 0.8),
    "cloudflare": (r"cf-browser-verification|checking your browser before|cf[-_]chl|attention required! \| cloudflare", 0.7),
    "akamai": (r"akamai.{0,40}(?:reference|denied)|_abck", 0.7),
    "perimeterx": (r"perimeterx|_pxcaptcha|px-captcha", 0.7),
    "imperva": (r"incapsula incident|_incap_|imperva", 0.7),
}
BLOCK_TEXT = r"access denied|unusual traffic|verify you are (?:a )?human|are you a robot|too many requests|temporarily blocked"
RETRYABLE = [408, 425, 429, 500, 502, 503, 504, 509, 520, 521, 522, 523, 524]


def detect_block(html, status=None) -> Column:
    """struct(blocked, confidence, vendor, signals) of a response."""
    body = F.lower(F.coalesce(col(html), F.lit("")))
    s = F.coalesce(col(status), F.lit(200)) if status is not None else F.lit(200)
    hits = [(v, body.rlike(p), w) for v, (p, w) in WALLS.items()]
    any_hit = reduce(lambda a, b: a | b, [h for _, h, _ in hits])
    refusal = body.rlike(BLOCK_TEXT)
    total = reduce(lambda a, b: a + b, [F.when(h, F.lit(w)).otherwise(F.lit(0.0)) for _, h, w in hits])
    total = total + F.when(s == 403, 0.4).when(s == 429, 0.5).when((s == 503) & (refusal | any_hit), 0.5).otherwise(0.0)
    total = total + F.when((s == 200) & (F.length(body) < 500) & (any_hit | refusal), 0.25).otherwise(0.0)
    confidence = F.round(F.least(F.lit(1.0), total), 2)
    vendor = F.coalesce(*[F.when(h, F.lit(v)) for v, h, _ in hits])
    signals = F.array_compact(F.array(*[F.when(h, F.lit(v)) for v, h, _ in hits], F.when(s.isin(403, 429, 503), F.concat(F.lit("status "), s.cast("string")))))
    return F.struct((confidence >= 0.5).alias("blocked"), confidence.alias("confidence"), vendor.alias("vendor"), signals.alias("signals"))


def challenge_action(block: Column, strategy: str = "render") -> Column:
    """What to do about a wall: pass, render, or fail."""
    return F.when(~block["blocked"], "pass").when((F.lit(strategy) == "render") & (block["confidence"] < 0.9), "render").otherwise("fail")


def visible_text(html) -> Column:
    c = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", " "), "<[^>]*>", " "), r"\s+", " "))


def needs_rendering(html, least: int = 200) -> Column:
    """struct(needed, reason): whether a page is empty until its scripts run."""
    h = F.coalesce(col(html), F.lit(""))
    shell = r"(?i)<div[^>]*\bid=[\"']?(?:root|app|__next|__nuxt)[\"']?[^>]*>\s*</div>"
    reason = (
        F.when(F.trim(h) == "", "empty")
        .when(h.rlike(shell), "empty app root")
        .when(h.rlike(r"(?is)<noscript[^>]*>[^<]*(?:enable|requires?|need)[^<]*javascript"), "noscript message")
        .when(F.length(visible_text(h)) < least, "little text")
    )
    return F.struct(reason.isNotNull().alias("needed"), reason.alias("reason"))


def retry_decision(status, attempt, most: int = 3, base_ms: int = 1000, factor: float = 2.0, cap_ms: int = 30_000) -> Column:
    """struct(retry, raw_delay_ms, adjust); a delay is then drawn from [raw / 2, raw]."""
    s, n = col(status), col(attempt)
    retry = s.isin(RETRYABLE) & (n < most)
    raw = F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(factor), (n - 1).cast("double")))
    adjust = F.when(s == 429, "slow down").when(s.isin(503, 509), "back off").when(s == 408, "wait longer")
    return F.struct(retry.alias("retry"), F.when(retry, raw).alias("raw_delay_ms"), F.when(retry, adjust).alias("adjust"))


def backoff(raw: Column, seed: int = 7) -> Column:
    return raw * (0.5 + F.rand(seed) / 2)


def retry_after_ms(value, now) -> Column:
    """Retry-After in milliseconds: seconds, or an HTTP date."""
    v = F.trim(col(value))
    at = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(v.rlike(r"^\d+$"), v.try_cast("long") * 1000), F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(at) - F.unix_millis(col(now).cast("timestamp")))))


def error_class(status) -> Column:
    """struct(code, retryable) of a failed fetch."""
    s = col(status)
    code = F.when(s.isNull(), "NETWORK").when(s == 429, "RATE_LIMITED").when(s.isin(401, 403), "FORBIDDEN").when(s == 404, "NOT_FOUND").when(s >= 500, "SERVER").when(s >= 400, "CLIENT")
    return F.struct(code.alias("code"), (s.isNull() | s.isin(RETRYABLE)).alias("retryable"))


def charset(html, content_type=None) -> Column:
    """The declared charset: header, meta, XML declaration, else utf-8."""
    head = F.lower(F.left(col(html), F.lit(2048)))
    header = F.lower(F.regexp_extract(col(content_type), r"(?i)charset=[\"']?([\w-]+)", 1)) if content_type is not None else F.lit("")
    found = [header, F.regexp_extract(head, r"<meta[^>]+charset=[\"']?([\w-]+)", 1), F.regexp_extract(head, r"<\?xml[^>]+encoding=[\"']([\w-]+)", 1)]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit("utf-8"))
