"""Identity, url, language, error and configuration functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiweave.functions.text import trim

SEPARATOR = "\u0001"
PROMPT_VERSION = 14
# Names of languages and their codes.
LANGUAGE_ALIASES = {
    "简体中文": "zh-CN", "简体": "zh-CN", "中文": "zh-CN", "chinese": "zh-CN", "chinese simplified": "zh-CN", "simplified chinese": "zh-CN",
    "繁體中文": "zh-TW", "繁体中文": "zh-TW", "繁體": "zh-TW", "繁体": "zh-TW", "chinese traditional": "zh-TW", "traditional chinese": "zh-TW",
    "english": "en", "英语": "en", "英文": "en", "日本語": "ja", "日语": "ja", "japanese": "ja", "français": "fr", "法语": "fr", "french": "fr",
    "deutsch": "de", "德语": "de", "german": "de", "español": "es", "西班牙语": "es", "spanish": "es", "한국어": "ko", "韩语": "ko", "korean": "ko",
    "русский": "ru", "俄语": "ru", "russian": "ru", "português": "pt", "葡萄牙语": "pt", "portuguese": "pt", "italiano": "it", "意大利语": "it", "italian": "it",
    "nederlands": "nl", "荷兰语": "nl", "dutch": "nl", "polski": "pl", "波兰语": "pl", "polish": "pl", "العربية": "ar", "阿拉伯语": "ar", "arabic": "ar",
    "українська": "uk", "乌克兰语": "uk", "ukrainian": "uk", "ไทย": "th", "泰语": "th", "thai": "th", "tiếng việt": "vi", "越南语": "vi", "vietnamese": "vi",
    "türkçe": "tr", "土耳其语": "tr", "turkish": "tr", "bahasa indonesia": "id", "印度尼西亚语": "id", "indonesian": "id",
}
LANGUAGE_LABELS = {
    "zh-CN": "简体中文", "zh-TW": "繁體中文", "en": "English", "fr": "Français", "ja": "日本語", "ko": "한국어", "de": "Deutsch", "es": "Español", "pt": "Português", "it": "Italiano", "nl": "Nederlands",
    "pl": "Polski", "ru": "Русский", "uk": "Українська", "ar": "العربية", "tr": "Türkçe", "vi": "Tiếng Việt", "th": "ไทย", "id": "Bahasa Indonesia", "hi": "हिन्दी", "bn": "বাংলা", "he": "עברית",
    "fa": "فارسی", "sv": "Svenska", "da": "Dansk", "fi": "Suomi", "no": "Norsk", "cs": "Čeština", "el": "Ελληνικά", "ro": "Română", "hu": "Magyar", "ms": "Bahasa Melayu", "fil": "Filipino",
}
OLD_CODES = {"iw": "he", "in": "id", "nb": "no", "nn": "no", "tl": "fil"}


def mapped(key: Column, table: dict[str, str]) -> Column:
    """Look up in a small fixed table; null if absent."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def hash_of(*parts: Column) -> Column:
    """Identity of a tuple of texts; null counts as empty."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cache_key(provider: Column, endpoint: Column, model: Column, fingerprint: Column, text: Column) -> Column:
    return hash_of(provider, endpoint, model, fingerprint, text)


def language_code(x: Column) -> Column:
    """Code of a language's name or code; empty if unknown."""
    t = trim(F.coalesce(x, F.lit("")))
    shaped = t.rlike(r"(?i)^[a-z]{2,3}(?:[-_][a-z]{2,8})?\z")
    base, region = F.lower(F.regexp_extract(t, r"(?i)^([a-z]+)", 1)), F.upper(F.regexp_extract(t, r"(?i)^[a-z]+[-_]([a-z]+)\z", 1))
    code = F.when(region == "", base).otherwise(F.concat_ws("-", base, region))
    return F.coalesce(mapped(F.lower(t), LANGUAGE_ALIASES), F.when(shaped, code), F.lit(""))


def language_base(x: Column) -> Column:
    """Base language, old codes renewed; empty if unknown."""
    base = F.split_part(F.lower(language_code(x)), F.lit("-"), F.lit(1))
    return F.coalesce(mapped(base, OLD_CODES), F.when(base == "und", "").otherwise(base))


def language_label(x: Column) -> Column:
    code = F.lower(language_code(x))
    chinese = F.when(code.rlike("tw|hk|mo|hant"), "zh-TW").otherwise("zh-CN")
    return F.coalesce(mapped(F.when(code.rlike("^zh(-|$)"), chinese).otherwise(language_base(x)), LANGUAGE_LABELS), x)


def machine_target(x: Column, provider: Column) -> Column:
    """The code a provider wants; null where the language is unknown (``require`` raises)."""
    code = language_code(x)
    dlx = F.when(code == "zh-CN", "ZH").when(code == "zh-TW", "ZH-HANT").otherwise(F.upper(code))
    return F.when(code == "", None).when(provider == "deeplx", dlx).otherwise(code)


def require(x: Column, message: str) -> Column:
    return F.coalesce(x, F.raise_error(F.lit(message)).cast("string"))


def url_origin(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"(?i)^(https?://[^/?#\s]+)", 1), r"://[^@/]*@", "://"))


def safe_url(url: Column) -> Column:
    """Origin and path, long opaque path parts masked; no credentials, query or fragment."""
    t = trim(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(t, r"(?i)^https?://[^/?#]+(/[^?#]*)?", 1)
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"(?<=/)[A-Za-z0-9_-]{24,}(?=/|\z)", "[id]"))
    return F.when(t == "", "").when(url_origin(t) == "", "[invalid-url]").otherwise(F.concat(url_origin(t), path))


def origin_pattern(url: Column) -> Column:
    host = F.regexp_extract(trim(url), r"(?i)^https?://(?:[^@/?#]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(trim(url), r"(?i)^(https?)://", 1)), F.lit("://"), F.lower(host), F.lit("/*")))


def safe_string(x: Column, most: int = 320) -> Column:
    """Urls, bearer tokens, named secrets and keys masked; at most so long."""
    out = F.regexp_replace(x, r"(?i)(https?://)(?:[^@/\s\"'<>]*@)?([^\s\"'<>?#]+)[^\s\"'<>]*", "$1$2")
    out = F.regexp_replace(out, r"(?i)\bBearer\s+[^\s,;]+", "Bearer [redacted]")
    out = F.regexp_replace(out, r"(?i)\b(api[_ -]?key|authorization|cookie|password|secret)\s*[:=]\s*[^\s,;]+", "$1=[redacted]")
    return F.substring(F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{8,}\b", "[redacted-key]"), 1, most)


def error_class(message: Column, status: Column) -> Column:
    m, s = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(status, F.lit(0))
    return (
        F.when(s.isin(401, 403) | m.rlike("认证|auth|unauthor|forbidden"), "authentication")
        .when((s == 404) | m.rlike("接口不存在|not found"), "endpoint-not-found")
        .when((s == 408) | m.rlike("timeout|timed out|超时"), "timeout")
        .when((s == 429) | m.rlike("rate.?limit|速率限制|too many requests"), "rate-limit")
        .when(s >= 500, "server-error")
        .when(m.rlike("abort|cancel|取消|中止"), "aborted")
        .when(m.rlike("json|parse|解析"), "invalid-response")
        .when(m.rlike("空内容|内容为空|empty|漏项|没有返回"), "empty-response")
        .when(m.rlike("network|fetch|网络"), "network")
        .when(m.rlike("permission|权限|授权"), "permission")
        .otherwise("unclassified")
    )


def failure_class(source_limited: Column, invalid: Column, message: Column, status: Column, failed: Column) -> Column:
    """Why a chunk failed, first rule that holds; null if nothing did."""
    known = (F.coalesce(message, F.lit("")) != "") | (F.coalesce(status, F.lit(0)) > 0)
    return F.when(source_limited > 0, "source-limit").when(invalid > 0, "invalid-response").when(known, error_class(message, status)).when(failed > 0, "missing-items")


def finite_count(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")), 0.0).otherwise(x)


def retry_delay_ms(header: Column, now: Column) -> Column:
    """Retry-After as milliseconds: seconds, or an HTTP date; else 0."""
    seconds = F.expr("1").cast("double") * 0 + header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_timestamp(date) - F.unix_timestamp(now)) * 1000.0
    return F.greatest(F.lit(0.0), F.coalesce(seconds * 1000, until, F.lit(0.0)))


def base_url(x: Column, default: Column) -> Column:
    """Endpoint as typed to endpoint: quotes, scheme, trailing call path, and /v1 where the default has it."""
    t = F.regexp_replace(F.regexp_replace(trim(F.coalesce(x, F.lit(""))), "^[\\s\"'`]+", ""), "[\\s\"'`,]+\\z", "")
    local = t.rlike(r"^(localhost|127\.|0\.0\.0\.0|\[::1\])")
    t = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.when(local, "http://").otherwise("https://"), t))
    t = F.regexp_replace(t, r"/+\z", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)/(?:chat/completions|completions|messages)\z", ""), r"/+\z", "")
    bare = t.rlike(r"(?i)^https?://[^/]+\z") & (F.lower(F.regexp_extract(t, r"(?i)^https?://([^/:]+)", 1)) == F.lower(F.regexp_extract(default, r"(?i)^https?://([^/:]+)", 1)))
    t = F.when(default.endswith("/v1") & bare, F.concat(t, F.lit("/v1"))).otherwise(t)
    return F.when(trim(F.coalesce(x, F.lit(""))) == "", "").otherwise(t)


def key_level(key: Column, pattern: Column) -> Column:
    k = trim(F.coalesce(key, F.lit("")))
    return F.when(k == "", "empty").when(k.rlike(r"\s") | ((F.coalesce(pattern, F.lit("")) != "") & ~F.call_function("rlike", k, pattern)), "warn").otherwise("ok")


def is_injectable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(https?|file)://") & ~url.startswith("https://chromewebstore.google.com"), F.lit(False))


def is_configured(base: Column, key: Column, model: Column, language: Column, need_base: Column, need_key: Column, need_model: Column) -> Column:
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    return (~need_base | given(base)) & (~need_key | given(key)) & (~need_model | given(model)) & given(language)


# Parts of names of models that don't chat.
NO_CHAT = r"(?i)(embed|embedding|whisper|tts|audio|speech|image|vision-only|rerank|moderation|dall|sora|clip)"


def model_list(reply: Column) -> Column:
    """Names in a provider's reply, distinct and sorted: a bare list, or the one under data or models, of texts or of objects with id, name or model."""
    entries = lambda text: F.from_json(text, "array<string>")
    raw = F.coalesce(entries(F.when(F.ltrim(reply).startswith("["), reply)), entries(F.get_json_object(reply, "$.data")), entries(F.get_json_object(reply, "$.models")), F.array().cast("array<string>"))
    field = lambda x: F.coalesce(*[F.when(F.get_json_object(x, f"$.{k}") != "", F.get_json_object(x, f"$.{k}")) for k in ("id", "name", "model")])
    names = F.transform(raw, lambda x: F.when(x.startswith("{"), field(x)).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != ""))))


def chat_models(names: Column) -> Column:
    """Names of models that may chat; all of them if none is left."""
    left = F.filter(names, lambda x: ~x.rlike(NO_CHAT))
    return F.when(F.size(left) > 0, left).otherwise(names)
