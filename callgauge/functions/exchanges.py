"""Fields of raw model-call exchanges as column expressions; bodies are JSON strings of the chat-completions shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_checks import strict_value
from .json_dump import dumped_member

#: Fixed: the hosts whose traffic is captured, and the providers looked for in a host, in order.
DEFAULT_HOSTS = ("api.groq.com", "openrouter.ai", "api.openai.com", "api.anthropic.com")
PROVIDERS = ("groq", "openrouter", "openai", "anthropic")
NON_PARAMETERS = ("model", "messages", "prompt")
TEXT_CAP, ERROR_CAP, RATE_LIMIT_CAP = 4000, 1000, 500


def host_allowed(host: Column, hosts: Iterable[str] | None = None, exact: bool = False) -> Column:
    """Whether the host contains (or, if ``exact``, is) one of ``hosts``; no hosts mean the default ones."""
    found = F.lit(False)
    for allowed in hosts or DEFAULT_HOSTS:
        found = found | (host == allowed if exact else F.contains(host, F.lit(allowed)))
    return F.coalesce(found, F.lit(False))


def provider_of(host: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in PROVIDERS:
        out = out.when(F.contains(host, F.lit(name)), F.lit(name))
    return out.otherwise(host)


def normal_provider(provider: Column) -> Column:
    return F.lower(F.trim(provider))


def outcome_of_status(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status == 429, "rate_limited").otherwise("error")


def parsed(body: Column) -> Column:
    return strict_value(body)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _filled(value: Column, path: str) -> Column:
    """The value at a path as text; null if it is absent, null, an empty text, list or object, the number zero or false."""
    found = F.try_variant_get(value, path, "variant")
    text, kind = F.try_variant_get(value, path, "string"), F.schema_of_variant(found)
    number = F.try_variant_get(found, "$", "double")
    empty = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(kind == "VOID", True)
    empty = empty.when(kind.startswith("ARRAY"), text == "[]").when(kind.startswith("OBJECT"), text == "{}").otherwise(number == 0)
    return F.when(~F.coalesce(empty, F.lit(False)), text)


def model_id(request: Column, response: Column) -> Column:
    return F.coalesce(_filled(request, "$.model"), _filled(response, "$.model"), F.lit("unknown"))


def prompt_of(request: Column, body: Column) -> Column:
    """The messages as Python dumps them, or else the prompt, capped; empty if there is neither. request: the text ``body``, parsed."""
    messages = F.when(_filled(request, "$.messages").isNotNull(), dumped_member(body, "messages", F.try_variant_get(request, "$.messages", "variant"), TEXT_CAP))
    return F.coalesce(messages, F.left(_filled(request, "$.prompt"), F.lit(TEXT_CAP)), F.lit(""))


def request_parameters(request: Column) -> Column:
    """All but the content of the request, as JSON with sorted keys and typed values."""
    entries = F.map_filter(request.try_cast("map<string,variant>"), lambda k, v: ~k.isin(*NON_PARAMETERS))
    return F.coalesce(F.to_json(entries), F.lit("{}"))


def response_text(response: Column) -> Column:
    """The first choice's message content (empty if the key is absent), or else its text, capped."""
    message = F.try_variant_get(response, "$.choices[0].message", "variant")
    content = F.try_variant_get(message, "$.content", "variant")
    text = F.when(message.isNotNull(), F.when(content.isNull(), F.lit("")).otherwise(F.try_variant_get(content, "$", "string")))
    return F.left(text.otherwise(F.try_variant_get(response, "$.choices[0].text", "string")), F.lit(TEXT_CAP))


def token_count(response: Column, which: str) -> Column:
    return F.try_variant_get(response, f"$.usage.{which}", "bigint")


def error_message(response: Column, fallback: Column) -> Column:
    """The error's message, or the error itself, or ``fallback``."""
    message = F.when(is_object(F.try_variant_get(response, "$.error", "variant")), _filled(response, "$.error.message"))
    return F.coalesce(message, _filled(response, "$.error"), fallback)


def direct_outcome(status: Column, exception_kind: Column, body_ok: Column) -> Column:
    """Outcome of a call made here: anything but a readable success, a rate limit or a timeout is an error."""
    return F.when(exception_kind == "timeout", "timeout").when(status == 429, "rate_limited").when(status.between(200, 299) & body_ok, "ok").otherwise("error")


def direct_error(outcome: Column, body: Column, message: Column) -> Column:
    return F.when(outcome == "rate_limited", F.concat(F.lit("HTTP 429: "), F.left(F.coalesce(body, F.lit("")), F.lit(RATE_LIMIT_CAP)))).when(outcome == "timeout", message).when(outcome == "error", F.left(message, F.lit(ERROR_CAP)))


def chat_payload(model: Column, prompt: Column, parameters: dict | None = None) -> Column:
    """The body of a chat request with one user message; ``parameters`` come last and win."""
    base = {"model": model, "messages": F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))}
    base |= {k: F.lit(v) for k, v in (parameters or {}).items()}
    return F.to_json(F.struct(*(v.alias(k) for k, v in base.items())))


def shortened(text: Column, width: int = 120) -> Column:
    """White space collapsed, and cut at a word's end with `` [...]`` if longer than ``width``."""
    plain = F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    head = F.regexp_extract(plain, rf"^(.{{0,{width - 6}}})(?: |$)", 1)
    return F.when(F.length(plain) <= width, plain).otherwise(F.ltrim(F.concat(head, F.lit(" [...]"))))


def shown_parameters(parameters: Column) -> Column:
    """Parameters for display: compact JSON, the raw text if it is none, nothing for an empty object."""
    return F.when(parameters != "{}", F.coalesce(F.to_json(F.try_parse_json(parameters)), parameters))
