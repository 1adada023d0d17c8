"""What goes over the wire to providers: requests made and replies read, as plain functions, and providers over a transport.

A request is a dict (url, headers, body: text). A transport is a function from
a request to (status, body); ``Offline`` answers each wire by itself, so nothing
here needs a network. Providers have the interface of ``operators.provider``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import parse_qs, quote, urlencode

from lexiweave.operators.provider import CallError

# The wires' paths, versions and limits.
CHAT_PATH, MESSAGES_PATH, FORM_PATH = "chat/completions", "messages", "translate_a/single"
MESSAGES_VERSION, MOST_TOKENS = "2023-06-01", 8192
FORM_BASE = "https://translate.googleapis.com"

Request = dict
Transport = Callable[[Request], tuple[int, str]]


def joined(base: str, path: str, query: str = "") -> str:
    url = f"{base.rstrip('/')}/{path}"
    return f"{url}{'&' if '?' in url else '?'}{query}" if query else url


def posted(url: str, headers: dict, body: dict) -> Request:
    return {"url": url, "headers": {"Content-Type": "application/json"} | headers, "body": json.dumps(body, ensure_ascii=False)}


def credentials(style: str, key: str) -> tuple[dict, str]:
    """(headers, query) that carry a key: as bearer token, in the query, or under a header of that name."""
    if style == "bearer":
        return {"Authorization": f"Bearer {key}"}, ""
    return ({}, f"key={quote(key, safe='')}") if style == "query" else ({style: key}, "")


def chat_request(base: str, key: str, model: str, system: str, user: str, *, temperature: float = 0.2, json_mode: bool = True, auth: str = "bearer", query: str = "", headers: dict | None = None, body: dict | None = None) -> Request:
    proof, more = credentials(auth, key)
    talk = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    wanted = {"response_format": {"type": "json_object"}} if json_mode else {}
    return posted(joined(base, CHAT_PATH, "&".join(filter(None, (more, query)))), proof | (headers or {}), {"model": model, "temperature": temperature, "messages": talk} | wanted | (body or {}))


def messages_request(base: str, key: str, model: str, system: str, user: str, *, temperature: float = 0.2, auth: str = "x-api-key", query: str = "", headers: dict | None = None, body: dict | None = None) -> Request:
    proof = {"Authorization": f"Bearer {key}"} if auth == "bearer" else {auth: key}
    said = {"model": model, "max_tokens": MOST_TOKENS, "temperature": temperature, "system": system, "messages": [{"role": "user", "content": user}]}
    return posted(joined(base, MESSAGES_PATH, query), {"anthropic-version": MESSAGES_VERSION} | proof | (headers or {}), said | (body or {}))


def form_request(base: str, text: str, source: str, target: str) -> Request:
    query = urlencode({"client": "gtx", "sl": source or "auto", "tl": target, "dt": "t", "dj": 1})
    return {"url": joined(base or FORM_BASE, FORM_PATH, query), "headers": {"Content-Type": "application/x-www-form-urlencoded;charset=UTF-8"}, "body": "q=" + quote(text, safe="")}


def json_request(base: str, text: str, source: str, target: str) -> Request:
    return posted(base.strip(), {}, {"text": text, "source_lang": source or "AUTO", "target_lang": target})


def at(data, *path):
    """What lies at a path of keys and indices, None where it breaks off."""
    for step in path:
        try:
            data = data[step]
        except (KeyError, IndexError, TypeError):
            return None
    return data


def chat_text(data) -> str | None:
    return at(data, "choices", 0, "message", "content")


def messages_text(data) -> str | None:
    blocks = at(data, "content")
    texts = [at(b, "text") for b in blocks if at(b, "type") == "text"] if isinstance(blocks, list) else []
    return "".join(t for t in texts if isinstance(t, str))


def form_text(data) -> str | None:
    """Sentences, as objects or as lists."""
    rows = at(data, "sentences") if isinstance(data, dict) else at(data, 0)
    return "".join(str(at(r, "trans" if isinstance(r, dict) else 0) or "") for r in rows) if isinstance(rows, list) else ""


def json_text(data) -> str | None:
    return data["data"] if isinstance(at(data, "data"), str) else at(data, "translation")


def read(status: int, body: str, text_of: Callable) -> str:
    """The text of a reply; CallError where the status is bad or there is none."""
    if not 200 <= status < 300:
        raise CallError(body[:300], status=status, retryable=status in (408, 425, 429) or status >= 500)
    try:
        data = json.loads(body)
    except ValueError:
        data = None
    code = at(data, "code")
    text = text_of(data)
    if (code is not None and text_of is json_text and float(code) != 200) or not isinstance(text, str) or not text.strip():
        soft = float(code) == 429 or float(code) >= 500 if code is not None else text_of is not json_text
        raise CallError(str(at(data, "message") or "an empty or unknown reply"), status=status, retryable=soft)
    return text


@dataclass
class Model:
    """A language model behind a wire ("chat" or "messages"). JSON mode is given up for good where a service refuses it."""

    transport: Transport
    wire: str = "chat"
    base: str = "https://api.x.example/v1"
    key: str = "k"
    model: str = "m"
    language: str = "fr"
    compile: Callable | None = None
    plain: set = field(default_factory=set)
    fallbacks: int = 0

    def messages(self, items: list[tuple[int, str]]) -> tuple[str, str]:
        if self.compile:
            return self.compile(items)
        return f"Translate each item into {self.language}.", json.dumps({"items": [{"i": i, "t": t} for i, t in items]}, ensure_ascii=False)

    def complete(self, items: list[tuple[int, str]]) -> str:
        system, user = self.messages(items)
        if self.wire == "messages":
            return read(*self.transport(messages_request(self.base, self.key, self.model, system, user)), messages_text)
        mode = (self.base, self.model) not in self.plain
        status, body = self.transport(chat_request(self.base, self.key, self.model, system, user, json_mode=mode))
        if mode and status == 400 and re.search("response_format|json_object", body, re.IGNORECASE):
            self.plain.add((self.base, self.model))
            self.fallbacks += 1
            status, body = self.transport(chat_request(self.base, self.key, self.model, system, user, json_mode=False))
        return read(status, body, chat_text)


@dataclass
class Engine:
    """A machine translation service behind a wire ("form" or "json")."""

    transport: Transport
    wire: str = "form"
    base: str = ""
    source: str = ""
    target: str = "fr"

    def translate(self, text: str) -> str:
        if self.wire == "form":
            return read(*self.transport(form_request(self.base, text, self.source, self.target)), form_text)
        return read(*self.transport(json_request(self.base or "https://x.example/translate", text, self.source, self.target)), json_text)


class Offline:
    """Answers every wire: marks each line, or each item, with the language. Refuses JSON mode, and is busy at the first call of texts of three items."""

    def __init__(self):
        self.busy: set = set()

    def __call__(self, request: Request) -> tuple[int, str]:
        url, body = request["url"], request["body"]
        if FORM_PATH in url:
            text = self.marked(parse_qs(body, keep_blank_values=True, strict_parsing=True, max_num_fields=1, separator="\0")["q"][0], re.search("[?&]tl=([^&]*)", url)[1])
            return 200, json.dumps({"sentences": [{"trans": text[i : i + 50]} for i in range(0, len(text), 50)], "src": "en"})
        said = json.loads(body)
        if "target_lang" in said:
            if said["text"].count("UNIT_") == 3 and said["text"] not in self.busy:
                self.busy.add(said["text"])
                return 200, json.dumps({"code": 429, "message": "busy"})
            return 200, json.dumps({"code": 200, "data": self.marked(said["text"], said["target_lang"].lower())})
        if "response_format" in said:
            return 400, "response_format is not known here"
        items = json.loads(said["messages"][-1]["content"])["items"]
        reply = json.dumps({"items": [{"i": x["i"], "t": f"[fr] {x['t']}"} for x in items]}, ensure_ascii=False)
        if "max_tokens" in said:
            return 200, json.dumps({"content": [{"type": "thinking", "thinking": "..."}, {"type": "text", "text": reply[:9]}, {"type": "text", "text": reply[9:]}]})
        return 200, json.dumps({"choices": [{"message": {"role": "assistant", "content": f"```json\n{reply}\n```"}}]})

    @staticmethod
    def marked(text: str, language: str) -> str:
        return re.sub(r"(?m)^(?!__LW_)(?=.)", f"[{language}] ", text)
