"""Message parsing as plain Python: what the tests hold the columns against."""

import base64
import binascii
import json

import re


def strip_html_text(html: str) -> str:
    """strip_html() of one text."""
    for tag in ("<br>", "<br/>", "<br />", "</p>", "</div>"):
        html = html.replace(tag, "\n")
    return re.sub(r"<[^>]*>", "", html).strip()


def _bytes(node: dict) -> bytes | None:
    """A body's data. JSON holds text; bytes that are no UTF-8 come as {"hex": ...}."""
    data = (node.get("body") or {}).get("data")
    if isinstance(data, dict):
        return bytes.fromhex(data["hex"])
    return data.encode() if isinstance(data, str) else None


def _plain(data: bytes | None) -> str | None:
    try:
        return data.decode() if data is not None else None
    except UnicodeDecodeError:
        return _decoded(data)


def _decoded(data: bytes | None) -> str | None:
    """URL-safe base64 with its padding, as UTF-8."""
    try:
        return base64.b64decode(data, b"-_", validate=True).decode() if data is not None else None
    except (binascii.Error, ValueError):
        return None


def _of_parts(parts: list[dict]) -> str | None:
    """Plain text first, depth first; then HTML of this level, which must be base64."""
    for part in parts:
        got = _plain(_bytes(part)) if part.get("mimeType") == "text/plain" else None
        if got is None and part.get("parts") is not None:
            got = _of_parts(part["parts"])
        if got is not None:
            return got
    for part in parts:
        got = _decoded(_bytes(part)) if part.get("mimeType") == "text/html" else None
        if got is not None:
            return strip_html_text(got)
    return None


def body_of(message: dict) -> str | None:
    """The parts' body, else the payload's own, else the snippet."""
    payload = message.get("payload") or {}
    got = _of_parts(payload["parts"]) if payload.get("parts") is not None else None
    got = _plain(_bytes(payload)) if got is None else got
    return message.get("snippet") if got is None else got


def parse(message: dict) -> dict:
    headers = (message.get("payload") or {}).get("headers") or []
    first = lambda name: next((h.get("value") for h in headers if (h.get("name") or "").lower() == name), None)
    to = first("to")
    return {"id": message.get("id") or "unknown", "subject": first("subject"), "snippet": message.get("snippet"), "from": first("from"), "to": [x.strip() for x in to.split(",")] if to is not None else None, "sent": first("date"), "body": body_of(message), "error": None}


def rows(raw):
    """The row of a raw message, as a dict."""
    try:
        got = json.loads(raw)
        if not isinstance(got, dict):
            raise ValueError("no object")
        return parse(got)
    except (TypeError, ValueError):
        return {"id": "unknown", "error": "no message"}
