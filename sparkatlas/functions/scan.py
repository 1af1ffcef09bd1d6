"""State-machine functions on single strings, for pandas UDFs and the driver: what column expressions can't say."""

from __future__ import annotations

import fnmatch
import json
import random
import re
import time
from email.utils import parsedate_to_datetime


def split_top_level(text: str, sep: str = ",") -> list[str]:
    """Parts between separators outside of parentheses and double quotes (a backslash escapes one), trimmed; empty ones stay but the last."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"' and text[i - 1 : i] != "\\":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == sep and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if start < len(text) else out


def json_blocks(text: str) -> list[str]:
    """The outermost {...} blocks."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def extract_json(text: str) -> str:
    """A fenced JSON block, any fenced block (less the rest of the fence's line), or the first brace block of a model's answer."""
    for fence in (r"```json(.*?)```", r"```[^\n]*\n(.*?)```", r"```(.*?)```"):
        if m := re.search(fence, text, re.DOTALL):
            return m[1].strip()
    return next(iter(json_blocks(text)), "")


def parse_summary(text: str) -> dict:
    """A structured answer, or the raw text as its summary."""
    try:
        got = json.loads(extract_json(text))
        if isinstance(got, dict) and got.get("summary"):
            return {"summary": str(got["summary"]), "key_classes": list(got.get("key_classes") or []), "dependencies": list(got.get("dependencies") or [])}
    except ValueError:
        pass
    return {"summary": text.strip(), "key_classes": [], "dependencies": []}


def excluded(path: str, patterns: list[str]) -> bool:
    """Whether a relative path matches a pattern as a whole, or its last name one less a leading `**/`. `*` stops at `/`."""
    def matches(name: str, pattern: str) -> bool:
        a, b = name.split("/"), pattern.replace("**", "*").split("/")
        return len(a) == len(b) and all(fnmatch.fnmatchcase(x, y) for x, y in zip(a, b, strict=True))

    return any(matches(path, p) or matches(path.rsplit("/", 1)[-1], p.removeprefix("**/")) for p in patterns)


def pack(sizes: list[int], most_items: int = 128, most_tokens: int = 100_000) -> list[int]:
    """The batch number of each item, packed greedily in order; an item that is too large has a batch of its own."""
    out, batch, items, tokens = [], 0, 0, 0
    for n in sizes:
        if items and (items == most_items or tokens + n > most_tokens):
            batch, items, tokens = batch + 1, 0, 0
        items, tokens = items + 1, tokens + n
        out.append(batch)
    return out


def retry_after(value: str, now: float) -> float | None:
    """Seconds to wait by a Retry-After header: a number or a date."""
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None


def backoff(attempt: int, hint: float | None = None, base: float = 0.2, cap: float = 10.0, jitter: float = 0.25) -> float:
    """Seconds before the next attempt: doubled each time; a hint wins; both are capped."""
    wait = min(cap, hint if hint is not None else base * 2 ** (attempt - 1))
    return wait * (1 + random.uniform(-jitter, jitter))


def retried(call, attempts: int = 4, sleep=time.sleep):
    """call(), again after errors that may pass (OSError, TimeoutError)."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except (OSError, TimeoutError):
            if n == attempts:
                raise
            sleep(backoff(n))
