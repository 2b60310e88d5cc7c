"""Answers of language models, as tolerant as they come: translations by id."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType


def bare(text: str) -> str:
    """What stands in the first fenced block, one of JSON before others; the whole text without any."""
    fence = "```json" if "```json" in text else "```"
    return (text.split(fence, 2)[1].split("```")[0] if fence in text else text).strip()


def translations(text: str | None) -> dict[str, str] | None:
    """Translated texts by id from a list of results, an object that holds one under ``translations`` or
    any other key, a single result, or a map of ids to texts; null if it is none of these."""
    try:
        data = json.loads(bare(text or ""))
    except ValueError:
        return None
    if isinstance(data, dict):
        lists = [data["translations"]] if data.get("translations") is not None else [v for v in data.values() if isinstance(v, list)]
        if lists:
            data = lists[0]
        elif "id" in data:
            data = [data]
        else:
            data = [{"id": k, "translated_text": v} for k, v in data.items() if isinstance(v, str)]
    if not isinstance(data, list):
        return None
    return {str(r["id"]): str(r.get("translated_text") or r.get("text") or "") for r in data if isinstance(r, dict) and "id" in r}


@pandas_udf(MapType(StringType(), StringType()))
def by_id(text: pd.Series) -> pd.Series:
    return text.map(translations)


def window(texts: list[str | None], headings: set[int], around: tuple[int, int], limit: int = 2500) -> str:
    """A page's lines as one text of at most ``limit`` characters: all of them, or those of the fragments
    ``around`` (from, to) and as many before and after, in turn, as it takes to fill it."""
    lines = [" ".join((t or "").split()) for t in texts]
    lines = [f"# {t}" if t and i in headings else t for i, t in enumerate(lines)]
    room = limit - sum(len(t) + 1 for t in lines)
    lo, hi = 0, len(lines)
    if room < 0:
        lo = min(max(around[0], 0), len(lines))
        hi = min(max(around[1], lo + 1), len(lines))
        room = limit - sum(len(t) + 1 for t in lines[lo:hi])
        while room > 0 and (lo > 0 or hi < len(lines)):
            if lo > 0:
                lo -= 1
                room -= len(lines[lo]) + 1
            if room > 0 and hi < len(lines):
                room -= len(lines[hi]) + 1
                hi += 1
    return "\n".join(t for t in lines[lo:hi] if t)[:limit]
