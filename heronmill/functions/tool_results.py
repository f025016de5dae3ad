"""Tool results made to fit: noisy keys dropped, arrays and strings cut, repeats removed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MOST_BYTES = 32 * 1024
#: Items and characters kept, tried in order until a result fits.
POLICIES = ((8, 2000), (6, 1000), (5, 500), (3, 250))
#: Members that carry no content.
NOISE = frozenset("html raw raw_content raw_html base64 binary".split())


def address(item) -> str | None:
    """What identifies an item: its url, uri or link."""
    if isinstance(item, dict):
        return next((item[k] for k in ("url", "uri", "link") if isinstance(item.get(k), str) and item[k]), None)
    return None


def compacted(value, items: int, chars: int):
    """One value under a policy."""
    if isinstance(value, str):
        if value[:1] in "{[" and value:
            try:
                return compacted(json.loads(value), items, chars)
            except ValueError:
                pass
        return value if len(value) <= chars else value[:chars] + "…"
    if isinstance(value, list):
        out, seen = [], set()
        for item in value:
            known = address(item)
            if known is None or known not in seen:
                out.append(compacted(item, items, chars))
                seen.add(known)
            if len(out) == items:
                break
        return out
    if isinstance(value, dict):
        keep = {k: v for k, v in value.items() if k not in NOISE and not (k == "data" and isinstance(v, str) and len(v.encode()) > 4096)}
        return {k: compacted(v, items, chars) for k, v in keep.items()}
    return value


def compact(text: str | None) -> str | None:
    """A result of at most 32 KiB (I08, I09); what fits is not touched."""
    if text is None or len(text.encode()) <= MOST_BYTES:
        return text
    try:
        value = json.loads(text)
    except ValueError:
        return json.dumps({"truncated": True, "text": text[:2000]}, ensure_ascii=False)
    for items, chars in POLICIES:
        out = json.dumps(compacted(value, items, chars), ensure_ascii=False, separators=(",", ":"))
        if len(out.encode()) <= MOST_BYTES:
            return out
    return json.dumps({"truncated": True}, separators=(",", ":"))


@pandas_udf(StringType())
def compact_results(texts: pd.Series) -> pd.Series:
    return texts.map(compact, na_action="ignore")
