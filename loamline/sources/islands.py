"""JSON that pages carry in their scripts: linked data as rows, and texts out of the state of a page's program."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of keys whose values are no content, the shortest text that counts as content, and the deepest level looked at.
SKIPPED_KEYS = [
    "config", "settings", "env", "buildid", "theme", "locale", "i18n", "translation", "track", "analytic", "gtag", "gtm", "telemetr", "beacon", "sentry",
    "consent", "cookie", "advert", "experiment", "abtest", "featureflag", "feature_flag", "flag", "nonce", "csrf", "token", "apikey", "webpack", "chunk",
    "runtime", "hydrat", "manifest", "version",
]
LEAST_CHARS, DEEPEST = 120, 24

LINKED = r"""(?is)<script\b[^>]*?\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
STATE = re.compile(r"""\btype\s*=\s*["']?\s*application/json\s*["']?(?:\s|$)|\bid\s*=\s*["']?__NEXT_DATA__\b""", re.I)


def linked_items(html: Column) -> Column:
    """Linked-data items of a page as an array of JSON texts: members of lists and of @graph one by one; nothing from the first bad block on."""
    blocks = F.filter(F.transform(F.regexp_extract_all(html, F.lit(LINKED), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    bad = F.array_position(F.transform(blocks, lambda b: F.get_json_object(b, "$").isNull()), F.lit(True))
    sound = F.when(bad > 0, F.slice(blocks, F.lit(1), (bad - 1).cast("int"))).otherwise(blocks)

    def members(block: Column) -> Column:
        graph = F.get_json_object(block, "$['@graph']")
        listed = lambda x: F.from_json(x, "array<string>")
        graphed = F.startswith(block, F.lit("{")) & F.startswith(graph, F.lit("[")) & (F.size(listed(graph)) > 0)
        one = F.when(F.startswith(block, F.lit("{")), F.array(block)).otherwise(F.array().cast("array<string>"))
        return F.when(F.startswith(block, F.lit("[")), listed(block)).when(graphed, listed(graph)).otherwise(one)

    return F.flatten(F.transform(sound, members))


def texts_of(html: str | None) -> list[str]:
    """Distinct long strings of a page's state, in document order."""
    found: dict[str, None] = {}
    for marks, body in SCRIPT.findall(html or ""):
        if not STATE.search(marks):
            continue
        try:
            left = [(json.loads(body), 0)]
        except (ValueError, RecursionError):
            continue
        while left:
            node, depth = left.pop()
            if depth > DEEPEST:
                continue
            if isinstance(node, dict):
                inner = [v for k, v in node.items() if not any(s in k.lower() for s in SKIPPED_KEYS)]
                left += [(v, depth + 1) for v in reversed(inner)]
            elif isinstance(node, list):
                left += [(v, depth + 1) for v in reversed(node)]
            elif isinstance(node, str) and len(node.strip()) >= LEAST_CHARS:
                found[node.strip()] = None
    return list(found)


def island_texts(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, place (from 0), text of each long string in the state that pages carry, one Arrow batch at a time.

    Bad JSON and pages without a state have no rows; so have null pages. Repeated keys are read page by page.
    """
    kept = df.select(key, html)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, place int, text string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, place, text) for i, page in enumerate(batch.column(1)) for place, text in enumerate(texts_of(page.as_py()))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[key, "place", "text"]
            )

    return kept.mapInArrow(read, schema)
