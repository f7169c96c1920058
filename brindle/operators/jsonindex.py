"""Token indexes over JSON documents: postings of every key and value, intersected, then rechecked on the document."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import jsons


def _scalar(x: Any) -> list[str]:
    # equal numbers have equal hashes, however they are written; recheck tells apart what collides
    if x is None or isinstance(x, (bool, str)):
        return [type(x).__name__, str(x)]
    return ["number", str(hash(x))]


def _inner(x: Any, path: list[str], out: set[str]) -> set[str]:
    """A token for each key and each value, with the keys on the way; places in arrays don't count."""
    if isinstance(x, dict):
        for k, v in x.items():
            out.add(json.dumps(["key", *path, k]))
            _inner(v, [*path, k], out)
    elif isinstance(x, list):
        for v in x:
            _inner(v, path, out)
    else:
        out.add(json.dumps(["value", *path, *_scalar(x)]))
    return out


def _top(key: str) -> str:
    return json.dumps(["top", key])


def _all(x: Any) -> list[str]:
    tops = x if isinstance(x, (dict, list)) else [x]
    return sorted(_inner(x, [], set()) | {_top(k) for k in tops if isinstance(k, str)})


tokens = jsons._udf(T.ArrayType(T.StringType()), _all)


def token_index(docs: DataFrame, id: str, doc: str) -> DataFrame:
    """id and token for each distinct token of each document."""
    return docs.select(F.col(id).alias("id"), F.explode(tokens(doc)).alias("token"))


def _having(docs: DataFrame, index: DataFrame, id: str, wanted: Sequence[str], least: int) -> DataFrame:
    """Rows of docs whose id has at least ``least`` of the wanted tokens."""
    if not least:
        return docs
    hits = index.filter(F.col("token").isin(*wanted)).groupBy("id").agg(F.count_distinct("token").alias("n")).filter(F.col("n") >= least)
    return docs.join(hits.select(F.col("id").alias("__hit")), F.col(id).eqNullSafe(F.col("__hit")), "left_semi")


def containing(docs: DataFrame, index: DataFrame, id: str, doc: str, part: str) -> DataFrame:
    """docs @> part.  Without a token in part (an empty object or array) every document is a candidate."""
    wanted = sorted(_inner(jsons.loads(part), [], set()))
    return _having(docs, index, id, wanted, len(wanted)).filter(jsons.contains(F.col(doc), F.lit(part)))


def having_all(docs: DataFrame, index: DataFrame, id: str, doc: str, keys: Sequence[str]) -> DataFrame:
    """docs ?& keys; with one key docs ? key."""
    wanted = sorted({_top(k) for k in keys})
    return _having(docs, index, id, wanted, len(wanted)).filter(jsons.exists_all(doc, list(keys)))


def having_any(docs: DataFrame, index: DataFrame, id: str, doc: str, keys: Sequence[str]) -> DataFrame:
    """docs ?| keys."""
    wanted = sorted({_top(k) for k in keys})
    return _having(docs, index, id, wanted, 1).filter(jsons.exists_any(doc, list(keys))) if wanted else docs.limit(0)
