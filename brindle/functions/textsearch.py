"""Text search without stemming: lexemes are lower-cased runs of letters, digits and underscores.

Vectors and queries are texts in the usual notation, 'lexeme':1,2 and 'a' & 'b', so they compare and print alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.base import col, val

#: The words that the english configuration leaves out of vectors made from JSON.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the to was were with".split()

_TOKEN = "[A-Za-z0-9_]+"
_ENTRY = r"'((?:''|[^'])*)'(?::([0-9A-D,]+))?"


def terms(s) -> Column:
    return F.regexp_extract_all(F.lower(col(s)), F.lit(_TOKEN), 0)


def _render(words: Column, stop: list[str] | None = None) -> Column:
    distinct = F.array_sort(F.array_distinct(words))
    if stop:
        distinct = F.filter(distinct, lambda w: ~w.isin(*stop))
    places = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, (i + 1).cast("string"))), lambda p: p.isNotNull())
    return F.array_join(F.transform(distinct, lambda w: F.concat(F.lit("'"), w, F.lit("':"), F.array_join(places(w), ","))), " ")


def to_tsvector(s) -> Column:
    return _render(terms(s))


def words_to_tsvector(words, config: str = "english") -> Column:
    """Of an array of words in order, as a JSON document gives them."""
    return _render(col(words), STOP_WORDS if config.lower() == "english" else None)


def _joined(s, operator: str) -> Column:
    return F.array_join(F.transform(terms(s), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), operator)


def to_tsquery(s) -> Column:
    return _joined(s, " & ")


plainto_tsquery = websearch_to_tsquery = to_tsquery


def phraseto_tsquery(s) -> Column:
    return _joined(s, " <-> ")


def ts_match_vq(vector, query) -> Column:
    """The operator @@: the vector has every lexeme of the query."""
    return F.size(F.array_except(terms(val(query)), terms(val(vector)))) == 0


def ts_rank(vector, query) -> Column:
    return F.when(ts_match_vq(vector, query), F.lit(0.1)).otherwise(F.lit(0.0)).cast("float")


ts_rank_cd = ts_rank


def ts_headline(document, query) -> Column:
    """The document with the query's words in bold."""
    document, wanted = col(document), terms(val(query))
    words = F.regexp_extract_all(document, F.lit(_TOKEN), 0)
    gaps = F.split(document, _TOKEN, -1)
    marked = F.transform(words, lambda w: F.when(F.array_contains(wanted, F.lower(w)), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return F.array_join(F.zip_with(gaps, marked, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def _entries(vector) -> Column:
    v = val(vector)
    names = F.regexp_extract_all(v, F.lit(_ENTRY), 1)
    places = F.regexp_extract_all(v, F.lit(_ENTRY), 2)
    return F.zip_with(names, places, lambda n, p: F.struct(n.alias("name"), F.filter(F.split(p, ","), lambda x: x != "").alias("places")))


def _written(entries: Column) -> Column:
    one = lambda e: F.concat(F.lit("'"), e["name"], F.lit("'"), F.when(F.size(e["places"]) > 0, F.concat(F.lit(":"), F.array_join(e["places"], ","))).otherwise(""))
    return F.array_join(F.transform(F.array_sort(entries), one), " ")


def strip(vector) -> Column:
    return _written(F.transform(_entries(vector), lambda e: F.struct(e["name"].alias("name"), F.array().cast("array<string>").alias("places"))))


def ts_delete(vector, lexeme: str) -> Column:
    return _written(F.filter(_entries(vector), lambda e: e["name"] != lexeme.lower()))


def setweight(vector, weight: str) -> Column:
    again = lambda e: F.transform(e["places"], lambda p: F.concat(F.rtrim(p, F.lit("ABCD")), F.lit(weight.upper())))
    return _written(F.transform(_entries(vector), lambda e: F.struct(e["name"].alias("name"), again(e).alias("places"))))


def ts_filter(vector, weights: str) -> Column:
    kept = lambda e: F.filter(e["places"], lambda p: F.substring(p, -1, 1).isin(*weights.upper()))
    entries = F.transform(_entries(vector), lambda e: F.struct(e["name"].alias("name"), kept(e).alias("places")))
    return _written(F.filter(entries, lambda e: F.size(e["places"]) > 0))


def tsvector_to_array(vector) -> Column:
    return F.array_sort(F.transform(_entries(vector), lambda e: e["name"]))


def array_to_tsvector(words) -> Column:
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(col(words), F.lower))), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), " ")


def numnode(query) -> Column:
    q = val(query)
    signs = sum((F.regexp_count(q, F.lit(p)) for p in ("&", r"\|", "!", "<->")), F.lit(0))
    return F.when(F.trim(q) == "", 0).otherwise(F.size(terms(q)) + signs)


def tsquery_phrase(a, b) -> Column:
    return F.array_join(F.transform(F.concat(terms(val(a)), terms(val(b))), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), " <-> ")


def ts_rewrite(query, target: str, new: str) -> Column:
    return F.replace(val(query), F.lit(target), F.lit(new))
