"""Every function of the dialect by its name."""

from __future__ import annotations

from collections.abc import Callable
from types import FunctionType

from brindle.functions import arrays, datetimes, jsons, maps, maths, misc, names, strings, textsearch, vectors

#: Names that differ from the library's: json and jsonb share functions, and some have a Python name of their own.
_RENAMED = {
    "numeric_power": maths.power, "json_typeof": jsons.typeof, "json_extract_path": jsons.extract_path, "json_extract_path_text": jsons.extract_path_text, "json_object": jsons.json_object, "json_set": jsons.set,
    "json_predicate": jsons.is_json, "json_path_exists_opr": jsons.path_exists, "json_path_match_opr": jsons.path_match, "hstore_slice": maps.slice, "hstore_delete": maps.delete, "vector_l2_squared_distance": vectors.l2_squared_distance,
    "vector_negative_inner_product": vectors.negative_inner_product, "vector_spherical_distance": vectors.spherical_distance, "overlaps": datetimes.overlaps, "similar_to": strings.similar_to, "regex_match_ci": strings.regex_match_ci,
}


def _public(module) -> dict[str, Callable]:
    return {n: f for n, f in vars(module).items() if not n.startswith("_") and callable(f) and (not isinstance(f, type)) and (isinstance(f, FunctionType) and f.__module__ in (module.__name__, "pyspark.sql.functions.builtin") or not isinstance(f, FunctionType))}


def functions() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in (misc, textsearch, vectors, maps, arrays, datetimes, maths, strings):
        found |= _public(module)
    for name, f in _public(jsons).items():
        plain = name.removeprefix("json_")
        for prefix in ("json_", "jsonb_"):
            found[prefix + plain] = f
    for name, f in _RENAMED.items():
        found[name] = f
        if name.startswith("json_"):
            found["jsonb_" + name.removeprefix("json_")] = f
    return found | _public(names)


def function(name: str) -> Callable:
    """A function by name; KeyError if there is none."""
    return functions()[name.lower()]
