"""Any JSON text in one form: keys sorted at every depth, numbers normal, named fields nulled or left out.

canonical_json() of functions.text needs the columns named in advance; what stands here needs no schema.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON scalar in canonical text, without backtracking.
_SCALAR = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|true|false|null)'


def canonical_text(raw: Column) -> Column:
    """The canonical form of JSON text; null for what is none or repeats a key."""
    return F.to_json(F.try_parse_json(raw))


def canonical_sha256(raw: Column) -> Column:
    return F.sha2(canonical_text(raw), 256)


def without_top(canonical: Column, names: list[str]) -> Column:
    """An object's canonical text less some of its own fields; those of inner objects stay."""
    fields = F.try_parse_json(canonical).try_cast("map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*names)))


def scrubbed(canonical: Column, nulled: list[str], dropped: list[str]) -> Column:
    """Canonical text in which fields of these names are null, or gone, at every depth.

    A quote before a name and a colon after it stand in canonical text only where the name is a key: in a string,
    quotes are escaped. Such a field must be a scalar; an object or a list under it is an error.
    """
    out = canonical
    for name in dropped:
        key = re.escape(f'"{name}":')
        for pattern in (rf"{key}{_SCALAR},", rf",{key}{_SCALAR}(?=\}})", rf"(?<=\{{){key}{_SCALAR}(?=\}})"):
            out = F.regexp_replace(out, pattern, "")
    for name in nulled:
        out = F.regexp_replace(out, re.escape(f'"{name}":') + _SCALAR, f'"{name}":null')
    left = [F.contains(canonical, F.lit(f'"{name}":{opening}')) for name in [*nulled, *dropped] for opening in "{["]
    if not left:
        return out
    inner = left[0]
    for other in left[1:]:
        inner = inner | other
    return F.when(inner, F.raise_error(F.lit("a field to be left out is no scalar")).cast("string")).otherwise(out)


def semantic_sha256(raw: Column, nulled: list[str] = ["serial_number"], dropped: list[str] = []) -> Column:  # noqa: B006
    """Hash of what a document says, whatever stands in the named fields and however its keys are ordered."""
    return F.sha2(scrubbed(canonical_text(raw), nulled, dropped), 256)


#: A candidate's component as it is embedded: fields, and the lists among them that are sets.
CANDIDATE = """candidate_id string, producer string, name string, version string, identifiers array<string>, roles array<string>,
    provenances array<struct<kind: string, locator: string, source_available: string>>, observed_hashes array<struct<algorithm: string, value: string>>, supplier_hashes array<struct<algorithm: string, value: string>>"""
_KEYS = {"": ["candidate_id", "identifiers", "name", "observed_hashes", "producer", "provenances", "roles", "supplier_hashes", "version"], "provenances": ["kind", "locator", "source_available"], "observed_hashes": ["algorithm", "value"], "supplier_hashes": ["algorithm", "value"]}


def _keys(value: Column, names: list[str]) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(value.try_cast("map<string,variant>"))) == F.array(*map(F.lit, names)), F.lit(False))


def canonical_list(values: Column) -> Column:
    """Whether an array is sorted and without repeats, as a set is written."""
    return values == F.array_sort(F.array_distinct(values))


def candidate_errors(raw: Column) -> Column:
    """What keeps each component of an embedded candidate list (JSON text) from being its own canonical projection.

    An array of index:rule: exact keys at both depths, sources that stay UNKNOWN, lists sorted without repeats; and
    ``order`` where the components themselves are not sorted by id, or ``list`` where the text is no list of objects.
    """
    items = F.try_parse_json(raw).try_cast("array<variant>")

    def each(item: Column, at: Column) -> Column:
        said = F.from_json(F.to_json(item), CANDIDATE)
        listed = lambda name: F.coalesce(F.try_variant_get(item, f"$.{name}", "array<variant>"), F.array(F.parse_json(F.lit("0"))))
        keyed = lambda names: lambda v: _keys(v, names)
        inner = [F.forall(listed(name), keyed(names)) for name, names in _KEYS.items() if name]
        exact = _keys(item, _KEYS[""]) & inner[0] & inner[1] & inner[2]
        rules = {
            "keys": exact,
            "source_available": F.forall(said["provenances"], lambda p: p["source_available"] == "UNKNOWN"),
            **{name: canonical_list(said[name]) for name in ("identifiers", "roles")},
            "provenances": canonical_list(F.transform(said["provenances"], lambda p: F.concat_ws(":", p["kind"], p["locator"]))),
            **{name: canonical_list(F.transform(said[name], lambda h: F.concat_ws("\0", h["algorithm"], h["value"]))) for name in ("observed_hashes", "supplier_hashes")},
        }
        first = F.lit(None).cast("string")
        for rule, fine in reversed(rules.items()):
            first = F.when(~F.coalesce(fine, F.lit(False)), F.concat_ws(":", at.cast("string"), F.lit(rule))).otherwise(first)
        return first

    ids = F.transform(items, lambda i: F.try_variant_get(i, "$.candidate_id", "string"))
    found = F.array_compact(F.transform(items, each))
    order = F.when(~F.coalesce(canonical_list(ids), F.lit(False)), F.array(F.lit("order"))).otherwise(F.array().cast("array<string>"))
    return F.when(items.isNull(), F.array(F.lit("list"))).otherwise(F.concat(found, order))
