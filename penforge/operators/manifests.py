"""Patch manifests: JSON against a closed schema, as columns; the first thing that is wrong is the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Size, fields of a manifest and of a patch.
MOST_BYTES = 1024 * 1024
FIELDS = ("document_id", "section_locator", "initial_fingerprint", "base_revision", "approved_patch_ids", "expected_fingerprints", "patches")
REQUIRED = ("section_locator", "section_fingerprint", "block_id", "source_start", "source_end", "before", "after", "rule_id", "rationale")
PATCH_FIELDS = ("patch_id", "node_path", *REQUIRED)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is(v: Column, *kinds: str) -> Column:
    found = F.lit(False)
    for k in kinds:
        found = found | _kind(v).startswith(k)
    return found


def _at(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _items(v: Column, key: str) -> Column:
    """The items of a list, none where it is no list."""
    return F.coalesce(F.when(_is(_at(v, key), "ARRAY"), _at(v, key, "array<variant>")), F.array().cast("array<variant>"))


def _keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.when(_is(v, "OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))), F.array().cast("array<string>"))


def _no_strings(v: Column, key: str) -> Column:
    """Whether a field is no list of texts."""
    return ~_is(_at(v, key), "ARRAY") | F.exists(_items(v, key), lambda x: ~F.coalesce(_kind(x) == "STRING", F.lit(False)))


def _texts(v: Column, key: str) -> Column:
    return F.transform(_items(v, key), lambda x: F.try_variant_get(x, "$", "string"))


def _id(p: Column) -> Column:
    """A patch's id as text; '' where it has none, or one that counts as nothing."""
    text = _at(p, "patch_id", "string")
    nothing = ~_is(_at(p, "patch_id"), "STRING") & text.isin("0", "false", "[]", "{}", "0.0")
    return F.coalesce(F.when(~nothing, text), F.lit(""))


def _patch_error(p: Column, earlier: Column) -> Column:
    """earlier: the ids of the patches before it."""
    places = _items(p, "node_path")
    whole = lambda x: F.coalesce(_kind(x).isin("BIGINT", "BOOLEAN"), F.lit(False))
    keys = _keys(p)
    numbers = [F.try_variant_get(p, f"$.{k}", "long").isNull() for k in ("source_start", "source_end")]
    return (
        F.when(~_is(p, "OBJECT"), "manifest_schema").when(F.size(F.array_except(keys, F.lit(list(PATCH_FIELDS)))) > 0, "unknown_fields").when(_id(p) == "", "manifest_schema")
        .when(F.array_contains(earlier, _id(p)), "duplicate_patch_id").when(~_is(_at(p, "node_path"), "ARRAY") | F.exists(places, lambda x: ~whole(x)), "manifest_schema")
        .when(F.size(F.array_except(F.lit(list(REQUIRED)), keys)) > 0, "manifest_schema").when(numbers[0] | numbers[1], "manifest_schema")
    )


def manifest_error(text: Column, document_id: Column) -> Column:
    """Null for a manifest that may be applied to a document, else the first of: manifest_limit, manifest_json,
    manifest_schema, unknown_fields, document_mismatch, duplicate_patch_id, duplicate_approved_id, unapproved_patch,
    missing_patch, in the order in which a reader meets them; unresolved_document without a document. A JSON object
    that names a field twice isn't taken as JSON."""
    v = F.try_parse_json(text)
    patches = _items(v, "patches")
    ids = F.transform(patches, _id)
    errors = F.transform(patches, lambda p, i: _patch_error(p, F.slice(ids, F.lit(1), i)))
    approved, revision = _texts(v, "approved_patch_ids"), _at(v, "base_revision")
    blank = lambda k: ~_is(_at(v, k), "STRING") | (_at(v, k, "string") == "")
    return (
        F.when(document_id.isNull(), "unresolved_document").when(F.octet_length(text) > MOST_BYTES, "manifest_limit").when(v.isNull(), "manifest_json")
        .when(~_is(v, "OBJECT"), "manifest_schema").when(F.size(F.array_except(_keys(v), F.lit(list(FIELDS)))) > 0, "unknown_fields")
        .when(~F.coalesce(_is(_at(v, "document_id"), "STRING") & (_at(v, "document_id", "string") == document_id), F.lit(False)), "document_mismatch")
        .when(~_is(_at(v, "patches"), "ARRAY"), "manifest_schema").when(F.size(F.array_compact(errors)) > 0, F.get(F.array_compact(errors), 0))
        .when(_no_strings(v, "approved_patch_ids"), "manifest_schema").when(F.size(F.array_distinct(approved)) < F.size(approved), "duplicate_approved_id")
        .when(_no_strings(v, "expected_fingerprints"), "manifest_schema").when(F.size(F.array_except(ids, approved)) > 0, "unapproved_patch")
        .when(F.size(F.array_except(approved, ids)) > 0, "missing_patch").when(blank("section_locator") | blank("initial_fingerprint"), "manifest_schema")
        .when(~F.coalesce((_kind(revision) == "BIGINT") & (_at(v, "base_revision", "long") >= 0), F.lit(False)), "manifest_schema")
    )


def manifest_patches(manifests: DataFrame, *keys: str) -> DataFrame:
    """keys and the fields of each patch of manifests (text, document_id) without an error."""
    good = manifests.withColumn("error", manifest_error(F.col("text"), F.col("document_id"))).where("error IS NULL")
    rows = good.select(*keys, F.posexplode(_items(F.try_parse_json("text"), "patches")).alias("place", "p"))
    kinds = {"node_path": "array<int>", "source_start": "long", "source_end": "long"}
    return rows.select(*keys, "place", *[_at(F.col("p"), k, kinds.get(k, "string")).alias(k) for k in PATCH_FIELDS])
