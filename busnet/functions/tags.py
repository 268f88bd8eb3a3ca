"""Tag conversion, name keys and NULL-aware ordering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# tags never loaded (fixed values)
EXCLUDED_TAGS = ["created_by", "source"]
# tag values read as false (fixed values)
FALSE_VALUES = ["", "0", "false", "no"]

# element kinds (fixed values)
NODE, WAY, RELATION = 0, 1, 2
KIND_OF = {"node": NODE, "way": WAY, "relation": RELATION}


def load_tags(entries: Column) -> Column:
    """array<struct<_k,_v>> -> map without the excluded keys; NULL (no tags) -> empty map."""
    pairs = F.transform(entries, lambda e: F.struct(e["_k"].alias("key"), e["_v"].alias("value")))
    as_map = F.map_from_entries(pairs)
    kept = F.map_filter(as_map, lambda k, _: ~k.isin(EXCLUDED_TAGS))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def string_tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.element_at(tags, F.lit(key)), F.lit(""))


def bool_tag(tags: Column, key: str) -> Column:
    return ~string_tag(tags, key).isin(FALSE_VALUES)


def element_label(osm_type: Column, osm_id: Column) -> Column:
    """'0_123' style text id; NULL if either part is NULL."""
    return F.concat(osm_type.cast("string"), F.lit("_"), osm_id.cast("string"))


def member_label(osm_type: Column, osm_id: Column) -> Column:
    """'node/123' style text id; any other kind counts as relation."""
    word = (
        F.when(osm_type == NODE, F.lit("node/"))
        .when(osm_type == WAY, F.lit("way/"))
        .otherwise(F.lit("relation/"))
    )
    return F.concat(word, osm_id.cast("string"))


def element_word(osm_type: Column) -> Column:
    return (
        F.when(osm_type == NODE, F.lit("node"))
        .when(osm_type == WAY, F.lit("way"))
        .when(osm_type == RELATION, F.lit("relation"))
    )


def element_code(word: str | None) -> int:
    """Kind of element that a word names; a lookup without a word is one of nodes."""
    kind = KIND_OF.get(word or "node")
    if kind is None:
        raise ValueError(f"{word!r} is none of {', '.join(KIND_OF)}")
    return kind


def name_key(name: Column, osm_type: Column, osm_id: Column) -> Column:
    """Clustering key: the name, or the element's own label if the name is '' or NULL."""
    return F.when(name != "", name).otherwise(element_label(osm_type, osm_id))


def falsy(text: Column) -> Column:
    return text.isNull() | (text == "")


def default_if_blank(text: Column, placeholder: str) -> Column:
    return F.when(falsy(text), F.lit(placeholder)).otherwise(text)


def sort_nulls_last(items: Column, *fields: str) -> Column:
    """Sort an array of structs by fields ascending, NULL fields last.

    sort_array orders NULL first inside a struct, so each field is preceded by its null flag.
    (It compares natively; array_sort would run a comparator expression per pair.)
    """
    keyed = F.transform(
        items,
        lambda e: F.struct(
            *[
                part
                for i, f in enumerate(fields)
                for part in (e[f].isNull().alias(f"n{i}"), e[f].alias(f"v{i}"))
            ],
            e.alias("item"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["item"])
