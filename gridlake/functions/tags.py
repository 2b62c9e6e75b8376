"""Operations on JSON tag objects (text), as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(tags: Column, key: str) -> Column:
    """A tag's value as text, null where it is missing."""
    return F.get_json_object(tags, f"$['{key}']")


def has_tag(tags: Column, key: str) -> Column:
    return tag(tags, key).isNotNull()


def no_tags(tags: Column) -> Column:
    return F.size(F.json_object_keys(tags)) == 0


def to_number(text: Column, default: float) -> Column:
    """Text as a number, or the default where it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def build(**pairs: Column) -> Column:
    """A JSON object of the given pairs; null values are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in pairs.items())))


def without(tags: Column, key: str) -> Column:
    """tags without a key, as a map."""
    return F.map_filter(F.from_json(tags, "map<string,string>"), lambda k, _: k != F.lit(key))


def merged(left: Column, right: Column) -> Column:
    """Two tag maps in one; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def extrusion_base(tags: Column) -> Column:
    return (
        F.when(has_tag(tags, "min_height"), to_number(tag(tags, "min_height"), 0))
        .when(has_tag(tags, "building:min_height"), to_number(tag(tags, "building:min_height"), 0))
        .when(has_tag(tags, "building:min_level"), to_number(tag(tags, "building:min_level"), 0) * 3)
        .otherwise(0.0)
    )


def extrusion_height(tags: Column) -> Column:
    return (
        F.when(has_tag(tags, "height"), to_number(tag(tags, "height"), 6))
        .when(has_tag(tags, "building:height"), to_number(tag(tags, "building:height"), 6))
        .when(has_tag(tags, "building:levels"), to_number(tag(tags, "building:levels"), 2) * 3)
        .otherwise(6.0)
    )


def is_building(tags: Column) -> Column:
    """Buildings and their parts at ground level or above."""
    return (has_tag(tags, "building") | has_tag(tags, "building:part")) & (~has_tag(tags, "layer") | (to_number(tag(tags, "layer"), 0) >= 0))
