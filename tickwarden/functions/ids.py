"""Entity, link and causal-variable identifiers (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickwarden.schemas import SHORT_NAME


def lookup(table: dict, key: Column, default=None) -> Column:
    """Literal map lookup; rows outside the table get `default`."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def short_metric(metric: Column) -> Column:
    return F.coalesce(lookup(SHORT_NAME, metric), metric)


def full_metric(short: Column) -> Column:
    return lookup({s: m for m, s in SHORT_NAME.items()}, short)


def variable(entity: Column, metric: Column) -> Column:
    return F.concat_ws("_", entity, short_metric(metric))


def split_variable(var: Column, strict_last_underscore: bool = False) -> tuple[Column, Column]:
    """(entity, short metric). The default knows two-word metrics; the strict form cuts at the last underscore."""
    if strict_last_underscore:
        pattern = r"^(.*)_([^_]*)$"
    else:
        names = "|".join(sorted(SHORT_NAME.values(), key=len, reverse=True))
        pattern = rf"^(.*)_({names})$"
    entity = F.regexp_extract(var, pattern, 1)
    return F.when(entity == "", var).otherwise(entity), F.regexp_extract(var, pattern, 2)


def link_id(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def endpoint(link: Column, side: int) -> Column:
    """Endpoint 0 or 1 of a link id; null for anything that is not a link id."""
    return F.when(link.contains("-"), F.split_part(link, F.lit("-"), F.lit(side + 1)))


def is_link(entity: Column) -> Column:
    return entity.contains("-")


def mentions(var: Column, entity: Column) -> Column:
    return F.coalesce((entity != "") & F.lower(var).contains(F.lower(entity)), F.lit(False))


def root_target(root: Column, links: Column, nodes: Column) -> tuple[Column, Column]:
    """(target node, target link) named by a root-cause variable, else the first affected entity."""
    entity = F.when(root.contains("_"), F.regexp_extract(root, r"^(.*)_[^_]*$", 1)).otherwise(root)
    blank = entity == ""
    first_link, first_node = F.try_element_at(links, F.lit(1)), F.try_element_at(nodes, F.lit(1))
    link = F.when(blank, first_link).when(is_link(entity), entity)
    node = F.when(blank & first_link.isNull(), first_node).when(~blank & ~is_link(entity), entity)
    return node, link
