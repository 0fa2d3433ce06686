"""Building blocks of metric points: tags, series key, metric family."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def series_key(metric: Column, tags: Column) -> Column:
    """``metric{k=v,...}`` with tags in key order; the join key for a series."""
    return F.concat(metric, tag_text(tags))


def tag_text(tags: Column) -> Column:
    """``{k=v,...}`` in key order; tags without a value are left out."""
    pairs = F.transform(
        F.sort_array(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def named_tag_text(**tags: Column) -> Column:
    """``tag_text`` of a map of these tags, whose order is known, so that no map is built or sorted."""
    pairs = [F.concat(F.lit(f"{name}="), tags[name]) for name in sorted(tags)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def series_id(key: Column) -> Column:
    """A 64-bit number for a series key."""
    return F.xxhash64(key)


def merge_tags(extra: Column, base: Column) -> Column:
    """Union of two tag maps; ``extra`` wins on a common key."""
    return F.map_zip_with(extra, base, lambda _, e, b: F.coalesce(e, b))


def _host_and_port(host: Column, port: Column) -> Column:
    return F.concat(host, F.lit("-"), port.cast("string"))


def service_tags(cluster: Column, job: Column, host: Column, port: Column) -> Column:
    return F.create_map(
        F.lit("cluster"), cluster,
        F.lit("job"), job,
        F.lit("hostAndPort"), _host_and_port(host, port),
    )


def service_tag_text(cluster: Column, job: Column, host: Column, port: Column, **more: Column) -> Column:
    """``tag_text`` of ``service_tags`` and what else a point has."""
    return named_tag_text(cluster=cluster, job=job, hostAndPort=_host_and_port(host, port), **more)


def metric_family(metric: Column) -> Column:
    """First two name parts; the storage partition of a point."""
    return F.substring_index(metric, ".", 2)
