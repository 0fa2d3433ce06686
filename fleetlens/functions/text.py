"""Parsers for the small string grammars that appear in operations data.

Everything here is a Column expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INT_PATTERN = r"^[+-]?[0-9]+$"


def strict_int(text: Column) -> Column:
    """BIGINT for an optionally signed run of digits, NULL for anything else.

    A bare ``try_cast`` is too lenient: it also accepts surrounding blanks.
    """
    return F.when(text.rlike(INT_PATTERN), text.try_cast("bigint"))


DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def single_precision(text: Column) -> Column:
    """A plain decimal number rounded to 32 bits and kept as DOUBLE."""
    return F.when(text.rlike(DECIMAL_PATTERN), text.try_cast("float").cast("double"))


def json_pointer(parent: Column, key: Column) -> Column:
    """Append one key to a JSON-pointer path (``~`` and ``/`` are escaped)."""
    escaped = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(parent, F.lit("/"), escaped)


def pointer_part(path: Column, index: int) -> Column:
    """The ``index``-th (1-based) key of a JSON-pointer path, unescaped."""
    part = F.split_part(path, F.lit("/"), F.lit(index + 1))
    return F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def relative_path(root: Column, path: Column) -> Column:
    """``path`` as seen from ``root``, both absolute and without ``.`` or ``..``; equal ones give ``.``."""
    above, below = _path_parts(root), _path_parts(path)
    # The first place where they part; the longer one has NULL to compare with.
    same = F.zip_with(above, below, lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = (F.array_position(F.array_append(same, F.lit(False)), False) - 1).cast("int")
    steps = F.concat(
        F.array_repeat(F.lit(".."), F.size(above) - common), F.slice(below, common + 1, F.greatest(F.size(below), F.lit(1))))
    return F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/"))


def html_id(name: Column) -> Column:
    """A name as an element id: dots, dashes and slashes become underscores."""
    return F.translate(name, ".-/", "___")


def setting_list(setting: Column) -> Column:
    """The values of a comma-separated setting. Only the ends of the whole text are trimmed, of one
    kind of character after the other; an empty setting is one empty value."""
    for char in (" ", "\n", "\t", "\r", ","):
        setting = F.trim(setting, F.lit(char))
    return F.split(setting, ",")


def host_from_url(url: Column) -> Column:
    """Host part of ``[http://|https://]host[:port][/path]``."""
    bare = F.regexp_replace(F.regexp_replace(url, "^http://", ""), "^https://", "")
    authority = F.split_part(bare, F.lit("/"), F.lit(1))
    return F.split_part(authority, F.lit(":"), F.lit(1))


def task_label(cluster: Column, job: Column, task_id: Column) -> Column:
    return F.concat(
        F.lit("cluster="), cluster, F.lit("/job="), job, F.lit("/task_id="), task_id.cast("string")
    )


def parse_task_label(label: Column) -> Column:
    """``cluster=A/job=B/task_id=N`` -> struct(cluster, job, task, error).

    Checks run left to right and the first one that fails sets ``error``.
    A task that is not an integer counts as 0.
    """
    parts = F.split(label, "/")
    first, second, third = (F.get(parts, i) for i in range(3))
    error = (
        F.when(F.size(parts) != 3, F.concat(F.lit("not three parts: "), label))
        .when(~first.startswith("cluster="), F.concat(F.lit("no cluster part: "), label))
        .when(~second.startswith("job="), F.concat(F.lit("no job part: "), label))
        .when(~third.startswith("task_id="), F.concat(F.lit("no task_id part: "), label))
    )
    ok = error.isNull()
    task = F.coalesce(strict_int(F.regexp_replace(third, "^task_id=", "")), F.lit(0))
    return F.struct(
        F.when(ok, F.regexp_replace(first, "^cluster=", "")).otherwise("").alias("cluster"),
        F.when(ok, F.regexp_replace(second, "^job=", "")).otherwise("").alias("job"),
        F.when(ok, task).otherwise(0).cast("bigint").alias("task"),
        error.alias("error"),
    )


def parse_endpoint(key: Column) -> Column:
    """``host:port[/id=N][/base_port=M][/k=v...]`` -> struct with defaults and an error.

    Defaults: id 0, base port 10000. Every pair also becomes an attribute; on a
    repeated key the last pair wins, for the attribute and for id / base port.
    """
    parts = F.split(key, "/")
    address = F.split(F.get(parts, 0), ":")
    host, port = F.get(address, 0), F.get(address, 1)
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, "="))
    good = F.filter(pairs, lambda p: F.size(p) == 2)

    def values_of(name: str) -> Column:
        return F.transform(
            F.filter(good, lambda p: F.get(p, 0) == name), lambda p: strict_int(F.get(p, 1))
        )

    ids, bases = values_of("id"), values_of("base_port")
    entries = F.concat(
        F.array(F.array(F.lit("host"), host), F.array(F.lit("port"), port)), good
    )
    # Keep an entry only when no later entry has the same key.
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: F.get(later, 0) == F.get(e, 0)
        ),
    )
    error = (
        F.when(F.size(address) != 2, "bad address")
        .when(strict_int(port).isNull(), "port is not an integer")
        .when(F.size(pairs) != F.size(good), "bad key-value pair")
        .when(F.exists(ids, lambda v: v.isNull()), "id is not an integer")
        .when(F.exists(ids, lambda v: v < 0), "id is negative")
        .when(F.exists(bases, lambda v: v.isNull()), "base_port is not an integer")
        .when(F.exists(bases, lambda v: v <= 0), "base_port is not positive")
    )
    return F.struct(
        host.alias("host"),
        strict_int(port).alias("agent_port"),
        F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit(0)).cast("bigint").alias("task_id"),
        F.coalesce(F.try_element_at(bases, F.lit(-1)), F.lit(10000)).cast("bigint").alias("base_port"),
        F.map_from_entries(
            F.transform(last, lambda e: F.struct(F.get(e, 0), F.get(e, 1)))
        ).alias("attributes"),
        error.alias("error"),
    )


def agent_url(host: Column, agent_port: Column) -> Column:
    return F.concat(F.lit("http://"), host, F.lit(":"), agent_port.cast("string"))


def endpoint_key(host: Column, agent_port: Column, task_id: Column) -> Column:
    return F.concat(host, F.lit(":"), agent_port.cast("string"), F.lit("/id="), task_id.cast("string"))


def jmx_url(host: Column, base_port: Column) -> Column:
    return F.concat(F.lit("http://"), host, F.lit(":"), (base_port + 1).cast("string"), F.lit("/jmx"))


def parse_ssh_endpoint(text: Column) -> Column:
    """``host[:sshPort][/agentPort=N]`` -> struct(host, ssh_port, agent_port, error).

    The agent part starts at the last slash; defaults are 22 and 9001.
    """
    has_agent = F.contains(text, F.lit("/"))
    head = F.when(has_agent, F.regexp_replace(text, r"/[^/]*$", "")).otherwise(text)
    tail = F.when(has_agent, F.regexp_extract(text, r"/[^/]*$", 0))
    address = F.split(head, ":")
    agent = F.split(tail, "agentPort=")
    ssh_port = F.when(F.size(address) == 1, F.lit(22)).otherwise(strict_int(F.get(address, 1)))
    agent_port = F.when(~has_agent, F.lit(9001)).otherwise(strict_int(F.get(agent, 1)))
    error = (
        F.when(F.trim(text) == "", "empty")
        .when(F.size(address) > 2, "bad host format")
        .when(ssh_port.isNull(), "ssh port is not an integer")
        .when(has_agent & (F.size(agent) != 2), "bad agent port format")
        .when(agent_port.isNull(), "agent port is not an integer")
    )
    return F.struct(
        F.get(address, 0).alias("host"),
        ssh_port.cast("bigint").alias("ssh_port"),
        agent_port.cast("bigint").alias("agent_port"),
        error.alias("error"),
    )


# Fixed value: how a removed job folder is named.
TRASH_PATTERN = r"\.trash\.([a-zA-Z0-9_\-]+)\.([0-9]+)\.([0-9]+)"


def trash_epoch(name: Column) -> Column:
    """Epoch seconds in a ``.trash.<job>.<task>.<epoch>`` name, -1 when it is not one."""
    return F.coalesce(
        F.regexp_extract(name, TRASH_PATTERN, 3).try_cast("bigint"), F.lit(-1).cast("bigint")
    )


def config_format(file_name: Column) -> Column:
    """``ini``, ``xml``, ``plain`` by the suffix of the base name, NULL for anything else."""
    base = base_name(file_name)
    return (
        F.when(base.endswith(".cfg") | base.endswith(".properties") | base.endswith(".conf"), "ini")
        .when(base.endswith(".xml"), "xml")
        .when(~F.contains(base, F.lit(".")) | base.endswith(".txt"), "plain")
    )
