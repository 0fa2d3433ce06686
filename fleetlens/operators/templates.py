"""Texts with variables: environment (X2), placeholders (X6, J3-J5, A6), runtime."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import ordered, text as tf
from fleetlens.session import stage

# The variables a document may use.
ENV_VARIABLES = ["ConfRootDir", "PkgRootDir", "PkgConfDir", "PkgDataDir", "PkgLogDir", "PkgStdoutDir"]
# The folders of a task below its root, per variable.
TASK_FOLDERS = {
    "PkgRootDir": "pkg", "PkgConfDir": "conf", "PkgDataDir": "data", "PkgLogDir": "log", "PkgStdoutDir": "stdout",
}


def substitute_env(text: Column, variables: Mapping[str, Column]) -> Column:
    """``{{.Name}}`` replaced on raw text; NULL when an unknown reference is left."""
    out = text
    for name in ENV_VARIABLES:
        if name in variables:
            out = F.replace(out, F.lit("{{." + name + "}}"), variables[name])
    return F.when(~F.contains(out, F.lit("{{.")), out)


def runtime_vars(text: Column, root: Column, task_id: Column) -> Column:
    """``$AgentRootDir`` and ``$TaskId`` replaced in one text."""
    with_root = F.replace(text, F.lit("$AgentRootDir"), root)
    return F.replace(with_root, F.lit("$TaskId"), task_id.cast("string"))


def job_root_dir(root: Column, cluster: Column, job: Column, task_id: Column) -> Column:
    return F.concat(root, F.lit("/"), cluster, F.lit("/"), job, F.lit("."), task_id.cast("string"))


def render_program(programs: DataFrame, agent_root: str) -> DataFrame:
    """X7 on program rows (name, job, task_id, bin, args, configs): variables replaced in the
    binary, the arguments and in file names and contents, plus ``root_dir``. Two file names
    that become equal leave the later one."""
    root, task = F.lit(agent_root), F.col("task_id")

    def fill(text: Column) -> Column:
        return runtime_vars(text, root, task)

    files = F.transform(
        F.map_entries("configs"), lambda e: F.struct(fill(e["key"]).alias("key"), fill(e["value"]).alias("value"))
    )
    last = F.filter(
        files,
        lambda e, i: ~F.exists(
            F.slice(files, i + F.lit(2), F.size(files)), lambda later: later["key"] == e["key"]
        ),
    )
    return programs.withColumns({
        "bin": fill(F.col("bin")),
        "args": F.transform("args", fill),
        "configs": F.map_from_entries(last),
        "root_dir": job_root_dir(root, F.col("name"), F.col("job"), task),
    })


def server_lists(tasks: DataFrame) -> DataFrame:
    """``host:base_port,...`` in task-id order for each (cluster, job)."""
    address = F.concat("host", F.lit(":"), F.col("base_port").cast("string"))
    return ordered.by_position(tasks, ["cluster", "job"], F.col("task_id"), address, ",", "server_list")


# The placeholder forms (job names and attributes are word characters).
TOKEN = r"%\{[a-zA-Z0-9_.+]+\}"
_W, _N = "([a-zA-Z0-9_]+)", "([0-9]+)"
FORMS = {
    "cluster_name": r"cluster\.name",
    "dep_cluster_name": rf"dependencies\.{_N}\.cluster_name",
    "dep_server_list": rf"dependencies\.{_N}\.{_W}\.server_list",
    "dep_attr_plus": rf"dependencies\.{_N}\.{_W}\.{_N}\.{_W}\+{_N}",
    "dep_attr": rf"dependencies\.{_N}\.{_W}\.{_N}\.{_W}",
    "attr_plus": rf"{_W}\.{_N}\.{_W}\+{_N}",
    "attr": rf"{_W}\.{_N}\.{_W}",
    "server_list": rf"{_W}\.server_list",
    "host_attr_plus": rf"{_W}\.x\.{_W}\+{_N}",
    "host_attr": rf"{_W}\.x\.{_W}",
}
# Position of each field among the groups of its form.
_FIELDS = {
    "dep_cluster_name": {"ordinal": 1},
    "dep_server_list": {"ordinal": 1, "job": 2},
    "dep_attr_plus": {"ordinal": 1, "job": 2, "task": 3, "attr": 4, "plus": 5},
    "dep_attr": {"ordinal": 1, "job": 2, "task": 3, "attr": 4},
    "attr_plus": {"job": 1, "task": 2, "attr": 3, "plus": 4},
    "attr": {"job": 1, "task": 2, "attr": 3},
    "server_list": {"job": 1},
    "host_attr_plus": {"job": 1, "attr": 2, "plus": 3},
    "host_attr": {"job": 1, "attr": 2},
}
HOST_FORMS = ("host_attr", "host_attr_plus")


def _anchored(form: str) -> str:
    return r"^%\{" + FORMS[form] + r"\}$"


def classify(token: Column) -> Column:
    """The form of a token, NULL for text that only looks like a placeholder."""
    out = None
    for form in FORMS:
        test = token.rlike(_anchored(form))
        if form == "attr":
            # dependencies.<n>.<word> is no job attribute; unless it is cluster_name it stays as text.
            test = test & ~token.startswith("%{dependencies.")
        out = F.when(test, form) if out is None else out.when(test, form)
    return out


def _field(name: str) -> Column:
    out = None
    for form, fields in _FIELDS.items():
        if name in fields:
            value = F.regexp_extract("token", _anchored(form), fields[name])
            cond = F.col("form") == form
            out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def extract_placeholders(templates: DataFrame, doc: Sequence[str], skip_host: bool = False) -> DataFrame:
    """One row per distinct placeholder of each document: (doc..., in_cluster, token, form,
    ordinal, at_job, at_task, attr, plus). Host-relative forms take the task id of the
    rendered row."""
    rows = templates.select(
        *doc, F.col("cluster").alias("in_cluster"), F.col("task_id").alias("own_task"),
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"),
    ).withColumn("form", classify(F.col("token"))).filter(F.col("form").isNotNull())
    if skip_host:
        rows = rows.filter(~F.col("form").isin(list(HOST_FORMS)))
    task = F.when(F.col("form").isin(list(HOST_FORMS)), F.col("own_task")).otherwise(
        _field("task").try_cast("bigint")
    )
    return rows.select(
        *doc, "in_cluster", "token", "form",
        _field("ordinal").try_cast("bigint").alias("ordinal"),
        _field("job").alias("at_job"),
        task.alias("at_task"),
        _field("attr").alias("attr"),
        F.coalesce(_field("plus").try_cast("bigint"), F.lit(0)).alias("plus"),
    )


def resolve_placeholders(
    placeholders: DataFrame,
    tasks: DataFrame,
    dependencies: DataFrame,
    jobs: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Adds ``value``, NULL where the lookup fails.

    ``tasks``: (cluster, job, task_id, host, base_port, attributes); ``dependencies``:
    (cluster, ordinal, dep_cluster); ``jobs``: (cluster, job), only needed when a job may
    have no tasks; ``names``: (cluster, cluster_name), only needed when clusters are known by
    something else than their name. All lookups are equi-joins on the full key.
    """
    through = placeholders.join(
        dependencies.select(F.col("cluster").alias("in_cluster"), "ordinal", "dep_cluster"),
        ["in_cluster", "ordinal"], "left",
    )
    is_dep = F.col("form").startswith("dep_")
    located = through.withColumn("target", F.when(is_dep, F.col("dep_cluster")).otherwise(F.col("in_cluster")))

    by_task = tasks.select(
        F.col("cluster").alias("target"), F.col("job").alias("at_job"), F.col("task_id").alias("at_task"), "attributes"
    )
    is_list = F.col("form").isin("server_list", "dep_server_list")
    is_name = F.col("form").isin("cluster_name", "dep_cluster_name")

    named = located.filter(is_name)
    if names is None:
        named = named.withColumn("value", F.col("target"))
    else:
        named = named.join(
            names.select(F.col("cluster").alias("target"), F.col("cluster_name").alias("value")), "target", "left"
        )
    attrs = located.filter(~is_list & ~is_name).join(by_task, ["target", "at_job", "at_task"], "left")
    raw = F.try_element_at("attributes", F.col("attr"))
    plus = F.col("form").endswith("_plus")
    attrs = attrs.withColumn(
        "value",
        F.when(plus, F.try_add(tf.strict_int(raw), F.col("plus")).cast("string")).otherwise(raw),
    ).drop("attributes")

    wanted = located.filter(is_list)
    referenced = wanted.select(F.col("target").alias("cluster"), F.col("at_job").alias("job")).distinct()
    lists = server_lists(tasks.join(referenced, ["cluster", "job"], "left_semi"))
    if jobs is not None:
        lists = jobs.select("cluster", "job").join(lists, ["cluster", "job"], "left").withColumn(
            "server_list", F.coalesce("server_list", F.lit(""))
        )
    listed = wanted.join(
        lists.select(F.col("cluster").alias("target"), F.col("job").alias("at_job"), F.col("server_list").alias("value")),
        ["target", "at_job"], "left",
    )
    out = named.unionByName(attrs).unionByName(listed)
    return out.select(*placeholders.columns, "value")


def render_templates(
    templates: DataFrame,
    doc: Sequence[str],
    tasks: DataFrame,
    dependencies: DataFrame,
    jobs: DataFrame | None = None,
    names: DataFrame | None = None,
    skip_host: bool = False,
) -> DataFrame:
    """``templates`` (doc..., cluster, task_id, text) with every placeholder replaced.

    Adds ``ok``; one failed lookup makes the whole document fail with NULL text. Only the
    tokens travel through the lookup joins, the texts meet their values once at the end.
    Values are put in place in one pass, so a value that looks like a placeholder stays.
    """
    # Three lookups read the tokens: they are extracted once.
    tokens_of = stage(extract_placeholders(templates, doc, skip_host), "placeholders")
    found = resolve_placeholders(tokens_of, tasks, dependencies, jobs, names)
    per_doc = found.groupBy(*doc).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__values"),
        F.max(F.col("value").isNull()).alias("__failed"),
    )
    joined = templates.join(per_doc, list(doc), "left")
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    pieces = F.split("text", TOKEN)
    filled = F.zip_with(
        pieces, tokens,
        lambda piece, token: F.concat(
            piece,
            F.coalesce(F.try_element_at("__values", F.coalesce(token, F.lit(""))), token, F.lit("")),
        ),
    )
    failed = F.coalesce("__failed", F.lit(False))
    text = F.when(failed, F.lit(None)).when(F.col("__values").isNull(), F.col("text")).otherwise(
        F.array_join(filled, "")
    )
    keep = [c for c in templates.columns if c != "text"]
    return joined.select(*keep, (~failed).alias("ok"), text.alias("text"))
