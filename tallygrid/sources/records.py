"""Raw drops into tables: scheduler records, sample series, allocations, disk reports, node configuration, directories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_TRES = "array<struct<type:string,name:string,count:bigint>>"
#: Fields that newer schedulers wrap in an object or a list are read as text and unwrapped.
RECORD_SCHEMA = f"""struct<meta:map<string,struct<version:struct<major:string,minor:string>>>,
jobs:array<struct<account:string,array:struct<job_id:bigint,task_id:string>,cluster:string,constraints:string,exit_code:struct<return_code:string,signal:string>,
flags:array<string>,`group`:string,job_id:bigint,name:string,nodes:string,partition:string,priority:string,qos:string,state:struct<current:string>,submit_line:string,
time:struct<elapsed:bigint,start:bigint,end:bigint,submission:bigint,limit:string>,tres:struct<requested:{_TRES},allocated:{_TRES}>,user:string,working_directory:string>>>"""
FLAGS = ("CLEAR_SCHEDULING", "STARTED_ON_SUBMIT", "STARTED_ON_SCHEDULE", "STARTED_ON_BACKFILL")
NEWEST_MAJOR = 25
_NO_TIME = (0, 4294967294, 4294967295)
SERIES_SCHEMA = "map<string,array<struct<metric:map<string,string>,values:array<array<string>>>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (text, file)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def expand_hostlist(nodes: Column) -> Column:
    """``r[1-2]n[001-003,7],gpu1`` as a sorted array of names without repeats; a name may have any number of brackets, and the first number of a range sets the width with its zeros."""
    names = F.regexp_extract_all(nodes, F.lit(r"(?:[^,\[\]]|\[[^\]]*\])+"), F.lit(0))

    def numbers(r: Column) -> Column:
        a, b = F.split_part(r, F.lit("-"), F.lit(1)), F.split_part(r, F.lit("-"), F.lit(2))
        whole = lambda x: F.try_to_number(x, F.lit("9999999999")).cast("bigint")
        padded = lambda n: F.when(F.char_length(n.cast("string")) < F.char_length(a), F.lpad(n.cast("string"), F.char_length(a), F.lit("0"))).otherwise(n.cast("string"))
        return F.when(F.contains(r, F.lit("-")), F.transform(F.sequence(whole(a), whole(b)), padded)).otherwise(F.array(r))

    def choices(part: Column) -> Column:
        ranges = F.regexp_extract_all(part, F.lit(r"[\[,]([^,\]]*)"), F.lit(1))  # unlike that of split, this pattern is compiled once
        found = F.when(F.contains(part, F.lit("[")), F.flatten(F.transform(ranges, numbers))).otherwise(F.array(F.lit("")))
        return F.struct(F.substring_index(part, "[", 1).alias("head"), found.alias("found"))

    def one(name: Column) -> Column:
        """Each part (a text and the bracket behind it) multiplies the names so far by its choices, which are made once."""
        parts = F.transform(F.regexp_extract_all(name, F.lit(r"[^\[\]]*\[[^\]]*\]|[^\[\]]+"), F.lit(0)), choices)
        product = F.aggregate(parts, F.array(F.lit("")).cast("array<string>"), lambda names, part: F.flatten(F.transform(names, lambda x: F.transform(part["found"], lambda y: F.concat(x, part["head"], y)))))
        return F.when(F.contains(name, F.lit("[")), product).otherwise(F.array(name))

    none = F.array().cast("array<string>")
    return F.when(nodes.isNull() | nodes.isin("", "None assigned"), none).otherwise(F.sort_array(F.array_distinct(F.flatten(F.transform(names, one)))))


def _unwrap(x: Column) -> Column:
    """A number, or the number inside ``{"set": .., "number": ..}``."""
    return F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.number")).otherwise(x).try_cast("bigint")


def _moment(x: Column) -> Column:
    return F.when(~x.isin(*_NO_TIME), F.timestamp_seconds(x))


def _resource(entries: Column, kind: str) -> Column:
    """The count of the last entry of a kind: ``gres_gpu`` with or without a model behind it."""
    key = lambda e: F.concat_ws("_", e["type"], F.nullif(e["name"], F.lit("")))
    hit = F.filter(entries, lambda e: (key(e) == kind) | (F.startswith(key(e), F.lit(f"{kind}:")) if kind == "gres_gpu" else F.lit(False)))
    return F.try_element_at(hit, F.lit(-1))["count"]


def _gpu_type(entries: Column) -> Column:
    hit = F.filter(entries, lambda e: (e["type"] == "gres") & F.startswith(e["name"], F.lit("gpu:")))
    return F.split_part(F.try_element_at(hit, F.lit(-1))["name"], F.lit(":"), F.lit(2))


def read_job_records(raw: DataFrame, *extra: str) -> DataFrame:
    """Scheduler documents (text, cluster, extra columns) as flat job rows.

    A banner before the first brace is skipped, as are rows without a group; the given cluster wins over the record's. A document of a scheduler newer than
    ``NEWEST_MAJOR`` is an error.
    """
    doc = F.from_json(F.substring(F.col("text"), F.locate("{", "text"), F.char_length("text")), RECORD_SCHEMA)
    each = raw.select("cluster", *extra, F.inline(F.array(doc)))  # each document is parsed once
    major = F.coalesce(F.col("meta")["Slurm"], F.col("meta")["slurm"])["version"]["major"].try_cast("int")
    checked = F.when(major > NEWEST_MAJOR, F.raise_error(F.concat(F.lit("unsupported scheduler version "), major.cast("string"))).cast("array<string>").isNull()).otherwise(F.lit(True))
    rows = each.filter(checked).select("cluster", *extra, F.explode("jobs").alias("j")).filter("j.group IS NOT NULL")
    j = lambda x: F.col(f"j.{x}")
    limit, code = _unwrap(j("time.limit")), j("exit_code.return_code")
    state = F.when(F.startswith(j("state.current"), F.lit("[")), F.get_json_object(j("state.current"), "$[0]")).otherwise(j("state.current"))
    signal = F.coalesce(F.get_json_object(j("exit_code.signal"), "$.signal_id"), F.get_json_object(j("exit_code.signal"), "$.id.number")).try_cast("bigint")
    resources = [_resource(j(f"tres.{g}"), k).alias(f"{g}_{k}") for g in ("requested", "allocated") for k in ("cpu", "mem", "node", "billing", "gres_gpu")]
    return rows.select(
        "cluster", *extra, j("job_id").alias("job_id"), F.nullif(j("array.job_id"), F.lit(0)).alias("array_job_id"), _unwrap(j("array.task_id")).alias("task_id"), j("name").alias("name"),
        j("user").alias("cluster_user"), j("group").alias("group"), j("account").alias("account"), state.alias("job_state"), _unwrap(code).alias("exit_code"), signal.alias("signal"),
        F.when(limit != 0, limit * 60).otherwise(limit).alias("time_limit"), _moment(j("time.submission")).alias("submit_time"), _moment(j("time.start")).alias("start_time"), _moment(j("time.end")).alias("end_time"),
        j("time.elapsed").cast("double").alias("elapsed_time"), j("partition").alias("partition"), expand_hostlist(j("nodes")).alias("nodes"), j("constraints").alias("constraints"), _unwrap(j("priority")).alias("priority"),
        j("qos").alias("qos"), j("working_directory").alias("work_dir"), F.coalesce(j("submit_line"), F.lit("")).alias("submit_line"), *resources,
        _gpu_type(j("tres.requested")).alias("requested_gpu_type"), _gpu_type(j("tres.allocated")).alias("allocated_gpu_type"), *[F.array_contains(j("flags"), f).alias(f) for f in FLAGS],
    )


def read_metric_series(raw: DataFrame) -> DataFrame:
    """Documents (text) of ``{"cluster$job$submit": [{"metric": labels, "values": [[ts, "v"], ...]}, ...]}`` as sample rows in input order; empty lists are skipped."""
    jobs = raw.select(F.explode(F.from_json("text", SERIES_SCHEMA)).alias("key", "series"))
    series = jobs.select("key", F.posexplode("series").alias("series_pos", "s"))
    part = lambda i: F.split_part("key", F.lit("$"), F.lit(i))
    rows = series.select(part(1).alias("cluster"), part(2).cast("bigint").alias("job_id"), part(3).alias("submit_time"), "series_pos", F.col("s.metric").alias("labels"), F.posexplode("s.values").alias("sample_pos", "v"))
    return rows.select("cluster", "job_id", "submit_time", F.col("labels")["__name__"].alias("metric"), "labels", "series_pos", "sample_pos", F.col("v")[0].cast("double").alias("ts_s"), F.col("v")[1].cast("double").alias("value"))


_UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5}


def byte_size(text: Column) -> Column:
    """``50TB`` (thousands) or ``13.49 GiB`` (1024s) as bytes; null if it is none."""
    number, unit, binary = (F.regexp_extract(F.trim(text), r"(?i)^([0-9.]+(?:e[0-9]+)?)\s*([KMGTP]?)(i?)B?$", i) for i in (1, 2, 3))
    power = F.create_map(*[F.lit(x) for p in _UNITS.items() for x in p])[F.upper(unit)]
    return (number.try_cast("double") * F.pow(F.when(F.lower(binary) == "i", 1024.0).otherwise(1000.0), power)).cast("bigint")


ALLOCATION_COLUMNS = ("start", "end", "cluster_name", "resource_name", "group_name", "cpu_year", "gpu_year", "rgu_year", "vcpu_year", "vgpu_year", "project_size", "project_inodes", "nearline_size")


def read_allocations(lines: DataFrame, clusters: DataFrame) -> DataFrame:
    """CSV lines (value; the header among them) as allocations: quoted cells may hold commas, cells are trimmed, missing and blank ones null, surplus ones dropped; unknown clusters and invalid rows are left out."""
    cells = F.from_csv("value", ", ".join(f"`{c}` string" for c in ALLOCATION_COLUMNS), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"'})
    parsed = lines.filter(F.trim("value") != "").select(F.inline(F.array(cells)))  # each line is parsed once
    rows = parsed.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ALLOCATION_COLUMNS]).filter("start <> 'start'")
    known = rows.join(F.broadcast(clusters.select(F.col("name").alias("cluster_name"), F.col("id").alias("cluster_id"))), "cluster_name")
    numbers = [c for c in ALLOCATION_COLUMNS if c.endswith("_year")]
    out = known.select(
        "cluster_id", "resource_name", "group_name", F.col("start").try_cast("date").alias("start"), F.col("end").try_cast("date").alias("end"), *[F.col(c).try_cast("double").try_cast("bigint").alias(c) for c in numbers],
        *[byte_size(F.col(c)).alias(c) for c in ("project_size", "nearline_size")], F.col("project_inodes").try_cast("double").cast("bigint").alias("project_inodes"),
        F.array(*[F.col(c).isNotNull() for c in (*numbers, "project_size", "nearline_size", "project_inodes")]).alias("given"),
    )
    found = F.array(*[F.col(c).isNotNull() for c in (*numbers, "project_size", "nearline_size", "project_inodes")])
    return out.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("group_name").isNotNull() & (found == F.col("given"))).drop("given")


def read_disk_reports(raw: DataFrame, *keys: str) -> DataFrame:
    """Report texts (text, keys) as (keys, group_name, user, nbr_files, size): lines of "Breakdown for project" sections; heads, rules and totals are skipped, a blank line closes a section."""
    whole = raw.select(*keys, "text", F.xxhash64(*keys, "text").alias("doc"))
    lines = whole.select(*keys, "doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    lines = lines.withColumn("w", words)
    heading = F.slice("w", 1, 3) == F.array(*map(F.lit, ("Breakdown", "for", "project")))
    mark = F.when(heading, F.get("w", F.lit(3))).when(F.trim("line") == "", F.lit(""))
    of_doc = Window.partitionBy("doc").orderBy("pos")
    inside = lines.withColumn("group_name", F.last(mark, ignorenulls=True).over(of_doc)).filter((F.col("group_name") != "") & ~heading)
    user, n, size = F.get("w", F.lit(0)), F.get("w", F.lit(1)).try_cast("bigint"), byte_size(F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3))))
    rows = inside.select(*keys, "group_name", user.alias("user"), n.alias("nbr_files"), size.alias("size"))
    return rows.filter(F.col("nbr_files").isNotNull() & F.col("size").isNotNull() & (F.col("user") != "Total"))


def _config_lines(raw: DataFrame, *keys: str) -> DataFrame:
    uncommented = F.regexp_replace("text", r"(?m)^([ \t]*#[^\n]*?)\\[ \t]*$", "$1")  # a comment does not go on
    joined = F.regexp_replace(uncommented, r"\\[ \t]*\n\s*", " ")
    return raw.select(*keys, F.posexplode(F.split(joined, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def read_node_gpus(raw: DataFrame, *keys: str) -> DataFrame:
    """Node configuration texts as (keys, node, gpus): ``NodeName=`` lines with a Gres list; lines that end in a backslash go on."""
    info = F.expr(r"str_to_map(regexp_replace(line, '\\s+', ' '), ' ', '=')")
    rows = _config_lines(raw, *keys).filter(F.startswith("line", F.lit("NodeName="))).withColumn("o", info).filter("o['Gres'] IS NOT NULL")
    return rows.select(*keys, F.explode(expand_hostlist(F.col("o")["NodeName"])).alias("node"), F.split(F.col("o")["Gres"], ",").alias("gpus"))


def gpu_billing(raw: DataFrame, node_gpus: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Billing weights of GPUs per (keys, gpu): explicit ``GRES/gpu:<type>=v`` of partitions, or a lone ``GRES/gpu=v`` for all GPUs of the partition's nodes.

    billing is the average, consistent tells whether none differs from the first by more than ``threshold`` percent.
    """
    info = F.expr(r"regexp_replace(line, '\\s+', ' ')")
    option = lambda name: F.regexp_extract(info, rf"(?:^| ){name}=(\S+)", 1)
    parts = _config_lines(raw, *keys).filter(F.startswith("line", F.lit("PartitionName="))).select(*keys, "line_no", option("Nodes").alias("nodes"), F.split(option("TRESBillingWeights"), ",").alias("weights"))
    value = lambda w: F.regexp_extract(w, r"=([\d.]+)", 1).try_cast("double")
    explicit = F.filter("weights", lambda w: F.startswith(w, F.lit("GRES/gpu:")))
    own = parts.select(*keys, "line_no", F.explode(F.transform(explicit, lambda w: F.struct(F.regexp_extract(w, r"^GRES/gpu:([^=]+)=", 1).alias("gpu"), value(w).alias("v")))).alias("x")).select(*keys, "line_no", "x.*")
    plain = F.try_element_at(F.filter("weights", lambda w: F.startswith(w, F.lit("GRES/gpu="))), F.lit(1))
    lone = parts.filter((F.size(explicit) == 0) & plain.isNotNull()).select(*keys, "line_no", value(plain).alias("v"), F.explode(expand_hostlist(F.col("nodes"))).alias("node"))
    held = node_gpus.select(*keys, "node", F.explode("gpus").alias("g")).withColumn("gpu", F.split_part("g", F.lit(":"), F.lit(2)))
    default = lone.join(held, [*keys, "node"]).select(*keys, "line_no", "gpu", "v").distinct()
    w = Window.partitionBy(*keys, "gpu").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = own.unionByName(default).withColumn("first", F.first("v").over(w))
    return both.groupBy(*keys, "gpu").agg(F.avg("v").alias("billing"), (F.max(F.abs(F.col("v") - F.col("first")) / F.col("first") * 100) <= threshold).alias("consistent"))


def read_since(spark: SparkSession, path: str, mark: datetime, schema: str) -> DataFrame:
    """JSON-lines drops in day folders (``day=YYYY-MM-DD``) from the mark on, in order of their ts; older folders are not opened."""
    return spark.read.schema(schema).json(path).filter((F.col("day") >= F.lit(mark.date())) & (F.col("ts") >= F.lit(mark))).orderBy("ts")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored and fresh rows, the newest by ``order`` of each key; on equal order the fresh one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("__new").desc())
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")


def jobs_by_reference(refs: DataFrame, jobs: DataFrame, keys: tuple[str, ...] = ("cluster_id", "job_id", "submit_time")) -> tuple[DataFrame, DataFrame]:
    """(references with their job_db_id, references without a job)."""
    own = jobs.select(*keys, "job_db_id")
    return refs.join(own, list(keys)), refs.join(own, list(keys), "left_anti")


def partition_drops(names: DataFrame, pattern: str = r"(\d{4})-(\d{2})-(\d{2})") -> DataFrame:
    """File names with the year, month and day in them; names without a date have nulls and are to be reported."""
    part = [F.nullif(F.regexp_extract("name", pattern, i), F.lit("")).alias(c) for i, c in ((1, "year"), (2, "month"), (3, "day"))]
    return names.select("name", *part)


def dispatch_drops(spark: SparkSession, path: str, target: str, pattern: str = r"(\d{4})-(\d{2})-(\d{2})", glob: str = "*", depth: int = 1) -> DataFrame:
    """Put the raw files under ``path`` into day folders by the date in their names: ``target`` is a table of (name, content, length, modified) by year, month and day, contents byte for byte. Returns (name, length) of the files without a date.
    A name has its last ``depth`` parts of the path.

    Files are read and written by the tasks, each whole; a folder of ``target`` that files of this run fall into is replaced, so a run that is repeated leaves the same. A file is one row, so files of up to 2 GB; Spark passes files without a byte over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = files.select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("name"), "content", "length", F.col("modificationTime").alias("modified"))
    part = [F.nullif(F.regexp_extract("name", pattern, i), F.lit("")).alias(c) for i, c in ((1, "year"), (2, "month"), (3, "day"))]
    dated = named.select("*", *part)
    placed = dated.filter("year IS NOT NULL")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(target)
    return dated.filter("year IS NULL").select("name", "length")
