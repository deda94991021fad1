"""People, accounts and values with a period of validity ([valid_from, valid_to), null = open)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.functions.ranges import running_max
from tallygrid.functions.timeaxis import epoch, seconds


def _holds(at: Column, lo: str = "valid_from", hi: str = "valid_to") -> Column:
    return (F.col(lo).isNull() | (F.col(lo) <= at)) & (F.col(hi).isNull() | (at < F.col(hi)))


def _meets(lo: datetime | None, hi: datetime | None) -> Column:
    """Whether the period of validity meets [lo, hi); a bound that is missing is open."""
    f, t = seconds(F.col("valid_from")), seconds(F.col("valid_to"))
    begun = F.lit(True) if hi is None else F.col("valid_from").isNull() | (f < epoch(hi))
    return begun if lo is None else begun & (F.col("valid_to").isNull() | (t > epoch(lo)))


def owners_asof(jobs: DataFrame, credentials: DataFrame, clusters: DataFrame) -> DataFrame:
    """Jobs with owner_id, who held the login on the cluster's domain at submission; jobs without one are left out (see :func:`ownerless`)."""
    domains = F.broadcast(clusters.select(F.col("id").alias("cluster_id"), "domain"))
    c = credentials.select(F.col("domain").alias("d"), F.col("username").alias("n"), F.col("user_id").alias("owner_id"), "valid_from", "valid_to")
    both = (F.col("d") == F.col("domain")) & (F.col("n") == F.col("cluster_user")) & _holds(F.col("submit_time"))
    return jobs.join(domains, "cluster_id").join(c, both).drop("d", "n", "valid_from", "valid_to")


def ownerless(jobs: DataFrame, credentials: DataFrame, clusters: DataFrame) -> DataFrame:
    """Jobs and dropped jobs per cluster."""
    owned = owners_asof(jobs, credentials, clusters).select("job_db_id").withColumn("owned", F.lit(1))
    return jobs.join(owned, "job_db_id", "left").groupBy("cluster_id").agg(F.count("*").alias("n_jobs"), F.sum(F.when(F.col("owned").isNull(), 1).otherwise(0)).alias("n_dropped"))


def member_type_asof(jobs: DataFrame, types: DataFrame) -> DataFrame:
    """Jobs with the member type valid at submission, or null."""
    t = types.select(F.col("user_id").alias("u"), "member_type", "valid_from", "valid_to")
    return jobs.join(t, (F.col("u") == F.col("user_id")) & _holds(F.col("submit_time")), "left").drop("u", "valid_from", "valid_to")


def supervisors_asof(jobs: DataFrame, supervisors: DataFrame) -> DataFrame:
    """Jobs with the ordered list of supervisors valid at submission, or null; lists are built once per validity, before the join."""
    keys = ["user_id", "valid_from", "valid_to"]
    lists = supervisors.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "supervisor"))), lambda x: x["supervisor"]).alias("supervisors")).withColumnRenamed("user_id", "u")
    return jobs.join(lists, (F.col("u") == F.col("user_id")) & _holds(F.col("submit_time")), "left").drop("u", "valid_from", "valid_to")


#: Slots that the time of a dated table is cut into, and copies of each slot over which rows are dealt.
SLOTS, DEALT = 256, 16


def asof(rows: DataFrame, at: str, dated: DataFrame, key: str, oldest_before: bool) -> DataFrame:
    """``rows`` with the columns of the latest ``dated`` row (key, since, ...) with since <= at.

    A null date takes the newest. Before all: the oldest if ``oldest_before``, else null. Each dated row becomes an interval up to the next one of its key.

    Rows and intervals meet by key and time slot, so few keys do not make few tasks: an interval stands in every slot that it touches. Intervals of a key do not overlap, so that makes
    (dated rows + keys x ``SLOTS``) x ``DEALT`` rows at most; the copies split a slot that most rows fall into. The span of the dated table is looked up first.
    """
    w = Window.partitionBy(key).orderBy("since")
    spans = dated.withColumn("__to", F.lead("since").over(w)).withColumn("__from", F.when(F.lit(oldest_before) & (F.row_number().over(w) == 1), F.lit(None).cast("timestamp")).otherwise(F.col("since")))
    ends = dated.select(F.min(seconds(F.col("since"))).alias("lo"), F.max(seconds(F.col("since"))).alias("hi")).first()  # one row
    lo, width = ends["lo"] or 0.0, max(1.0, ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / SLOTS)

    def slot(moment: Column) -> Column:
        inside = F.greatest(F.lit(-1), F.least(F.lit(SLOTS), F.floor((seconds(moment) - lo) / width))).cast("int")
        return F.when(moment.isNotNull(), inside)  # least and greatest pass nulls over

    undated = SLOTS + 1
    touched = F.sequence(F.coalesce(slot(F.col("__from")), F.lit(-1)), F.coalesce(slot(F.col("__to")), F.lit(SLOTS)))
    touched = F.when(F.col("__to").isNull(), F.concat(touched, F.array(F.lit(undated)))).otherwise(touched)
    copies = F.sequence(F.lit(0), F.lit(DEALT - 1))
    d = spans.withColumnRenamed(key, "__k").withColumn("__slot", F.explode(touched)).withColumn("__copy", F.explode(copies))
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    dealt = rows.withColumn("__s", F.coalesce(slot(F.col(at)), F.lit(undated))).withColumn("__c", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(DEALT)).cast("int"))
    inside = (F.col("__from").isNull() | (F.col("__from") <= F.col(at))) & (F.col("__to").isNull() | (F.col(at) < F.col("__to")))
    hit = (F.col("__k") == F.col(key)) & (F.col("__slot") == F.col("__s")) & (F.col("__copy") == F.col("__c")) & F.when(F.col(at).isNull(), F.col("__to").isNull()).otherwise(inside)
    return dealt.join(d, hit, "left").drop("__k", "__from", "__to", "__slot", "__copy", "__s", "__c", "since")


def values_at(keys: DataFrame, dated: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the value valid at their date, rows without any)."""
    d = dated.withColumnRenamed(key, "__k")
    hit = (F.col("__k") == F.col(key)) & _holds(F.col(at))
    return keys.join(d, hit).drop("__k"), keys.join(d, hit, "left_anti")


def values_in_range(dated: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    return dated.filter(_meets(lo, hi))


def find_users(
    users: DataFrame, types: DataFrame | None = None, supervisors: DataFrame | None = None, *, name: str | None = None, email: str | None = None,
    member_type: str | None = None, supervisor: int | None = None, lo: datetime | None = None, hi: datetime | None = None, now: datetime | None = None,
) -> DataFrame:
    """Users whose name contains ``name`` (any case), with that email, that member type or that supervisor during [lo, hi).

    Without both bounds the range is the microsecond from ``now`` (default: the clock) on; with one of them the other is open.
    """
    if lo is None and hi is None:
        lo = now or datetime.now(timezone.utc)
        hi = lo + timedelta(microseconds=1)
    out = users
    if name is not None:
        out = out.filter(F.contains(F.lower("display_name"), F.lit(name.lower())))
    if email is not None:
        out = out.filter(F.col("email") == email)
    for table, column, value in ((types, "member_type", member_type), (supervisors, "supervisor", supervisor)):
        if value is not None:
            held = table.filter((F.col(column) == value) & _meets(lo, hi)).select(F.col("user_id").alias("id"))
            out = out.join(held, "id", "left_semi")
    return out


def check_no_overlap(dated: DataFrame, keys: list[str], ties: list[Column] | None = None) -> DataFrame:
    """Rows whose period begins before an earlier one of their key has ended. Equal periods go by ``ties`` (default: the other plain columns), so a repeated run reports the same ones."""
    others = ties or [F.col(f"`{c}`") for c, kind in dated.dtypes if c not in (*keys, "valid_from", "valid_to") and not kind.startswith(("map", "array", "struct", "variant"))]
    w = Window.partitionBy(*keys).orderBy(F.col("valid_from").asc_nulls_first(), F.col("valid_to").asc_nulls_last(), *others).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.coalesce(F.col("valid_to"), F.lit(datetime(9999, 1, 1)).cast("timestamp"))).over(w)
    return dated.withColumn("__end", ends).filter(F.col("__end").isNotNull() & (F.col("valid_from").isNull() | (F.col("valid_from") < F.col("__end")))).drop("__end")


def merge_equal_periods(dated: DataFrame, keys: list[str]) -> DataFrame:
    """Touching or overlapping periods of one key and value as one period."""
    far, past = F.lit(datetime(9999, 1, 1)).cast("timestamp"), F.lit(datetime(1, 1, 1)).cast("timestamp")
    x = dated.select(*keys, F.coalesce("valid_from", past).alias("a"), F.coalesce("valid_to", far).alias("b"))
    w = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    out = x.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return out.select(*keys, F.when(F.col("a") != past, F.col("a")).alias("valid_from"), F.when(F.col("b") != far, F.col("b")).alias("valid_to"))


_OPEN = float("inf")
_PERIODS = "array<struct<a:double,b:double,v:string>>"


def _let(x: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _period(a: Column, b: Column, v: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), v.alias("v"))


def _after(state: Column, i: Column, truncate: bool) -> Column:
    """The state (held and rejected periods) after one more insert, as sets of periods.

    kin: periods of the same value that overlap or touch the insert; rivals: those of other values that overlap it. An open insert ends where the first
    rival after its start begins. Its hull with its kin takes their place, unless one of them covers it. Rivals that the hull meets either are cut out of it
    (``truncate``), or give way: an open end to a later start, an open beginning to an earlier end. If one cannot, the insert is rejected.
    """
    overlaps = lambda h, a, b: (h["a"] < b) & (a < h["b"])
    own = lambda h: (h["v"] == i["v"]) & (h["a"] <= i["b"]) & (i["a"] <= h["b"])
    rival = lambda h: (h["v"] != i["v"]) & overlaps(h, i["a"], i["b"])
    starts = F.transform(F.filter(state["held"], lambda h: rival(h) & (h["a"] > i["a"])), lambda h: h["a"])
    end = F.when(i["b"] == _OPEN, F.coalesce(F.array_min(starts), i["b"])).otherwise(i["b"])

    def with_end(end: Column) -> Column:
        kin = F.filter(state["held"], own)
        hull = F.struct(F.least(i["a"], F.array_min(F.transform(kin, lambda h: h["a"]))).alias("a"), F.greatest(end, F.array_max(F.transform(kin, lambda h: h["b"]))).alias("b"))
        covered = F.exists(kin, lambda h: (h["a"] <= i["a"]) & (end <= h["b"]))
        return F.when(covered, state).otherwise(_let(hull, with_hull))

    def with_hull(u: Column) -> Column:
        met = lambda h: rival(h) & overlaps(h, u["a"], u["b"])
        ends_early, begins_late = lambda h: (h["b"] == _OPEN) & (h["a"] < u["a"]), lambda h: (h["a"] == -_OPEN) & (u["b"] < h["b"])
        rest, rivals = F.filter(state["held"], lambda h: ~own(h) & ~met(h)), F.array_sort(F.filter(state["held"], met))
        if truncate:
            gaps = F.zip_with(F.concat(F.array(u["a"]), F.transform(rivals, lambda h: h["b"])), F.concat(F.transform(rivals, lambda h: h["a"]), F.array(u["b"])), lambda a, b: _period(a, b, i["v"]))
            return F.struct(F.concat(rest, rivals, F.filter(gaps, lambda g: g["a"] < g["b"])).alias("held"), state["bad"].alias("bad"))
        shorter = F.transform(rivals, lambda h: F.when(ends_early(h), _period(h["a"], u["a"], h["v"])).otherwise(_period(u["b"], h["b"], h["v"])))
        placed = F.struct(F.concat(rest, shorter, F.array(_period(u["a"], u["b"], i["v"]))).alias("held"), state["bad"].alias("bad"))
        refused = F.struct(state["held"].alias("held"), F.concat(state["bad"], F.array(_period(i["a"], i["b"], i["v"]))).alias("bad"))
        return F.when(F.forall(rivals, lambda h: ends_early(h) | begins_late(h)), placed).otherwise(refused)

    return _let(end, with_end)


#: A key with more inserts is cut into islands that are folded side by side.
LARGE_KEY = 10_000


def _islands(each: DataFrame, key: str) -> DataFrame:
    """``each`` (key, i: seq, a, b, v) with island: runs of inserts whose periods overlap or touch, one after the other. Rules look at periods that overlap or touch only, so islands can't influence each other; an open end reaches all that follows."""
    rows = each.select(key, F.col("i.a").alias("__a"), F.col("i.b").alias("__b"), F.col("i.seq").alias("__seq"), "i")
    order = [F.col("__a"), F.col("__b"), F.col("__seq")]
    reach = running_max(rows, [key], order, "__b", "__reach", before=True)
    begun = reach.withColumn("__begin", F.when(F.col("__reach").isNull() | (F.col("__a") > F.col("__reach")), F.col("__a")))
    return running_max(begun, [key], order, "__begin", "island").select(key, "i", "island")


def insert_dated(inserts: DataFrame, key: str, truncate: bool = False) -> DataFrame:
    """Inserts (key, seq, value, from_s, to_s; null = open, equal ends: nothing) taken in order of seq into periods per key: key, value, from_s, to_s, rejected.

    A rejected insert comes back as a row of its own. Whether an insert is rejected depends on those before it whose periods meet, so a key is folded in order, by built-in functions over the array of its inserts.
    Keys of more than ``LARGE_KEY`` inserts are cut into islands (:func:`_islands`), found by ranges of the key's inserts and folded in as many tasks as there are; one island is folded by one.
    """
    lo, hi = F.coalesce(F.col("from_s").cast("double"), F.lit(-_OPEN)), F.coalesce(F.col("to_s").cast("double"), F.lit(_OPEN))
    each = inserts.select(key, F.struct("seq", lo.alias("a"), hi.alias("b"), F.col("value").cast("string").alias("v")).alias("i")).filter("i.a < i.b")
    large = each.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > LARGE_KEY).select(F.col(key).alias("__large"))
    whole = F.lit(0.0).alias("island")
    if large.isEmpty():
        dealt = each.select(key, "i", whole)
    else:
        is_large = F.col(key).eqNullSafe(F.col("__large"))
        dealt = each.join(large, is_large, "left_anti").select(key, "i", whole).unionByName(_islands(each.join(large, is_large, "left_semi"), key))
    state = f"struct<held:{_PERIODS},bad:{_PERIODS}>"
    none = F.struct(F.array().cast(_PERIODS).alias("held"), F.array().cast(_PERIODS).alias("bad")).cast(state)
    done = dealt.groupBy(key, "island").agg(F.array_sort(F.collect_list("i")).alias("i")).select(key, F.aggregate("i", none, lambda s, i: _after(s, i, truncate).cast(state)).alias("s"))
    shown = lambda rejected: lambda h: F.struct(h["v"].alias("value"), F.nullif(h["a"], F.lit(-_OPEN)).alias("from_s"), F.nullif(h["b"], F.lit(_OPEN)).alias("to_s"), F.lit(rejected).alias("rejected"))
    both = F.concat(F.transform("s.held", shown(False)), F.transform("s.bad", shown(True)))
    return done.select(key, F.inline(both))


def _least_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches, by rounds of least neighbours with short-cuts until nothing changes."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "n")
        new = labels.join(near, labels["node"] == near["n"], "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = new.select(F.col("node").alias("j"), F.col("label").alias("l2"))
        new = new.join(jump, new["label"] == jump["j"], "left").select("node", F.coalesce("l2", "label").alias("label")).checkpoint()
        settled = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty()
        labels = new
        if settled:
            return labels


def resolve_identities(records: DataFrame) -> DataFrame:
    """Records (record_id, source, source_rank, ids array<struct<source,id>>, name, email) given to persons.

    Records that share any (source, id) are one person; name and email come from the first source that has them. Returns person_id (the
    smallest record_id), record_id, name, email, conflict (a source gives the person two ids), valid (it has a name and an email).
    """
    links = records.select("record_id", F.explode("ids").alias("x")).select("record_id", "x.source", "x.id").distinct()
    first = links.groupBy("source", "id").agg(F.min("record_id").alias("b"))
    edges = links.join(first, ["source", "id"]).select(F.col("record_id").alias("a"), "b")
    labels = _least_labels(edges.unionByName(records.select(F.col("record_id").alias("a"), F.col("record_id").alias("b"))))
    own = records.join(labels, records["record_id"] == labels["node"]).withColumnRenamed("label", "person_id")
    conflict = links.join(labels, links["record_id"] == labels["node"]).groupBy("label", "source").agg(F.count_distinct("id").alias("n")).groupBy("label").agg((F.max("n") > 1).alias("conflict"))
    rank = F.struct("source_rank", "record_id")
    filled = own.groupBy("person_id").agg(*[F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), rank)).alias(c) for c in ("name", "email")])
    out = own.select("person_id", "record_id").join(filled, "person_id").join(conflict, F.col("person_id") == F.col("label"), "left").drop("label")
    return out.withColumn("conflict", F.coalesce("conflict", F.lit(False))).withColumn("valid", F.col("name").isNotNull() & F.col("email").isNotNull())


def resolve_against(stored: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fresh records (record_id, ids array<struct<source,id>>) against the ids of stored persons (person_id, source, id): (assigned, merged).

    ``assigned``: record_id, person_id, is_new; a record that reaches a stored person gets the least such, others form persons of their own, numbered by their least record_id. ``merged``: old_id, new_id of the
    stored persons that fresh records show to be one (for :func:`remap_owners`, :func:`merge_ids` and :func:`merge_periods`). Only fresh records and the stored persons that share an id with one are labelled, so the
    work grows with what is new; the persons are those that a resolution of all records at once would find.
    """
    links = records.select("record_id", F.explode("ids").alias("x")).select("record_id", "x.source", "x.id").distinct()
    node = lambda new, c: F.struct(F.lit(new).alias("new"), F.col(c).cast("long").alias("id"))
    first = links.groupBy("source", "id").agg(F.min("record_id").alias("least"))
    among = links.join(first, ["source", "id"]).select(node(True, "record_id").alias("a"), node(True, "least").alias("b"))
    reached = first.join(stored.select("source", "id", "person_id"), ["source", "id"]).select(node(True, "least").alias("a"), node(False, "person_id").alias("b"))
    own = records.select(node(True, "record_id").alias("a"), node(True, "record_id").alias("b"))
    labels = _least_labels(among.unionByName(reached).unionByName(own)).checkpoint()
    assigned = labels.filter("node.new").select(F.col("node.id").alias("record_id"), F.col("label.id").alias("person_id"), F.col("label.new").alias("is_new"))
    merged = labels.filter("NOT node.new AND node.id <> label.id").select(F.col("node.id").alias("old_id"), F.col("label.id").alias("new_id"))
    return assigned, merged


def merge_dated(records: DataFrame, persons: DataFrame, values: Column, truncate: bool) -> DataFrame:
    """Dated values of all records of a person as one set of periods: person_id, value, from_s, to_s, rejected.

    ``records``: record_id, source_rank; ``persons``: record_id, person_id; ``values``: an array of (value, valid_from, valid_to) of the record. Sources come in the order of their rank, records of a source by id: with
    ``truncate`` (types, supervisors) later ones fill what earlier ones leave open, else (accounts) they are inserts that may be rejected; those come back as rows (:func:`insert_dated`).
    """
    each = records.select("record_id", "source_rank", F.posexplode(values).alias("pos", "x")).join(persons.select("record_id", "person_id"), "record_id")
    order = Window.partitionBy("person_id").orderBy("source_rank", "record_id", "pos")
    to_s = lambda c: F.unix_micros(F.col(f"x.{c}").cast("timestamp")) / 1e6
    inserts = each.select("person_id", F.row_number().over(order).cast("long").alias("seq"), F.col("x.value").alias("value"), to_s("valid_from").alias("from_s"), to_s("valid_to").alias("to_s"))
    return insert_dated(inserts, "person_id", truncate)


def update_ids(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ids of persons (person_id, source, id): a fresh one takes the place of the stored one of its person and source, which is reported as replaced."""
    f = fresh.select("person_id", "source", F.col("id").alias("new"))
    both = stored.withColumnRenamed("id", "old").join(f, ["person_id", "source"], "full_outer")
    return both.select("person_id", "source", F.coalesce("new", "old").alias("id"), F.when(F.col("new") != F.col("old"), F.col("old")).alias("replaced"))


def remap_owners(fact: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """A fact table (jobs, supervisor references) with the ids of merged persons (old_id, new_id) replaced."""
    m = mapping.select(F.col("old_id").alias("__old"), "new_id")
    return fact.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("new_id", column)).drop("__old", "new_id")


def merge_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ids (user_id, source, id) after persons were merged: of two of one source the remaining person's own stays; lost tells those that differ."""
    moved = remap_owners(ids.withColumn("was", F.col("user_id")), mapping, "user_id")
    first = F.min_by("id", F.struct((F.col("was") != F.col("user_id")).alias("moved"), "was"))
    out = moved.groupBy("user_id", "source").agg(first.alias("id"), F.array_sort(F.collect_set("id")).alias("all"))
    return out.select("user_id", "source", "id", F.array_except("all", F.array("id")).alias("lost"))


def merge_periods(dated: DataFrame, mapping: DataFrame, truncate: bool, ties: list[str] | None = None) -> DataFrame:
    """Dated values (user_id, value, from_s, to_s) after persons were merged: the remaining person's own come first, those of the merged one around them (``truncate``: member types, supervisors) or as inserts that may be rejected (accounts). Own and merged ones go by person, begin, value, the columns ``ties`` and end (an open one last), so a repeated run finds the same."""
    moved = remap_owners(dated.withColumn("was", F.col("user_id")), mapping, "user_id")
    order = Window.partitionBy("user_id").orderBy(F.col("was") != F.col("user_id"), "was", F.col("from_s").asc_nulls_first(), "value", *(ties or []), F.col("to_s").asc_nulls_last())
    return insert_dated(moved.withColumn("seq", F.row_number().over(order).cast("long")).drop("was"), "user_id", truncate)


def supervisor_levels(persons: DataFrame, supervisors: DataFrame) -> DataFrame:
    """(id, level): 0 without supervisors among ``persons``, else after all of them; those in or behind a cycle come last, together (level -1).

    A round per level, until no person is free: as many as the longest chain of supervisors.
    """
    left, links, out = persons.select("id"), supervisors.select(F.col("user_id").alias("id"), "supervisor").join(persons.select(F.col("id").alias("supervisor")), "supervisor", "left_semi"), None
    for level in count():
        free = left.join(links.select("id"), "id", "left_anti").checkpoint()
        if free.isEmpty():
            break
        out = free.withColumn("level", F.lit(level)) if out is None else out.unionByName(free.withColumn("level", F.lit(level)))
        left = left.join(free, "id", "left_anti").checkpoint()
        links = links.join(free.withColumnRenamed("id", "supervisor"), "supervisor", "left_anti").checkpoint()
    last = left.withColumn("level", F.lit(-1))
    return last if out is None else out.unionByName(last)


#: Letters that count as another one.
_FOLDED_LETTERS = ("éèëêçîï", "eeeecii")


def letters(name: Column) -> Column:
    """The characters of a name in lower case, sorted, repeats included: a sparse count of each, whatever its script."""
    return F.array_sort(F.regexp_extract_all(F.translate(F.lower(name), *_FOLDED_LETTERS), F.lit("(?s)."), F.lit(0)))


def letter_distance(a: Column, b: Column) -> Column:
    """By how much the counts of all characters of two sorted lists differ in sum: repeats are numbered, so lists become sets."""
    def numbered(x: Column) -> Column:
        return F.transform(x, lambda c, i: F.concat(c, (i - F.array_position(x, c)).cast("string")))

    return F.size(F.array_except(numbered(a), numbered(b))) + F.size(F.array_except(numbered(b), numbered(a)))


def near_letters(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(c, d, distance) of the letter lists ``left`` (c) and ``right`` (d), each distinct, whose counts differ by ``threshold`` or less in sum.

    Characters are dealt into blocks by hash, so no alphabet is fixed: one block for a threshold of 2 or less, else threshold / 2 + 1. In one of the blocks such lists differ by ``apart`` characters at most (the threshold, else one), so
    they are equal there once each has left out what the other lacks. A grid has a cell per block and letters in it; every list stands in its own cell and in those with up to ``apart`` characters left out, and lists meet
    where they have left out no more together. With one block only lists within the threshold meet; else the distance is a condition of the join.
    """
    n = 1 if threshold <= 2 else threshold // 2 + 1
    apart = threshold // n

    def without(x: Column) -> Column:
        """``x`` with one character less, each way once."""
        less = F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.concat(F.slice(x, F.lit(1), i - 1), F.slice(x, i + 1, F.size(x))))
        return F.when(F.size(x) > 0, F.array_distinct(less)).otherwise(F.array().cast("array<array<string>>"))

    def cells(x: str) -> Column:
        def of(k: int) -> Column:
            found = [F.array(F.filter(x, lambda c: F.pmod(F.xxhash64(c), F.lit(n)) == k) if n > 1 else F.col(x))]
            for _ in range(apart):
                found.append(F.array_distinct(F.flatten(F.transform(found[-1], without))))
            cell = lambda out: lambda text: F.struct(F.lit(k).alias("block"), F.array_join(text, "").alias("cell"), F.lit(out).alias("out"))
            return F.concat(*[F.transform(texts, cell(out)) for out, texts in enumerate(found)])

        return F.inline(F.concat(*[of(k) for k in range(n)]))

    a, b = left.select("c", cells("c")).alias("a"), right.select("d", cells("d")).alias("b")
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.out") + F.col("b.out") <= apart)
    met = a.join(b, same if n == 1 else same & (letter_distance(F.col("c"), F.col("d")) <= threshold))
    return met.select("c", "d").distinct().withColumn("distance", letter_distance(F.col("c"), F.col("d")))


def nearest_names(left: DataFrame, right: DataFrame, threshold: int, nearest: int = 10) -> DataFrame:
    """(id, other, distance, rank): for each person of ``left`` (id, name) the ``nearest`` persons of ``right`` within ``threshold`` by letter counts; ties go by name, then id.

    Names of equal letters are one list before any join, with their first ``nearest`` persons; names that are null take no part.
    """
    known = lambda df, c: df.filter("name IS NOT NULL").withColumn(c, letters(F.col("name")))
    first = Window.partitionBy("d").orderBy("name", "id")
    r = known(right, "d").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= nearest).select("d", "name", F.col("id").alias("other"))
    l = known(left, "c").select("id", "c")
    near = near_letters(l.select("c").distinct(), r.select("d").distinct(), threshold).join(r, "d")
    order = Window.partitionBy("c").orderBy("distance", "name", "other")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return l.join(ranked, "c").select("id", "other", "distance", "rank")


def match_names(left: DataFrame, right: DataFrame, threshold: int, nearest: int = 10) -> DataFrame:
    """Persons (id, name, email) of two lists: equal email first; of the rest those with exactly one name within ``threshold`` by letter counts among the ``nearest``.

    Names of equal letters are one list before any join (see :func:`near_letters`), with the number of its persons and the least id, so no pair of persons is made.
    """
    by_email = right.filter("email <> ''").groupBy(F.lower("email").alias("e")).agg(F.min("id").alias("other"))
    e = left.filter("email <> ''").join(by_email, F.lower("email") == F.col("e")).groupBy("id").agg(F.min("other").alias("other")).withColumn("by", F.lit("email"))
    l = left.join(e.select("id"), "id", "left_anti").filter("name IS NOT NULL").select("id", letters(F.col("name")).alias("c"))
    r = right.join(e.select(F.col("other").alias("id")), "id", "left_anti").filter("name IS NOT NULL").select("id", letters(F.col("name")).alias("d"))
    r = r.groupBy("d").agg(F.count("*").alias("k"), F.min("id").alias("other"))
    near = near_letters(l.select("c").distinct(), r.select("d"), threshold).join(r, "d").groupBy("c").agg(F.sum("k").alias("k"), F.min(F.struct("distance", "other")).alias("first"))
    one = l.join(near.filter(F.least("k", F.lit(nearest)) == 1), "c").groupBy("id").agg(F.count("*").alias("rows"), F.min("first.other").alias("other")).filter("rows = 1")
    return e.unionByName(one.select("id", "other", F.lit("name").alias("by")))


def unmatched(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Persons that no pair holds, with the side they are on."""
    a = left.select("id").join(pairs.select("id"), "id", "left_anti").withColumn("side", F.lit("left"))
    b = right.select("id").join(pairs.select(F.col("other").alias("id")), "id", "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)
