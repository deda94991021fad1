"""User sources as one common record, and what their entries lack."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_ID = "struct<source:string,id:string>"
_IDS = f"array<{_ID}>"
_TYPES = "array<struct<value:string,valid_from:timestamp,valid_to:timestamp>>"
_ACCOUNTS = "array<struct<domain:string,username:string,valid_from:timestamp,valid_to:timestamp>>"
_SUPERVISORS = f"array<struct<supervisors:{_IDS},valid_from:timestamp,valid_to:timestamp>>"
#: The common record. ``own_id`` is null where an entry can't be identified; ``missing`` names the fields that it lacks.
RECORD = f"source string, own_id string, name string, email string, ids {_IDS}, types {_TYPES}, accounts {_ACCOUNTS}, supervisors {_SUPERVISORS}, missing array<string>, entry string"


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""


def _record(df: DataFrame, source: str, own_id: Column, entry: Column, missing: dict[str, Column], **fields: Column) -> DataFrame:
    """The common record of each row: fields that the source has not are empty, ``missing`` are conditions by field, ``entry`` is how the source calls the row."""
    lists = {"ids": _IDS, "types": _TYPES, "accounts": _ACCOUNTS, "supervisors": _SUPERVISORS}
    out = {"source": F.lit(source), "own_id": own_id, "name": fields.get("name", F.lit(None)).cast("string"), "email": fields.get("email", F.lit(None)).cast("string")}
    out |= {c: F.coalesce(fields[c].cast(kind), F.array().cast(kind)) if c in fields else F.array().cast(kind) for c, kind in lists.items()}
    out["missing"] = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(c)) for c, test in missing.items()])).cast("array<string>")
    out["entry"] = entry.cast("string")
    return df.select(*[x.alias(c) for c, x in out.items()])


def _account(domain: str, username: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(domain).alias("domain"), username.alias("username"), start.cast("timestamp").alias("valid_from"), end.cast("timestamp").alias("valid_to"))


def _known(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~_blank(x), F.struct(F.lit(source).alias("source"), x.alias("id"))) for source, x in pairs]))


def read_member_csv(rows: DataFrame, open_accounts: DataFrame, at: datetime, domain: str, source: str = "members") -> DataFrame:
    """Member rows (any case of name, email, username, ccri, activation_status, member_since) as the common record: person code, dated account.

    Active: an account open from member_since; else an open account known by username ends at ``at``, others give none. The own id is the code without its last three characters.
    """
    r = rows.select(*[F.col(c).alias(c.strip().lower()) for c in rows.columns])
    held = open_accounts.select(F.col("username").alias("u"), F.col("valid_from").alias("since"))
    both = r.join(held, F.col("username") == F.col("u"), "left")
    active = F.lower("activation_status") == "activated"
    start = F.when(active, F.col("member_since").try_cast("timestamp")).otherwise(F.col("since"))
    account = F.when(active | F.col("since").isNotNull(), _account(domain, F.col("username"), start, F.when(~active, F.lit(at))))
    own = F.when(~_blank(F.col("ccri")), F.expr("substr(ccri, 1, length(ccri) - 3)"))
    lacks = {"own_id": _blank(F.col("ccri")), "username": _blank(F.col("username")), "member_since": active & F.col("member_since").try_cast("timestamp").isNull()}
    return _record(both, source, own, F.col("username"), lacks, name=F.col("name"), email=F.col("email"), accounts=F.array_compact(F.array(account)))


def read_hr_rows(rows: DataFrame, member_types: dict[tuple[str, str], str], blocked: list[str], professors: str = "professor", directory: str = "directory", source: str = "hr") -> DataFrame:
    """HR rows (member_no, name, email, profile, affiliation, start, end: dates in UTC, supervisors: member numbers) as the common record.

    Rows with a blocked number are left out, rows without email have no own id. Type and supervisors are valid from start to end; professors have no supervisors, nor do blocked ones count. The address names the
    person in the directory too.
    """
    kinds = F.create_map(*[F.lit(x) for (p, a), t in member_types.items() for x in (f"{p}|{a}", t)])
    kind = kinds[F.concat_ws("|", "profile", "affiliation")]
    kept = rows.filter(~F.coalesce(F.col("member_no").isin(blocked), F.lit(False))).withColumn("kind", kind)
    start, end = (F.col(c).try_cast("timestamp") for c in ("start", "end"))
    of = F.transform(F.filter("supervisors", lambda x: ~_blank(x) & ~x.isin(blocked)), lambda x: F.struct(F.lit(source).alias("source"), x.alias("id")))
    boss = F.when((F.coalesce(F.col("kind"), F.lit("")) != professors) & (F.size(of) > 0), F.array(F.struct(of.alias("supervisors"), start.alias("valid_from"), end.alias("valid_to"))))
    dated = F.when(F.col("kind").isNotNull(), F.array(F.struct(F.col("kind").alias("value"), start.alias("valid_from"), end.alias("valid_to"))))
    email = F.when(~_blank(F.col("email")), F.lower(F.trim("email")))
    lacks = {"own_id": _blank(F.col("member_no")), "email": email.isNull(), "type": F.col("kind").isNull(), "start": start.isNull()}
    own = F.when(email.isNotNull() & ~_blank(F.col("member_no")), F.col("member_no"))
    return _record(kept, source, own, F.col("member_no"), lacks, name=F.col("name"), email=email, ids=_known((directory, email)), types=dated, supervisors=boss)


def read_directory(raw: DataFrame, open_accounts: DataFrame, at: datetime, domain: str, source: str = "directory") -> DataFrame:
    """Directory documents (text: a JSON list of entries whose fields are lists) as the common record. An entry that is not suspended has an account from ``at`` on; a suspended one
    whose account is open (``open_accounts``: username) ends it at ``at``, other suspended ones are left out. The id is the address in lower case."""
    fields = "array<struct<displayName:array<string>,mail:array<string>,posixUid:array<string>,suspended:array<string>>>"
    e = raw.select(F.explode(F.from_json("text", fields)).alias("e")).select(*[F.get(f"e.{c}", F.lit(0)).alias(c) for c in ("displayName", "mail", "posixUid", "suspended")])
    held = open_accounts.select(F.col("username").alias("__u")).distinct()
    both = e.join(held, F.col("posixUid") == F.col("__u"), "left")
    active, now = F.coalesce(F.col("suspended"), F.lit("false")) != "true", F.lit(at)
    email = F.when(~_blank(F.col("mail")), F.lower("mail"))
    kept = both.filter(active | F.col("__u").isNotNull())
    account = F.when(~_blank(F.col("posixUid")), _account(domain, F.col("posixUid"), now, F.when(~active, now)))
    lacks = {"own_id": email.isNull(), "username": _blank(F.col("posixUid")), "suspended": F.col("suspended").isNull()}
    return _record(kept, source, email, F.coalesce("mail", "posixUid", "displayName"), lacks, name=F.col("displayName"), email=email, accounts=F.array_compact(F.array(account)))


def read_legacy_dump(raw: DataFrame, home: str, partner: str, directory: str = "directory", members: str = "members", source: str = "legacy", zone: str = "America/Montreal") -> DataFrame:
    """Dump documents (text: a JSON list of persons with an account block each of the ``home`` and the ``partner`` site) as the common record. Times are local in ``zone``; the home account counts if active; the partner's
    id is its code (``ccri`` of ``<partner>_members`` or ``<partner>_roles``) without the last three characters."""
    person = (
        f"array<struct<name:string,record_start:string,record_end:string,`{home}`:struct<email:string,username:string,active:boolean>,`{partner}`:struct<username:string>,"
        f"`{partner}_members`:struct<ccri:string>,`{partner}_roles`:struct<ccri:string>>>"
    )
    p = raw.select(F.explode(F.from_json("text", person)).alias("p"))
    start, end = (F.to_utc_timestamp(F.col(f"p.record_{x}").cast("timestamp"), zone) for x in ("start", "end"))
    mail, code = F.col(f"p.{home}.email"), F.coalesce(F.col(f"p.{partner}_members"), F.col(f"p.{partner}_roles"))["ccri"]
    login = F.col(f"p.{partner}.username")
    accounts = F.array(F.when(F.coalesce(F.col(f"p.{home}.active"), F.lit(False)), _account(home, F.col(f"p.{home}.username"), start, end)), F.when(login != "", _account(partner, login, start, end)))
    known = _known((directory, mail), (members, F.left(code, F.char_length(code) - 3)))
    own = F.when(~_blank(mail), F.lower(mail))
    lacks = {"own_id": own.isNull(), "start": start.isNull()}
    return _record(p, source, own, F.coalesce(mail, F.col("p.name")), lacks, name=F.col("p.name"), email=own, ids=known, accounts=F.array_compact(accounts))


def read_manual_pairs(raw: DataFrame, source: str = "manual") -> DataFrame:
    """Documents (text: ``{"name": [{"name": source, "mid": id}, ...]}``) as the common record: ids that belong together, without accounts."""
    pairs = raw.select(F.explode(F.from_json("text", "map<string,array<struct<name:string,mid:string>>>")).alias("key", "x"))
    ids = F.array_distinct(F.transform(F.filter("x", lambda x: ~_blank(x["mid"])), lambda x: F.struct(x["name"].alias("source"), x["mid"].alias("id"))))
    return _record(pairs, source, F.when(~_blank(F.col("key")), F.col("key")), F.col("key"), {"own_id": _blank(F.col("key")), "ids": F.size(ids) < 2}, ids=ids)


#: Readers of user sources by name: functions of a DataFrame and options that return the common record.
USER_READERS: dict[str, Callable[..., DataFrame]] = {"directory": read_directory, "legacy": read_legacy_dump, "manual": read_manual_pairs, "members": read_member_csv, "hr": read_hr_rows}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    """Make a reader of one's own known to :func:`read_users`; a name can be given once."""
    if name in USER_READERS:
        raise ValueError(f"there is a reader called {name} already")
    USER_READERS[name] = reader


def _all(sources: Sequence[tuple[str, DataFrame, dict]], patches: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    parts = [USER_READERS[name](raw, **options).withColumn("source_rank", F.lit(rank)) for rank, (name, raw, options) in enumerate(sources)]
    return reduce(DataFrame.transform, patches, reduce(DataFrame.unionByName, parts))


def read_users(sources: Sequence[tuple[str, DataFrame, dict]], patches: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """All sources (reader, raw, options) as common records, with the source's rank in the given order: the first that has a value wins (:func:`tallygrid.operators.people.resolve_identities`).

    ``patches`` change the records one after the other before they are matched. Entries without an own id are left out here; :func:`missing_fields` reports them.
    """
    return _all(sources, patches).filter("own_id IS NOT NULL").drop("missing", "entry")


def missing_fields(sources: Sequence[tuple[str, DataFrame, dict]], patches: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """(source, own_id, entry, field): what the entries of all sources lack; of those without own id, the name that the source has for them."""
    return _all(sources, patches).select("source", "own_id", "entry", F.explode("missing").alias("field"))
