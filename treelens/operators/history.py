"""History operators: chains, as-of, version runs, retention cuts and paging."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows a page may ask for.
MAX_LIMIT = 10_000


def chain(commits: DataFrame, limit: int = 0) -> DataFrame:
    """First-parent chain of every library, newest first; ``limit`` 0 takes all."""
    out = commits.select("library_id", F.col("rn").alias("pos"), "commit_id", "parent_id", "created_at")
    return out.filter(F.col("pos") <= limit) if limit else out


def as_of(commits: DataFrame, at: str) -> DataFrame:
    """The commit of each library that was the head at a time."""
    seen = commits.filter(F.col("created_at") <= F.lit(at).cast("timestamp_ntz"))
    newest = F.max_by("commit_id", F.struct("created_at", "commit_id"))
    return seen.groupBy("library_id").agg(newest.alias("commit_id"), F.max("created_at").alias("created_at"))


def versions(commits: DataFrame, entries: DataFrame, name: int) -> DataFrame:
    """Runs of one path along the chain: a row per run, naming its oldest commit.

    Absence is a value (a null id); the absent run at the oldest end is dropped.
    """
    own = entries.filter(F.col("name") == name).select("commit_id", "child_id")
    seen = commits.join(own, "commit_id", "left")
    w = Window.partitionBy("library_id").orderBy("created_at", "commit_id")
    before, first = F.lag("child_id").over(w), F.row_number().over(w) == 1
    change = F.when(first, F.col("child_id").isNotNull()).otherwise(~F.col("child_id").eqNullSafe(before))
    return seen.withColumn("starts", change).filter("starts").select(
        "library_id", "commit_id", "created_at", "child_id"
    )


def retention_cut(commits: DataFrame, cutoff: str) -> DataFrame:
    """All commits with ``doomed``: the first non-head one before the cutoff, and all behind it."""
    old = (F.col("rn") > 1) & (F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz"))
    w = Window.partitionBy("library_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return commits.withColumn("doomed", F.max(old).over(w))


def change_feed(asked: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """(library_id, state, anchor, op, name, id) of libraries asked for what changed since a commit.

    ``asked`` has library_id and since, ``commits`` those that can still be read with rn, ``files``
    (commit_id, name, child_id). The state is ``unchanged`` if nothing is newer, ``gone`` if
    the commit is unknown or cut off (the client has to start anew), else ``changes`` with a row per
    path; the anchor to ask with next is the head.
    """
    c = F.col
    head = commits.filter("rn = 1").select("library_id", c("commit_id").alias("head"))
    known = commits.select("library_id", c("commit_id").alias("since"), F.lit(True).alias("known"))
    at = asked.select("library_id", "since").join(head, "library_id").join(known, ["library_id", "since"], "left")
    state = F.when(c("since") == c("head"), "unchanged").when(c("known"), "changes").otherwise("gone")
    at = at.select("library_id", "since", "head", state.alias("state"))
    told = at.filter("state = 'changes'")
    old = told.join(files, c("since") == c("commit_id")).select("library_id", "name", c("child_id").alias("old_id"))
    new = told.join(files, c("head") == c("commit_id")).select("library_id", "name", c("child_id").alias("new_id"))
    diff = old.join(new, ["library_id", "name"], "full_outer").filter(~c("old_id").eqNullSafe(c("new_id")))
    op = F.when(c("old_id").isNull(), "create").when(c("new_id").isNull(), "delete").otherwise("modify")
    rows = diff.select("library_id", op.alias("op"), "name", c("new_id").alias("id"))
    anchor = F.when(c("state") != "gone", c("head"))
    return at.join(rows, "library_id", "left").select("library_id", "state", anchor.alias("anchor"), "op", "name", "id")


def retention_days(override, row, default):
    """Window in days: the override, else the library's row, else the default; 0 keeps all."""
    return F.coalesce(override, row, default)


def check_limit(limit: int) -> int:
    """A page's limit, or an error; never clamped."""
    if not 0 < limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of an ordered result; past the end it is empty, limit 0 takes the rest."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def encode_cursor(pinned: dict[str, str], offset: int) -> str:
    """An opaque token that pins the snapshot a listing was taken of."""
    raw = json.dumps({"v": 1, "pin": pinned, "offset": offset}, sort_keys=True).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode_cursor(token: str) -> tuple[dict[str, str], int]:
    try:
        got = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        pinned, offset, version = got["pin"], got["offset"], got["v"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if version != 1 or not isinstance(offset, int) or offset < 0:
        raise ValueError("malformed cursor")
    return pinned, offset
