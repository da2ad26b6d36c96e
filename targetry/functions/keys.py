"""Content keys of stored results and of snapshots."""

from __future__ import annotations

from datetime import UTC, datetime
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed_md5(values: Column) -> Column:
    """md5 over `bytes:value` frames in order; empty for an empty or null array."""
    frames = F.array_join(F.transform(values, lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)), "")
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.md5(frames)).otherwise(F.lit(""))


def request_hash(urls: Column) -> Column:
    """Order counts."""
    return framed_md5(urls)


def exclusion_hash(patterns: Column) -> Column:
    """Order does not count."""
    return framed_md5(F.array_sort(patterns))


# Fixed values in the keys below: how they begin and what their parts are called.
def _suffix(hash_: Column, name: str) -> Column:
    return F.when(hash_ == "", F.lit("")).otherwise(F.concat(F.lit(name), hash_))


def graph_key(repo: Column, treehash: Column, strategy: Column, exclusion: Column) -> Column:
    return F.concat(repo, F.lit("/graphs/"), treehash, F.lit("/"), strategy, F.lit("-tgb"), _suffix(exclusion, "_requests-options-"))


def treehash_key(repo: Column, base_sha: Column, requests: Column) -> Column:
    return F.concat(repo, F.lit("/treehashes/base-sha-"), base_sha, _suffix(requests, "_request-urls-"))


def diff_key(repo: Column, before: Column, after: Column, exclusion: Column) -> Column:
    return F.concat(repo, F.lit("/compared-targets/"), before, F.lit("_"), after, _suffix(exclusion, "_requests-options-"))


def snapshot_key(remote: str, commit_ts: int, sha: str) -> str:
    """Snapshots of a remote by UTC day."""
    return f"itg/{quote(remote, safe='$&+=:@')}/{datetime.fromtimestamp(commit_ts, UTC):%Y-%m-%d}/{commit_ts}_{sha}"


def parse_snapshot_key(key: str) -> tuple[str, int, str]:
    parts = key.split("/")
    if len(parts) != 4 or parts[0] != "itg" or "_" not in parts[3]:
        raise ValueError(f"not a snapshot key: {key}")
    ts, _, sha = parts[3].partition("_")
    return unquote(parts[1]), int(ts), sha
