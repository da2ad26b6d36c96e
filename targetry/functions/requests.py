"""What a request has to look like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a change's address, and the strategies.
CHANGE_URI = r"^github://([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?(?::[0-9]+)?)/((?:[^/?#]+/)*[^/?#]+)/([^/?#]+)/pull/([1-9][0-9]*)/([0-9a-f]{40})$"
STRATEGIES = ("UNSET", "NATIVE", "SHELL")


def change(uri: Column) -> Column:
    """struct(host, org, repo, number, head_sha) of a change's address; null if it isn't in its one canonical form."""
    names = ("host", "org", "repo", "number", "head_sha")
    return F.when(uri.rlike(CHANGE_URI), F.struct(*[F.regexp_extract(uri, CHANGE_URI, i + 1).alias(n) for i, n in enumerate(names)]))


@dataclass(frozen=True)
class BuildDescription:
    remote: str
    base_sha: str
    requests: tuple[str, ...] = ()
    strategy: str = "UNSET"

    def __post_init__(self) -> None:
        if not self.remote:
            raise ValueError("remote is required")
        if not self.base_sha:
            raise ValueError("base_sha is required")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")


def check_pair(before: BuildDescription, after: BuildDescription) -> None:
    """Two revisions that are compared are of one repository."""
    if before.remote != after.remote:
        raise ValueError("both revisions need the same remote")


def resolve_repository(remote: str, repositories: dict[str, dict]) -> dict:
    """The configuration of a repository by its exact remote."""
    if remote not in repositories:
        raise ValueError(f"unknown repository {remote}")
    return repositories[remote]
