"""Answers requests for graphs and changed targets from stored results, building what is missing; requests can be cancelled."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from targetry.functions import keys
from targetry.functions.requests import BuildDescription, check_pair
from targetry.operators import diff
from targetry.sources import graphs, stored
from targetry.sources.tables import read_text, write_text


class Cancelled(RuntimeError):
    """The request was cancelled."""


class Engine:
    """build: the hashed graph (name, hash, ...) of a description, without the excluded targets' hashes. tree: the content
    hash of the tree that a description leads to, which is quick to find.

    Results are stored under content keys in base. A description's tree is written down before its graph is built, so that
    one that leads to a known tree is answered from that tree's graph; two trees name the diff between them.
    """

    def __init__(self, spark: SparkSession, base: str, build: Callable[[BuildDescription, tuple[str, ...]], DataFrame], tree: Callable[[BuildDescription], str], repo: str = "repo"):
        self.spark, self.base, self.build, self.tree, self.repo = spark, base, build, tree, repo
        self._cancelled: set[str] = set()
        self._own = threading.local()

    # --- requests ---

    @contextmanager
    def request(self, name: str) -> Iterator[None]:
        """What the thread asks for inside belongs to a request, which cancel() stops."""
        tag = self._tag(name)
        context = self.spark.sparkContext  # tags of a session are its thread's own, those of the context all threads'
        context.addJobTag(tag)
        self._own.request = name
        try:
            self._check()
            yield
        except Exception as e:
            if name in self._cancelled and not isinstance(e, Cancelled):
                raise Cancelled(name) from e
            raise
        finally:
            context.removeJobTag(tag)
            self._own.request = None

    def cancel(self, name: str) -> None:
        """Stops a request's running jobs and begins no others; from any thread."""
        self._cancelled.add(name)
        self.spark.sparkContext.cancelJobsWithTag(self._tag(name))

    def _tag(self, name: str) -> str:
        return f"targetry-{self.repo}-{name}".replace(",", "_")

    def _check(self) -> None:
        name = getattr(self._own, "request", None)
        if name in self._cancelled:
            raise Cancelled(name)

    # --- keys ---

    def _key(self, *made: tuple[str, object]) -> list[str]:
        return list(self.spark.range(1).select(*[c.alias(k) for k, c in made]).first())

    def _names(self, values: tuple[str, ...]) -> object:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    def tree_of(self, description: BuildDescription) -> str:
        """The description's tree, as written down before or found now."""
        (key,) = self._key(("k", keys.treehash_key(F.lit(self.repo), F.lit(description.base_sha), keys.request_hash(self._names(description.requests)))))
        known = read_text(self.spark, f"{self.base}/{key}")
        if known:
            return known
        self._check()
        tree = self.tree(description)
        write_text(self.spark, f"{self.base}/{key}", tree)
        return tree

    # --- answers ---

    def graph(self, description: BuildDescription, excluded: tuple[str, ...] = (), like: graphs.Graph | None = None) -> graphs.Graph:
        """The description's graph. Built and stored if its tree has none."""
        (key,) = self._key(("k", keys.graph_key(F.lit(self.repo), F.lit(self.tree_of(description)), F.lit(description.strategy), keys.exclusion_hash(self._names(excluded)))))
        found = graphs.get(self.spark, self.base, key)
        if found is None:
            self._check()
            targets = self.build(description, excluded)
            self._check()
            found = graphs.put(targets, self.base, key, like)
        self._check()
        return found

    def changed(self, before: BuildDescription, after: BuildDescription, max_distance: int = -1, excluded: tuple[str, ...] = ()) -> DataFrame:
        """name, change_type, before, after, is_seed, distance. The whole diff is stored under both trees; one that can't be
        read to its end is computed again."""
        check_pair(before, after)
        trees = [self.tree_of(before), self.tree_of(after)]
        (key,) = self._key(("k", keys.diff_key(F.lit(self.repo), F.lit(trees[0]), F.lit(trees[1]), keys.exclusion_hash(self._names(excluded)))))
        found = stored.whole(self.spark, self.base, key)
        if found is None:
            old = self.graph(before, excluded)
            new = self.graph(after, excluded, like=old)
            made = diff.diff(old, new)
            self._check()
            stored.put(made, self.base, key)
            found = stored.whole(self.spark, self.base, key)
            if found is None:
                raise OSError(f"{self.base}/{key} can't be read after it was written")
        self._check()
        return diff.within(found, max_distance)
