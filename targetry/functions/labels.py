"""Labels, packages, repositories and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_part(label: Column) -> Column:
    """What stands before the last `:`; empty without one."""
    return F.coalesce(F.regexp_extract(label, r"(?s)^(.*):[^:]*$", 1), F.lit(""))


def name_part(label: Column) -> Column:
    """What stands after the last `:`; the whole label without one."""
    return F.regexp_extract(label, r"(?s)([^:]*)$", 1)


def join_label(package: Column, name: Column) -> Column:
    return F.when(package == "", name).otherwise(F.concat(package, F.lit(":"), name))


def package_of(label: Column) -> Column:
    """Package path: before the first `:`, without leading `//`."""
    return F.regexp_replace(F.substring_index(label, ":", 1), "^//", "")


def canonical_repo(label: Column) -> Column:
    """`name` of `@@name//...`, else empty."""
    return F.regexp_extract(label, r"^@@([^/]+)//", 1)


def apparent_repo(label: Column) -> Column:
    """`name` of `@name//...` with one `@`, else empty."""
    return F.regexp_extract(label, r"^@([^@/]+)//", 1)


def is_external(label: Column) -> Column:
    return F.startswith(label, F.lit("@"))


def external_rule(label: Column) -> Column:
    """The `//external:` rule that a label of another repository belongs to."""
    return F.concat(F.lit("//external:"), F.regexp_replace(F.substring_index(label, "//", 1), "^@+", ""))


def path_label(path: Column) -> Column:
    """`a/b/c` as `//a/b:c`; a path of one part as `//:c`."""
    return F.concat(F.lit("//"), F.regexp_replace(path, r"(?s)^(?:(.*)/)?([^/]*)$", "$1:$2"))


def wildcard_label(package: Column) -> Column:
    """All targets of a package; `.` and the empty package are the root."""
    return F.when(package.isin("", "."), F.lit("//:*")).otherwise(F.concat(F.lit("//"), package, F.lit(":*")))


def doubled_package(label: Column) -> Column:
    """Whether the target's name repeats its package path before a slash."""
    package = package_of(label)
    return (package != "") & F.startswith(name_part(label), F.concat(package, F.lit("/")))


def can_be_root(rule_type: Column) -> Column:
    return ~F.coalesce(rule_type, F.lit("")).isin("source file", "package group")


def short_remote(remote: Column) -> Column:
    """After the last `:`."""
    return F.substring_index(remote, ":", -1)


def containing_packages(path: Column) -> Column:
    """The directories above a path, nearest first, the root last."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array(F.lit("")))
