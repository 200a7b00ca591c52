"""Hierarchies as tables: objects, links and attributes, and the operations on their paths.

Links form a graph: an object may have several parents. Paths are resolved by joins, one a level for all paths at once;
reverse paths by a breadth-first expansion. The tables may be of any size; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import GridError, LinkError

OBJECTS = "obj bigint, kind string, comment string, mtime bigint, reason string"
LINKS = "parent bigint, name string, type string, child bigint, target_path string, target_file string, creation_order bigint"
ATTRS = "obj bigint, name string, dtype string, dims array<bigint>, value string, creation_order bigint"
#: Indirections (soft and external links) that one path may take, and levels that an expansion goes down.
MAX_INDIRECTIONS, MAX_DEPTH = 32, 64


def parts(path: str) -> list[str]:
    """Names of a path; empty ones and '.' are skipped, '..' is a name like any other."""
    return [p for p in path.split("/") if p not in ("", ".")]


@dataclass(frozen=True)
class Catalog:
    objects: DataFrame
    links: DataFrame
    attrs: DataFrame
    root: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(spark.createDataFrame([(0, "group", None, None, None)], OBJECTS), spark.createDataFrame([], LINKS), spark.createDataFrame([], ATTRS))

    # Looking

    def members(self, group: int, order: str = "name", descending: bool = False, limit: int | None = None) -> DataFrame:
        """Links of a group in order of name or creation."""
        key = F.col({"name": "name", "creation": "creation_order"}[order])
        df = self.links.where(F.col("parent") == group).orderBy(key.desc() if descending else key.asc())
        return df if limit is None else df.limit(limit)

    def length(self, group: int) -> int:
        return self.links.where(F.col("parent") == group).count()

    def of_kind(self, group: int, kind: str) -> DataFrame:
        """Objects of a kind that hard links of a group name, by name; not recursive."""
        hard = self.links.where((F.col("parent") == group) & (F.col("type") == "hard"))
        return hard.join(self.objects.where(F.col("kind") == kind), F.col("child") == F.col("obj")).select("name", "obj").orderBy("name")

    def resolve(self, path: str, start: int | None = None, follow: bool = True) -> int:
        """The object at one path. Soft targets resolve from the root."""
        at, todo, taken = self.root if path.startswith("/") or start is None else start, parts(path), 0
        while todo:
            name, todo = todo[0], todo[1:]
            row = self.links.where((F.col("parent") == at) & (F.col("name") == name)).first()
            if row is None:
                raise LinkError(f"no {name!r} in {path!r}")
            if row["type"] == "hard":
                at = row["child"]
            elif row["type"] == "soft" and follow:
                taken += 1
                if taken > MAX_INDIRECTIONS:
                    raise LinkError(f"too many links in {path!r}")
                at, todo = self.root, parts(row["target_path"]) + todo
            else:
                raise LinkError(f"{name!r} in {path!r} leads to {row['target_file']}")
        return at

    def resolve_all(self, paths: DataFrame, column: str = "path", depth: int = 8) -> DataFrame:
        """(path, obj) for many paths at once: one join a level, hard links; paths that lead nowhere have null."""
        names = F.filter(F.split(column, "/"), lambda p: (p != "") & (p != "."))
        df = paths.select(F.col(column), names.alias("names_"), F.lit(self.root).cast("bigint").alias("obj"))
        hard = self.links.where("type = 'hard'").select(F.col("parent").alias("l_parent"), F.col("name").alias("l_name"), "child")
        for k in range(depth):
            name = F.get("names_", F.lit(k))
            df = df.join(hard, (F.col("obj") == F.col("l_parent")) & (name == F.col("l_name")), "left")
            df = df.select(column, "names_", F.when(F.size("names_") > k, F.col("child")).otherwise(F.col("obj")).alias("obj"))
        return df.select(column, F.when(F.size("names_") <= depth, F.col("obj")).alias("obj"))

    def exists(self, path: str, start: int | None = None) -> bool:
        """Whether the link is there; true for a soft link that leads nowhere."""
        *head, last = parts(path) or [""]
        try:
            at = self.resolve("/".join(head), self.root if path.startswith("/") or start is None else start) if head else (self.root if path.startswith("/") or start is None else start)
        except LinkError:
            return False
        return bool(last == "" or self.links.where((F.col("parent") == at) & (F.col("name") == last)).limit(1).count())

    def paths(self, max_depth: int = MAX_DEPTH) -> DataFrame:
        """(obj, path): for each object its first path, breadth first, names in order."""
        hard = self.links.where("type = 'hard'").select("parent", "name", "child")
        level = self.objects.where(F.col("obj") == self.root).select("obj", F.lit("/").alias("path"))
        found = [level]
        for _ in range(max_depth):
            below = level.withColumnRenamed("path", "up").join(hard, F.col("obj") == F.col("parent"))
            path = F.concat(F.when(F.col("up") == "/", "/").otherwise(F.concat("up", F.lit("/"))), "name")
            below = below.groupBy(F.col("child").alias("obj")).agg(F.min(path).alias("path"))
            seen = reduce(DataFrame.unionByName, found).select("obj")
            level = below.join(seen, "obj", "left_anti").checkpoint() if self._checkpoints() else below.join(seen, "obj", "left_anti")
            if level.isEmpty():
                break
            found.append(level)
        return reduce(DataFrame.unionByName, found)

    def _checkpoints(self) -> bool:
        return self.links.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()

    def link_counts(self) -> DataFrame:
        """(obj, links): hard links to each object, and one more to the root."""
        n = self.links.where("type = 'hard'").groupBy(F.col("child").alias("obj")).agg(F.count("*").alias("n"))
        own = F.when(F.col("obj") == self.root, 1).otherwise(0)
        return self.objects.join(n, "obj", "left").select("obj", (F.coalesce("n", F.lit(0)) + own).cast("bigint").alias("links"))

    def info(self) -> DataFrame:
        """Kind, link count, attribute count and times of every object; the token is the object's number."""
        n = self.attrs.groupBy("obj").agg(F.count("*").alias("n_attrs"))
        out = self.objects.join(self.link_counts(), "obj").join(n, "obj", "left")
        return out.select(F.col("obj").alias("token"), "kind", "links", F.coalesce("n_attrs", F.lit(0)).alias("n_attrs"), "comment", *[F.col("mtime").alias(t) for t in ("atime", "mtime", "ctime", "btime")])

    def attr_names(self, obj: int) -> DataFrame:
        return self.attrs.where(F.col("obj") == obj).orderBy("creation_order").select("name")

    # Changing: each gives another catalog

    def _next(self, df: DataFrame, column: str) -> int:
        top = df.agg(F.max(column)).first()[0]
        return 0 if top is None else top + 1

    def _link(self, parent: int, name: str, type: str, child: int | None = None, path: str | None = None, file: str | None = None) -> Catalog:
        if self.links.where((F.col("parent") == parent) & (F.col("name") == name)).limit(1).count():
            raise LinkError(f"{name!r} exists")
        spark = self.links.sparkSession
        row = spark.createDataFrame([(parent, name, type, child, path, file, self._next(self.links, "creation_order"))], LINKS)
        return replace(self, links=self.links.unionByName(row))

    def _place(self, path: str, start: int | None) -> tuple[int, str]:
        names = parts(path)
        if not names:
            raise LinkError("an empty name")
        at = self.root if path.startswith("/") or start is None else start
        return (self.resolve("/".join(names[:-1]), at) if names[:-1] else at), names[-1]

    def add_object(self, path: str, kind: str = "group", start: int | None = None, mtime: int | None = None) -> tuple[Catalog, int]:
        """An object at a path; groups on the way are made."""
        out, at, names = self, self.root if path.startswith("/") or start is None else start, parts(path)
        for k, name in enumerate(names):
            last = k == len(names) - 1
            row = out.links.where((F.col("parent") == at) & (F.col("name") == name)).first()
            if row is not None and not last:
                if row["type"] != "hard" or out.objects.where((F.col("obj") == row["child"]) & (F.col("kind") == "group")).isEmpty():
                    raise LinkError(f"{name!r} is no group")
                at = row["child"]
                continue
            if row is not None:
                raise LinkError(f"{name!r} exists")
            obj = out._next(out.objects, "obj")
            new = self.objects.sparkSession.createDataFrame([(obj, kind if last else "group", None, mtime, None)], OBJECTS)
            out = replace(out, objects=out.objects.unionByName(new))._link(at, name, "hard", obj)
            at = obj
        return out, at

    def link_hard(self, target: str, path: str, start: int | None = None) -> Catalog:
        parent, name = self._place(path, start)
        return self._link(parent, name, "hard", self.resolve(target, start))

    def link_soft(self, target: str, path: str, start: int | None = None) -> Catalog:
        parent, name = self._place(path, start)
        return self._link(parent, name, "soft", path=target)

    def link_external(self, file: str, target: str, path: str, start: int | None = None) -> Catalog:
        parent, name = self._place(path, start)
        return self._link(parent, name, "external", path=target, file=file)

    def unlink(self, name: str, group: int | None = None) -> Catalog:
        group = self.root if group is None else group
        this = (F.col("parent") == group) & (F.col("name") == name)
        if self.links.where(this).isEmpty():
            raise LinkError(f"no {name!r}")
        return replace(self, links=self.links.where(~this))

    def relink(self, name: str, path: str, group: int | None = None) -> Catalog:
        """Moves a link. The new place is checked first, so the link cannot be lost."""
        group = self.root if group is None else group
        row = self.links.where((F.col("parent") == group) & (F.col("name") == name)).first()
        if row is None:
            raise LinkError(f"no {name!r}")
        parent, new = self._place(path, group)
        return self.unlink(name, group)._link(parent, new, row["type"], row["child"], row["target_path"], row["target_file"])

    def set_comment(self, obj: int, comment: str | None) -> Catalog:
        c = F.when(F.col("obj") == obj, F.lit(comment).cast("string")).otherwise(F.col("comment"))
        return replace(self, objects=self.objects.withColumn("comment", c))

    def set_attr(self, obj: int, name: str, dtype: str, dims: list[int], value: str) -> Catalog:
        if not self.attrs.where((F.col("obj") == obj) & (F.col("name") == name)).isEmpty():
            raise GridError(f"attribute {name!r} exists")
        row = self.attrs.sparkSession.createDataFrame([(obj, name, dtype, dims, value, self._next(self.attrs, "creation_order"))], ATTRS)
        return replace(self, attrs=self.attrs.unionByName(row))
