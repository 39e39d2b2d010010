"""Deeply nested semi-structured records as flat tables (problem 6).

The texts of an Arrow batch are read as one buffer (json_buffers): kernels over the buffer give all
values of all texts as flat arrays, with the values inside each as Arrow lists.  From there a level
of objects is a column of value numbers.  Its children come from the offsets of those lists
(list_flatten), are numbered back to their parents (list_parent_indices), and take the parents' keys
and ids by vectorised take.  No text is parsed by itself and no object is looped over; only fields
that are neither texts nor whole numbers, and texts with escapes, are decoded.

Cases: null text, text that is no JSON (cut-off text included) and JSON scalars yield nothing.
JSON text inside JSON counts as what it holds, up to 16 layers.  A wrapper around the list, a single
object instead of a list, and an object whose keys are the ids of its values are read alike.  Of
equal names in one object the last counts.  Objects without id stand in the tables of classes and
methods; their children link to the nearest object around them that has one.  Equal rows come out
once.  Clashing or extra columns of the input are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .json_buffers import LIST, OBJECT, STRING, Forest

#: Fields of a class or method object, and those that hold further objects.
NESTS = ("classes", "methods")
SCALARS = ("id", "name", "startLine", "endLine", "code", "description")
OBJECT_FIELDS = ("name", "start_line", "end_line", "code", "description")
PLACE = ("file", "line_start", "line_end", "column_start", "column_end")
OBJECTS = "file_id bigint, object_key string, parent_key string, id string, parent_id string, kind string, " + ", ".join(f"{c} string" for c in OBJECT_FIELDS)
LOCATIONS = "ord bigint, location_key string, node_id string, " + ", ".join(f"{c} string" for c in PLACE)


def _id_text(value) -> str | None:
    """A number as an id."""
    return None if value is None or isinstance(value, (bool, dict, list)) else str(value)


def _plain_text(value) -> str | None:
    """A value that is no string as text; whole numbers without a point."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return None if value is None else json.dumps(value, ensure_ascii=False)


def _line_text(value) -> str | None:
    return _id_text(int(value) if isinstance(value, float) and value.is_integer() else value)


def _not_blank(texts):
    """Texts without the blank ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.if_else(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0), pa.scalar(None, pa.string()), texts)


class _Members:
    """Class and method objects of a forest, level by level."""

    def __init__(self, forest):
        import numpy as np

        self.f = forest
        self.nests = [forest.field(k) for k in NESTS]
        self.scalars = {k: forest.field(k) for k in SCALARS}
        n = len(forest.kind)
        self.told = np.zeros(n, bool)  # objects with a field of their own
        for rows in self.scalars.values():
            self.told |= (rows >= 0) & (forest.kind[np.maximum(rows, 0)] >= STRING) if n else False
        self.nested = (self.nests[0] >= 0) | (self.nests[1] >= 0)

    def directly_in(self, tok, kind, owner):
        """(value, named, kind, owner) of each object directly in the values, in order: lists, wrappers and
        maps from ids are opened.  named: the value whose key in a map is the object's id, or -1."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        f = self.f
        named = np.full(len(tok), -1)
        while len(tok):
            tok = f.opened[tok]
            k = f.kind[tok]
            is_object = k == OBJECT
            member = is_object & (self.told[tok] | (self.nested[tok] & (named >= 0)))
            wrapper = is_object & ~member & self.nested[tok]
            mapping = is_object & ~member & ~wrapper
            spread = (k == LIST) | mapping
            if member.all():
                break
            # the children of lists and maps by the offsets of their lists, with their parents' places
            rows = np.flatnonzero(spread)
            lists = f.children.take(pa.array(tok[rows]))
            kids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            of = rows[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
            parts = [(kids, np.where(mapping[of], kids, -1), kind[of], of, np.arange(len(kids)))]
            rows = np.flatnonzero(member)
            parts.append((tok[rows], named[rows], kind[rows], rows, np.zeros(len(rows), np.int64)))
            for i, nest in enumerate(self.nests):
                rows = np.flatnonzero(wrapper & (nest[tok] >= 0))
                parts.append((nest[tok[rows]], np.full(len(rows), -1), np.full(len(rows), i), rows, np.full(len(rows), i)))
            new, names, kinds, of, nth = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((nth, of))
            tok, named, kind, owner = new[order], names[order], kinds[order], owner[of[order]]
        return tok, named, kind, owner

    def ids(self, tok, named):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = _not_blank(self.f.texts(self.scalars["id"][tok], _id_text, lambda x: None))
        return pc.coalesce(own, self.f.keys.take(pa.array(np.maximum(named, 0), mask=named < 0)))

    def below(self, tok):
        """(value, kind, place of the object) of what the objects hold, classes before methods."""
        import numpy as np

        each = np.stack([nest[tok] for nest in self.nests], axis=1)
        at = np.flatnonzero(each.ravel() >= 0)
        return each.ravel()[at], at % 2, at // 2


def _object_batches(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["file_id", "object_key", "parent_key", "id", "parent_id", "kind", *OBJECT_FIELDS]
    for batch in batches:
        roots = batch.column(0)
        forest = Forest([(t or "").encode() for t in batch.column(1).to_pylist()])
        text = np.flatnonzero((forest.roots >= 0) & roots.is_valid().to_numpy(zero_copy_only=False))
        if not len(text):
            continue
        m = _Members(forest)
        root_text = roots.cast(pa.string())
        # the first level lies in the texts themselves
        tok, named, kind, owner = m.directly_in(forest.roots[text], np.zeros(len(text), np.int64), text)
        keys, around, nearest, root = root_text, pa.nulls(len(root_text), pa.string()), root_text, np.arange(len(root_text))
        while len(tok):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            up = pa.array(owner)
            own = m.ids(tok, named)
            key = pc.binary_join_element_wise(keys.take(up), pa.array(nth).cast(pa.string()), "/")
            fields = [forest.texts(m.scalars[k][tok], _plain_text, lambda x: json.dumps(x, ensure_ascii=False)) for k in ("name", "startLine", "endLine", "code", "description")]
            outer = nearest.take(up)
            yield pa.RecordBatch.from_arrays([roots.take(pa.array(root[owner])), key, around.take(up), own, outer, pa.array(np.array(NESTS)[kind]), *fields], names)
            below, kinds, of = m.below(tok)
            keys, around, nearest, root = key, key, pc.coalesce(own, outer), root[owner]
            tok, named, kind, owner = m.directly_in(below, kinds, of)


def _location_batches(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["ord", "location_key", "node_id", *PLACE]
    for batch in batches:
        forest = Forest([(t or "").encode() for t in batch.column(2).to_pylist()])
        owner = np.flatnonzero(forest.roots >= 0)
        at = forest.field("location")
        top = forest.opened[forest.roots[owner]]
        held = np.flatnonzero((forest.kind[top] == OBJECT) & (at[top] >= 0)) if len(top) else top
        tok, owner = at[top[held]], owner[held]
        while len(tok):
            tok = forest.opened[tok]
            is_list = forest.kind[tok] == LIST
            if not is_list.any():
                break
            rows = np.flatnonzero(is_list)
            lists = forest.children.take(pa.array(tok[rows]))
            of = rows[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]
            rest = np.flatnonzero(~is_list)
            new, up = np.concatenate([pc.list_flatten(lists).to_numpy(zero_copy_only=False), tok[rest]]), np.concatenate([of, rest])
            order = np.argsort(up, kind="stable")
            tok, owner = new[order], owner[up[order]]
        if not len(tok):
            continue
        fields = {k: np.where(forest.kind[tok] == OBJECT, forest.field(k)[tok], -1) for k in PLACE}
        there = np.zeros(len(tok), bool)
        for rows in fields.values():
            there |= forest.texts(rows, _plain_text, json.dumps).is_valid().to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(there)
        if not len(keep):
            continue
        owner = owner[keep]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        nth = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        columns = []
        for k in PLACE:
            rows = fields[k][keep]
            if k == "file":
                columns.append(forest.texts(rows, _plain_text, lambda x: json.dumps(x, ensure_ascii=False)))
            else:
                columns.append(pc.utf8_trim_whitespace(_not_blank(forest.texts(rows, _line_text, lambda x: None))))
        up = pa.array(owner)
        ords = batch.column(0).take(up)
        key = pc.binary_join_element_wise(ords.cast(pa.string()), pa.array(nth).cast(pa.string()), "/")
        yield pa.RecordBatch.from_arrays([ords, key, batch.column(1).take(up), *columns], names)


def objects(files: DataFrame) -> DataFrame:
    """Every class and method object of hier_files.classes with all its fields.

    object_key is its own key, parent_key that of the object around it (null at the top); parent_id is
    the id of the nearest object around it that has one, else file_id as text.
    """
    return files.where(F.col("classes").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "classes").mapInArrow(_object_batches, OBJECTS)


def classes(files: DataFrame) -> DataFrame:
    """(file_id, object_key, parent_key, id, parent_id, name, start_line, end_line, code, description) of classes."""
    return objects(files).where("kind = 'classes'").drop("kind").distinct()


def methods(files: DataFrame) -> DataFrame:
    """The same of methods."""
    return objects(files).where("kind = 'methods'").drop("kind").distinct()


def locations(nodes: DataFrame) -> DataFrame:
    """(ord, location_key, node_id, file, line_start, line_end, column_start, column_end) of the locations in nodes.metadata."""
    n = nodes.where(F.col("metadata").isNotNull()).select(F.col("ord").cast("bigint").alias("ord"), F.col("id").cast("string").alias("id"), "metadata")
    return n.mapInArrow(_location_batches, LOCATIONS).distinct()


def class_links(files: DataFrame) -> DataFrame:
    """Class and method objects with an id, with the nearest object around each."""
    o = objects(files).where("id IS NOT NULL")
    return o.select(F.lit("hier_files").alias("root_table"), F.col("file_id").cast("string").alias("root_id"), "parent_id", F.col("id").alias("child_id")).distinct()


def location_links(nodes: DataFrame) -> DataFrame:
    """Locations with both lines."""
    both = locations(nodes).where("line_start IS NOT NULL AND line_end IS NOT NULL")
    child = F.concat_ws("-", "line_start", "line_end")
    return both.select(F.lit("nodes").alias("root_table"), F.col("ord").cast("string").alias("root_id"), F.col("node_id").alias("parent_id"), child.alias("child_id")).distinct()


def flat_links(files: DataFrame, nodes: DataFrame) -> DataFrame:
    return class_links(files).unionByName(location_links(nodes))
