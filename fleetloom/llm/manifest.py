"""A hash tree over a table: leaves by row, a tree per group, a tree over the groups, and proofs folded again.

Parents keep a copy of their hash state before each child. Folding a changed child resumes the state before its
slot and takes in the changed value and the siblings to its right only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable
from fleetloom.functions.ordered import with_global_number

ARITY = 3
# Levels of a tree that one task builds at once, of at most ARITY ** LEVELS nodes.
LEVELS = 5

PATH = "array<struct<left: string, right: string>>"
Level = list[tuple[list, list[str]]]


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 in hex of the fields one after the other: ``-`` for NULL, else the bytes in UTF-8, ``:`` and the value."""
    shown = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in fields]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in shown]), 256)


def levels_of(nodes: int) -> int:
    """Levels above so many nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def build(nodes: list[str], levels: int) -> tuple[str, list[Level]]:
    """The node on top of so many levels, and for every level its parents: states before each child, and the children."""
    made = []
    for _ in range(levels):
        parents, above = [], []
        for at in range(0, len(nodes), ARITY):
            children, state, before = nodes[at : at + ARITY], hashlib.sha256(), []
            for child in children:
                before.append(state.copy())
                state.update(child.encode())
            parents.append((before, children))
            above.append(state.hexdigest())
        made.append(parents)
        nodes = above
    return nodes[0], made


def path_of(place: int, made: list[Level]) -> list[tuple[str, str]]:
    """The siblings to the left and to the right of a node and of those above it, level by level."""
    path = []
    for parents in made:
        place, slot = divmod(place, ARITY)
        children = parents[place][1]
        path.append(("".join(children[:slot]), "".join(children[slot + 1 :])))
    return path


def fold(value: str, place: int, made: list[Level], above: list[tuple]) -> str:
    """The top that a value in a place leads to: states of parents resumed, then those of the levels above."""
    for parents in made:
        place, slot = divmod(place, ARITY)
        before, children = parents[place]
        state = before[slot].copy()
        state.update(value.encode())
        for child in children[slot + 1 :]:
            state.update(child.encode())
        value = state.hexdigest()
    for before, right in above:
        state = before.copy()
        state.update(value.encode())
        state.update(right)
        value = state.hexdigest()
    return value


def _levels_here(nodes: int) -> int:
    """Levels that a task builds over its part of a group of so many nodes."""
    return min(LEVELS, levels_of(nodes))


def _parts(nodes: DataFrame, *more: str) -> DataFrame:
    """``grp, part, n, members``: runs of at most ARITY ** LEVELS consecutive nodes of a group, in order.

    ``nodes`` has ``grp, place, n, node``: the place from 0 within the group, and the number of nodes of the group.
    """
    run = ARITY**LEVELS
    return (
        nodes.withColumn("part", F.expr(f"place div {run}"))
        .groupBy("grp", "part", "n")
        .agg(F.array_sort(F.collect_list(F.struct("place", "node", *more))).alias("members"))
    )


def _members(batch: pa.RecordBatch, row: int, *names: str) -> list[list]:
    values = batch.column("members")[row].values
    return [values.field(name).to_pylist() for name in names]


def _tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node on top of every part, as a node of the next stage."""
    for batch in batches:
        tops = []
        for row, n in enumerate(batch.column("n").to_pylist()):
            (nodes,) = _members(batch, row, "node")
            tops.append(bytes.fromhex(build([v.hex() for v in nodes], _levels_here(n))[0]))
        above = pa.array([-(-n // ARITY**LEVELS) for n in batch.column("n").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("grp"), batch.column("part"), above, pa.array(tops, pa.binary())], names=["grp", "place", "n", "node"]
        )


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every member of a part: within the part, and then that of its top."""
    for batch in batches:
        for row, n in enumerate(batch.column("n").to_pylist()):
            places, nodes = _members(batch, row, "place", "node")
            _, made = build([v.hex() for v in nodes], _levels_here(n))
            above = [(p["left"], p["right"]) for p in batch.column("path")[row].as_py()]
            found = [[{"left": a, "right": b} for a, b in [*path_of(i, made), *above]] for i in range(len(nodes))]
            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("grp")[row].as_py()] * len(nodes)), pa.array(places, pa.int64()), pa.array(found, kind)],
                names=["grp", "place", "path"],
            )


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf with the hash of its siblings and the root that its replacement, or else the leaf, leads to."""
    for batch in batches:
        for row, n in enumerate(batch.column("n").to_pylist()):
            nodes, instead = _members(batch, row, "node", "instead")
            leaves = [v.hex() for v in nodes]
            _, made = build(leaves, _levels_here(n))
            path = [(p["left"].encode(), p["right"].encode()) for p in batch.column("path")[row].as_py()]
            above = [(hashlib.sha256(left), right) for left, right in path]
            siblings = b"".join(left + right for left, right in path)
            proofs, roots = [], []
            for place, (leaf, other) in enumerate(zip(leaves, instead, strict=True)):
                proof = hashlib.sha256("".join(a + b for a, b in path_of(place, made)).encode())
                proof.update(siblings)
                proofs.append(proof.hexdigest())
                roots.append(fold(leaf if other is None else other.hex(), place, made, above))
            values = batch.column("members")[row].values
            subroot = pa.array([batch.column("subroot")[row].as_py().hex()] * len(leaves))
            yield pa.RecordBatch.from_arrays(
                [values.field("id"), pa.array(leaves), subroot, pa.array(proofs), pa.array(roots)],
                names=["id", "leaf", "subroot", "proof_sha256", "folded_root"],
            )


def _stages(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The parts of every stage, from the nodes up, and the last nodes, one a group. A stage is 243 times smaller than the one before."""
    parts = [durable(nodes)]
    while True:
        tops = durable(parts[-1].select("grp", "part", "n", "members").mapInArrow(_tops, "grp STRING, place BIGINT, n BIGINT, node BINARY"))
        if not tops.where("n > 1").limit(1).count():
            return parts, tops
        parts.append(durable(_parts(tops)))


def _down(parts: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the nodes of the first stage but one, from those of the last nodes."""
    for part in reversed(parts):
        met = part.join(paths.withColumnRenamed("place", "part"), ["grp", "part"])
        paths = durable(met.select("grp", "n", "members", "path").mapInArrow(_paths, f"grp STRING, place BIGINT, path {PATH}"))
    return paths


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    tampered: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A leaf is the hash of a row's ``fields``. The leaves of a group, by id, and then the groups, by name in bytes,
    are combined by threes until one is left. ``tampered`` gives other values for fields of the rows ``where`` it
    holds; their leaves are made again and folded to a root with the siblings of the originals. Every row is folded,
    changed or not.

    NULL fields are ``-``. The group NULL comes first, so does the id NULL; rows that share group and id go by their
    leaves, so that rows equal in all fields are interchangeable. A group of one row has its leaf as subroot, a
    table of one group its subroot as root. Without rows there is no result row. Other columns do not matter.

    Rows are dealt out by ranges of (group, id), so that a group with most of the rows is spread; a task builds five
    levels over 243 nodes at most, and a path to the root is kept for each such part, not for each row.
    """
    held = [F.col(c) for c in fields]
    changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
    instead = F.when(F.lit(False) if where is None else F.coalesce(where, F.lit(False)), F.unhex(leaf_hash(changed)))
    leaves = docs.select(
        F.col(id_col).alias("id"),
        # NULL sorts before all others, which begin with a letter.
        F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
        F.unhex(leaf_hash(held)).alias("node"),
        instead.alias("instead"),
    )
    # The random number spreads rows that are equal in all of it.
    numbered = with_global_number(leaves.withColumn("tie", F.rand(0)), ["grp", F.asc_nulls_first("id"), "node", "instead", "tie"], "number")
    groups = numbered.groupBy("grp").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = numbered.join(durable(groups), "grp").select("grp", "n", "id", "node", "instead", (F.col("number") - F.col("first")).alias("place"))
    parts, subroots = _stages(_parts(placed, "id", "instead"))
    named = with_global_number(subroots.select(F.col("grp").alias("name"), "node"), ["name"], "number")
    every = durable(named.select(F.lit("").alias("grp"), (F.col("number") - 1).alias("place"), "name", "node"))
    n = every.count()
    above, tops = _stages(_parts(every.withColumn("n", F.lit(n).cast("long"))))
    root = tops.select(F.lower(F.hex("node"))).first()
    none = F.array().cast(PATH)
    of_groups = _down(above, tops.select("grp", "place", none.alias("path")))
    named = every.join(of_groups, ["grp", "place"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("place"), "path")
    paths = _down(parts[1:], named).withColumnRenamed("place", "part")
    met = parts[0].join(paths, ["grp", "part"]).join(every.select(F.col("name").alias("grp"), F.col("node").alias("subroot")), "grp")
    folded = met.select("n", "members", "path", "subroot").mapInArrow(
        _folded, f"id {leaves.schema['id'].dataType.simpleString()}, leaf STRING, subroot STRING, proof_sha256 STRING, folded_root STRING"
    )
    at_top = F.lit(root[0] if root else None).cast("string")
    return folded.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", at_top.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == at_top).alias("verified"),
    )
