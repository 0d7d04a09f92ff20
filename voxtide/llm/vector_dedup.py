"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

The library has no embeddings of its own, so this operator is general: a vector has an id and components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from voxtide.llm.components import connected
from voxtide.session import cut_lineage

# Vectors of a bucket that one task compares; larger buckets are compared in pairs of parts of about half of this.
BUCKET_ROWS = 2_048


def projections(dimension: int, tables: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions and uniform shifts of all tables' hash functions, the same in every task."""
    random = np.random.default_rng([seed, dimension])
    return random.standard_normal((dimension, tables * width)), random.random(tables * width)


def bucket_keys(vectors: np.ndarray, tables: int, width: int, cell: float, seed: int) -> np.ndarray:
    """Bucket of each unit vector in each table: ``width`` quantised projections, mixed into 32 bits."""
    directions, shifts = projections(vectors.shape[1], tables, width, seed)
    steps = np.floor(vectors @ directions / cell + shifts).astype(np.int64).reshape(len(vectors), tables, width)
    odd = np.random.default_rng([seed, 1]).integers(1, 1 << 62, size=(tables, width), dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        mixed = (steps * odd).sum(axis=2)
        return (mixed ^ (mixed >> 29)) & 0xFFFFFFFF


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    # Scaled first, so that neither very large nor very small components are lost in their squares.
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def linked_in_bucket(
    table: int, nodes: np.ndarray, copies: np.ndarray, keys: np.ndarray, vectors: np.ndarray, parts: np.ndarray | None, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links in one bucket, the links that no earlier table has, and the smallest node linked to each.

    With ``parts`` only pairs from different parts count.
    """
    near = np.triu(vectors @ vectors.T >= least, 1)
    if parts is not None:
        near &= parts[:, None] != parts[None, :]
    a, b = np.nonzero(near)
    first = (keys[a, :table] != keys[b, :table]).all(axis=1)
    links = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(links, a[first], copies[b[first]])
    np.add.at(links, b[first], copies[a[first]])
    root = nodes.copy()
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    met = np.zeros(len(nodes), dtype=bool)
    met[a] = met[b] = True
    return nodes[met], links[met], root[met]


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def bucket_links(
    nodes: DataFrame, kind: str, least: float, tables: int, width: int, cell: float, seed: int, bucket_rows: int
) -> DataFrame:
    """``node, copies, embedding`` to ``node, links, root`` rows, one for each bucket in which the node has links."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat, edges = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
            raw = [flat[i:j].tobytes() for i, j in zip(edges, edges[1:])]
            keys = np.empty((len(raw), tables), dtype=np.int64)
            sizes = np.diff(edges)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keys[at] = bucket_keys(_unit([raw[i] for i in at], kind), tables, width, cell, seed)
            short = keys.astype("<u4")
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(raw), pa.int32()), pa.array(keys[:, t]), pa.array(sizes, pa.int32()), batch.column("node"), batch.column("copies"), pa.array(raw, pa.binary()), pa.array([k.tobytes() for k in short], pa.binary())],
                    ["t", "v", "size", "node", "copies", "raw", "keys"],
                )

    rows = nodes.mapInArrow(hashed, "t int, v bigint, size int, node bigint, copies bigint, raw binary, keys binary")
    large = rows.groupBy("t", "v", "size").count().filter(F.col("count") > bucket_rows)
    large = cut_lineage(large.withColumn("n", F.ceil(2 * F.col("count") / bucket_rows).cast("int")).drop("count"))
    if large.isEmpty():
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "part": F.lit(0)})
    else:
        # Part p meets every part q once, itself included: in group (min, max).
        rows = rows.join(large, ["t", "v", "size"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        rows = rows.withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")}).drop("q", "n")
    group = ["t", "v", "size", "i", "j"]
    dealt = rows.select(*group, "part", "node", "copies", "raw", "keys").repartition(*group).sortWithinPartitions(*group)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(table: pa.Table) -> pa.RecordBatch:
            marks = [table.column(c).to_numpy() for c in group]
            change = np.zeros(table.num_rows, dtype=bool)
            change[0] = True
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], table.num_rows)
            raw, short = table.column("raw").to_pylist(), table.column("keys").to_pylist()
            node, copies, part = (table.column(c).to_numpy() for c in ("node", "copies", "part"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, ends):
                if e - s > 1:
                    unit = _unit(raw[s:e], kind)
                    keys = np.frombuffer(b"".join(short[s:e]), "<u4").reshape(e - s, tables)
                    apart = part[s:e] if marks[3][s] != marks[4][s] else None
                    out.append(linked_in_bucket(int(marks[0][s]), node[s:e], copies[s:e], keys, unit, apart, least))
            merged = [np.concatenate(x) for x in zip(*out)] or [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged], ["node", "links", "root"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            # The last group may go on in the next batch.
            last, at = [table.column(c)[-1].as_py() for c in group], table.num_rows
            same = np.ones(table.num_rows, dtype=bool)
            for c, value in zip(group, last):
                same &= table.column(c).to_numpy() == value
            at = int(np.argmax(same))
            if at:
                yield found(table.slice(0, at))
            held = table.slice(at).combine_chunks()
        if held is not None and held.num_rows:
            yield found(held)

    return dealt.mapInArrow(compared, "node bigint, links bigint, root bigint")


def near_vectors(
    vectors: DataFrame,
    least_cosine: float = 0.9,
    tables: int = 20,
    width: int = 8,
    cell: float = 1.6,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Links between vectors with a cosine of at least ``least_cosine``: ``vec_id, embedding`` to ``vec_id, n_links,
    component_id, kept``.

    Equal vectors are one node, linked to its copies. Nodes fall into one bucket of each of ``tables`` tables by
    ``width`` projections on normal directions, shifted and cut into cells of ``cell``; what shares a bucket
    is compared exactly, in double precision. A link found in several tables counts in the first. Buckets send
    on counts and one link per node, never pairs, and large ones are compared in parts by several tasks. Some pairs
    share no bucket: expected at a cosine of 0.9 are 6 %, at 0.95 0.3 %. ``width`` should grow with the
    logarithm of the number of vectors, and ``tables`` with it.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest ``vec_id`` reachable, ``kept``
    says whether it is the row's own. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, and so do rows without ``vec_id`` (their component is null, they are not kept). Vectors of different
    length are never linked. Rows that share a ``vec_id`` are vectors of their own. Further columns are ignored.
    """
    element = FloatType() if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else DoubleType()
    kind = "<f4" if element == FloatType() else "<f8"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(ArrayType(element)).alias("embedding"))
    usable = F.col("vec_id").isNotNull() & _finite(F.col("embedding"))
    # 128 bits that stand for the vector; none for rows that link with nothing.
    rows = rows.withColumn("v1", F.when(usable, F.xxhash64("embedding"))).withColumn("v2", F.when(usable, F.xxhash64(F.lit(1), "embedding")))
    same = rows.filter("v1 IS NOT NULL").groupBy("v1", "v2").agg(
        F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )
    # Numbered once: the checkpoint keeps the numbers.
    nodes = cut_lineage(same.withColumn("node", F.monotonically_increasing_id()))
    found = cut_lineage(
        bucket_links(nodes.select("node", "copies", "embedding"), kind, least_cosine, tables, width, cell, seed, bucket_rows)
    )
    parts = connected(found.filter("root < node"), "node", "root").withColumnRenamed("id", "node")
    named = nodes.select("node", "v1", "v2", "lowest", "copies").join(parts, "node", "left")
    named = named.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    named = named.withColumn("root", F.coalesce("component_id", "node")).drop("component_id")
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    answers = named.join(lowest, "root").select("v1", "v2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "v1", "v2").join(answers, ["v1", "v2"], "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
