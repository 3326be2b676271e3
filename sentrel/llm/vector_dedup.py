"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one kept vector per group.

1. Equal vectors of a label become one class with a count, so copies are never paired.
2. Labels with more than CELL classes are cut into cells around unit centroids, fitted by Lloyd rounds on at most SAMPLE
   vectors, a number that grows with the label; at most CENTROIDS centroids in all, dealt by size. Every vector is
   assigned, and also visits each cell whose border is nearer than half the chord of the threshold. Of two vectors that
   are similar enough but live in two cells, at least one visits the other's cell, so no pair is missed.
3. A cell is compared in blocks of BLOCK rows: every two blocks meet in one task, which takes their product, counts links
   and returns for each linked vector its count and the root of its group in the block, never the pairs.

Cosines are in double precision. Only vectors with equal, non-null labels and equal lengths are compared; vectors that are
null, empty, zero or hold null or non-finite components, and those without vec_id, link with nothing. Rows that share a
vec_id are linked as one node; their link counts are by row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import components, schema, settle

CELL, BLOCK, SAMPLE, CENTROIDS, ROUNDS = 2048, 2048, 50_000, 8192, 6


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, width (0 if it links with nothing), name (of equal vectors) and unit (64-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, names, units = [], [], []
            for vec, label, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = own.values
                x = None
                if vec is not None and label is not None and values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(float)
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(top) and top > 0 else None
                if x is None:
                    width.append(0)
                    names.append(None)
                    units.append(None)
                else:
                    x = x / math.sqrt(float(x @ x)) + 0.0
                    width.append(len(x))
                    names.append(hashlib.blake2b(own.values.to_numpy(zero_copy_only=False).astype(float).tobytes(), digest_size=16).digest())
                    units.append(x.tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(width, pa.int32()), pa.array(names, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "label", "width", "name", "unit"])

    return vectors.mapInArrow(run, schema("vec_id long, label string, width int, name binary, unit binary"))


def fit_cells(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit centroids of the large labels."""
    large = classes.groupBy("label", "width").count().where(F.col("count") > CELL).orderBy(F.desc("count"), "label", "width").limit(CENTROIDS // 2).collect()
    if not large:
        return {}
    wanted = {(r.label, r.width): max(2, math.ceil(2 * r["count"] / CELL)) for r in large}
    share = min(1.0, CENTROIDS / sum(wanted.values()))
    wanted = {k: max(2, int(n * share)) for k, n in wanted.items()}
    names = classes.sparkSession.createDataFrame([k for k in wanted], "label string, width int")
    fitted = settle(classes.join(F.broadcast(names), ["label", "width"]).select("label", "width", "unit", "name").orderBy(F.xxhash64("name"), "name").limit(SAMPLE).repartition(8), "sample")
    cells: dict[tuple[str, int], np.ndarray] = {}
    for r in fitted.select("label", "width", "unit").limit(CENTROIDS * 4).collect():  # starting points: a bounded number of vectors
        own = cells.setdefault((r.label, r.width), [])
        if len(own) < wanted[r.label, r.width]:
            own.append(np.frombuffer(r.unit, float))
    cells = {k: np.array(v) for k, v in cells.items()}

    def sums(now: dict) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros_like(v) for k, v in now.items()}
            for batch in batches:
                for label, width, unit in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    x = np.frombuffer(unit, float)
                    if (label, width) in now:
                        total[label, width][int(np.argmax(now[label, width] @ x))] += x
            for (label, width), t in total.items():
                yield pa.record_batch([pa.array([label]), pa.array([width], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["label", "width", "t"])

        out = {k: np.zeros_like(v) for k, v in now.items()}
        for r in fitted.select("label", "width", "unit").mapInArrow(run, schema("label string, width int, t binary")).collect():  # 8 x CENTROIDS sums
            out[r.label, r.width] += np.frombuffer(r.t, float).reshape(out[r.label, r.width].shape)
        return out

    for _ in range(ROUNDS):
        for k, t in sums(cells).items():
            size = np.linalg.norm(t, axis=1, keepdims=True)
            cells[k] = np.where(size > 0, t / np.maximum(size, 1e-300), cells[k])
    return cells


def placed(classes: DataFrame, cells: dict, cosine: float) -> DataFrame:
    """Each class in its own cell (guest false) and in those that it visits; visits lists the latter."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for label, width, rep, copies, unit in zip(*(batch.column(i).to_pylist() for i in range(5))):
                home, visits = 0, []
                if (label, width) in cells:
                    dots = cells[label, width] @ np.frombuffer(unit, float)
                    home = int(np.argmax(dots))
                    gaps = np.maximum(np.linalg.norm(cells[label, width] - cells[label, width][home], axis=1), 1e-12)
                    near = (dots[home] - dots) / gaps <= reach
                    near[home] = False
                    visits = np.flatnonzero(near).tolist()
                for cell in [home, *visits]:
                    rows.append((label, width, cell, cell != home, home, visits, rep, copies, unit))
            columns = list(zip(*rows)) or [[]] * 9
            types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["label", "width", "cell", "guest", "home", "visits", "rep", "copies", "unit"])

    return classes.select("label", "width", "rep", "copies", "unit").mapInArrow(run, schema("label string, width int, cell int, guest boolean, home int, visits array<int>, rep long, copies long, unit binary"))


def block_links(cosine: float):
    """Links between the rows (r) and columns (c) of one task; a task of one block with itself has rows only."""

    def run(table: pa.Table) -> pa.Table:
        col = {n: table.column(n).to_pylist() for n in ("side", "guest", "home", "visits", "rep", "copies", "cell")}
        rep, copies = np.array(col["rep"], np.int64), np.array(col["copies"], np.int64)
        side = np.array(col["side"])
        units = np.array([np.frombuffer(u, float) for u in table.column("unit").to_pylist()])
        rows = np.flatnonzero(side == "r")
        cols = np.flatnonzero(side == "c")
        same = table.column("kind")[0].as_py() == "m" and table.column("x")[0] == table.column("y")[0]
        cols = rows if same else cols
        if not len(rows) or not len(cols):
            return pa.table([pa.array([], pa.int64())] * 3, ["rep", "links", "root"])
        linked = units[rows] @ units[cols].T >= cosine
        if same:
            np.fill_diagonal(linked, False)
        elif col["guest"][rows[0]]:
            # a pair whose both ends visit each other counts in the cell with the smaller number only
            homes = np.array(col["home"])[rows]
            for home in np.unique(homes):
                if home < col["cell"][0]:
                    returns = np.array([home in col["visits"][j] for j in cols])
                    linked[np.ix_(homes == home, returns)] = False
        r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        part = linked[np.ix_(r, c)]
        a, b = rep[rows[r]].copy(), rep[cols[c]].copy()
        top = np.iinfo(np.int64).max
        while len(r):
            a2 = np.minimum(a, np.where(part, b, top).min(1))
            b2 = np.minimum(b, np.where(part, a2[:, None], top).min(0))
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
        out = [(rep[rows[r]], part @ copies[cols[c]], a)]
        if not same:
            out.append((rep[cols[c]], copies[rows[r]] @ part, b))
        return pa.table([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], ["rep", "links", "root"])

    return run


def vector_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; see the module's text."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = settle(unit_rows(source), "units")
    key = ["label", "width", "name"]
    classes = settle(rows.where("width > 0").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "classes")
    in_cells = settle(placed(classes, fit_cells(classes), cosine), "cells")
    cell = ["label", "width", "cell"]
    sizes = in_cells.groupBy(*cell).agg(F.sum((~F.col("guest")).cast("int")).alias("m"), F.sum(F.col("guest").cast("int")).alias("g"))
    sized = in_cells.join(sizes.withColumns({"mb": F.ceil(F.col("m") / BLOCK).cast("int"), "gb": F.ceil(F.col("g") / BLOCK).cast("int")}), cell)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("guest"), F.col("gb")).otherwise(F.col("mb"))).cast("int")
    sized = sized.withColumn("own", own)
    def pair(kind: str, x: str, y: str, side: str) -> str:
        return f"named_struct('kind', '{kind}', 'x', int({x}), 'y', int({y}), 'side', '{side}')"

    def all_blocks(n: str, where: str, made: str) -> str:
        return f"transform(filter(if({n} > 0, sequence(0, {n} - 1), array()), j -> {where}), j -> {made})"

    member_tasks = F.expr(f"concat(array({pair('m', 'own', 'own', 'r')}), {all_blocks('mb', 'j > own', pair('m', 'own', 'j', 'r'))}, {all_blocks('mb', 'j < own', pair('m', 'j', 'own', 'c'))}, {all_blocks('gb', 'true', pair('g', 'j', 'own', 'c'))})")
    guest_tasks = F.expr(all_blocks("mb", "true", pair("g", "own", "j", "r")))
    dealt = sized.withColumn("t", F.explode(F.when(F.col("guest"), guest_tasks).otherwise(member_tasks)))
    dealt = dealt.select(*cell, "t.kind", "t.x", "t.y", "t.side", "guest", "home", "visits", "rep", "copies", "unit")
    found = settle(dealt.groupBy(*cell, "kind", "x", "y").applyInArrow(block_links(cosine), schema("rep long, links long, root long")), "linked")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    facts = classes.select(*key, "rep", "copies").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    whole = rows.join(facts.select(*key, "rep", "copies", "links", "root"), key, "left")
    component = F.coalesce("root", "rep", "vec_id")
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return whole.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)
