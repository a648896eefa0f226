"""Near-duplicate vectors by randomised-rotation binary codes.

Unit vectors are rotated at random several times and reduced to sign bits, once per distinct vector
and into a stored table.  With ``o`` the unit vector, ``s`` its sign vector scaled to unit length and
``c = <s, o>``, the correction factor stored beside the code, ``<s, q> / c`` is an unbiased estimate
of ``<o, q>`` over rotations, with the error bound

    |estimate - <o, q>|  <=  sqrt(1 - <o, q>^2) * sqrt(1 - c^2) / c

for every rotation (``s = c o + sqrt(1 - c^2) e`` with ``e`` a unit vector at right angles to ``o``).
``q`` is stored in 8 bits a component with the length of what rounding took away, which is added to
the bound.  A pair is ruled out if for any rotation the estimate lies below the smallest that the
bound leaves to a cosine at the threshold, so that no link is lost to the codes.  Blocks meet by
their codes alone; full vectors are fetched only for the vectors of a block that some pair is left
open for, and these are recomputed in double precision.  (Sums over code bits are products of
unpacked signs, not population counts: numpy multiplies faster than it counts bits.)

Candidates.  Vectors of one label are compared block against block.  Where labels are large, each
label is first divided by some bits of one rotation, in several independent tables: how many bits
and tables follows from the label sizes by cost, with enough tables that a pair at the threshold is
missed with a probability below ``MISS`` (with 0 bits, the outcome for labels below some ten
thousand vectors, nothing can be missed; ``exact`` asks for that at every size).  A pair met in
several tables counts in the first.

Blocks hold a bounded number of vectors whatever a label or a group of copies holds.  They return
one row per vector and block pair (links seen, and one linked vector by which components grow),
never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table
from shelfmark.llm.components import connected_components

LINK_AT = 0.98
BLOCK = 1024
MISS = 1e-9
ROTATIONS = 2
MAX_BITS = 24
SEED = 8
#: Relative costs: of sending a vector to a task, and of one comparison of codes.
SEND_COST, PAIR_COST = 1000.0, 1.0


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same dimension and number on every machine."""
    normal = np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def agreement(threshold: float = LINK_AT) -> float:
    """Chance that a sign bit of two vectors at the threshold agrees."""
    return 1 - math.acos(threshold) / math.pi


def tables_for(bits: int, threshold: float = LINK_AT) -> int:
    return 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - agreement(threshold) ** bits))


def choose_bits(largest: int, threshold: float = LINK_AT) -> int:
    """The number of bucket bits of the least cost per vector, for the largest label's size."""

    def cost(bits: int) -> float:
        bucket = largest / 2**bits
        return tables_for(bits, threshold) * (SEND_COST * math.ceil(bucket / BLOCK) + PAIR_COST * bucket)

    return min(range(MAX_BITS + 1), key=cost)


def lowest_estimate(c: np.ndarray, threshold: float) -> np.ndarray:
    """The least estimate that a pair at or above ``threshold`` can have, by the error bound."""
    return threshold - math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - c**2)) / c


def encode(unit: np.ndarray) -> dict[str, np.ndarray]:
    """Codes and query forms of unit vectors, a row for each vector and a part for each rotation.

    ``code`` packed signs, ``c`` their correction factor, ``query`` rotated components as 8-bit
    integers times ``scale``, ``slack`` the length of the rounding error.
    """
    n, dim = unit.shape
    out = {"code": np.zeros((n, ROTATIONS, (dim + 7) // 8), np.uint8), "query": np.zeros((n, ROTATIONS, dim), np.int8)} | {f: np.zeros((n, ROTATIONS)) for f in ("c", "scale", "slack")}
    for k in range(ROTATIONS):
        turned = unit @ rotation(dim, k)
        out["code"][:, k] = np.packbits(turned >= 0, axis=1)
        out["c"][:, k] = np.abs(turned).sum(axis=1) / math.sqrt(dim)
        scale = np.abs(turned).max(axis=1) / 127
        whole = np.rint(turned / scale[:, None])
        out["query"][:, k], out["scale"][:, k], out["slack"][:, k] = whole, scale, np.sqrt(((turned - whole * scale[:, None]) ** 2).sum(axis=1))
    return out


def open_pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray], dim: int, threshold: float) -> np.ndarray:
    """Which pairs of a query form of ``x`` and a code of ``y`` the bound does not rule out."""
    left = None
    for k in range(ROTATIONS):
        signs = np.unpackbits(y["code"][:, k], axis=1)[:, :dim].astype(np.float32) * 2 - 1
        product = x["query"][:, k].astype(np.float32) @ signs.T
        c = y["c"][:, k]
        # 1e-4 covers single precision.
        least = c * (lowest_estimate(c, threshold) - 1e-4)
        fits = product * (x["scale"][:, k] / math.sqrt(dim))[:, None].astype(np.float32) + x["slack"][:, k][:, None].astype(np.float32) >= least[None, :].astype(np.float32)
        left = fits if left is None else left & fits
    return left


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the pairs of unit vectors with cosine >= ``threshold``, and how many the codes left open."""
    i, j = np.nonzero(open_pairs(encode(x), encode(y), x.shape[1], threshold))
    hit = np.einsum("ij,ij->i", x[i], y[j]) >= threshold if len(i) else np.zeros(0, bool)
    return i[hit], j[hit], len(i)


def _unit(rows: pd.Series) -> np.ndarray:
    v = np.array(rows.tolist(), np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def bucket_keys(unit: np.ndarray, bits: int, n_tables: int) -> np.ndarray:
    """A row for each vector: its bucket in each table, as signs of the first bits of rotations of its own."""
    dim, weights = unit.shape[1], 1 << np.arange(bits, dtype=np.int64)
    out = np.zeros((len(unit), n_tables), np.int64)
    per = max(1, dim // max(1, bits))
    for t in range(n_tables if bits else 0):
        # Tables share a rotation as long as it has bits that none has used.
        r = rotation(dim, 1000 + t // per)
        part = r[:, t % per * bits : t % per * bits + bits]
        out[:, t] = (unit @ part >= 0) @ weights[: part.shape[1]]
    return out


def _bucket_batches(bits: int, n_tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, same in batch.groupby(batch["embedding"].str.len()):
                keys = bucket_keys(_unit(same["embedding"]), bits, n_tables) if dim else np.zeros((len(same), n_tables), np.int64)
                yield pd.DataFrame({"node": same["node"], "mark": same["mark"], "cell": list(keys)})

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest vertex of its component under the edges ``i, j``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


CODED = "node long, mark long, label string, dim int, cell array<long>, code binary, query binary, c array<double>, scale array<double>, slack array<double>"


def _code_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for dim, same in batch.groupby(batch["embedding"].str.len()):
            got = encode(_unit(same["embedding"]))
            told = {f: same[f].to_numpy() for f in ("node", "mark", "label")} | {"dim": int(dim), "cell": list(same["cell"])}
            packed = {f: [v.tobytes() for v in got[f]] for f in ("code", "query")}
            yield pd.DataFrame({**told, **packed, **{f: list(got[f]) for f in ("c", "scale", "slack")}})


def _halves(half: np.ndarray, one_block: bool) -> tuple[np.ndarray, np.ndarray]:
    left = np.arange(len(half)) if one_block else np.flatnonzero(half == 0)
    return left, left if one_block else np.flatnonzero(half == 1)


KEYS = ["label", "dim", "number", "key", "b1", "b2"]
KEY_TYPES = "label string, dim int, number int, key long, b1 int, b2 int"


def _screen(threshold: float):
    def run(key: tuple, unit: pd.DataFrame) -> pd.DataFrame:
        """The vectors of a block pair that some pair is left open for."""
        dim = int(key[1])
        own = bool(unit["one_block"].iloc[0])
        coded = {f: np.array(unit[f].tolist(), float).reshape(len(unit), ROTATIONS) for f in ("c", "scale", "slack")}
        coded["code"] = np.frombuffer(b"".join(unit["code"]), np.uint8).reshape(len(unit), ROTATIONS, -1)
        coded["query"] = np.frombuffer(b"".join(unit["query"]), np.int8).reshape(len(unit), ROTATIONS, dim)
        left, right = _halves(unit["half"].to_numpy(), own)
        met = np.zeros(len(unit), bool)
        for a in range(0, len(left), BLOCK):
            for b in range(0, len(right), BLOCK):
                some, other = left[a : a + BLOCK], right[b : b + BLOCK]
                fits = open_pairs({f: v[some] for f, v in coded.items()}, {f: v[other] for f, v in coded.items()}, dim, threshold)
                if own:
                    fits &= some[:, None] != other[None, :]
                met[some] |= fits.any(axis=1)
                met[other] |= fits.any(axis=0)
        kept = unit.loc[met, ["half", "one_block", "node", "mark"]]
        return kept.assign(**dict(zip(KEYS, key, strict=True)))[[*KEYS, "half", "one_block", "node", "mark"]]

    return run


def _compare(threshold: float):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        """One block pair, exactly: ``half`` tells the two blocks apart (both 0 for a block against itself)."""
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "mark", "links", "other")})
        unit = unit.sort_values(["half", "node", "mark"])
        node, times = unit["node"].to_numpy(), unit["times"].to_numpy()
        vectors, cells, number = _unit(unit["embedding"]), np.array(unit["cell"].tolist(), np.int64), int(unit["number"].iloc[0])
        own = bool(unit["one_block"].iloc[0])
        left, right = _halves(unit["half"].to_numpy(), own)
        found_i, found_j = [], []
        for a in range(0, len(left), BLOCK):
            for b in range(0, len(right), BLOCK):
                i, j = np.nonzero(vectors[left[a : a + BLOCK]] @ vectors[right[b : b + BLOCK]].T >= threshold - 1e-9)
                i, j = left[a + i], right[b + j]
                keep = i < j if own else np.ones(len(i), bool)
                keep &= np.einsum("ij,ij->i", vectors[i], vectors[j]) >= threshold
                i, j = i[keep], j[keep]
                if number and len(i):  # met in an earlier table already
                    new = ~(cells[i, :number] == cells[j, :number]).any(axis=1)
                    i, j = i[new], j[new]
                found_i.append(i)
                found_j.append(j)
        if not found_i or not sum(map(len, found_i)):
            return none
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        links = np.bincount(i, weights=times[j], minlength=len(unit)) + np.bincount(j, weights=times[i], minlength=len(unit))
        root = _forest(len(unit), i, j)
        some = np.unique(np.concatenate((i, j)))
        return pd.DataFrame({"node": node[some], "mark": unit["mark"].to_numpy()[some], "links": links[some].astype(np.int64), "other": node[root[some]]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = LINK_AT, exact: bool = False) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` per row of ``vectors``; other columns are ignored, whatever their names.

    Only vectors of the same label (not null) and dimension are compared, by cosine in double
    precision.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing.  Equal vectors of a label are one vertex for the search and count as one link each to
    one another.  Rows that repeat an id count as vectors of their own but are one vertex of a
    component; a vector of null id links but names no component.  An empty table gives an empty
    result.  ``exact`` compares all vectors of a label at every size, instead of dividing large
    labels into tables that miss a pair at the threshold with a chance below ``MISS``.
    """
    prepare(vectors.sparkSession)
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value to the cosine, and to the key; a key has 128 bits.
    rows = rows.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))))
    rows = materialise(rows.withColumns({f"k{i}": F.when(v.isNotNull(), F.xxhash64(F.lit(i), "label", "embedding")) for i in (1, 2)}), "vectors")
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("id").alias("least"), F.count("*").alias("times"))
    # Vertices are numbered by smallest id (or hash), so that a rerun of a task numbers them alike; classes
    # of one smallest id (repeated ids) share a vertex, and the mark tells their links apart.
    node = F.coalesce(F.col("least"), -1 - F.abs(F.col("k1") % (1 << 62)))
    classes = materialise(classes.select("k1", "k2", "label", "embedding", "least", "times", node.alias("node"), F.col("k1").alias("mark")), "vector-classes")
    bits = 0
    if not exact:
        largest = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits = choose_bits(largest, threshold)
    n_tables = tables_for(bits, threshold)
    if bits:
        celled = classes.select("node", "mark", "embedding").mapInPandas(_bucket_batches(bits, n_tables), "node long, mark long, cell array<long>")
        classes = materialise(classes.join(celled, ["node", "mark"]), "vector-cells")
    else:
        classes = classes.withColumn("cell", F.array(F.lit(0).cast("long")))
    coded = materialise(classes.select("node", "mark", "label", "cell", "embedding").mapInPandas(_code_batches, CODED), "vector-codes")
    spread = coded.select("*", F.posexplode("cell").alias("number", "key")).drop("cell")
    sizes = spread.groupBy("label", "dim", "number", "key").agg(F.count("*").alias("size")).filter("size > 1")
    placed = spread.join(sizes, ["label", "dim", "number", "key"]).withColumn("n_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(SEED)), F.col("n_blocks")).cast("int"))
    # A code goes to every pair of blocks that holds its own: as many copies as its bucket has blocks.
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pairs = pairs.withColumn("b1", F.least("block", "with")).withColumn("b2", F.greatest("block", "with")).withColumn("half", F.when(F.col("block") == F.col("b1"), 0).otherwise(1))
    pairs = pairs.withColumn("one_block", (F.col("b1") == F.col("b2")).cast("int"))
    screened = pairs.select(*KEYS, "half", "one_block", "node", "mark", "code", "query", "c", "scale", "slack").groupBy(*KEYS).applyInPandas(_screen(threshold), f"{KEY_TYPES}, half int, one_block int, node long, mark long")
    left = materialise(screened, "vector-open").join(classes.select("node", "mark", "times", "embedding", "cell"), ["node", "mark"])
    seen = left.groupBy(*KEYS).applyInPandas(_compare(threshold), "node long, mark long, links long, other long")
    seen = materialise(seen, "vector-links")
    links = seen.groupBy("node", "mark").agg(F.sum("links").alias("links"))
    roots = connected_components(seen.select("node", "other"), "node", "other").withColumnRenamed("node", "vertex")
    known = classes.select("k1", "k2", "times", "least", "node", "mark").join(links, ["node", "mark"], "left").join(roots, F.col("node") == F.col("vertex"), "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(names, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    found = rows.select("id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return found.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: All pairs of a label, for DuckDB; components by walking links from every vector.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.least, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
