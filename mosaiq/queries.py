"""Registered queries of the linear-algebra engine and their SQL for DuckDB.

Inputs are the quantised embeddings Q (integers), G = Qᵀ Q, and matrices with a row for each vector. Sums
of integers and dyadic numbers are exact in any order; other results are rounded far above their error.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .matrix import TiledMatrix, unpack
from .operators import divide, eigen, factor, multiply, panel, shape, solve
from .plans.strategy import shared_dir
from .sources import columnmajor, generators, storage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Tile of G.
GB = 24


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an integer matrix in coordinates: (i, j, v)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x"))
    return rows.select("i", F.col("j").cast("long").alias("j"), F.floor(F.col("x").cast("double") * 64 + 0.5).cast("double").alias("v"))


def q_matrix(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    coo = quantised(spark, sf_dir).withColumnRenamed("v", "re")
    m = (spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0] or 0) + 1
    return TiledMatrix.from_coo(coo, m, 64, 512, GB)


def g_matrix(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """G in tiles, from its coordinate form (64 x 64)."""
    return TiledMatrix.from_coo(gram_gemm(spark, sf_dir), 64, 64, GB, GB)


def gram_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qᵀ Q: each task multiplies its rows by themselves, and one small shuffle adds the products of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            values = [v for v in batch.column(0).to_numpy(zero_copy_only=False) if v is not None]
            rows = np.zeros((len(values), max([len(total), *map(len, values)])))
            for row, v in zip(rows, values, strict=True):
                row[: len(v)] = np.floor(v.astype(np.float64) * 64 + 0.5)
            product = rows.T @ rows
            product[: len(total), : len(total)] += total
            total = product
        n = len(total)
        i, j = np.divmod(np.arange(n * n), max(n, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "re"])

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding")
    return rows.mapInArrow(run, "i long, j long, re double").groupBy("i", "j").agg(F.sum("re").alias("re"))


_Q = """q AS (SELECT vec_id AS i, (k - 1)::BIGINT AS j, floor(embedding[k]::DOUBLE * 64 + 0.5) AS v
FROM embeddings, range(1, 65) t(k) WHERE k <= len(embedding)),
g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS re FROM q a JOIN q b USING (i) GROUP BY a.j, b.j)"""


def _coo(a: TiledMatrix, digits: int | None = None, zeros: bool = True) -> DataFrame:
    value = F.col("re") if digits is None else F.round("re", digits)
    return a.to_coo(zeros).select("i", "j", (value + F.lit(0.0)).alias("re"))


def _register(name: str, query: Query, oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def _poisoned(a: TiledMatrix, uplo: str) -> TiledMatrix:
    """Only a triangle holds numbers; the other holds NaN, which would show in any result that reads it."""

    def spoil(ti: int, tj: int, x: np.ndarray) -> np.ndarray:
        bad = (ti < tj if uplo == "L" else ti > tj) if ti != tj else None
        return np.where(K._mask(x, uplo), x, np.nan) if bad is None else np.full_like(x, np.nan) if bad else x

    return a.map_tiles(spoil)


_register("gram_gemm", gram_gemm, f"WITH {_Q} SELECT i, j, re FROM g")
_register("gemm_tiles", lambda s, d: _coo(multiply.gemm(q := q_matrix(s, d), q, opa="T")), f"WITH {_Q} SELECT i, j, re FROM g")
_register(
    "gemm_alpha_beta",
    lambda s, d: _coo(multiply.gemm(g := g_matrix(s, d), g, 2, -3, g)),
    f"WITH {_Q} SELECT a.i, b.j, 2 * sum(a.re * b.re) - 3 * any_value(c.re) AS re FROM g a JOIN g b ON a.j = b.i JOIN g c ON c.i = a.i AND c.j = b.j GROUP BY a.i, b.j",
)
_register(
    "gemm_chain",
    lambda s, d: _coo(multiply.chain(q_matrix(s, d).transpose(), q_matrix(s, d), generators.from_function(s, 64, 8, GB, GB, lambda i, j: (i + 2 * j) % 3.0))),
    f"WITH {_Q} SELECT g.i, b.j, sum(g.re * ((g.j + 2 * b.j) % 3)) AS re FROM g, range(8) b(j) GROUP BY g.i, b.j",
)

_B = "((7 * {0} + 3 * {1}) % 11 - 5)"


def _b(spark: SparkSession, m: int, n: int, mb: int, nb: int) -> TiledMatrix:
    return generators.from_function(spark, m, n, mb, nb, lambda i, j: (7 * i + 3 * j) % 11 - 5.0)


for _side in "LR":
    for _uplo in "LU":
        _inside = "a.i >= a.j" if _uplo == "L" else "a.i <= a.j"
        _h = f"h AS (SELECT i, j, re FROM g a WHERE {_inside} UNION ALL SELECT j, i, re FROM g a WHERE {_inside} AND a.i <> a.j)"
        _register(
            f"hemm_{'left' if _side == 'L' else 'right'}_{'lower' if _uplo == 'L' else 'upper'}",
            lambda s, d, side=_side, uplo=_uplo: _coo(multiply.hemm(side, uplo, _poisoned(g_matrix(s, d), uplo), _b(s, 64, 10, GB, 4) if side == "L" else _b(s, 10, 64, 4, GB), 2)),
            f"WITH {_Q}, {_h} SELECT h.i, b.j, 2 * sum(h.re * {_B.format('h.j', 'b.j')}) AS re FROM h, range(10) b(j) GROUP BY h.i, b.j"
            if _side == "L"
            else f"WITH {_Q}, {_h} SELECT b.i, h.j, 2 * sum({_B.format('b.i', 'h.i')} * h.re) AS re FROM h, range(10) b(i) GROUP BY b.i, h.j",
        )

#: Triangles of G times a power of two: their solves are well conditioned, and products stay exact.
_SCALE = 2.0**-17


def _small_g(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    return g_matrix(spark, sf_dir).scale(_SCALE)


def _trmm(side: str, uplo: str, op: str, diag: str, spark: SparkSession, sf_dir: str, alpha: float = 2) -> TiledMatrix:
    return multiply.trmm(side, uplo, op, diag, _poisoned(_small_g(spark, sf_dir), uplo), g_matrix(spark, sf_dir), alpha)


_G = f"WITH {_Q} SELECT i, j, re FROM g"
for _side in "LR":
    for _uplo in "LU":
        for _op in "NT":
            for _diag in "NU":
                _name = f"{_side}{_uplo}{_op}".lower() + ("_nonunit" if _diag == "N" else "_unit")
                _element = f"CASE WHEN i = j THEN {'re * pow(2, -17)' if _diag == 'N' else '1'} WHEN i {'>' if _uplo == 'L' else '<'} j THEN re * pow(2, -17) ELSE 0 END"
                _a = f"a AS (SELECT {'i, j' if _op == 'N' else 'j AS i, i AS j'}, {_element} AS v FROM g)"
                _register(
                    f"trmm_{_name}",
                    lambda s, d, v=(_side, _uplo, _op, _diag): _coo(_trmm(*v, s, d)),
                    f"WITH {_Q}, {_a} SELECT a.i, b.j, 2 * sum(a.v * b.re) AS re FROM a JOIN g b ON a.j = b.i GROUP BY a.i, b.j"
                    if _side == "L"
                    else f"WITH {_Q}, {_a} SELECT b.i, a.j, 2 * sum(b.re * a.v) AS re FROM g b JOIN a ON b.j = a.i GROUP BY b.i, a.j",
                )
                _register(f"trsm_{_name}", lambda s, d, v=(_side, _uplo, _op, _diag): _coo(solve.trsm(*v, _poisoned(_small_g(s, d), v[1]), _trmm(*v, s, d), 0.5, "tiles"), 3), _G)


def _squared(uplo: str, f: TiledMatrix) -> TiledMatrix:
    """L Lᴴ or Uᴴ U."""
    return multiply.gemm(f, f, opb="C") if uplo == "L" else multiply.gemm(f, f, opa="C")


def _inverted_back(uplo: str, diag: str, spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """T⁻¹ (T G)."""
    inverse = solve.trtri(uplo, diag, _poisoned(_small_g(spark, sf_dir), uplo), "tiles")
    return multiply.trmm("L", uplo, "N", diag, inverse, _trmm("L", uplo, "N", diag, spark, sf_dir, 1))


def _solved_by_inverse(uplo: str, spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """(L Lᴴ)⁻¹ (G G), where L Lᴴ is G."""
    g = g_matrix(spark, sf_dir).stored("gram")
    inverse = solve.potri(uplo, _poisoned(factor.potrf(uplo, g), uplo))
    return multiply.gemm(inverse.hermitian(uplo), multiply.gemm(g, g))


def _standard_and_back(uplo: str, spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """L (L⁻¹ G L⁻ᴴ) Lᴴ, or the same with U."""
    t = _small_g(spark, sf_dir).triangle(uplo).stored("triangle")
    standard = solve.hegst(uplo, _poisoned(g_matrix(spark, sf_dir), uplo), _poisoned(t, uplo)).hermitian(uplo)
    return multiply.gemm(multiply.gemm(t, standard), t, opb="C") if uplo == "L" else multiply.gemm(multiply.gemm(t, standard, opa="C"), t)


for _uplo in "LU":
    _word = "lower" if _uplo == "L" else "upper"
    for _way in ("task", "tiles"):
        _register(f"potrf_{_word}_{_way}", lambda s, d, u=_uplo, w=_way: _coo(_squared(u, factor.potrf(u, _poisoned(g_matrix(s, d), u), w).stored("factor")), 3), _G)
    for _diag in "NU":
        _register(f"trtri_{_word}_{'nonunit' if _diag == 'N' else 'unit'}", lambda s, d, u=_uplo, g=_diag: _coo(_inverted_back(u, g, s, d), 3), _G)
    _meets = "a.i = b.i AND a.i >= a.j AND b.i >= b.j AND a.j >= b.j" if _uplo == "L" else "a.j = b.j AND a.i <= a.j AND b.i <= b.j AND a.i <= b.i"
    _i, _j = ("a.j", "b.j") if _uplo == "L" else ("a.i", "b.i")
    _register(
        f"lauum_{_word}",
        lambda s, d, u=_uplo: _coo(multiply.lauum(u, _poisoned(g_matrix(s, d), u)), None, False),
        f"WITH {_Q} SELECT {_i} AS i, {_j} AS j, sum(a.re * b.re) AS re FROM g a JOIN g b ON {_meets} GROUP BY {_i}, {_j} HAVING sum(a.re * b.re) <> 0",
    )
    _register(f"potri_{_word}", lambda s, d, u=_uplo: _coo(_solved_by_inverse(u, s, d), 1), _G)
    _register(f"gen_to_std_{_word}", lambda s, d, u=_uplo: _coo(_standard_and_back(u, s, d), 3), _G)
_register("potrf_gram", lambda s, d: _coo(multiply.gemm(f := factor.potrf("L", g_matrix(s, d), "tiles").stored("factor"), f, opb="C"), 0), f"WITH {_Q} SELECT i, j, re FROM g")
_register("herk_lower", lambda s, d: _coo(multiply.herk("L", q_matrix(s, d), op="C"), None, False).filter("i >= j"), f"WITH {_Q} SELECT i, j, re FROM g WHERE i >= j AND re <> 0")
_register("her2k_lower", lambda s, d: _coo(multiply.her2k("L", g_matrix(s, d), g_matrix(s, d)), None, False).filter("i >= j"), f"WITH {_Q} SELECT a.i, b.j, 2 * sum(a.re * b.re) AS re FROM g a JOIN g b ON a.j = b.i WHERE a.i >= b.j GROUP BY a.i, b.j HAVING sum(a.re * b.re) <> 0")


def _scalar(spark: SparkSession, name: str, value: float) -> DataFrame:
    return spark.createDataFrame([(name, float(value))], "name string, value double")


for _uplo, _where in (("G", "true"), ("L", "i >= j"), ("U", "i <= j")):
    _register(f"max_norm_{ {'G': 'general', 'L': 'lower', 'U': 'upper'}[_uplo] }", lambda s, d, u=_uplo: _scalar(s, "max", shape.max_norm(_poisoned(g_matrix(s, d), u) if u != "G" else g_matrix(s, d), u)), f"WITH {_Q} SELECT 'max' AS name, max(abs(re)) AS value FROM g WHERE {_where}")

_REVERSED = "CASE WHEN {0} BETWEEN 24 AND 47 THEN 71 - {0} ELSE {0} END"


def _reverse(spark: SparkSession) -> DataFrame:
    return spark.range(GB).selectExpr("id pos", f"{GB - 1} - id src")


_both = "(i BETWEEN 24 AND 47 AND j BETWEEN 24 AND 47)"
_register("permute_rows", lambda s, d: _coo(shape.permute(g_matrix(s, d), _reverse(s), "rows", 1, 2)), f"WITH {_Q} SELECT CASE WHEN {_both} THEN 71 - i ELSE i END AS i, j, re FROM g")
_register("permute_columns", lambda s, d: _coo(shape.permute(g_matrix(s, d), _reverse(s), "columns", 1, 2)), f"WITH {_Q} SELECT i, CASE WHEN {_both} THEN 71 - j ELSE j END AS j, re FROM g")
_register("slice", lambda s, d: _coo(g_matrix(s, d).submatrix(5, 10, 40, 33)), f"WITH {_Q} SELECT i - 5 AS i, j - 10 AS j, re FROM g WHERE i BETWEEN 5 AND 44 AND j BETWEEN 10 AND 42")
_register("column_slice", lambda s, d: _coo(g_matrix(s, d).submatrix(0, 7, 64, 9)), f"WITH {_Q} SELECT i, j - 7 AS j, re FROM g WHERE j BETWEEN 7 AND 15")
_register("retile", lambda s, d: _coo(q_matrix(s, d).retile(100, 7)), f"WITH {_Q} SELECT i, j, v AS re FROM q")
_register("transpose", lambda s, d: _coo(q_matrix(s, d).transpose()), f"WITH {_Q} SELECT j AS i, i AS j, v AS re FROM q")
_register("paste", lambda s, d: _coo(shape.paste(_b(s, 10, 12, 4, 4), g_matrix(s, d), (20, 30))), f"WITH {_Q} SELECT i, j, CASE WHEN i BETWEEN 20 AND 29 AND j BETWEEN 30 AND 41 THEN {_B.format('(i - 20)', '(j - 30)')} ELSE re END AS re FROM g")
_register("triangle_mask", lambda s, d: _coo(g_matrix(s, d).triangle("L", "U"), None, False), f"WITH {_Q} SELECT i, j, CASE WHEN i = j THEN 1 ELSE re END AS re FROM g WHERE i >= j AND (i = j OR re <> 0)")
_register("add", lambda s, d: _coo(multiply.add(g_matrix(s, d), g_matrix(s, d).transpose(), -3)), f"WITH {_Q} SELECT i, j, -2 * re AS re FROM g")
_register("scale", lambda s, d: _coo(g_matrix(s, d).scale(0.5)), f"WITH {_Q} SELECT i, j, re / 2 AS re FROM g")
_register("scale_columns", lambda s, d: _coo(multiply.scale_columns(g_matrix(s, d), s.range(64).selectExpr("id idx", "id + 0.5D value"))), f"WITH {_Q} SELECT i, j, re * (j + 0.5) AS re FROM g")
_register("cast_to_complex", lambda s, d: g_matrix(s, d).cast_to_complex().to_coo(), f"WITH {_Q} SELECT i, j, re, 0::DOUBLE AS im FROM g")


def _vectors(spark: SparkSession, sf_dir: str) -> int:
    """Number of vectors; their ids go from 0 on."""
    return (spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0] or 0) + 1


def _from_driver(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """G (64 x 64) from a column-major array whose columns stand 70 elements apart."""
    flat = np.full(64 * 70, np.nan)
    flat.reshape(64, 70)[:, :64] = g_matrix(spark, sf_dir).to_numpy().T
    return TiledMatrix.from_column_major(spark, flat, 64, 64, 10, 7, 70)


_register("set_identity", lambda s, d: _coo(generators.identity(s, _vectors(s, d), 128), None, False), "SELECT vec_id AS i, vec_id AS j, 1::DOUBLE AS re FROM embeddings")
_register("set_function", lambda s, d: _coo(_b(s, _vectors(s, d), 22, 70, 5)), f"SELECT i, j, {_B.format('i', 'j')}::DOUBLE AS re FROM (SELECT vec_id AS i FROM embeddings) a, range(22) b(j)")
_register("set_function_transposed", lambda s, d: _coo(generators.from_function(s, _vectors(s, d), 22, 70, 5, lambda i, j: i - 2.0 * j, "T")), "SELECT i, j, (j - 2 * i)::DOUBLE AS re FROM (SELECT vec_id AS i FROM embeddings) a, range(22) b(j)")
_register("set_zero", lambda s, d: _coo(q_matrix(s, d).cleared()), "SELECT vec_id AS i, vec_id AS j, 0::DOUBLE AS re FROM embeddings WHERE false")
_register("column_major", lambda s, d: _coo(_from_driver(s, d)), f"WITH {_Q} SELECT i, j, re FROM g")


def _checked(a: TiledMatrix, low: float, high: float) -> DataFrame:
    """Number of elements, whether all moduli are inside of the limits, and whether a diagonal element has an imaginary part."""
    mb, nb = a.mb, a.nb

    def run(tiles: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, inside, odd = 0, True, False
        for ti, tj, x in tiles:
            square = x.ravel(order="K")
            square = square.view(square.real.dtype) ** 2
            square = square[::2] + square[1::2] if np.iscomplexobj(x) else square
            n, inside = n + x.size, inside and bool(square.min() >= low * low and square.max() <= high * high)
            k = tj * nb - ti * mb
            odd = odd or -x.shape[1] < k < x.shape[0] and bool(np.diagonal(x, -k).imag.any())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([inside]), pa.array([odd])], ["n", "inside", "odd_diagonal"])

    return a.fold_tiles(run, "n long, inside boolean, odd_diagonal boolean").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("inside").alias("inside"), F.max("odd_diagonal").alias("odd_diagonal"))


_COUNT = "(SELECT count(*) AS m FROM embeddings)"
_register("set_random", lambda s, d: _checked(generators.random(s, _vectors(s, d), 30, 70, 9), 0, 1), f"SELECT 30 * m AS n, true AS inside, false AS odd_diagonal FROM {_COUNT}")
_register("set_random_hermitian", lambda s, d: _checked(generators.random_hermitian(s, _vectors(s, d), 128, 0, "z"), 0, 1.0), f"SELECT m * m AS n, true AS inside, false AS odd_diagonal FROM {_COUNT}")
_register("set_random_positive_definite", lambda s, d: _checked(generators.random_positive_definite(s, m := _vectors(s, d), 128), 0, 2 * m + 1), f"SELECT m * m AS n, true AS inside, false AS odd_diagonal FROM {_COUNT}")
_register("set_random_banded", lambda s, d: _coo(generators.random_hermitian(s, _vectors(s, d), 128, band=3), None, False).selectExpr("max(abs(i - j)) width", "count(*) n"), f"SELECT 3::BIGINT AS width, 7 * m - 12 AS n FROM {_COUNT}")
_register("set_random_non_zero_diagonal", lambda s, d: generators.random_non_zero_diagonal(s, _vectors(s, d), 128).diagonal().selectExpr("count(*) n", "min(abs(re)) >= 0.1 and max(abs(re)) <= 1 inside"), f"SELECT m AS n, true AS inside FROM {_COUNT}")


def _stored_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    storage.write(q_matrix(spark, sf_dir), folder, "q")
    return _coo(storage.read(spark, folder, "q", (64, 20), "d"))


_register("write_and_read", _stored_and_read, f"WITH {_Q} SELECT i, j, v AS re FROM q")
_register(
    "text_forms",
    lambda s, d: s.createDataFrame([(storage.to_csv(g := q_matrix(s, d).submatrix(0, 0, 2, 3)), storage.to_numpy_code(g))], "csv string, code string"),
    f"""WITH {_Q}, s AS (SELECT * FROM q WHERE i < 2 AND j < 3), r AS (SELECT i, string_agg(v::INT::VARCHAR || ',', '' ORDER BY j) || chr(10) AS line FROM s GROUP BY i)
SELECT (SELECT string_agg(line, '' ORDER BY i) FROM r) AS csv, 'mat = np.array([' || string_agg(v::VARCHAR, ', ' ORDER BY j, i) || '], dtype=np.float64).reshape(3, 2).T' || chr(10) AS code FROM s""",
)

# -- eigensolvers ----------------------------------------------------------------------


def _laplace(spark: SparkSession, n: int, nb: int) -> TiledMatrix:
    # Tiles of zeros aren't made.
    return TiledMatrix.generate(spark, n, n, nb, nb, lambda i, j: np.where(i == j, 2.0, np.where(abs(i - j) == 1, -1.0, 0.0)), keep="abs(ti - tj) <= 1")


def _rounded(values: DataFrame) -> DataFrame:
    return values.select("idx", F.round("value", 8).alias("value"))


#: Eigenvalues of the second difference along all vectors' ids.
_LAPLACE = "SELECT vec_id AS idx, round(2 * (1 - cos(pi() * (vec_id + 1) / (1 + count(*) OVER ()))), 8) AS value FROM embeddings"
_register("syevd_laplace", lambda s, d: _rounded(eigen.heevd("L", _poisoned(_laplace(s, _vectors(s, d), 125), "L"), strategy="task").values), _LAPLACE)
_register("syevd_staged", lambda s, d: _rounded(eigen.heevd("U", _poisoned(_laplace(s, _vectors(s, d), 125), "U"), strategy="tiles", band=125).values), _LAPLACE)
_register("stedc_laplace", lambda s, d: _rounded(eigen.tridiagonal_eigensolver(s, np.full(n := _vectors(s, d), 2.0), np.full(n - 1, -1.0)).values), _LAPLACE)
_register(
    "syevd_partial",
    lambda s, d: _coo(multiply.gemm(g := g_matrix(s, d), (e := eigen.heevd("L", _poisoned(g, "L"), end=4)).vectors), 4).selectExpr("j", "re * re v").groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("square")).join(e.values.withColumnRenamed("idx", "j"), "j").select("j", "n", F.round(F.sqrt("square") - F.abs("value"), 2).alias("apart")),
    "SELECT j, 64::BIGINT AS n, 0::DOUBLE AS apart FROM range(4) t(j)",
)


def _reconstructed(a: TiledMatrix, e: eigen.Eigen) -> TiledMatrix:
    return multiply.gemm(multiply.scale_columns(e.vectors, e.values), e.vectors, opb="C")


_register("syevd_reconstruct", lambda s, d: _coo(_reconstructed(g := g_matrix(s, d), eigen.heevd("L", g)), 0), f"WITH {_Q} SELECT i, j, re FROM g")
_register("syevd_reconstruct_staged", lambda s, d: _coo(_reconstructed(g := g_matrix(s, d), eigen.heevd("L", g, strategy="tiles", band=12)), 0), f"WITH {_Q} SELECT i, j, re FROM g")


def _orthogonal(b: TiledMatrix, z: TiledMatrix) -> DataFrame:
    return _coo(multiply.gemm(z, multiply.gemm(b, z), opa="C"), 7)


_IDENTITY = "SELECT i, j, (i = j)::INT::DOUBLE AS re FROM range(64) a(i), range(64) b(j)"


def _pencil(spark: SparkSession, sf_dir: str) -> tuple[TiledMatrix, TiledMatrix]:
    """A small multiple of G, and the identity with a smaller one."""
    g = _small_g(spark, sf_dir).stored("gram")
    return g, multiply.add(generators.identity(spark, 64, GB), g, 0.5).stored("metric")


def _metric(uplo: str, factorized: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pencil(spark, sf_dir)
    return _orthogonal(b, eigen.hegvd(uplo, _poisoned(a, uplo), factor.potrf(uplo, b) if factorized else b, factorized=factorized).vectors)


_register("sygvd_orthogonality", lambda s, d: _metric("L", False, s, d), _IDENTITY)
_register("sygvd_factorized", lambda s, d: _metric("U", True, s, d), _IDENTITY)


def _invariants(a: TiledMatrix, band: int) -> DataFrame:
    return a.to_coo().agg(F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("re"))), 3).alias("trace"), F.round(F.sum(F.col("re") * F.col("re")) / 1000, 0).alias("squares"), F.sum(((F.abs(F.col("i") - F.col("j")) > band) & (F.abs("re") > 1e-6)).cast("long")).alias("outside"))


_INVARIANTS = f"WITH {_Q} SELECT sum(CASE WHEN i = j THEN re END) AS trace, round(sum(re * re) / 1000, 0) AS squares, 0::BIGINT AS outside FROM g"
_register("red2band_invariants", lambda s, d: _invariants(eigen.reduction_to_band(g_matrix(s, d), 12).matrix, 12), _INVARIANTS)


def _tridiagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = eigen.band_to_tridiagonal(eigen.reduction_to_band(g_matrix(spark, sf_dir), 12), 12)
    return _invariants(TiledMatrix.from_numpy(spark, np.diag(t.d) + np.diag(t.e, 1) + np.diag(t.e, -1), GB, GB), 1)


_register("b2t_invariants", _tridiagonal, _INVARIANTS)


def _back_transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q T Qᴴ, with both back-transformations applied to the identity, is G again."""
    band = eigen.reduction_to_band(g_matrix(spark, sf_dir), 12)
    t = eigen.band_to_tridiagonal(band, 12)
    q = eigen.bt_reduction_to_band(eigen.bt_band_to_tridiagonal(generators.identity(spark, 64, GB), t.reflectors), band.panels)
    middle = TiledMatrix.from_numpy(spark, np.diag(t.d) + np.diag(t.e, 1) + np.diag(t.e, -1), GB, GB)
    return _coo(multiply.gemm(multiply.gemm(q, middle), q, opb="C"), 0)


_register("back_transforms", _back_transformed, f"WITH {_Q} SELECT i, j, re FROM g")


def _index_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = quantised(spark, sf_dir).filter("j = 0").select(F.col("i").alias("idx"), F.col("v").alias("value"))
    perm = shape.sort_index(values)
    back = shape.apply_index(shape.apply_index(values, perm), shape.invert_index(perm))
    shifted = shape.add_index(perm, 100).select("pos", "src")
    return shape.apply_index(values, perm).withColumnRenamed("value", "sorted").join(back.withColumnRenamed("value", "restored"), "idx").join(shifted.withColumnRenamed("pos", "idx"), "idx")


_register("index_operations", _index_operations, f"WITH {_Q}, r AS (SELECT i, v, row_number() OVER (ORDER BY v, i) - 1 AS pos FROM q WHERE j = 0) SELECT a.pos AS idx, a.v AS sorted, b.v AS restored, a.i + 100 AS src FROM r a JOIN r b ON b.i = a.pos")


# -- complex matrices, sizes and residuals ---------------------------------------------


def _both_parts(a: TiledMatrix, digits: int = 7) -> DataFrame:
    return a.to_coo().select("i", "j", *((F.round(c, digits) + F.lit(0.0)).alias(c) for c in ("re", "im")))


def _complex_q(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """Q with its columns in reverse order as the imaginary part."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = lambda x: F.floor(x.cast("double") * 64 + 0.5).cast("double")
    both = rows.select(F.col("vec_id").alias("i"), F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))).alias("j", "x"))
    return TiledMatrix.from_coo(both.select("i", "j", part(F.col("x.a")).alias("re"), part(F.col("x.b")).alias("im")), _vectors(spark, sf_dir), 64, 512, GB, "z")


_QC = f"{_Q}, c AS (SELECT a.i, a.j, a.v AS re, b.v AS im FROM q a JOIN q b ON a.i = b.i AND b.j = 63 - a.j)"
#: The complex Gram matrix Qᴴ Q; its elements are whole.
_H = f"{_QC}, h AS (SELECT a.j AS i, b.j, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im FROM c a JOIN c b USING (i) GROUP BY a.j, b.j)"
_BI = "(({0} + 2 * {1}) % 5 - 1)"


def _complex_b(spark: SparkSession, m: int, mb: int) -> TiledMatrix:
    return generators.from_function(spark, m, 13, mb, 4, lambda i, j: (7 * i + 3 * j) % 11 - 5.0 + 1j * ((i + 2 * j) % 5 - 1.0), dtype="z")


def _complex_gemm(op: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 op(Q) B - 3 C for complex Q, B and a C of i - j."""
    q = _complex_q(spark, sf_dir)
    m, mb, k, kb = (q.m, q.mb, 64, GB) if op == "N" else (64, GB, q.m, q.mb)
    c = generators.from_function(spark, m, 13, mb, 4, lambda i, j: i - j + 0j, dtype="z")
    return _both_parts(multiply.gemm(q, _complex_b(spark, k, kb), 2, -3, c, opa=op))


for _op in "NTC":
    _rows, _inner, _sign = ("i", "j", "") if _op == "N" else ("j", "i", "-" if _op == "C" else "")
    _br, _bi, _ai = _B.format(f"c.{_inner}", "b.j"), _BI.format(f"c.{_inner}", "b.j"), f"({_sign}c.im)"
    _register(
        f"gemm_complex_{_op.lower()}",
        lambda s, d, o=_op: _complex_gemm(o, s, d),
        f"WITH {_QC} SELECT c.{_rows} AS i, b.j, 2 * sum(c.re * {_br} - {_ai} * {_bi}) - 3 * (c.{_rows} - b.j) AS re, 2 * sum(c.re * {_bi} + {_ai} * {_br}) AS im FROM c, range(13) b(j) GROUP BY c.{_rows}, b.j",
    )

# Sizes (m, n, k) and tiles (mb, nb, kb).
_GEMM_SIZES = [(26, 13, 0, 3, 6, 2), (3, 3, 3, 3, 3, 3), (8, 8, 11, 10, 9, 13), (3, 2, 4, 1, 1, 1), (6, 9, 8, 2, 3, 4), (21, 21, 21, 3, 4, 5), (12, 20, 11, 3, 4, 5), (8, 8, 11, 3, 3, 5), (0, 13, 7, 3, 6, 2), (26, 0, 7, 3, 6, 2)]


def _gemm_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 A B + C / 2 for corners of G that begin at (5, 7), (9, 3) and (1, 2)."""
    g = g_matrix(spark, sf_dir).stored("gram")
    cut = lambda at, m, n, mb, nb: g.window(at, (m, n), tile=(mb, nb))
    cases = [multiply.gemm(cut((5, 7), m, k, mb, kb), cut((9, 3), k, n, kb, nb), 2, 0.5, cut((1, 2), m, n, mb, nb)) for m, n, k, mb, nb, kb in _GEMM_SIZES]
    return functools.reduce(DataFrame.unionAll, (_coo(x).select(F.lit(at).cast("long").alias("size"), "i", "j", "re") for at, x in enumerate(cases)))


_register(
    "gemm_sizes",
    _gemm_sizes,
    f"WITH {_Q}, "
    + "s AS ("
    + " UNION ALL ".join(f"SELECT {at}::BIGINT AS size, {m} AS m, {n} AS n, {k} AS k" for at, (m, n, k, *_) in enumerate(_GEMM_SIZES))
    + ") SELECT size, c.i - 1 AS i, c.j - 2 AS j, coalesce((SELECT 2 * sum(a.re * b.re) FROM g a JOIN g b ON a.j - 7 = b.i - 9 WHERE a.i - 5 = c.i - 1 AND b.j - 3 = c.j - 2 AND a.j >= 7 AND a.j - 7 < k), 0) + c.re / 2 AS re FROM s, g c WHERE c.i >= 1 AND c.j >= 2 AND c.i - 1 < m AND c.j - 2 < n",
)

# Orders and tiles.
_SQUARE_SIZES = [(0, 2), (5, 8), (34, 34), (4, 3), (16, 10), (34, 13), (32, 5)]


def _complex_gram(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    q = _complex_q(spark, sf_dir)
    return multiply.gemm(q, q, opa="C").stored("gram")


def _potrf_sizes(spark: SparkSession, sf_dir: str, uplo: str) -> DataFrame:
    """Corners of the complex Gram matrix from their factors."""
    h = _complex_gram(spark, sf_dir)
    corners = [(at, factor.potrf(uplo, _poisoned(h.window((0, 0), (n, n), tile=(nb, nb)), uplo), "tiles")) for at, (n, nb) in enumerate(_SQUARE_SIZES)]
    return functools.reduce(DataFrame.unionAll, (_both_parts(_squared(uplo, f.stored("factor")), 3).select(F.lit(at).cast("long").alias("size"), "i", "j", "re", "im") for at, f in corners))


for _uplo, _word in (("L", "lower"), ("U", "upper")):
    _register(
        f"potrf_complex_{_word}",
        lambda s, d, u=_uplo: _potrf_sizes(s, d, u),
        f"WITH {_H}, s AS (" + " UNION ALL ".join(f"SELECT {at}::BIGINT AS size, {n} AS n" for at, (n, _) in enumerate(_SQUARE_SIZES)) + ") SELECT size, i, j, re, im FROM s, h WHERE i < n AND j < n",
    )


def _complex_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complex Gram matrix X from Aᴴ X = Aᴴ X, A being its own lower triangle made small."""
    h = _complex_gram(spark, sf_dir)
    a = _poisoned(h.scale(_SCALE), "L")
    return _both_parts(solve.trsm("L", "L", "C", "N", a, multiply.trmm("L", "L", "C", "N", a, h), 1, "tiles"), 3)


_register("trsm_complex_llc", _complex_solved, f"WITH {_H} SELECT i, j, re, im FROM h")


def _residual(factorized: bool, strategy: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = _pencil(spark, sf_dir)
        e = eigen.hegvd("L", a, factor.potrf("L", b) if factorized else b, factorized=factorized, strategy=strategy)
        return _coo(multiply.add(multiply.gemm(a, e.vectors), multiply.scale_columns(multiply.gemm(b, e.vectors), e.values), -1), 7)

    return run


_ZERO = "SELECT i, j, 0::DOUBLE AS re FROM range(64) a(i), range(64) b(j)"
_register("sygvd_residual", _residual(False, None), _ZERO)
_register("sygvd_residual_factorized", _residual(True, None), _ZERO)
_register("sygvd_residual_staged", _residual(False, "tiles"), _ZERO)
for _n in (93, 100):  # tiles that the cuts of the tree don't halve evenly
    _register(f"stedc_laplace_{_n}", lambda s, d, nb=_n: _rounded(eigen.tridiagonal_eigensolver(s, np.full(n := _vectors(s, d), 2.0), np.full(n - 1, -1.0), nb, strategy="tiles").values), _LAPLACE)
    _register(f"syevd_staged_{_n}", lambda s, d, nb=_n: _rounded(eigen.heevd("L", _laplace(s, _vectors(s, d), nb), strategy="tiles", band=nb).values), _LAPLACE)


def _kernel_results(a: np.ndarray) -> Iterator[tuple[str, np.ndarray | float]]:
    """Results of all kernels for a symmetric, positive definite tile."""
    low, up, spoiled, singular = np.tril(a), np.triu(a), a.copy(), np.tril(a)
    spoiled[2, 2], singular[1, 1] = -1, 0
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    w, z = K.stedc(d, e)
    v, taus, r = K.householder_panel(a[:, :4])
    yield "gemm", K.gemm(a, low, a, 2, 3, "C", "T")
    yield "hemm", K.hemm("R", "U", up, low)
    yield "herk", np.tril(K.herk("L", low, a, 1, 1))
    yield "her2k", np.triu(K.her2k("U", low, a, a))
    yield "trmm", K.trmm("L", "L", "C", "N", a, a)
    yield "trsm", K.trmm("R", "U", "T", "U", a, K.trsm("R", "U", "T", "U", a, a))
    yield "add", K.add(2, low, a)
    yield "scal", K.scal(3, a)
    yield "lacpy", K.lacpy("L", a, 2 * a)
    yield from ((f"lange_{kind}", K.lange(kind, a)) for kind in "M1IF")
    yield "lantr", K.lantr("F", "L", "U", a)
    yield "laset", K.laset("G", 2, 5, a)
    yield "hegst", np.tril(K.hegst(2, "L", a, a))
    yield "lauum", np.tril(K.lauum("L", a))
    factored = np.tril(K.potrf("L", a))
    yield "potrf", factored @ factored.T
    yield "potrf_info", K.potrf_info("L", spoiled)[1]
    yield "stedc", K.scale_columns(z, w) @ z.T
    yield "scale_columns", K.scale_columns(a, d)
    yield "trtri", np.tril(K.trtri("L", "N", a)) @ low
    yield "trtri_info", K.trtri_info("L", "N", singular)[1]
    yield "larft", (np.eye(len(a)) - v @ K.larft(v, taus) @ v.conj().T) @ r


def _kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kernel on the four diagonal tiles of G times 2^-15: numbers, or sums of the elements times 1 + i + 2 j."""
    tiles = TiledMatrix.from_coo(gram_gemm(spark, sf_dir).filter("i div 16 = j div 16"), 64, 64, 16, 16).scale(2.0**-15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ti, _, a in unpack(batch):
                rows = []
                for name, x in _kernel_results(a):
                    if isinstance(x, np.ndarray):
                        i, j = np.indices(x.shape)
                        x = (x * (1 + i + 2 * j)).sum()
                    rows.append((name, ti, float(x)))
                kernels, at, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kernels), pa.array(at, pa.int64()), pa.array(values)], ["kernel", "tile", "value"])

    return tiles.tiles.mapInArrow(run, "kernel string, tile long, value double").withColumn("value", F.round("value", 5))


def _kernels_sql() -> str:
    weighted = lambda name, table, v="v", where="true": f"SELECT '{name}' AS kernel, t AS tile, sum(({v}) * (1 + i + 2 * j)) AS value FROM {table} WHERE {where} GROUP BY t"
    product = lambda name, left, right, i, j, on: f"{name} AS (SELECT a.t, a.{i} AS i, b.{j} AS j, sum(a.v * b.v) AS v FROM {left} a JOIN {right} b ON a.t = b.t AND {on} GROUP BY a.t, a.{i}, b.{j})"
    plus = lambda table, times, plus_: f"(SELECT t, i, j, {times} * coalesce(p.v, 0) + {plus_} * d.v AS v FROM d LEFT JOIN {table} p USING (t, i, j))"
    number = lambda name, v: f"SELECT '{name}', t, {v} FROM d GROUP BY t"
    tables = [
        "d AS (SELECT i // 16 AS t, i % 16 AS i, j % 16 AS j, re * pow(2, -15) AS v FROM g WHERE i // 16 = j // 16)",
        "l AS (SELECT * FROM d WHERE i >= j)",
        product("dl", "d", "l", "i", "i", "a.j = b.j"),  # D Lᵀ
        product("ld", "l", "d", "i", "j", "a.j = b.i"),  # L D
        product("ll", "l", "l", "i", "i", "a.j = b.j"),  # L Lᵀ
        product("td", "l", "d", "j", "j", "a.i = b.i"),  # Lᵀ D
        product("tl", "l", "l", "j", "j", "a.i = b.i"),  # Lᵀ L
        product("tdl", "td", "l", "i", "j", "a.j = b.i"),  # Lᵀ D L
        "sums AS (SELECT t, j, sum(abs(v)) AS s FROM d GROUP BY t, j)",
    ]
    rows = [
        weighted("gemm", plus("dl", 2, 3)),
        weighted("hemm", "ld"),
        weighted("herk", plus("ll", 1, 1), where="i >= j"),
        weighted("her2k", "(SELECT t, i, j, x.v + y.v + d.v AS v FROM d JOIN ld x USING (t, i, j) JOIN dl y USING (t, i, j))", where="i <= j"),
        weighted("trmm", "td"),
        weighted("trsm", "d"),
        weighted("add", "d", "v * CASE WHEN i >= j THEN 3 ELSE 1 END"),
        weighted("scal", "d", "3 * v"),
        weighted("lacpy", "d", "v * CASE WHEN i >= j THEN 1 ELSE 2 END"),
        number("lange_M", "max(abs(v))"),
        "SELECT 'lange_1', t, max(s) FROM sums GROUP BY t",
        "SELECT 'lange_I', t, max(s) FROM sums GROUP BY t",
        number("lange_F", "sqrt(sum(v * v))"),
        number("lantr", "sqrt(16 + sum(CASE WHEN i > j THEN v * v ELSE 0 END))"),
        weighted("laset", "d", "CASE WHEN i = j THEN 5 ELSE 2 END"),
        weighted("hegst", "tdl", where="i >= j"),
        weighted("lauum", "tl", where="i >= j"),
        weighted("potrf", "d"),
        number("potrf_info", "3"),
        weighted("stedc", "d", where="abs(i - j) <= 1"),
        "SELECT 'scale_columns', d.t, sum(d.v * e.v * (1 + d.i + 2 * d.j)) FROM d JOIN d e ON d.t = e.t AND d.j = e.i AND e.i = e.j GROUP BY d.t",
        weighted("trtri", "d", "CASE WHEN i = j THEN 1 ELSE 0 END"),
        number("trtri_info", "2"),
        weighted("larft", "d", where="j < 4"),
    ]
    return f"WITH {_Q}, {', '.join(tables)} SELECT kernel, tile, round(value::DOUBLE, 5) AS value FROM ({' UNION ALL '.join(rows)})"


_register("tile_kernels", _kernels, _kernels_sql())


# -- divide and conquer in tiles, index operations over tables ---------------------------


def _tridiagonal_of(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """A tridiagonal matrix with two rows for each vector: the first two components on the diagonal, the next two beside it."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *(F.floor(F.col("embedding")[k].cast("double") * 64 + 0.5).cast("double").alias(f"v{k}") for k in range(4)))
    table = rows.orderBy("vec_id").toArrow()
    v = [table.column(f"v{k}").to_numpy() for k in range(4)]
    return np.column_stack(v[:2]).ravel(), np.column_stack(v[2:]).ravel()[:-1]


def _stedc_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the eigenvalues' powers, and the largest residual and departure from orthonormal columns, of order 2 x vectors."""
    d, e = _tridiagonal_of(spark, sf_dir)
    values, z = eigen.tridiagonal_eigensolver(spark, d, e, 125, strategy="tiles")
    w = values.orderBy("idx").toArrow().column("value").to_numpy()  # a number for each row
    worst = [F.round(F.lit(x), 9).alias(name) for x, name in ((divide.largest_residual(d, e, w, z), "residual"), (divide.apart_from_orthonormal(z), "apart"))]
    return values.agg(F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("trace"), F.round(F.sum(F.col("value") * F.col("value")), 5).alias("squares"), *worst)


_register(
    "stedc_tiles",
    _stedc_tiles,
    """WITH v AS (SELECT vec_id, floor(embedding[1]::DOUBLE * 64 + 0.5) AS a, floor(embedding[2]::DOUBLE * 64 + 0.5) AS b, floor(embedding[3]::DOUBLE * 64 + 0.5) AS c, floor(embedding[4]::DOUBLE * 64 + 0.5) AS d, vec_id = max(vec_id) OVER () AS last FROM embeddings)
SELECT 2 * count(*) AS n, sum(a + b) AS trace, sum(a * a + b * b + 2 * c * c + CASE WHEN last THEN 0 ELSE 2 * d * d END) AS squares, 0::DOUBLE AS residual, 0::DOUBLE AS apart FROM v""",
)


def _syevd_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G Z - Z W for the eigenpairs of G, merged in tiles of 8."""
    g = TiledMatrix.from_coo(gram_gemm(spark, sf_dir), 64, 64, 8, 8).stored("gram")
    e = eigen.heevd("L", _poisoned(g, "L"), strategy="tiles", band=4)
    return _coo(multiply.add(multiply.gemm(g, e.vectors), multiply.scale_columns(e.vectors, e.values), -1), 6)


_register("syevd_residual_tiles", _syevd_tiles, "SELECT i, j, 0::DOUBLE AS re FROM range(64) a(i), range(64) b(j)")


def _typed(spark: SparkSession, sf_dir: str) -> TiledMatrix:
    """Q with columns that are zero below a cut at a third of its rows (j % 3 = 0), above it (j % 3 = 2) or dense, times small integers."""
    q = q_matrix(spark, sf_dir)
    split = q.m // 3
    kinds = np.array([divide.UPPER, divide.DENSE, divide.LOWER])[np.arange(64) % 3]

    def masked(ti: int, tj: int, x: np.ndarray) -> np.ndarray:
        i, kind = np.arange(ti * 512, ti * 512 + x.shape[0])[:, None], kinds[tj * GB : tj * GB + x.shape[1]][None, :]
        return np.where((kind == divide.UPPER) & (i >= split) | (kind == divide.LOWER) & (i < split), 0, x)

    return divide.typed_product(q.map_tiles(masked), split, kinds, lambda i, j: (i + 3.0 * j) % 7 - 2, 20)


_register(
    "zero_block_product",
    lambda s, d: _coo(_typed(s, d)),
    f"WITH {_Q}, s AS (SELECT (max(i) + 1) // 3 AS cut FROM q) SELECT i, c.j, sum(CASE WHEN q.j % 3 = 0 AND i >= cut OR q.j % 3 = 2 AND i < cut THEN 0 ELSE v END * ((q.j + 3 * c.j) % 7 - 2)) AS re FROM q, s, range(20) c(j) GROUP BY i, c.j",
)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of all vectors, numbered: (idx, value)."""
    return quantised(spark, sf_dir).select((F.col("i") * 64 + F.col("j")).alias("idx"), F.col("v").alias("value"))


_E = "e AS (SELECT i * 64 + j AS idx, v AS value FROM q)"
_register("sort_index", lambda s, d: shape.sort_index(_elements(s, d)), f"WITH {_Q}, {_E} SELECT row_number() OVER (ORDER BY value, idx) - 1 AS pos, idx AS src FROM e")
_register(
    "stable_partition",
    lambda s, d: shape.stable_partition(_elements(s, d).selectExpr("idx", "cast(pmod(value, 4) as int) type")),
    f"WITH {_Q}, {_E}, t AS (SELECT idx, ((value % 4 + 4) % 4)::INT AS type FROM e) SELECT row_number() OVER (ORDER BY type, idx) - 1 AS pos, idx AS src, type FROM t",
)


def _merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted first and second components of all vectors, merged."""
    runs = [shape.ranked(quantised(spark, sf_dir).filter(F.col("j") == k).selectExpr("v value", "i"), "value", "i").selectExpr("pos idx", "value") for k in (0, 1)]
    return shape.merge_sorted(*runs)


_register(
    "merge_sorted",
    _merged_runs,
    f"WITH {_Q}, r AS (SELECT j::INT AS run, row_number() OVER (PARTITION BY j ORDER BY v, i) - 1 AS src, v FROM q WHERE j < 2) SELECT row_number() OVER (ORDER BY v, run, src) - 1 AS pos, run, src FROM r",
)


# -- stages of the eigensolver whose vectors stay in tables -------------------------------


def _turned_back(middle: TiledMatrix, q: TiledMatrix) -> DataFrame:
    """Q M Qᴴ in whole numbers."""
    return _coo(multiply.gemm(multiply.gemm(q, middle), q, opb="C"), 0)


def _chased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five diagonals of G, made tridiagonal by a wavefront of groups of four sweeps, and back."""
    g = TiledMatrix.from_coo(gram_gemm(spark, sf_dir).filter("abs(i - j) <= 2"), 64, 64, 16, 16)
    t = eigen.band_to_tridiagonal(g, 2, group=4)
    q = eigen.bt_band_to_tridiagonal(generators.identity(spark, 64, 16), t.reflectors, group=2)
    return _turned_back(TiledMatrix.from_numpy(spark, np.diag(t.d) + np.diag(t.e, 1) + np.diag(t.e, -1), 16, 16), q)


_register("band_chase_wavefront", _chased, f"WITH {_Q} SELECT i, j, CASE WHEN abs(i - j) <= 2 THEN re ELSE 0 END AS re FROM g")


def _reduced_by_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G by way of its band form, the panels being factored by trees of tasks."""
    band = eigen.reduction_to_band(TiledMatrix.from_coo(gram_gemm(spark, sf_dir), 64, 64, 8, 8), 8, held=64)
    return _turned_back(band.matrix, eigen.bt_reduction_to_band(generators.identity(spark, 64, 8), band.panels))


_register("red2band_tree", _reduced_by_trees, f"WITH {_Q} SELECT i, j, re FROM g")


def _tall_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q again, from its reflectors: R above zeros less V T V1ᴴ R."""
    q = q_matrix(spark, sf_dir).retile(128, 64)
    v, t, r = panel.tall_skinny_qr(q)
    top = v.submatrix(0, 0, 64, 64).to_numpy()
    turned = TiledMatrix.from_numpy(spark, t @ (top.conj().T @ r), 64, 64)
    above = TiledMatrix.from_numpy(spark, r, 64, 64).window((0, 0), (64, 64), (0, 0), (q.m, 64), (128, 64))
    return _coo(multiply.add(above, multiply.gemm(v, turned), -1), 6)


_register("tall_skinny_qr", _tall_qr, f"WITH {_Q} SELECT i, j, v AS re FROM q")


# -- raw and text files, ranges of zeros --------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _column_major_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q through raw column-major files whose columns stand three elements further apart than they are long."""
    q, path = q_matrix(spark, sf_dir), _folder(spark, "raw")
    columnmajor.write(q, path, q.m + 3)
    return _coo(columnmajor.read(spark, path, q.m, q.n, 100, GB, q.m + 3))


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q through text files."""
    path = _folder(spark, "text")
    storage.write_csv(q_matrix(spark, sf_dir), path)
    return _coo(storage.read_csv(spark, path, 128, 16))


_register("column_major_files", _column_major_files, f"WITH {_Q} SELECT i, j, v AS re FROM q")
_register("csv_files", _csv_files, f"WITH {_Q} SELECT i, j, v AS re FROM q")
_register("csv_rows", lambda s, d: storage.csv_lines(q_matrix(s, d)), f"WITH {_Q} SELECT i, string_agg(v::INT::VARCHAR || ',', '' ORDER BY j) AS line FROM q GROUP BY i")
_register("set_zero_range", lambda s, d: _coo(g_matrix(s, d).cleared((0, 1), (2, 3)), None, False), f"WITH {_Q} SELECT i, j, re FROM g WHERE re <> 0 AND NOT (i < 48 AND j >= 24)")
