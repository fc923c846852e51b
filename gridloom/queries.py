"""Registered queries over the array, table, stream and task operators, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import GridArray
from gridloom.operators import elementwise, fourier, indexing, linalg, reduce, reshape, sorting, stencil, tables
from gridloom.plans import tasks
from gridloom.plans.durable import fresh_path, materialize
from gridloom.sources import arrays
from gridloom.streaming import region


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}

#: Lines of orders that a task holds.
ORDER_LINES = 400_000


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = Query(f, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> GridArray:
    """The embeddings as a dense matrix; its height comes from the footer's row count."""
    df = table(spark, sf_dir, "embeddings")
    return arrays.from_array_column(df, "vec_id", "embedding", (df.count(), 64))


def vector(spark: SparkSession, sf_dir: str) -> GridArray:
    df = table(spark, sf_dir, "events")
    return arrays.from_columns(df, ["event_id"], "value", (df.count(),))


def sparse(spark: SparkSession, sf_dir: str) -> GridArray:
    """Quantities by order and supplier; orders are dealt to tasks of at most about ``ORDER_LINES`` lines, which sum up and join where they are."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    top = lines.agg(F.max("l_orderkey"), F.max("l_suppkey"), F.count("*")).first()
    dealt = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-top[2] // ORDER_LINES)), "l_orderkey")
    df = dealt.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return arrays.from_columns(df, ["l_orderkey", "l_suppkey"], "v", (top[0] + 1, top[1] + 1), True)


def gram(spark: SparkSession, sf_dir: str) -> GridArray:
    return linalg.syrk(matrix(spark, sf_dir))


def spd(spark: SparkSession, sf_dir: str) -> GridArray:
    """The embeddings' Gram matrix plus the identity."""
    g = gram(spark, sf_dir)
    return g.values(F.col("v") + F.when(F.col("i0") == F.col("i1"), 1.0).otherwise(0.0))


def rounded(a: GridArray, digits: int = 5) -> DataFrame:
    """Cells rounded, with zero's sign dropped."""
    return a.df.select(*a.index, (F.round("v", digits) + 0.0).alias("v"))


E_ = "e as (select vec_id::bigint as i0, generate_subscripts(embedding, 1) - 1 as i1, unnest(embedding)::double as v from embeddings)"
X_ = "x as (select event_id as i0, value as v from events)"
N_ = "n as (select count(*) as n from events)"
S_ = "s as (select l_orderkey as i0, l_suppkey as i1, sum(l_quantity) as v from lineitem group by 1, 2)"
W = f"with {E_} "


@query("entry_colmeans", W + "select 0::bigint as i0, i1, round(avg(v * 2 + 1), 5) + 0.0 as v from e group by i1")
def _(s, d):
    return rounded(reduce.reduce(elementwise.broadcast(lambda x, a, b: x * a + b, matrix(s, d), 2.0, 1.0), "mean", (0,)))


for _op, _sql in {"sum": "sum(v)", "prod": "product(1 + v / 1e3)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "var": "var_samp(v)", "std": "stddev_samp(v)", "norm": "sqrt(sum(v * v))"}.items():
    _f = (lambda v: 1 + v / 1e3) if _op == "prod" else None
    for _dims, _sel, _group in ((None, "", ""), ((0,), "0::bigint as i0, i1, ", " group by i1"), ((1,), "i0, 0::bigint as i1, ", " group by i0")):
        if _dims is None and _op == "prod":
            continue
        _name = f"{_op}_" + ("all" if _dims is None else f"dims{_dims[0] + 1}")
        query(_name, f"{W}select {_sel}round({_sql}, 5) + 0.0 as v from e{_group}")(lambda s, d, o=_op, k=_dims, f=_f: rounded(reduce.reduce(matrix(s, d), o, k, f)))


@query("extrema_all", f"with {X_} select round(min(v), 6) as lo, round(max(v), 6) as hi from x")
def _(s, d):
    return reduce.reduce(vector(s, d), "extrema").df.select(F.round("v.min", 6).alias("lo"), F.round("v.max", 6).alias("hi"))


@query("sum_init", f"with {X_} select round(5 + sum(v), 4) as v from x")
def _(s, d):
    return rounded(reduce.reduce(vector(s, d), "sum", init=5.0), 4)


@query("mapreduce_abs2", W + "select round(sum(v * v), 4) + 0.0 as v from e")
def _(s, d):
    return rounded(reduce.reduce(matrix(s, d), "sum", f=lambda v: v * v), 4)


@query("fold_dims2", W + "select i0, 0::bigint as i1, round(sum(abs(v)), 5) + 0.0 as v from e group by i0")
def _(s, d):
    return rounded(reduce.fold(matrix(s, d), lambda a, x: a + x, 0.0, (1,), F.abs))


@query("norm_upper", W + "select round(sqrt(sum(v * v)), 5) + 0.0 as v from e where i0 <= i1")
def _(s, d):
    return rounded(reduce.reduce(reduce.triangle(matrix(s, d)), "norm"))


@query("is_symmetric", "select * from (values ('gram', true), ('changed', false)) t(k, equal)")
def _(s, d):
    g = gram(s, d)
    changed = indexing.set_value(g, [(3, 4), (5, 6)], -1.0)
    return reduce.is_symmetric(g, 1e-9).select(F.lit("gram").alias("k"), "equal").union(reduce.is_symmetric(changed, 1e-9).select(F.lit("changed"), "equal"))


@query("is_finite", "select bool_and(isfinite(value)) as finite from events")
def _(s, d):
    return reduce.is_finite(vector(s, d))


@query("histogram", "select event_type as bucket, count(*) as n from events group by 1")
def _(s, d):
    return reduce.histogram(table(s, d, "events"), F.col("event_type"))


@query("bcast_scalar", W + "select i0, i1, round(sin(v) + 1, 5) + 0.0 as v from e")
def _(s, d):
    return rounded(elementwise.broadcast(lambda x, y: F.sin(x) + y, matrix(s, d), 1.0))


@query("bcast_vec_mat", W + ", m as (select i0, avg(v) as m from e group by i0) select e.i0, e.i1, round(v - m, 5) + 0.0 as v from e join m using (i0)")
def _(s, d):
    a = matrix(s, d)
    return rounded(elementwise.broadcast(lambda x, y: x - y, a, reduce.reduce(a, "mean", (1,))))


@query("bcast_outer", W + ", m as (select i1, avg(v) as m from e group by i1), r as (select i0, max(v) as r from e group by i0) select r.i0, m.i1, round(r * m, 5) + 0.0 as v from r, m")
def _(s, d):
    a = matrix(s, d)
    return rounded(elementwise.broadcast(lambda x, y: x * y, reduce.reduce(a, "max", (1,)), reduce.reduce(a, "mean", (0,))))


@query("add_mat", W + "select i0, i1, round(v + v * v, 5) + 0.0 as v from e")
def _(s, d):
    a = matrix(s, d)
    return rounded(a + a.values(F.col("v") * F.col("v")))


@query("sub_mat", W + "select i0, i1, round(v - 3 * v, 5) + 0.0 as v from e")
def _(s, d):
    a = matrix(s, d)
    return rounded(a - a * 3.0)


@query("div_scalar", W + "select i0, i1, round(v / 7, 6) + 0.0 as v from e")
def _(s, d):
    return rounded(matrix(s, d) / 7.0, 6)


@query("map_affine", f"with {X_} select i0, round(2 * v + 1, 5) + 0.0 as v from x")
def _(s, d):
    return rounded(elementwise.map_cells(lambda v: 2 * v + 1, vector(s, d)))


@query("scale_diag", W + "select i0, i1, round(v * (i0 + 1), 4) + 0.0 as v from e")
def _(s, d):
    a = matrix(s, d)
    return rounded(elementwise.scale_rows(arrays.allocate(s, a.shape[:1], lambda i: F.col(i[0]) + 1.0), a), 4)


@query("eq_all", "select * from (values ('same', true), ('changed', false), ('near', true)) t(k, equal)")
def _(s, d):
    a = matrix(s, d)
    named = lambda k, x: x.select(F.lit(k).alias("k"), "equal")
    changed = indexing.set_value(a, [(7, 8), (9, 10)], 1e6)
    return named("same", elementwise.equal(a, a.T.T)).union(named("changed", elementwise.equal(a, changed))).union(named("near", elementwise.equal(a, a + 1e-9, 1e-6)))


@query("alloc_zeros_ones", "select count(*) as n, 1200.0 as total from range(1200)")
def _(s, d):
    both = arrays.zeros(s, (40, 30)) + arrays.ones(s, (40, 30))
    return both.df.agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("alloc_eye", "select range as i0, range as i1, 1.0::double as v from range(30)")
def _(s, d):
    return arrays.eye(s, 40, 30).df


@query("alloc_random")
def _(s, d):
    kinds = [arrays.rand(s, (100, 100), 3), arrays.randn(s, (100, 100), 3), arrays.sprand(s, (100, 100), 0.1, 3), arrays.refill(arrays.zeros(s, (40, 40)), "laplace", 5)]
    out = None
    for n, a in enumerate(kinds):
        own = a.df.agg(F.lit(n).alias("kind"), F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("deviation"))
        out = own if out is None else out.union(own)
    return out


@query("tile_sums", W + "select (i0 // 100)::int as b0, (i1 // 16)::int as b1, round(sum(v), 5) + 0.0 as v from e group by 1, 2")
def _(s, d):
    return arrays.tiles(matrix(s, d), (100, 16)).groupBy("b0", "b1").agg((F.round(F.sum("v"), 5) + 0.0).alias("v"))


@query("assign_tiles", W + "select (i0 // 10)::int as b0, ((i0 // 10) % 4)::int as part, count(*) as n from e group by 1, 2")
def _(s, d):
    """Rows of tiles in turn over four partitions: where each row of tiles lies."""
    placed = arrays.assign(matrix(s, d), (10, 16), "cyclicrow", 4).withColumn("part", F.spark_partition_id())
    return placed.groupBy("b0", "part").agg(F.count("*").alias("n"))


@query("save_load", W + "select i0, i1, round(v, 5) + 0.0 as v from e")
def _(s, d):
    path = fresh_path(s, "array")
    arrays.save(matrix(s, d), path)
    return rounded(arrays.load(s, path))


@query("slice_range", W + "select i0 - 10 as i0, i1 - 3 as i1, round(v, 5) + 0.0 as v from e where i0 >= 10 and i0 < 50 and i1 >= 3 and i1 < 9")
def _(s, d):
    return rounded(indexing.take(matrix(s, d), slice(10, 50), slice(3, 9)))


@query("slice_drop", W + "select i1 as i0, round(v, 5) + 0.0 as v from e where i0 = 7")
def _(s, d):
    return rounded(indexing.take(matrix(s, d), 7, slice(None)))


@query("gather_repeated", W + ", k as (select * from (values (0::bigint, 5), (1, 2), (2, 5), (3, 40)) t(p, i0)) select p as i0, i1, round(v, 5) + 0.0 as v from e join k using (i0)")
def _(s, d):
    return rounded(indexing.take(matrix(s, d), [5, 2, 5, 40], slice(None)))


@query("linear_index", W + "select round(v, 5) + 0.0 as v from e where i0 = 123 % (select count(*) from embeddings) and i1 = 123 // (select count(*) from embeddings)")
def _(s, d):
    return rounded(indexing.linear(matrix(s, d), 123))


@query("first_last", f"with {X_}, {N_} select 'first' as k, round(v, 6) as v from x where i0 = 0 union all select 'last', round(v, 6) from x, n where i0 = n - 1")
def _(s, d):
    a = vector(s, d)
    one = lambda k, x: x.df.select(F.lit(k).alias("k"), F.round("v", 6).alias("v"))
    return one("first", indexing.first(a)).union(one("last", indexing.last(a)))


@query("setindex_fn", W + "select i0, i1, round(case when i0 between 2 and 7 and i1 between 1 and 6 then 1.0 else v end, 5) + 0.0 as v from e")
def _(s, d):
    return rounded(indexing.set_value(matrix(s, d), [(2, 8), (1, 7)], 1.0))


@query("set_block", W + "select a.i0, a.i1, round(coalesce(b.v, a.v), 5) + 0.0 as v from e a left join e b on b.i0 = a.i0 - 20 and b.i1 = a.i1 - 8 and b.i0 between 3 and 5 and b.i1 between 4 and 9")
def _(s, d):
    a = matrix(s, d)
    return rounded(indexing.set_block(a, [(23, 26), (12, 18)], indexing.take(a, slice(3, 6), slice(4, 10))))


@query("transpose", W + "select i1 as i0, i0 as i1, round(v, 5) + 0.0 as v from e")
def _(s, d):
    return rounded(matrix(s, d).T)


@query("permute3", "select (range % 5) as i0, (range // 20) as i1, (range // 5 % 4) as i2, range::double as v from range(60)")
def _(s, d):
    a = arrays.allocate(s, (3, 4, 5), lambda i: (F.col(i[0]) * 20 + F.col(i[1]) * 5 + F.col(i[2])).cast("double"))
    return reshape.permute(a, (2, 0, 1)).df


@query("vcat", W + ", n as (select count(*) as n from embeddings) select i0, i1, round(v, 5) + 0.0 as v from e union all select i0 + n, i1, round(2 * v, 5) + 0.0 from e, n")
def _(s, d):
    a = matrix(s, d)
    return rounded(reshape.concat(0, a, a * 2.0))


@query("hcat", W + "select i0, i1, round(v, 5) + 0.0 as v from e union all select i0, i1 + 64, round(2 * v, 5) + 0.0 from e")
def _(s, d):
    a = matrix(s, d)
    return rounded(reshape.concat(1, a, a * 2.0))


@query("mirror", W + "select i0, i1, round(v, 5) + 0.0 as v from e where i0 <= i1 union all select i1, i0, round(v, 5) + 0.0 from e where i0 < i1")
def _(s, d):
    return rounded(reshape.mirror(matrix(s, d)))


@query("sort_asc", f"with {X_} select row_number() over (order by v, i0) - 1 as i0, round(v, 6) as v from x")
def _(s, d):
    return sorting.sort(vector(s, d)).df.select("i0", F.round("v", 6).alias("v"))


@query("sort_desc", f"with {X_} select row_number() over (order by v desc, i0) - 1 as i0, round(v, 6) as v from x")
def _(s, d):
    return sorting.sort(vector(s, d), reverse=True).df.select("i0", F.round("v", 6).alias("v"))


@query("sort_by_key", f"with {X_} select row_number() over (order by abs(v - 50), i0) - 1 as i0, round(v, 6) as v from x")
def _(s, d):
    return sorting.sort(vector(s, d), by=lambda v: F.abs(v - 50)).df.select("i0", F.round("v", 6).alias("v"))


def _at(p: str, c: str = "v") -> str:
    """A cell of x at a position, as SQL."""
    return f"(select {c} from x y where y.i0 = {p})"


#: SQL of the value one position outside, left and right, by boundary.
EDGES = {
    "wrap": (stencil.wrap(), _at("n - 1"), _at("0")),
    "pad": (stencil.pad(2.0), "2.0", "2.0"),
    "clamp": (stencil.clamp(), _at("0"), _at("n - 1")),
    "reflect": (stencil.reflect(), _at("0"), _at("n - 1")),
    "mirror": (stencil.reflect(False), _at("1"), _at("n - 2")),
    "antireflect": (stencil.anti_reflect(), f"-{_at('0')}", f"-{_at('n - 1')}"),
    "extrap": (stencil.extrapolate(), f"2 * {_at('0')} - {_at('1')}", f"2 * {_at('n - 1')} - {_at('n - 2')}"),
}
for _kind, (_rule, _left, _right) in EDGES.items():
    _sql = (
        f"with {X_}, {N_}, edge as (select {_left} as l, {_right} as r from n) select i0, round(coalesce(lag(v) over (order by i0), l) + v + coalesce(lead(v) over (order by i0), r), 5) + 0.0 as v from x, edge"
    )
    query(f"st1_{_kind}", _sql)(lambda s, d, r=_rule: rounded(stencil.neighbours(vector(s, d), 1, r)))

GRID = "g as (select vec_id::bigint as i0, generate_subscripts(embedding, 1) - 1 as i1, unnest(embedding)::double as v from embeddings), m as (select count(*) as m from embeddings), o as (select * from (values (-1), (0), (1)) t(o))"


@query("st2_wrap", f"with {GRID} select (g.i0 + a.o + m) % m as i0, (g.i1 + b.o + 64) % 64 as i1, round(sum(v), 4) + 0.0 as v from g, o a, o b, m group by 1, 2")
def _(s, d):
    return rounded(stencil.neighbours(matrix(s, d), 1, stencil.wrap()), 4)


@query(
    "st2_mixed",
    f"with {GRID}, t as (select i0, i1, a.o as p, b.o as q from g, o a, o b) select t.i0, t.i1, round(sum(case when t.i1 + q < 0 or t.i1 + q > 63 then 1.5 else g.v end), 4) + 0.0 as v "
    "from t, m left join g on g.i0 = least(greatest(t.i0 + p, 0), m - 1) and g.i1 = least(greatest(t.i1 + q, 0), 63) group by 1, 2",
)
def _(s, d):
    return rounded(stencil.neighbours(matrix(s, d), 1, (stencil.clamp(), stencil.pad(1.5))), 4)


@query("st_max_fold", f"with {X_} select i0, round(greatest(coalesce(lag(v) over (order by i0), v), v, coalesce(lead(v) over (order by i0), v)), 6) as v from x")
def _(s, d):
    return rounded(stencil.neighbours(vector(s, d), 1, stencil.clamp(), fold=F.array_max), 6)


@query(
    "life_step",
    f"with {GRID}, c as (select i0, i1, (v > 0)::bigint as v from g), t as (select (c.i0 + a.o + m) % m as i0, (c.i1 + b.o + 64) % 64 as i1, sum(v) as s from c, o a, o b, m group by 1, 2) "
    "select t.i0, t.i1, (s - v = 3 or (v = 1 and s - v = 2))::bigint as v from t join c using (i0, i1)",
)
def _(s, d):
    return stencil.life_step(matrix(s, d).values((F.col("v") > 0).cast("bigint"))).df


@query("gram", W + "select a.i1 as i0, b.i1 as i1, round(sum(a.v * b.v), 4) + 0.0 as v from e a join e b using (i0) group by 1, 2")
def _(s, d):
    return rounded(gram(s, d), 4)


@query("matvec", W + "select a.i0, round(sum(a.v * b.v), 4) + 0.0 as v from e a join e b on b.i0 = 0 and b.i1 = a.i1 group by 1")
def _(s, d):
    a = matrix(s, d)
    return rounded(linalg.matmul(a, indexing.take(a, 0, slice(None))), 4)


P2 = ", p as (select a.i1 as i0, b.i1 as i1, sum(a.v * b.v) as v from e a join e b using (i0) group by 1, 2)"


@query("matmul", W + P2 + " select e.i0, p.i1, round(sum(e.v * p.v) / 1e3, 4) + 0.0 as v from e join p on e.i1 = p.i0 group by 1, 2")
def _(s, d):
    return rounded(linalg.matmul(matrix(s, d), gram(s, d)) / 1e3, 4)


@query("matmul_tiled", W + P2 + " select e.i0, p.i1, round(sum(e.v * p.v) / 1e3, 4) + 0.0 as v from e join p on e.i1 = p.i0 group by 1, 2")
def _(s, d):
    return rounded(linalg.matmul_tiled(matrix(s, d), gram(s, d), 64) / 1e3, 4)


@query("power2", W + P2 + " select a.i0, b.i1, round(sum(a.v * b.v) / 1e6, 4) + 0.0 as v from p a join p b on a.i1 = b.i0 group by 1, 2")
def _(s, d):
    return rounded(linalg.power(gram(s, d), 2) / 1e6, 4)


@query("spmv", f"with {S_} select i0, round(sum(v * (1.0 / (1 + i1))), 4) + 0.0 as v from s group by 1")
def _(s, d):
    a = sparse(s, d)
    return rounded(linalg.matmul(a, arrays.allocate(s, a.shape[1:], lambda i: 1.0 / (1 + F.col(i[0])))), 4)


@query("spgemm", f"with {S_} select a.i1 as i0, b.i1 as i1, round(sum(a.v * b.v), 2) + 0.0 as v from s a join s b using (i0) group by 1, 2")
def _(s, d):
    a = sparse(s, d)
    return rounded(linalg.matmul(a.T, a), 2)


def _kinds(**parts: DataFrame) -> DataFrame:
    """Cells ``i0, i1, v`` of several matrices, each under its name."""
    out = None
    for name, df in parts.items():
        own = df.select(F.lit(name).alias("kind"), "i0", "i1", "v")
        out = own if out is None else out.union(own)
    return out


def _column(a: GridArray) -> DataFrame:
    """A matrix's first column, rounded."""
    return rounded(GridArray(a.df.filter("i1 = 0"), a.shape))


SPD_ = P2 + ", g as (select i0, i1, v + (i0 = i1)::int as v from p)"
ONE_ = "select a.range as i0, b.range as i1, (a.range = b.range)::int::double as v from range(64) a, range(64) b"
X0_ = "select range as i0, round(1.0 / (1.3::double + range), 4) as v from range(64)"


def _x0(s: SparkSession) -> GridArray:
    """What the solvers are to find: 1 / 1.3, 1 / 2.3, 1 / 3.3, ..., none of which ends in a 5 where it is rounded."""
    return arrays.allocate(s, (64,), lambda i: 1.0 / (1.3 + F.col(i[0])))


@query("cholesky_residual", W + SPD_ + ", h as (select sqrt(v) as h from g where i0 = 0 and i1 = 0) select 'product' as kind, i0, i1, round(v, 4) + 0.0 as v from g union all select 'first', i0, 0::bigint, round(v / h, 5) + 0.0 from g, h where i1 = 0")
def _(s, d):
    """The factor times its transpose, and the factor's first column; three panels."""
    f = linalg.cholesky(spd(s, d), block=24)
    return _kinds(product=rounded(linalg.matmul(f, f.T), 4), first=_column(f))


@query("lu_residual", W + SPD_ + " select 'product' as kind, i0, i1, round(v, 4) + 0.0 as v from g union all select 'large', 0, 0, 0.0")
def _(s, d):
    """The factors' product, its rows put back in their order, and how many multipliers are over 1."""
    low, up, order = linalg.lu(spd(s, d), block=24)
    product = linalg.matmul(low, up).df.join(order.df.select("i0", F.col("v").cast("bigint").alias("r")), "i0").select(F.col("r").alias("i0"), "i1", "v")
    large = low.df.agg(F.lit(0).cast("bigint").alias("i0"), F.lit(0).cast("bigint").alias("i1"), F.count_if(F.abs("v") > 1 + 1e-9).cast("double").alias("v"))
    return _kinds(product=rounded(GridArray(product, (64, 64)), 4), large=large)


@query("lu_plain", W + SPD_ + " select 'product' as kind, i0, i1, round(v, 4) + 0.0 as v from g union all select 'first', i0, 0::bigint, round(g.v / h.v, 5) + 0.0 from g, (select v from g where i0 = 0 and i1 = 0) h where i1 = 0")
def _(s, d):
    """Without exchange of rows: the product, and the lower factor's first column."""
    low, up, _ = linalg.lu(spd(s, d), pivot=False, block=24)
    return _kinds(product=rounded(linalg.matmul(low, up), 4), first=_column(low))


@query("qr_residual", W + f"select 'product' as kind, i0, i1, round(v, 4) + 0.0 as v from e union all select 'gram', i0, i1, v from ({ONE_}) union all select 'first', i0, 0, round(v / (select sqrt(sum(v * v)) from e where i1 = 0), 5) + 0.0 from e where i1 = 0")
def _(s, d):
    """The factors' product, that q's columns are orthonormal, and its first column."""
    q, r = linalg.qr(matrix(s, d))
    q = GridArray(materialize(q.df, "q"), q.shape)
    return _kinds(product=rounded(linalg.matmul(q, r), 4), gram=rounded(linalg.syrk(q)), first=_column(q))


@query("svdvals", W + P2 + f"select 'product' as kind, i0, i1, round(v, 4) + 0.0 as v from e union all select 'left', i0, i1, v from ({ONE_}) union all select 'right', i0, i1, v from ({ONE_}) union all select 'squares', i0, i1, round(v, 3) + 0.0 from p union all select 'ascents', 0, 0, 0.0")
def _(s, d):
    """The factors' product, that both are orthonormal, the squares of the values by the right factor, and how often the values ascend."""
    a = matrix(s, d)
    u, values, vt = linalg.svd(a)
    scaled = elementwise.scale_rows(values, vt)
    pairs = values.df.alias("a").join(values.df.alias("b"), F.expr("a.i0 + 1 = b.i0"))
    ascents = pairs.agg(F.lit(0).cast("bigint").alias("i0"), F.lit(0).cast("bigint").alias("i1"), F.count_if(F.expr("b.v > a.v")).cast("double").alias("v"))
    return _kinds(product=rounded(linalg.matmul(u, scaled), 4), left=rounded(linalg.syrk(u)), right=rounded(linalg.syrk(vt, outer=True)), squares=rounded(linalg.syrk(scaled), 3), ascents=ascents)


@query("solve_residual", X0_)
def _(s, d):
    a = spd(s, d)
    return rounded(linalg.solve(a, linalg.matmul(a, _x0(s)), "cholesky"), 4)


@query("solve_lu", X0_)
def _(s, d):
    """A matrix that is not symmetric, by LU."""
    a = elementwise.scale_rows(arrays.allocate(s, (64,), lambda i: 1.0 + F.col(i[0])), spd(s, d))
    return rounded(linalg.solve(a, linalg.matmul(a, _x0(s))), 4)


@query("triangular_solves", "select kind, i0, round(1.0 / (1.3::double + i0), 4) as v from (select range as i0 from range(64)), (values ('upper N'), ('upper T'), ('lower N'), ('lower T'), ('right')) k(kind)")
def _(s, d):
    """Upper and lower triangles, plain and transposed, from the left, and one from the right; blocks of 24 rows."""
    a, x = spd(s, d), _x0(s)
    out = None
    for kind, upper, op in (("upper N", True, "N"), ("upper T", True, "T"), ("lower N", False, "N"), ("lower T", False, "T")):
        t = reduce.triangle(a, upper)
        found = linalg.triangular_solve(a, linalg.matmul(t.T if op == "T" else t, x), upper, op=op, block=24)
        own = rounded(found, 4).select(F.lit(kind).alias("kind"), "i0", "v")
        out = own if out is None else out.union(own)
    row = GridArray(x.df.select(F.lit(0).cast("bigint").alias("i0"), F.col("i0").alias("i1"), "v"), (1, 64))
    found = linalg.triangular_solve(a, linalg.matmul(row, reduce.triangle(a)), True, "right", block=24)
    return out.union(rounded(found, 4).select(F.lit("right"), F.col("i1").alias("i0"), "v"))


@query("least_squares", W + "select i1 as i0, round(sum(v * sin(i0)), 4) + 0.0 as v from e group by 1")
def _(s, d):
    """The residual of a tall system is orthogonal to its columns: a.T @ a @ x is a.T @ b."""
    a = matrix(s, d)
    x = linalg.solve(a, arrays.allocate(s, a.shape[:1], lambda i: F.sin(F.col(i[0]).cast("double"))))
    return rounded(linalg.matmul(a.T, linalg.matmul(a, x)), 4)


@query("least_norm", W + ", r as (select e.i0, sum(e.v / (1.3::double + e.i1)) as v from e where i0 < 16 group by 1) select i0, round(v, 4) + 0.0 as v from r")
def _(s, d):
    """A wide system, of all columns and sixteen rows, has its right side met."""
    a = matrix(s, d)
    wide = GridArray(materialize(indexing.take(a, slice(0, 16), slice(None)).df, "wide"), (16, 64))
    x = linalg.solve(wide, linalg.matmul(wide, _x0(s)))
    return rounded(linalg.matmul(wide, x), 4)


@query("inverse_residual", ONE_)
def _(s, d):
    a = spd(s, d)
    return rounded(linalg.matmul(linalg.inverse(a), a))


@query("cg_residual", X0_)
def _(s, d):
    """Conjugate gradients on the Gram matrix with its height on the diagonal."""
    a, g = matrix(s, d), gram(s, d)
    g = g.values(F.col("v") + F.when(F.col("i0") == F.col("i1"), float(a.shape[0])).otherwise(0.0))
    g = GridArray(materialize(g.df, "spd"), g.shape)
    return rounded(linalg.conjugate_gradient(g, linalg.matmul(g, _x0(s)), 1e-9), 4)


@query("gemm_tn", W + P2 + " select i0, i1, round(1.5 * v, 4) + 0.0 as v from p")
def _(s, d):
    """2 * a.T @ a - 0.5 * c with c = a.T @ a."""
    a = matrix(s, d)
    return rounded(linalg.multiply_into(gram(s, d), a, a, 2.0, -0.5, "TN"), 4)


@query("power0", ONE_)
def _(s, d):
    return linalg.power(gram(s, d), 0).dense().df


@query("fft_parseval", f"with {X_} select round(sum(v * v), 2) as energy from x")
def _(s, d):
    a = vector(s, d)
    return fourier.transform(fourier.complex_cells(a), a.shape).agg(F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / a.cells, 2).alias("energy"))


@query("fft_coefficients", f"with {X_}, {N_}, k as (select range as k from range(8)) select k as i0, round(sum(v * cos(2 * pi() * k * i0 / n)), 3) + 0.0 as re, round(-sum(v * sin(2 * pi() * k * i0 / n)), 3) + 0.0 as im from x, n, k group by 1")
def _(s, d):
    """The first coefficients of the whole vector's transform; lines of 4096 cells a task, so it is laid out as a matrix or a convolution."""
    a = vector(s, d)
    made = fourier.transform(fourier.complex_cells(a), a.shape, line_cells=4096)
    return made.filter("i0 < 8").select("i0", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query("fft2_coefficients", W + ", m as (select count(*) as m from embeddings), k as (select a.range as p, b.range as q from range(4) a, range(4) b) select p as i0, q as i1, round(sum(v * cos(2 * pi() * (p * i0 / m + q * i1 / 64))), 3) + 0.0 as re, round(-sum(v * sin(2 * pi() * (p * i0 / m + q * i1 / 64))), 3) + 0.0 as im from e, m, k group by 1, 2")
def _(s, d):
    """The corner coefficients of the whole matrix's transform."""
    a = matrix(s, d)
    made = fourier.transform(fourier.complex_cells(a), a.shape)
    return made.filter("i0 < 4 and i1 < 4").select("i0", "i1", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query("fft3_coefficients", W + ", k as (select a.range as p, b.range as q, c.range as r from range(2) a, range(2) b, range(2) c), m as (select count(*) as m from embeddings) select p as i0, q as i1, r as i2, round(sum(v * cos(2 * pi() * (p * i0 / m + q * (i1 // 8) / 8 + r * (i1 % 8) / 8))), 3) + 0.0 as re, round(-sum(v * sin(2 * pi() * (p * i0 / m + q * (i1 // 8) / 8 + r * (i1 % 8) / 8))), 3) + 0.0 as im from e, m, k group by 1, 2, 3")
def _(s, d):
    """The embeddings as a cube of 8 by 8 columns."""
    a = matrix(s, d)
    cube = GridArray(a.df.select("i0", F.floor(F.col("i1") / 8).cast("bigint").alias("i1"), (F.col("i1") % 8).alias("i2"), "v"), (a.shape[0], 8, 8))
    made = fourier.transform(fourier.complex_cells(cube), cube.shape)
    return made.filter("i0 < 2 and i1 < 2 and i2 < 2").select("i0", "i1", "i2", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query("fft2_round_trip", W + "select i0, i1, round(v, 5) + 0.0 as v from e where i0 < 32")
def _(s, d):
    """The whole matrix there and back; only the result is cut to the rows that the SQL gives."""
    a = matrix(s, d)
    there = fourier.transform(fourier.complex_cells(a), a.shape)
    back = fourier.transform(there, a.shape, inverse=True)
    return back.filter("i0 < 32").select("i0", "i1", (F.round("re", 5) + 0.0).alias("v"))


@query("tbl_map", "select l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) as s from lineitem")
def _(s, d):
    return tables.map_rows(table(s, d, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), s=F.round(F.col("l_quantity") + F.col("l_extendedprice") + F.col("l_discount") + F.col("l_tax"), 4))


@query("tbl_filter", "select l_orderkey, l_linenumber from lineitem where l_quantity > 10 and l_extendedprice > 10")
def _(s, d):
    return tables.filter_all(table(s, d, "lineitem"), lambda c: c > 10, ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber")


@query("tbl_reduce", "select l_returnflag, round(sum(l_quantity), 2) as q, count(*) as n from lineitem group by 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.count("*").alias("n"))


@query("tbl_innerjoin", "select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as q from lineitem join orders on l_orderkey = o_orderkey group by 1")
def _(s, d):
    right = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return tables.inner_join(table(s, d, "lineitem"), right, "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("tbl_join_unique", "select o_orderkey, o_orderpriority, min(l_linenumber) as l_linenumber from orders join lineitem on l_orderkey = o_orderkey group by 1, 2")
def _(s, d):
    """A right side with several rows a key: the first one's is joined."""
    right = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return tables.inner_join(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), right, "o_orderkey", right_unique=True)


def _events(s: SparkSession, d: str, r: region.Region, files: int = 4) -> DataFrame:
    """The events as a stream of several files."""
    path = fresh_path(s, "events")
    df = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    df.repartition(files, "seq").write.parquet(path)
    return r.source(path, df.schema)


def _streamed(s: SparkSession, d: str, *build: Callable[[DataFrame], DataFrame], max_evals: int | None = None) -> list[DataFrame]:
    r = region.Region(s)
    with r:
        stream = _events(s, d, r)
        paths = [r.sink(f(stream), max_evals) for f in build]
    r.wait()
    return [r.read(p) for p in paths]


@query("stream_map", "select event_id as seq, round(value + 1, 5) as v from events")
def _(s, d):
    return _streamed(s, d, lambda x: x.select("seq", F.round(F.col("v") + 1, 5).alias("v")))[0]


@query("stream_zip", "select event_id as seq, round((value + 1) + (value + 2), 5) as v from events")
def _(s, d):
    def diamond(x):
        left, right = x.select("seq", "ts", (F.col("v") + 1).alias("a")), x.select("seq", "ts", (F.col("v") + 2).alias("b"))
        return region.zip_streams(left, right, "seq", "ts", "60 days").select(F.col("a.seq").alias("seq"), F.round(F.col("a.a") + F.col("b.b"), 5).alias("v"))

    return _streamed(s, d, diamond)[0]


@query("stream_fanout", "select event_id as seq, round(value * 2, 5) as v, 'double' as k from events union all select event_id, round(value / 2, 5), 'half' from events")
def _(s, d):
    one = lambda k, f: lambda x: x.select("seq", F.round(f(F.col("v")), 5).alias("v"), F.lit(k).alias("k"))
    a, b = _streamed(s, d, one("double", lambda v: v * 2), one("half", lambda v: v / 2))
    return a.union(b)


def _in_order(s: SparkSession, d: str, r: region.Region, files: int = 4) -> DataFrame:
    """The events as a stream of ``files`` files, one after the other by number, each sorted."""
    path, df = fresh_path(s, "events"), table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("v"))
    n = df.count()
    for k in range(files):
        df.filter(F.floor(F.col("seq") * files / n) == k).coalesce(1).sortWithinPartitions("seq").write.mode("append").parquet(path)
    return r.source(path, df.schema)


@query("stream_max_evals", "select event_id as seq, round(value, 5) as v from events where event_id < 100")
def _(s, d):
    """The first hundred rows of the stream, and no more."""
    r = region.Region(s)
    with r:
        path = r.sink(_in_order(s, d, r).select("seq", F.round("v", 5).alias("v")), 100)
    r.wait()
    return r.read(path)


@query("stream_finish", f"with {X_}, {N_} select round(sum(v), 3) as result, count(*) as rows, 2 as batches from x, n where floor(i0 * 4 / n) < 2")
def _(s, d):
    """A stage with state that ends its stream once it has half of the rows, with their sum."""
    r, n = region.Region(s), table(s, d, "events").count()

    def step(batch, number, seen):
        total, rows = batch.agg(F.sum("v"), F.count("*")).first()
        seen = (seen[0] + (total or 0.0), seen[1] + rows, seen[2] + 1)
        return region.Finish(seen) if 2 * seen[1] >= n - 4 else seen

    stage = r.each(_in_order(s, d, r), step, (0.0, 0, 0))
    r.wait()
    return s.createDataFrame([r.result(stage)], "result double, rows bigint, batches int").withColumn("result", F.round("result", 3))


@query("stream_window", "select time_bucket(interval '1 day', ts) as day, count(*) as n from events group by 1 having time_bucket(interval '1 day', ts) + interval '1 day' <= (select max(ts) from events)")
def _(s, d):
    """Windows as the stream closes them: a last event, far ahead, moves the watermark past all others; its own window stays open."""
    r, path = region.Region(s), fresh_path(s, "events")
    df = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    df.repartition(4, "seq").write.parquet(path)
    top = df.agg(F.max("ts").alias("top"))
    top.select(F.lit(-1).cast("bigint").alias("seq"), (F.col("top") + F.expr("interval 90 days")).alias("ts")).write.mode("append").parquet(path)
    with r:
        found = r.sink(region.windowed(r.source(path, df.schema), "ts", "1 day", "60 days", F.count("*").alias("n")))
    r.wait()
    return r.read(found).crossJoin(top).filter("window.end <= top").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("checkpoint_restore", "select o_orderstatus as k, count(*) as n from orders group by 1")
def _(s, d):
    """The second call finds the first one's table and does not make its own."""
    path = fresh_path(s, "restore")
    made = lambda t, c: lambda: table(s, d, t).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    tasks.restore_or_run(s, path, made("orders", "o_orderstatus"))
    return tasks.restore_or_run(s, path, made("lineitem", "l_returnflag"))


@query("task_graph", "select (select count(*) from orders) + (select count(*) from lineitem) as v")
def _(s, d):
    pool = tasks.Tasks(s)
    a, b = pool.spawn(lambda: table(s, d, "orders").count()), pool.spawn(lambda: table(s, d, "lineitem").count())
    return s.createDataFrame([(pool.spawn(lambda x, y: x + y, a, b).fetch(),)], "v bigint")


@query("task_queues", "select 'bulk' as k, (select count(*) from orders) + (select count(*) from customer) as v union all select 'sequence', 123")
def _(s, d):
    """Tasks in bulk run side by side; in a sequence one after the other."""
    pool, seen = tasks.Tasks(s), []
    counts = pool.spawn_bulk([(lambda t=t: table(s, d, t).count(),) for t in ("orders", "customer")])
    pool.spawn_sequential([(seen.append, x) for x in (1, 2, 3)])[-1].fetch()
    return s.createDataFrame([("bulk", sum(tasks.fetch_all(counts))), ("sequence", int("".join(map(str, seen))))], "k string, v bigint")


@query("csv_load", "select n_nationkey, n_name, n_regionkey from nation")
def _(s, d):
    path, df = fresh_path(s, "csv"), table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    df.write.option("header", True).csv(path)
    return arrays.read_table(s, path, "csv", header=True, inferSchema=True).select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])


@query("distribute", "select i.range as i0, j.range as i1, (i.range * 7 + j.range)::double as v from range(11) i, range(7) j")
def _(s, d):
    import numpy as np

    return arrays.from_numpy(s, np.arange(77, dtype=float).reshape(11, 7)).df


@query("zeros_like", W + "select i0, i1, 0.0::double as v from e")
def _(s, d):
    return arrays.zeros_like(matrix(s, d)).df


SP_ = f"{S_}, t as (select max(l_orderkey) + 1 as m, max(l_suppkey) + 1 as n from lineitem)"


@query("sparse_rows_min", f"with {SP_} select i0, 0::bigint as i1, round(case when count(*) < any_value(n) then least(min(v), 0) else min(v) end, 4) + 0.0 as v from s, t group by 1")
def _(s, d):
    """Absent cells are zeros that count; rows without a cell stay absent."""
    return rounded(reduce.reduce(sparse(s, d), "min", (1,)), 4)


@query("sparse_mean", f"with {SP_} select round(sum(v) / any_value(m * n), 8) + 0.0 as v from s, t")
def _(s, d):
    return rounded(reduce.reduce(sparse(s, d), "mean"), 8)


@query("sparse_plus_scalar", "select i.range as i0, j.range as i1, (i.range = j.range)::int + 1.5::double as v from range(20) i, range(30) j")
def _(s, d):
    return (arrays.eye(s, 20, 30) + 1.5).df


@query("sparse_set_block", "select i.range as i0, j.range as i1, case when i.range < 5 and j.range between 2 and 8 then 5.0 else (i.range = j.range)::int end::double as v from range(20) i, range(30) j")
def _(s, d):
    return indexing.set_value(arrays.eye(s, 20, 30), [(0, 5), (2, 9)], 5.0).dense().df


@query("sparse_stencil", "with g as (select i.range as i0, j.range as i1, (i.range = j.range)::int::double as v from range(20) i, range(30) j), o as (select * from (values (-1), (0), (1)) t(o)) select a.i0, a.i1, max(g.v) - min(g.v) as v from g a, o p, o q, g where g.i0 = least(greatest(a.i0 + p.o, 0), 19) and g.i1 = least(greatest(a.i1 + q.o, 0), 29) group by 1, 2")
def _(s, d):
    return stencil.neighbours(arrays.eye(s, 20, 30), 1, stencil.clamp(), fold=lambda v: F.array_max(v) - F.array_min(v)).df


@query("st_pad_extremes", f"with {X_}, y as (select i0, case when i0 = 0 then 'inf'::double else v end as v from x) select i0, least(round(coalesce(lag(v) over (order by i0), 0) + v + coalesce(lead(v) over (order by i0), 0), 5) + 0.0, 1e300) as v from y")
def _(s, d):
    """A pad beside an infinite cell is the pad."""
    a = indexing.set_value(vector(s, d), [(0, 1)], float("inf"))
    return stencil.neighbours(a, 1, stencil.pad(0.0)).df.select("i0", F.least(F.round("v", 5) + 0.0, F.lit(1e300)).alias("v"))


@query("st_big_integers", "select event_id as i0, greatest(coalesce(lag(v) over (order by event_id), v), v, coalesce(lead(v) over (order by event_id), v)) as v from (select event_id, 9007199254740993 + event_id * 2 as v from events)")
def _(s, d):
    """Integers beyond what a double holds keep their digits in the halo."""
    a = vector(s, d)
    big = GridArray(a.df.select("i0", (F.lit(9007199254740993) + F.col("i0") * 2).alias("v")), a.shape)
    return stencil.neighbours(big, 1, stencil.clamp(), fold="max").df


@query("st_custom", f"with {X_}, {N_} select i0, round(coalesce(lag(v) over (order by i0), (select v * 0.5 + 1 from x where i0 = 1)) + v + coalesce(lead(v) over (order by i0), (select y.v * 0.5 + 1 from x y, n where y.i0 = n - 2)), 5) + 0.0 as v from x")
def _(s, d):
    """A boundary of one's own: half of the second cell, and one."""
    own = stencil.Boundary(lambda p, n: ([(1 if p < 0 else n - 2, 0.5)], 1.0))
    return rounded(stencil.neighbours(vector(s, d), 1, own))


@query("copy_into", W + "select i0, i1, round(case when i0 between 4 and 9 and i1 between 2 and 6 then 0 else v end, 5) + 0.0 as v from e")
def _(s, d):
    return rounded(indexing.copy_into(matrix(s, d), arrays.zeros(s, (6, 5)), (4, 2)))


@query("map_tiles", W + "select i0, i1, round(v - avg(v) over (partition by i0 // 100, i1 // 16), 5) + 0.0 as v from e")
def _(s, d):
    """Each tile without its own mean."""
    return rounded(elementwise.map_tiles(lambda x: x - x.mean(), matrix(s, d), (100, 16)))
