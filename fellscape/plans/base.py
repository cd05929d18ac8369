"""Node and edge tables that the queries start from, with the SQL that defines them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellscape.functions.scalar import finite
from fellscape.operators.edges import with_displacement, with_ends
from fellscape.operators.knn import exact_knn
from fellscape.operators.nodeagg import local_density, local_diffusion
from fellscape.session import latest, table

DIMS, K = 6, 10
#: Numbers of a cell's position (spliced), as many again follow for the velocity (unspliced).
NUMBERS = 32
XS, VS = [f"x{i}" for i in range(DIMS)], [f"v{i}" for i in range(DIMS)]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def walsh(i: int, term: str) -> str:
    """SQL of coordinate i: the product of 32 numbers with a Walsh function, so that all of them count; {0} in ``term`` is the number's position."""
    signs = ["-" if bin((i + 1) & j).count("1") % 2 else "+" for j in range(NUMBERS)]
    return "(0.0::DOUBLE " + " ".join(f"{s} {term.format(j)}" for j, s in enumerate(signs)) + f") / {NUMBERS**0.5!r}::DOUBLE"


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the embeddings table: six orthonormal projections of all spliced numbers as position, of unspliced minus spliced as velocity."""
    at = lambda k: f"cast(embedding[{k}] AS DOUBLE)"
    exprs = [f"{walsh(i, at('{0}'))} AS x{i}" for i in range(DIMS)] + [f"{walsh(i, '(' + at('{0}+' + str(NUMBERS)) + ' - ' + at('{0}') + ')')} AS v{i}" for i in range(DIMS)]
    plain = [e.replace("0.0::DOUBLE", "0D").replace("::DOUBLE", "D") for e in exprs]
    return table(spark, folder, "embeddings").selectExpr("vec_id AS idx", "label", *plain)


def knn(spark: SparkSession, folder: str) -> DataFrame:
    return exact_knn(points(spark, folder), "idx", XS, K)


def located(spark: SparkSession, folder: str, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): points with density, diffusion and energy; kNN edges with both ends and displacement."""
    near, pts = knn(spark, folder), points(spark, folder)
    bare = with_displacement(with_ends(near, pts, [*XS, *VS]), DIMS)
    nodes = pts.join(local_density(near), "idx").join(local_diffusion(bare, DIMS), "idx").withColumn("energy", -F.log("density"))
    return nodes, with_displacement(with_ends(near, nodes, [*XS, *VS, "density", "diffusion", "energy", "label"]), DIMS)


def fit_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Current, not deleted nodes of all fits with a finite energy."""
    rows = latest(table(spark, folder, "fit_cells"), "node_no", "loaded_at", ["deleted_at", "fit_id", "label", "energy", "uncertainty", "density", "commitment_time"])
    return rows.where(F.col("deleted_at").isNull() & finite("energy")).select("fit_id", F.col("node_no").alias("idx"), "label", "energy", "uncertainty", "density", "commitment_time")


def fit_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with a finite work whose two ends are not null, each delivered edge once."""
    e = table(spark, folder, "fit_edges").select("edge_no", "fit_id", F.col("source").alias("src"), F.col("target").alias("dst"), F.col("distance").alias("dist"), "alignment", "work")
    return e.where(finite("work") & F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def fit_ends(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("energy", "density", "label")) -> DataFrame:
    return with_ends(fit_edges(spark, folder), fit_nodes(spark, folder), list(columns), ["fit_id"])


# ------------------------------------------------------------------ the same in SQL


def dot_sql(a: str, b: str, n: int = DIMS) -> str:
    return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(n)) + ")"


_DIST = "sqrt(" + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(DIMS)) + ")"
PTS = (
    "pts AS (SELECT vec_id AS idx, label, "
    + ", ".join(f"{walsh(i, 'embedding[{0}+1]::DOUBLE')} AS x{i}" for i in range(DIMS))
    + ", "
    + ", ".join(f"{walsh(i, '(embedding[{0}+33]::DOUBLE - embedding[{0}+1]::DOUBLE)')} AS v{i}" for i in range(DIMS))
    + " FROM embeddings)"
)
KNN = f"""{PTS},
far AS (SELECT a.idx AS src, b.idx AS dst, {_DIST} AS dist FROM pts a JOIN pts b ON a.idx <> b.idx),
knn AS (SELECT src, dst, rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rank FROM far) WHERE rank <= {K})"""
_VAR = " + ".join(f"coalesce(var_samp(b.v{i}), 0)" for i in range(DIMS))
_BOTH = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in [*XS, *VS, "density", "diffusion", "energy", "label"])
_DX = ", ".join(f"b.x{i} - a.x{i} AS dx{i}" for i in range(DIMS))
ENDS = f"""{KNN},
dens AS (SELECT src AS idx, (1 + sum(exp(-dist * dist / (2 * 0.65 * 0.65)))) / (1 + count(*)) AS density FROM knn GROUP BY src),
diff AS (SELECT k.src AS idx, greatest(({_VAR}) / {DIMS}, 1e-6) AS diffusion FROM knn k JOIN pts b ON b.idx = k.dst GROUP BY k.src),
nodes AS (SELECT p.*, density, diffusion, -ln(density) AS energy FROM pts p JOIN dens USING (idx) JOIN diff USING (idx)),
ends AS (SELECT k.src, k.dst, k.rank, k.dist, {_BOTH}, {_DX} FROM knn k JOIN nodes a ON a.idx = k.src JOIN nodes b ON b.idx = k.dst),
al AS (SELECT *, sqrt({dot_sql('dx', 'dx')}) AS len, sqrt({dot_sql('a_v', 'a_v')}) AS speed, {dot_sql('a_v', 'dx')} AS drift FROM ends),
aligned AS (SELECT *, CASE WHEN len * speed > 0 THEN drift / (len * speed) ELSE 0 END AS alignment FROM al),
worked AS (SELECT *, -ln(greatest(b_density, 1e-12) / greatest(a_density, 1e-12)) - drift + 0.5 * {dot_sql('dx', 'dx')} / greatest(a_diffusion, 1e-12) AS work FROM aligned)"""
FITS = """fn AS (SELECT fit_id, node_no AS idx, label, energy, uncertainty, density, commitment_time
  FROM (SELECT *, row_number() OVER (PARTITION BY node_no ORDER BY loaded_at DESC) AS rn FROM fit_cells) WHERE rn = 1 AND deleted_at IS NULL AND isfinite(energy)),
fe AS (SELECT DISTINCT edge_no, fit_id, source AS src, target AS dst, distance AS dist, alignment, work FROM fit_edges WHERE isfinite(work) AND source IS NOT NULL AND target IS NOT NULL),
ft AS (SELECT e.*, a.energy AS a_energy, b.energy AS b_energy, a.density AS a_density, b.density AS b_density, a.label AS a_label, b.label AS b_label
  FROM fe e JOIN fn a ON a.fit_id = e.fit_id AND a.idx = e.src JOIN fn b ON b.fit_id = e.fit_id AND b.idx = e.dst)"""


def rounded_sql(prefix: str, columns: str, rest: str, digits: int = 6) -> str:
    """WITH prefix SELECT ...; a column written as ~expr AS name is rounded."""
    out = []
    for c in columns.split(";"):
        c = c.strip()
        if c.startswith("~"):
            e, _, n = c[1:].rpartition(" AS ")
            out.append(f"round({e}, {digits}) AS {n}")
        else:
            out.append(c)
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in prefix else ''}{prefix.replace('RECURSIVE ', '')} SELECT {', '.join(out)} {rest}"
