"""Networks and volumes derived from the driver's tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem")

VIEWS = {
    "net_vertex": """
SELECT c_custkey AS v_id, CAST((c_custkey*37)%1000 AS DOUBLE) AS x, CAST((c_custkey*91)%1000 AS DOUBLE) AS y, CAST((c_custkey*53)%500 AS DOUBLE) AS z FROM {customer}""",
    "net_edge": """
SELECT o_orderkey AS e_id, o_custkey AS v0, (o_custkey*7+o_orderkey*3+1) % (SELECT count(*) FROM {customer}) AS v1 FROM {orders}""",
    "net_inner": """
SELECT l_orderkey AS e_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
       count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_partkey%11 - 5 AS DOUBLE) AS jx, CAST(l_partkey%7 - 3 AS DOUBLE) AS jy,
       CAST(l_suppkey%5 - 2 AS DOUBLE) AS jz, CAST(2.0 + l_quantity/10.0 AS DOUBLE) AS d FROM {lineitem}""",
    "net_point": """
SELECT e.e_id, CAST(0 AS BIGINT) AS seq, a.x, a.y, a.z, CAST(4.0 AS DOUBLE) AS d FROM {net_edge} e JOIN {net_vertex} a ON a.v_id=e.v0
UNION ALL
SELECT i.e_id, CAST(i.seq AS BIGINT) AS seq, a.x+(b.x-a.x)*i.seq/(i.n+1)+i.jx, a.y+(b.y-a.y)*i.seq/(i.n+1)+i.jy, a.z+(b.z-a.z)*i.seq/(i.n+1)+i.jz, i.d
FROM {net_inner} i JOIN {net_edge} e ON e.e_id=i.e_id JOIN {net_vertex} a ON a.v_id=e.v0 JOIN {net_vertex} b ON b.v_id=e.v1
UNION ALL
SELECT e.e_id, coalesce(k.n,0)+1, b.x, b.y, b.z, CAST(4.0 AS DOUBLE)
FROM {net_edge} e JOIN {net_vertex} b ON b.v_id=e.v1 LEFT JOIN (SELECT e_id, max(n) AS n FROM {net_inner} GROUP BY e_id) k ON k.e_id=e.e_id""",
    "vox": """
SELECT CAST(l_orderkey%64 AS INT) AS x, CAST(l_partkey%64 AS INT) AS y, CAST(l_suppkey%16 AS INT) AS z, max(CAST(l_quantity*5 AS INT)) AS v FROM {lineitem} GROUP BY 1,2,3""",
}

#: A network of all orders with as many vertices as edges: loose ends, chains, and trees that hang on rings.
SPARSE = VIEWS | {
    "net_vertex": """
SELECT o_orderkey AS v_id, CAST((o_orderkey*37)%1000 AS DOUBLE) AS x, CAST((o_orderkey*91)%997 AS DOUBLE) AS y, CAST((o_orderkey*53)%499 AS DOUBLE) AS z FROM {orders}""",
    "net_edge": """
SELECT a.o_orderkey AS e_id, a.o_orderkey AS v0, b.o_orderkey AS v1 FROM {orders} a JOIN {orders} b ON b.o_orderkey = (a.o_orderkey * a.o_orderkey + a.o_custkey) % (SELECT count(*) FROM {orders})""",
}

#: Of the volume that ``vox`` lies in.
SIZE = (64, 64, 16)


class Fixtures:
    """The derived tables of one data folder: the network of all orders and lineitems (dense or sparse), and a volume."""

    def __init__(self, spark: SparkSession, sf_dir: str, sparse: bool = False):
        self.spark, self.sf_dir, self.views = spark, sf_dir, SPARSE if sparse else VIEWS
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                need = {k: getattr(self, k) for k in (*TABLES, *VIEWS) if "{" + k + "}" in self.views[name]}
                self.made[name] = self.spark.sql(self.views[name], **need)
            elif name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]

    @property
    def lit(self) -> DataFrame:
        """The voxels of 230 or more."""
        return self.vox.where("v >= 230").selectExpr("x", "y", "z", "255 AS v")


def ctes(sparse: bool = False) -> str:
    """The views as the beginning of a WITH RECURSIVE query."""
    names = {k: k for k in (*TABLES, *VIEWS)}
    lit = "lit AS (SELECT x, y, z, 255 AS v FROM vox WHERE v >= 230)"
    return "WITH RECURSIVE " + ",\n".join([*(f"{k} AS ({v.format(**names).strip()})" for k, v in (SPARSE if sparse else VIEWS).items()), lit])
