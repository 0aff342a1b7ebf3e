"""Column roles that the given tables play, as Spark views and as the same SQL.

The tables hold orders and documents; operators are written over roles such as
profile, feature, count, site, campaign, position. Each view here says which
columns play which role, once for Spark and once for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def counts(self) -> DataFrame:
        g = self.table("lineitem").groupBy(F.col("l_suppkey").alias("profile"), F.col("l_partkey").alias("feature"))
        return g.agg(F.sum("l_quantity").cast("bigint").alias("n"))

    @property
    def counts_pos(self) -> DataFrame:
        li = self.table("lineitem")
        return li.groupBy(
            F.col("l_suppkey").alias("profile"), (F.year("l_shipdate") % 5 + 1).alias("campaign"), F.col("l_returnflag").alias("position"), F.col("l_partkey").alias("feature")
        ).agg(F.sum("l_quantity").cast("bigint").alias("n"))

    @property
    def taxonomy(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("feature"), F.array("p_type", "p_brand", "p_name").alias("lineage"))

    @property
    def profiles(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("profile"), F.col("s_nationkey").alias("site"), F.col("n_regionkey").alias("block"), (F.col("s_suppkey") % 10 == 0).alias("is_control")
        )

    @property
    def sites(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(k.alias("site"), (k * 0.37).alias("lat"), (k * k % 23).cast("double").alias("lon"), F.col("n_regionkey").alias("block"))

    @property
    def daily(self) -> DataFrame:
        e = self.table("events")
        return e.groupBy((F.col("user_id") % 25).alias("site"), F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 2).alias("value"))

    @property
    def readings(self) -> DataFrame:
        e = self.table("events")
        return e.select(F.col("user_id").alias("sample"), F.col("event_type").alias("analyte"), "value", "ts", "event_id")

    @property
    def phyla(self) -> DataFrame:
        """Counts of the first rank by (site, campaign, position): a small composition table."""
        c = self.counts_pos.join(self.taxonomy, "feature").join(self.profiles, "profile")
        return c.groupBy("site", "campaign", "position", F.element_at("lineage", 1).alias("taxon")).agg(F.sum("n").alias("n"))

    @property
    def names(self) -> DataFrame:
        """Counts of the last rank by (site, campaign, position): a composition of more parts."""
        c = self.counts_pos.join(self.taxonomy, "feature").join(self.profiles, "profile")
        return c.groupBy("site", "campaign", "position", F.element_at("lineage", 3).alias("taxon")).agg(F.sum("n").alias("n"))

    @property
    def brands(self) -> DataFrame:
        """Counts of the second rank by profile."""
        c = self.counts.join(self.taxonomy, "feature")
        return c.groupBy("profile", F.element_at("lineage", 2).alias("taxon")).agg(F.sum("n").alias("n"))

    @property
    def site_brands(self) -> DataFrame:
        c = self.counts.join(self.taxonomy, "feature").join(self.profiles, "profile")
        return c.groupBy("site", F.element_at("lineage", 2).alias("taxon")).agg(F.sum("n").alias("n"))

    @property
    def triples(self) -> DataFrame:
        """Places, trades and goods as triples (s, p, o, o_kind)."""
        def edge(df, s, p, o, kind="iri"):
            return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))

        iri = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
        r, n, s, c = (self.table(t) for t in ("region", "nation", "supplier", "customer"))
        p, o = self.table("part"), self.table("orders")
        parts = [
            edge(r, iri("region", "r_regionkey"), "type", F.lit("Region")), edge(r, iri("region", "r_regionkey"), "label", F.col("r_name"), "literal"),
            edge(n, iri("nation", "n_nationkey"), "type", F.lit("Nation")), edge(n, iri("nation", "n_nationkey"), "label", F.col("n_name"), "literal"),
            edge(n, iri("nation", "n_nationkey"), "partOf", iri("region", "n_regionkey")),
            edge(s, iri("supplier", "s_suppkey"), "type", F.lit("Supplier")), edge(s, iri("supplier", "s_suppkey"), "label", F.col("s_name"), "literal"),
            edge(s, iri("supplier", "s_suppkey"), "locatedIn", iri("nation", "s_nationkey")),
            edge(c, iri("customer", "c_custkey"), "type", F.lit("Customer")), edge(c, iri("customer", "c_custkey"), "locatedIn", iri("nation", "c_nationkey")),
            edge(p, iri("part", "p_partkey"), "type", F.lit("Part")), edge(p, iri("part", "p_partkey"), "size", F.col("p_size"), "literal"),
            edge(o, iri("order", "o_orderkey"), "type", F.lit("Order")), edge(o, iri("order", "o_orderkey"), "placedBy", iri("customer", "o_custkey")),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out


_TRIPLES = """
    SELECT 'region/' || r_regionkey AS s, 'type' AS p, 'Region' AS o, 'iri' AS o_kind FROM region
    UNION ALL SELECT 'region/' || r_regionkey, 'label', r_name, 'literal' FROM region
    UNION ALL SELECT 'nation/' || n_nationkey, 'type', 'Nation', 'iri' FROM nation
    UNION ALL SELECT 'nation/' || n_nationkey, 'label', n_name, 'literal' FROM nation
    UNION ALL SELECT 'nation/' || n_nationkey, 'partOf', 'region/' || n_regionkey, 'iri' FROM nation
    UNION ALL SELECT 'supplier/' || s_suppkey, 'type', 'Supplier', 'iri' FROM supplier
    UNION ALL SELECT 'supplier/' || s_suppkey, 'label', s_name, 'literal' FROM supplier
    UNION ALL SELECT 'supplier/' || s_suppkey, 'locatedIn', 'nation/' || s_nationkey, 'iri' FROM supplier
    UNION ALL SELECT 'customer/' || c_custkey, 'type', 'Customer', 'iri' FROM customer
    UNION ALL SELECT 'customer/' || c_custkey, 'locatedIn', 'nation/' || c_nationkey, 'iri' FROM customer
    UNION ALL SELECT 'part/' || p_partkey, 'type', 'Part', 'iri' FROM part
    UNION ALL SELECT 'part/' || p_partkey, 'size', CAST(p_size AS VARCHAR), 'literal' FROM part
    UNION ALL SELECT 'order/' || o_orderkey, 'type', 'Order', 'iri' FROM orders
    UNION ALL SELECT 'order/' || o_orderkey, 'placedBy', 'customer/' || o_custkey, 'iri' FROM orders
"""

VIEWS = {
    "counts": ("SELECT l_suppkey AS profile, l_partkey AS feature, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2", ()),
    "counts_pos": (
        "SELECT l_suppkey AS profile, CAST(year(l_shipdate) % 5 + 1 AS INTEGER) AS campaign, l_returnflag AS position, l_partkey AS feature, "
        "CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3, 4", ()),
    "taxonomy": ("SELECT p_partkey AS feature, p_type AS r1, p_brand AS r2, p_name AS r3 FROM part", ()),
    "profiles": (
        "SELECT s_suppkey AS profile, s_nationkey AS site, n_regionkey AS block, s_suppkey % 10 = 0 AS is_control FROM supplier JOIN nation ON s_nationkey = n_nationkey", ()),
    "sites": ("SELECT n_nationkey AS site, CAST(n_nationkey * CAST(0.37 AS DOUBLE) AS DOUBLE) AS lat, CAST(n_nationkey * n_nationkey % 23 AS DOUBLE) AS lon, n_regionkey AS block FROM nation", ()),
    "daily": ("SELECT user_id % 25 AS site, CAST(ts AS DATE) AS date, round(sum(value), 2) AS value FROM events GROUP BY 1, 2", ()),
    "readings": ("SELECT user_id AS sample, event_type AS analyte, value, ts, event_id FROM events", ()),
    "phyla": ("SELECT site, campaign, position, r1 AS taxon, sum(n) AS n FROM counts_pos JOIN taxonomy USING (feature) JOIN profiles USING (profile) GROUP BY 1, 2, 3, 4", ("counts_pos", "taxonomy", "profiles")),
    "names": ("SELECT site, campaign, position, r3 AS taxon, sum(n) AS n FROM counts_pos JOIN taxonomy USING (feature) JOIN profiles USING (profile) GROUP BY 1, 2, 3, 4", ("counts_pos", "taxonomy", "profiles")),
    "brands": ("SELECT profile, r2 AS taxon, sum(n) AS n FROM counts JOIN taxonomy USING (feature) GROUP BY 1, 2", ("counts", "taxonomy")),
    "site_brands": ("SELECT site, r2 AS taxon, sum(n) AS n FROM counts JOIN taxonomy USING (feature) JOIN profiles USING (profile) GROUP BY 1, 2", ("counts", "taxonomy", "profiles")),
    "triples": (_TRIPLES, ()),
}


def sql(views: str, body: str, **more: str) -> str:
    """``body`` after WITH clauses for the named views (and what they need), then ``more`` named parts."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][1]:
            need(other)
        if name not in names:
            names.append(name)

    for view in views.split():
        need(view)
    parts = [f"{n} AS ({VIEWS[n][0]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body


def registry() -> tuple[dict, Callable]:
    """A query table and the decorator that fills it with functions of Roles."""
    found: dict = {}

    def query(name: str, oracle: str | None = None):
        def add(f):
            found[name] = (lambda spark, sf_dir: f(Roles(spark, sf_dir)), oracle)
            return f

        return add

    return found, query
