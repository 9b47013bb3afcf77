"""Table scans and the derived relations that the operators share.

The driver's tables stand in for a versioned store: customers are accounts with one
library each, orders are commits (newest is the head), line items are the entries of
a commit's root directory, and (supplier, part) pairs are stored objects in packs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """The derived relations over one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def libraries(self) -> DataFrame:
        """(library_id, owner, quota, live): the quota comes from the balance, at most 0 is none."""
        return self.t("customer").select(
            F.col("c_custkey").alias("library_id"), F.col("c_name").alias("owner"),
            F.col("c_acctbal").cast("decimal(18,2)").alias("quota"), (F.col("c_acctbal") > 0).alias("live"),
            F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        )

    def commits(self) -> DataFrame:
        """(library_id, commit_id, created_at, parent_id, rn): rn is 1 at the head."""
        old = Window.partitionBy("library_id").orderBy("created_at", "commit_id")
        new = Window.partitionBy("library_id").orderBy(F.desc("created_at"), F.desc("commit_id"))
        c = self.t("orders").select(
            F.col("o_custkey").alias("library_id"), F.col("o_orderkey").alias("commit_id"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("author"),
        )
        return c.withColumn("parent_id", F.lag("commit_id").over(old)).withColumn(
            "rn", F.row_number().over(new)
        )

    def entries(self) -> DataFrame:
        """(commit_id, name, child_id): one child per name, the smallest."""
        return (
            self.t("lineitem")
            .groupBy(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("name"))
            .agg(F.min("l_partkey").alias("child_id"))
        )

    def namespace(self, rn: int = 1, mark: str = "h") -> DataFrame:
        """(dir_id, name, child_id, node_type): a tree of regions, nations, accounts and the files of
        their ``rn``-th newest commits, below the directory ``mark``; directories that differ have other ids."""
        text, pick = lambda c: F.col(c).cast("string"), lambda *cs: F.concat_ws("", F.lit(mark), *cs)
        row = lambda dir_id, name, child, kind: [dir_id.alias("dir_id"), name.alias("name"), child.alias("child_id"), F.lit(kind).alias("node_type")]
        c = self.commits().filter(F.col("rn") == rn).select("library_id", "commit_id")
        owner = self.libraries().join(c, "library_id")
        files = self.entries().join(c, "commit_id")
        return (
            self.t("region").select(*row(F.lit(mark), F.col("r_name"), pick(F.lit("r"), text("r_regionkey")), 1))
            .unionByName(self.t("nation").select(*row(pick(F.lit("r"), text("n_regionkey")), F.col("n_name"), pick(F.lit("n"), text("n_nationkey")), 1)))
            .unionByName(owner.select(*row(pick(F.lit("n"), text("nation")), text("library_id"), F.concat(F.lit("o"), text("commit_id")), 1)))
            .unionByName(files.select(*row(F.concat(F.lit("o"), text("commit_id")), text("name"), F.concat(F.lit("f"), text("child_id")), 0)))
        )

    def sizes(self) -> DataFrame:
        """(child_id, size): a part's size stands for the file's."""
        return self.t("part").select(
            F.col("p_partkey").alias("child_id"), F.col("p_size").cast("long").alias("size")
        )

    def trees(self) -> DataFrame:
        """(library_id, commit_id, rn, name, child_id, size) of every commit's files."""
        return (
            self.commits().join(self.entries(), "commit_id").join(self.sizes(), "child_id")
            .select("library_id", "commit_id", "rn", "name", "child_id", "size")
        )

    def objects(self) -> DataFrame:
        """(pack_id, object_id, frame_len): stored objects, each once per pack."""
        li = self.t("lineitem").select(F.col("l_suppkey").alias("pack_id"), F.col("l_partkey").alias("object_id"))
        return li.distinct().join(
            self.sizes().withColumnRenamed("child_id", "object_id"), "object_id"
        ).select("pack_id", "object_id", F.col("size").alias("frame_len"))

    def references(self) -> DataFrame:
        """(pack_id, object_id, library_id, created_at, rn) of live libraries' commits."""
        li = self.t("lineitem").select(
            F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("pack_id"),
            F.col("l_partkey").alias("object_id"),
        )
        live = self.libraries().filter("live").select("library_id")
        return self.commits().join(live, "library_id").join(li, "commit_id")

    def reach(self) -> DataFrame:
        """(pack_id, object_id, mrn): the newest commit that reaches an object."""
        return self.references().groupBy("pack_id", "object_id").agg(F.min("rn").alias("mrn"))

    def chunks(self) -> DataFrame:
        """(manifest_id, seq, size, off): a conversation is a file, its turns its chunks."""
        w = Window.partitionBy("manifest_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        c = self.t("conversations").select(
            F.col("conv_id").alias("manifest_id"), F.col("turn").alias("seq"),
            F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
            F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("chunk_id"),
        )
        return c.withColumn("off", F.sum("size").over(w) - F.col("size"))

    def events(self) -> DataFrame:
        return self.t("events").select(
            "event_id", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"), "user_id",
            "event_type", F.col("value").cast("decimal(18,2)").alias("value"),
        )


#: The same relations as DuckDB common table expressions, by name.
CTE = {
    "libraries": """libraries AS (SELECT c_custkey library_id, c_name AS owner, c_acctbal::DECIMAL(18,2) quota,
  c_acctbal > 0 live, c_nationkey nation, c_mktsegment segment FROM customer)""",
    "commits": """commits AS (SELECT o_custkey library_id, o_orderkey commit_id, o_orderdate created_at, o_orderstatus author,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) parent_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders)""",
    "entries": """entries AS (SELECT l_orderkey commit_id, l_linenumber AS name, min(l_partkey) child_id
  FROM lineitem GROUP BY 1, 2)""",
    "ns": """ns AS (SELECT m, dir_id, name, child_id, node_type FROM (VALUES (1, 'h'), (2, 'p')) v(rn, m), LATERAL (
  SELECT m AS dir_id, r_name AS name, m || 'r' || r_regionkey AS child_id, 1 AS node_type FROM region
  UNION ALL SELECT m || 'r' || n_regionkey, n_name, m || 'n' || n_nationkey, 1 FROM nation
  UNION ALL SELECT m || 'n' || nation, library_id::VARCHAR, 'o' || commit_id, 1 FROM libraries JOIN commits c USING (library_id) WHERE c.rn = v.rn
  UNION ALL SELECT 'o' || commit_id, e.name::VARCHAR, 'f' || child_id, 0 FROM entries e JOIN commits c USING (commit_id) WHERE c.rn = v.rn)),
walked AS (SELECT a.m, '/' || a.name AS path, a.child_id AS id, a.node_type FROM ns a WHERE a.dir_id = a.m
  UNION ALL SELECT a.m, '/' || a.name || '/' || b.name, b.child_id, b.node_type FROM ns a JOIN ns b ON a.m = b.m AND b.dir_id = a.child_id WHERE a.dir_id = a.m
  UNION ALL SELECT a.m, '/' || a.name || '/' || b.name || '/' || c.name, c.child_id, c.node_type FROM ns a JOIN ns b ON a.m = b.m AND b.dir_id = a.child_id JOIN ns c ON c.m = a.m AND c.dir_id = b.child_id WHERE a.dir_id = a.m
  UNION ALL SELECT a.m, '/' || a.name || '/' || b.name || '/' || c.name || '/' || d.name, d.child_id, d.node_type FROM ns a JOIN ns b ON a.m = b.m AND b.dir_id = a.child_id JOIN ns c ON c.m = a.m AND c.dir_id = b.child_id JOIN ns d ON d.m = a.m AND d.dir_id = c.child_id WHERE a.dir_id = a.m)""",
    "sizes": "sizes AS (SELECT p_partkey child_id, p_size::BIGINT size FROM part)",
    "trees": """trees AS (SELECT library_id, commit_id, rn, name, child_id, size
  FROM commits JOIN entries USING (commit_id) JOIN sizes USING (child_id))""",
    "objects": """objects AS (SELECT DISTINCT l_suppkey pack_id, l_partkey object_id, p_size::BIGINT frame_len
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "refs": """refs AS (SELECT l_suppkey pack_id, l_partkey object_id, library_id, created_at, rn, commit_id
  FROM commits JOIN libraries USING (library_id) JOIN lineitem ON l_orderkey = commit_id WHERE live)""",
    "reach": "reach AS (SELECT pack_id, object_id, min(rn) mrn FROM refs GROUP BY 1, 2)",
    "chunks": """chunks AS (SELECT conv_id manifest_id, turn seq, octet_length(encode(coalesce(text, '')))::BIGINT size,
  sha256(coalesce(text, '')) chunk_id,
  (sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
   - octet_length(encode(coalesce(text, ''))))::BIGINT off FROM conversations)""",
    "ev": """ev AS (SELECT event_id, ts, floor(epoch(ts))::BIGINT sec, user_id, event_type, value::DECIMAL(18,2) AS value FROM events)""",
}
ORDER = ("libraries", "commits", "entries", "ns", "sizes", "trees", "objects", "refs", "reach", "chunks", "ev")
NEEDS = {
    "trees": ("commits", "entries", "sizes"),
    "refs": ("commits", "libraries"),
    "reach": ("refs", "commits", "libraries"),
    "ns": ("libraries", "commits", "entries"),
}


def with_ctes(names: str, query: str) -> str:
    """``query`` behind the named relations and those they need."""
    wanted = set(names.split())
    for n in list(wanted):
        wanted.update(NEEDS.get(n, ()))
    body = query.strip()
    first = body[:4].upper()
    parts = [CTE[n] for n in ORDER if n in wanted]
    if first == "WITH":
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].strip()
    return "WITH " + ",\n".join(parts) + "\n" + body
