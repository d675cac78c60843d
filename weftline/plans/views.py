"""The driver's tables read as the engine's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.indexes.adjacency import Adjacency
from weftline.indexes.cells import CellIndex
from weftline.indexes.search import SearchIndex
from weftline.indexes.symbols import SymbolIndex
from weftline.operators.store import write_partitions
from weftline.session import scratch_path

#: The same readings in SQL, as common table expressions.
GRAPH_SQL = """
nodes as (
  select 'c:' || c_custkey::varchar as id, 'trade' as workspace, c_name as label, 'customer' as kind, n_name as file_path, c_nationkey as community
  from customer join nation on n_nationkey = c_nationkey
  union all
  select 's:' || s_suppkey::varchar, 'trade', s_name, 'supplier', n_name, s_nationkey from supplier join nation on n_nationkey = s_nationkey
),
edges as (
  select 'c:' || o_custkey::varchar as source, 's:' || l_suppkey::varchar as target,
    case l_returnflag when 'A' then 'CALLS' when 'R' then 'IMPLEMENTS' else 'IMPORTS' end as type
  from lineitem join orders on o_orderkey = l_orderkey
)
"""
STEPS_SQL = """
steps as (
  select conv_id::varchar as session_id, turn as step_index, case role when 'user' then 'USER_INPUT' when 'assistant' then 'PLANNER_RESPONSE' else 'SYSTEM' end as type,
    case role when 'user' then 'USER_EXPLICIT' when 'assistant' then 'MODEL' else 'SYSTEM' end as source, text as content
  from conversations
)
"""
EVENTS_SQL = """
calls as (
  select event_id, ts as created_at, user_id::varchar as workspace, event_type as capability, value as duration_ms, props from events
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: dict[tuple, tuple[str, StructType | None]] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of what stands in a folder, and in the tables that are folders."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for entry in fs.listStatus(place):
        inner = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inner]
    return tuple(sorted(found))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], StructType | None]) -> tuple[str, StructType | None]:
    """A folder that ``build`` has filled, and its schema: once for an application and for the input's files as they are.

    It is filled again where these have other names, sizes or times, or where it is gone.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key not in _tables or not _exists(spark, _tables[key][0]):
        path = scratch_path(spark, name)
        _tables[key] = (path, build(path))
    return _tables[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table of the graph, written by workspace when it is asked for first, as an ingestion leaves it, and read from then on."""

    def write(path: str) -> StructType:
        df = build(spark, sf_dir)
        write_partitions(df, path)
        return df.schema

    path, schema = kept(spark, sf_dir, name, write)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def trade_adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The trade edges by either end."""
    path, _ = kept(spark, sf_dir, "trade_adjacency", lambda p: Adjacency(spark, p, 16).build(trade_edges(spark, sf_dir)) and None)
    return Adjacency(spark, path, 16)


def trade_symbols(spark: SparkSession, sf_dir: str) -> SymbolIndex:
    path, _ = kept(spark, sf_dir, "trade_symbols", lambda p: SymbolIndex(spark, p).build(trade_nodes(spark, sf_dir)) and None)
    return SymbolIndex(spark, path)


def part_symbols(spark: SparkSession, sf_dir: str) -> SymbolIndex:
    """Parts as symbols of one workspace."""
    nodes = lambda: table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("workspace"), F.col("p_name").alias("label"), F.lit("part").alias("kind"), F.col("p_brand").alias("file_path"))
    path, _ = kept(spark, sf_dir, "part_symbols", lambda p: SymbolIndex(spark, p).build(nodes()) and None)
    return SymbolIndex(spark, path)


def vector_cells(spark: SparkSession, sf_dir: str) -> CellIndex:
    """The embeddings by cell."""
    path, _ = kept(spark, sf_dir, "vector_cells", lambda p: CellIndex(spark, p, "vec_id").build(table(spark, sf_dir, "embeddings")) and None)
    return CellIndex(spark, path, "vec_id")


def step_search(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The conversations' steps, searchable."""
    path, _ = kept(spark, sf_dir, "step_search", lambda p: SearchIndex(spark, p).append(steps(spark, sf_dir)) and None)
    return SearchIndex(spark, path)


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "trade_nodes", make_nodes)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "trade_edges", lambda s, d: make_edges(s, d).withColumn("workspace", F.lit("trade"))).drop("workspace")


def make_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as nodes; their nation is file and community."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def side(name: str, prefix: str, letter: str) -> DataFrame:
        rows = table(spark, sf_dir, name).withColumnRenamed(f"{letter}_nationkey", "n_nationkey").join(nation, "n_nationkey")
        key = "custkey" if letter == "c" else "suppkey"
        return rows.select(F.concat(F.lit(f"{letter}:"), F.col(f"{letter}_{key}").cast("string")).alias("id"), F.lit("trade").alias("workspace"), F.col(f"{letter}_name").alias("label"), F.lit(name).alias("kind"), F.col("n_name").alias("file_path"), F.col("n_nationkey").alias("community"), F.lit("sql").alias("language"), F.concat_ws(" ", f"{letter}_name", "n_name").alias("text"))

    return side("customer", "c:", "c").unionByName(side("supplier", "s:", "s"))


def make_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed edge from customer to supplier for each line item."""
    line, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "R", "IMPLEMENTS").otherwise("IMPORTS")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("target"), kind.alias("type"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript steps."""
    user, agent = F.col("role") == "user", F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("step_index"), F.when(user, "USER_INPUT").when(agent, "PLANNER_RESPONSE").otherwise("SYSTEM").alias("type"), F.when(user, "USER_EXPLICIT").when(agent, "MODEL").otherwise("SYSTEM").alias("source"), F.col("text").alias("content"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: the user is the session, the type the tool, ``error`` an error."""
    error = F.col("event_type") == "error"
    call = F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("args")))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("step_index"), F.lit("MODEL").alias("source"), F.when(error, "ERROR_MESSAGE").otherwise("PLANNER_RESPONSE").alias("type"), F.when(error, "ERROR").otherwise("DONE").alias("status"), F.col("ts").alias("created_at"), F.col("props").alias("content"), call.alias("tool_calls"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry rows."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("workspace"), F.col("event_type").alias("capability"), F.col("value").alias("duration_ms"), "props")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), "doc_id", "lang")
