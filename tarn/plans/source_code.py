"""Queries of code structure over source files made from ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lexical, resolve
from ..sources import code
from ..sources.tables import read_spread, read_table

PYTHON = """import os.path
from shop import item_{k}


class Part{k}(Base):
    # size {s}
    def weigh(self, x: Weight) -> float:
        return os.path.join(x, str({s}))


def pack_{k}(a):
    def inner(b):
        return b
    return inner(a)
"""
SCRIPT = """import {{ load }} from './load_{k}';
// part {k}
export function pack{k}(a) {{
  return load("}}{{" + a);
}}
const weigh{k} = (x) => {{
  return x * {s};
}};
class Part{k} {{
  size() {{
    return {s};
  }}
  static name = (n) => n;
}}
interface Box{k} {{ a: string }}
"""
GO = """package p{k}

type Part{k} struct {{
    size int
}}

func (p Part{k}) Weigh() int {{
    if p.size > {s} {{
        return 1
    }}
    return 0
}}
"""


def _filled(template: str) -> Column:
    """A template with a part's key and size in it, as a column."""
    text = F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    return F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"python": PYTHON, "typescript": SCRIPT, "go": GO}
    language, text = F.lit("text"), F.lit("nothing to see")
    for i, (name, template) in enumerate(kinds.items()):
        own = F.col("p_partkey") % 4 == i
        language, text = F.when(own, name).otherwise(language), F.when(own, _filled(template)).otherwise(text)
    return read_spread(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file_path"), language.alias("language"), text.alias("text"), "p_partkey", "p_size")


def code_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.concepts(_files(spark, sf_dir))


def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select(F.col("p_partkey").alias("chunk_id"), "language", F.lit(1).alias("start_line"), F.col("text").alias("code"))
    return code.entities(rows).select("chunk_id", "name", "entity_type", "line")


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each language without merging: how many, of which kind, over how many lines."""
    out = code.chunk_files(_files(spark, sf_dir), merge=False)
    return out.groupBy("language", "chunk_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


REGION = """def total(x):
    return helper(x)


def helper(x):
    return round(x)
"""
NATION = """from regions.r{r} import total as up
import regions.r{r}


def nation_{k}(x):
    return up(x) + regions.r{r}.helper(x)
"""
SUPPLIER = """import nations.n{r} as home
from tools.scale import *


class Supplier(Base):
    def load(self):
        return self.cost(2)

    def cost(self, n):
        return home.nation_{r}({k}) * n * len(only_{k}())


def only_{k}():
    return Supplier().load()
"""


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls resolved to definitions, over a module for each region, nation and supplier."""
    region, nation, supplier = (read_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))

    def files(rows: DataFrame, folder: str, template: str, key: str, above: str) -> DataFrame:
        text = F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col(key).cast("string")), F.lit("{r}"), F.col(above).cast("string"))
        return rows.select(F.format_string(f"src/{folder}%d.py", F.col(key)).alias("file_path"), F.lit("python").alias("language"), text.alias("text"))

    made = files(region, "regions/r", REGION, "r_regionkey", "r_regionkey").unionAll(files(nation, "nations/n", NATION, "n_nationkey", "n_regionkey")).unionAll(files(supplier, "suppliers/s", SUPPLIER, "s_suppkey", "s_nationkey"))
    return resolve.call_edges(code.concepts(made), code.references(made))


def research_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found from one region: it names its nations, and these their suppliers; two hops of five names."""
    region, nation, supplier = (read_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    name = lambda kind, key: F.concat(F.lit(kind), F.lpad(F.col(key).cast("string"), 8, "0"))
    parts = [
        region.select((F.col("r_regionkey") + 10**9).cast("long").alias("chunk_id"), name("rg", "r_regionkey").alias("symbol"), F.lit(None).cast("long").alias("above"), F.lit(0).alias("seq")),
        nation.select((F.col("n_nationkey") + 2 * 10**9).cast("long").alias("chunk_id"), name("na", "n_nationkey").alias("symbol"), (F.col("n_regionkey") + 10**9).cast("long").alias("above"), F.col("n_nationkey").cast("int").alias("seq")),
        supplier.select(F.col("s_suppkey").alias("chunk_id"), name("su", "s_suppkey").alias("symbol"), (F.col("s_nationkey") + 2 * 10**9).cast("long").alias("above"), F.col("s_suppkey").cast("int").alias("seq")),
    ]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    named = rows.filter("above is not null").select(F.col("above").alias("chunk_id"), "seq", F.col("symbol").alias("name"), F.lit("function_call").alias("entity_type"))
    code_of = named.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("code"))
    chunks = rows.select("chunk_id", "symbol").join(code_of, "chunk_id", "left").withColumn("code", F.coalesce("code", F.lit("nothing")))
    start = rows.filter(F.col("symbol") == "rg00000000").select("chunk_id", F.lit(1.0).alias("score"))
    found, _ = graph.research(spark, lexical.build_index(chunks), chunks, named, start)
    return found.select("chunk_id", "hop")


_CONCEPTS = [  # remainder of the key, language, symbol, concept, start, end, parent
    (0, "python", "Part#", "class", 5, 8, None), (0, "python", "weigh", "method", 7, 8, "Part#"), (0, "python", "comment_6", "comment", 6, 6, None), (0, "python", "pack_#", "function", 11, 14, None),
    (0, "python", "inner", "function", 12, 13, None), (1, "typescript", "comment_2", "comment", 2, 2, None), (1, "typescript", "pack#", "function", 3, 5, None), (1, "typescript", "weigh#", "function", 6, 8, None),
    (1, "typescript", "Part#", "class", 9, 14, None), (1, "typescript", "size", "method", 10, 12, "Part#"), (1, "typescript", "name", "method", 13, 13, "Part#"), (1, "typescript", "Box#", "class", 15, 15, None),
    (2, "go", "Part#", "class", 3, 5, None), (2, "go", "Weigh", "function", 7, 12, None),
]
_ENTITIES = [  # remainder, name, kind, line
    (0, "os.path.join", "function_call", 8), (0, "str", "function_call", 8), (0, "inner", "function_call", 14), (0, "os.path", "import", 1), (0, "shop", "import", 2), (0, "Weight", "class_reference", 7),
    (1, "./load_#", "import", 1), (1, "pack#", "function_call", 3), (1, "load", "function_call", 4), (1, "size", "function_call", 10),
]
_row = lambda r: "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")"

ORACLES = {
    "call_graph": """WITH r AS (SELECT 'src/regions/r' || r_regionkey || '.py' AS f FROM region), n AS (SELECT 'src/nations/n' || n_nationkey || '.py' AS f, 'src/regions/r' || n_regionkey || '.py' AS up, n_nationkey AS k, n_regionkey AS r FROM nation),
        s AS (SELECT 'src/suppliers/s' || s_suppkey || '.py' AS f, 'src/nations/n' || s_nationkey || '.py' AS up, s_suppkey AS k, s_nationkey AS n FROM supplier),
        e(caller_file, caller, caller_line, name, callee_file, callee, callee_line, scope) AS (
            SELECT f, 'total', 1, 'helper', f, 'helper', 5, 'file' FROM r
            UNION ALL SELECT f, 'nation_' || k, 5, 'up', up, 'total', 1, 'import' FROM n UNION ALL SELECT f, 'nation_' || k, 5, 'regions.r' || r || '.helper', up, 'helper', 5, 'import' FROM n
            UNION ALL SELECT f, 'load', 6, 'self.cost', f, 'cost', 9, 'class' FROM s UNION ALL SELECT f, 'cost', 9, 'home.nation_' || n, up, 'nation_' || n, 5, 'import' FROM s
            UNION ALL SELECT f, 'cost', 9, 'only_' || k, f, 'only_' || k, 13, 'file' FROM s UNION ALL SELECT f, 'only_' || k, 13, 'Supplier', f, 'Supplier', 5, 'file' FROM s)
        SELECT * FROM e""",
    "research_hops": """WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_regionkey = 0 ORDER BY n_nationkey LIMIT 5)
        SELECT CAST(1000000000 AS BIGINT) AS chunk_id, 0 AS hop UNION ALL SELECT n_nationkey + 2000000000, 1 FROM n
        UNION ALL SELECT * FROM (SELECT s_suppkey, 2 FROM supplier JOIN n ON s_nationkey = n_nationkey ORDER BY i, s_suppkey LIMIT 5)""",
    "code_concepts": f"""WITH c(r, language, symbol, concept, start_line, end_line, parent) AS (VALUES {', '.join(map(_row, _CONCEPTS))})
        SELECT CAST(p_partkey AS VARCHAR) AS file_path, language, replace(symbol, '#', CAST(p_partkey AS VARCHAR)) AS symbol, concept, start_line, end_line, replace(parent, '#', CAST(p_partkey AS VARCHAR)) AS parent FROM part JOIN c ON p_partkey % 4 = r""",
    "code_entities": f"""WITH c(r, name, entity_type, line) AS (VALUES {', '.join(map(_row, _ENTITIES))})
        SELECT p_partkey AS chunk_id, replace(name, '#', CAST(p_partkey AS VARCHAR)) AS name, entity_type, line FROM part JOIN c ON p_partkey % 4 = r""",
    "code_chunks": f"""WITH c(r, language, symbol, concept, start_line, end_line, parent) AS (VALUES {', '.join(map(_row, _CONCEPTS))}),
        g(r, language, concept, start_line, end_line) AS (VALUES (0, 'python', 'unknown', 1, 4)),
        u AS (SELECT r, language, concept, start_line, end_line FROM c UNION ALL SELECT * FROM g)
        SELECT language, concept AS chunk_type, count(*) AS n_chunks, CAST(sum(end_line - start_line + 1) AS BIGINT) AS n_lines FROM part JOIN u ON p_partkey % 4 = r GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (code_concepts, code_entities, code_chunks, call_graph, research_hops)}
