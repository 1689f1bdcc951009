"""Names in code resolved to the definitions they mean, by joins of a symbol table with what is called.

A call is looked up in the scopes of its place, nearest first: ``self.x`` among the methods of the calling class, a plain
name among the functions and classes of the file, a name that the file imports in the module it comes from, and last
among all definitions, where exactly one has that name.  Every lookup is an equality join on module (or file) and name, so it
is spread like any join; a call that several scopes answer has the nearest one's answer.

A module is the path of its file without extension, by dots; an import means the file whose path ends so (of several the
shortest, then the first).  Calls without a definition here (libraries, values) have no edge.  Null names and files are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["caller_file", "caller", "caller_line", "name"]


def module_of(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, r"^\.?/+", ""), r"(/__init__)?\.[A-Za-z0-9]+$", "")
    return F.translate(bare, "/", ".")


def _tails(dotted: Column) -> Column:
    """The endings of a dotted path, itself first."""
    parts = F.split(dotted, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def import_table(references: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, alias, target_file, symbol``: what local names of imports mean; ``symbol`` is null for a module."""
    rows = references.filter("kind = 'import'").select("file_path", F.col("name").alias("alias"), "module", "symbol", "level")
    # one point is the file's own package, each further one the package above
    package = F.split(module_of(F.col("file_path")), r"\.")
    is_package = F.col("file_path").rlike(r"(^|/)__init__\.[A-Za-z0-9]+$")
    up = F.greatest(F.size(package) - F.col("level") + is_package.cast("int"), F.lit(0))
    above = F.array_join(F.slice(package, F.lit(1), up), ".")
    dotted = F.when(F.col("level") == 0, F.col("module")).when(F.col("module") == "", above).when(above == "", F.col("module")).otherwise(F.concat_ws(".", above, "module"))
    rows = rows.withColumn("module", dotted)
    known = files.select(F.col("file_path").alias("target_file")).distinct().withColumn("whole", module_of(F.col("target_file")))
    place = F.row_number().over(Window.partitionBy("tail").orderBy(F.length("whole"), "target_file"))
    known = known.select("target_file", "whole", F.explode(_tails(F.col("whole"))).alias("tail")).withColumn("r", place).filter("r = 1").select("target_file", "tail")
    # "from package import module" names a module; "from module import name" a name in one
    both = rows.withColumn("whole", F.when(F.col("symbol").isNotNull(), F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "symbol")))
    as_module = both.filter("whole is not null").join(known.withColumnRenamed("tail", "whole"), "whole").select("file_path", "alias", "target_file", F.lit(None).cast("string").alias("symbol"))
    in_module = both.join(known.withColumnRenamed("tail", "module"), "module").select("file_path", "alias", "target_file", "symbol")
    return as_module.unionByName(in_module).distinct()


def call_edges(concepts: DataFrame, references: DataFrame) -> DataFrame:
    """``caller_file, caller, caller_line, name, callee_file, callee, callee_line, scope``: of each called name (once for each calling
    function) the definition it means.  ``concepts`` is the symbol table (functions, methods and classes of files)."""
    table = concepts.filter("concept in ('function', 'method', 'class') and symbol is not null")
    table = table.select(F.col("file_path").alias("callee_file"), F.col("symbol").alias("callee"), F.col("start_line").alias("callee_line"), F.col("parent").alias("_owner"), "concept")
    first = F.row_number().over(Window.partitionBy("callee_file", "_owner", "callee").orderBy("callee_line"))
    table = table.withColumn("_r", first).filter("_r = 1").drop("_r")
    top = table.filter("_owner is null")
    calls = references.filter("kind = 'call' and name is not null")
    calls = calls.select(F.col("file_path").alias("caller_file"), F.col("symbol").alias("caller"), F.col("start_line").alias("caller_line"), "name", F.col("parent").alias("_class")).distinct()
    calls = calls.withColumns({"_head": F.substring_index("name", ".", 1), "_last": F.substring_index("name", ".", -1), "_stem": F.expr("CASE WHEN instr(name, '.') > 0 THEN left(name, length(name) - length(substring_index(name, '.', -1)) - 1) END")})
    out = [*EDGE, "callee_file", "callee", "callee_line"]
    found = lambda df, scope, rank: df.select(*out, F.lit(scope).alias("scope"), F.lit(rank).alias("_rank"))

    own = calls.filter("_class is not null and name = concat('self.', _last)").join(table.filter("concept = 'method'"), (F.col("caller_file") == F.col("callee_file")) & (F.col("_class") == F.col("_owner")) & (F.col("_last") == F.col("callee")))
    local = calls.filter("_stem is null").join(top, (F.col("caller_file") == F.col("callee_file")) & (F.col("name") == F.col("callee")))
    names = import_table(references, concepts).withColumnsRenamed({"file_path": "_in", "symbol": "_symbol"})
    by_name = calls.filter("_stem is null").join(names.filter("_symbol is not null"), (F.col("caller_file") == F.col("_in")) & (F.col("name") == F.col("alias")))
    by_name = by_name.join(top, (F.col("target_file") == F.col("callee_file")) & (F.col("_symbol") == F.col("callee")))
    by_module = calls.filter("_stem is not null").join(names.filter("_symbol is null"), (F.col("caller_file") == F.col("_in")) & (F.col("_stem") == F.col("alias")))
    by_module = by_module.join(top, (F.col("target_file") == F.col("callee_file")) & (F.col("_last") == F.col("callee")))
    of_class = calls.filter("_stem is not null").join(names.filter("_symbol is not null"), (F.col("caller_file") == F.col("_in")) & (F.col("_stem") == F.col("alias")))
    of_class = of_class.join(table, (F.col("target_file") == F.col("callee_file")) & (F.col("_symbol") == F.col("_owner")) & (F.col("_last") == F.col("callee")))
    single = table.groupBy("callee").agg(F.count(F.lit(1)).alias("_n"), F.first("callee_file").alias("callee_file"), F.first("callee_line").alias("callee_line")).filter("_n = 1")
    everywhere = calls.filter("_head <> 'self' or _class is null").join(single, F.col("_last") == F.col("callee"))
    every = found(own, "class", 1)
    for df, scope, rank in ((local, "file", 2), (by_name, "import", 3), (by_module, "import", 3), (of_class, "import", 3), (everywhere, "only", 4)):
        every = every.unionByName(found(df, scope, rank))
    nearest = F.row_number().over(Window.partitionBy(*EDGE).orderBy("_rank", "callee_file", "callee_line"))
    return every.withColumn("_n", nearest).filter("_n = 1").select(*out, "scope")


def callers_of(edges: DataFrame, symbol: str) -> DataFrame:
    """Functions that call a definition of this name: an equality filter."""
    return edges.filter(F.col("callee") == symbol).select("caller_file", "caller", "caller_line", "callee_file").distinct()
