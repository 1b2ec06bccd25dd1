"""Readers and writers: source trees, project documents, tables, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom import schemas


def source_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(file, author, repo, text) of all files below author/repo folders; others are left alone."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.regexp_replace(F.input_file_name(), "^[a-z]+:/*", "/")
    base = root.split("://")[-1].rstrip("/")
    inside = F.regexp_replace(path, f"^/*{base.lstrip('/')}/", "")
    out = rows.select(inside.alias("file"), F.split(inside, "/")[0].alias("author"), F.try_element_at(F.split(inside, "/"), F.lit(2)).alias("repo"), F.col("value").alias("text"))
    return out.where(~F.col("file").rlike(r"(^|/)\."))


def repositories(files: DataFrame) -> DataFrame:
    """Distinct author/repo pairs; folders with a leading dot don't count."""
    return files.where("author not like '.%' and repo not like '.%' and size(split(file, '/')) > 2").select("author", "repo").distinct()


def without_duplicates(files: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Files that a duplicate list doesn't name."""
    return files.join(duplicates.select("file").distinct(), "file", "left_anti")


def project_documents(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Module documents of the first ``limit`` projects: (project, file, module).

    A project file maps author/repo to its ``src_files``, and these map paths to modules.
    """
    chosen = paths[:limit] if limit else paths
    if not chosen:
        raise ValueError("no processed projects")
    kind = "map<string,struct<src_files:map<string,string>>>"
    rows = spark.read.text(chosen, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("project", "content"))
    files = rows.select("project", F.explode("content.src_files").alias("file", "json"))
    return files.select("project", "file", F.from_json("json", schemas.MODULE).alias("module"))


def module_document(spark: SparkSession, path: str) -> DataFrame:
    """(file, module) of files with one module document each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schemas.MODULE).alias("module"))


def scored(raw: Column) -> Column:
    """[["type", "0.6"], ..] as an array of struct(type, score)."""
    return F.transform(raw, lambda p: F.struct(p[0].alias("type"), p[1].cast("double").alias("score")))


def flattened_predictions(modules: DataFrame, digits: int = 3) -> DataFrame:
    """(file, slot, type, score): every prediction of variables, parameters and returns, at all levels."""
    base = modules.select("file", "module.*")
    functions = base.select("file", F.explode("funcs").alias("f")).select("file", F.col("f.q_name").alias("scope"), "f.*")
    classes = base.select("file", F.explode("classes").alias("c")).select("file", F.col("c.q_name").alias("class"), "c.*")
    methods = classes.select("file", F.explode("funcs").alias("f")).select("file", F.col("f.q_name").alias("scope"), "f.*")
    both = functions.select("file", "scope", "params_p", "variables_p", "ret_type_p").unionByName(methods.select("file", "scope", "params_p", "variables_p", "ret_type_p"))
    maps = [
        base.select("file", F.lit("").alias("scope"), F.lit("var").alias("kind"), F.explode("variables_p").alias("name", "raw")),
        classes.select("file", F.col("class").alias("scope"), F.lit("var").alias("kind"), F.explode("variables_p").alias("name", "raw")),
        both.select("file", "scope", F.lit("param").alias("kind"), F.explode("params_p").alias("name", "raw")),
        both.select("file", "scope", F.lit("var").alias("kind"), F.explode("variables_p").alias("name", "raw")),
        both.where("ret_type_p is not null").select("file", "scope", F.lit("ret").alias("kind"), F.lit("return").alias("name"), F.col("ret_type_p").alias("raw")),
    ]
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    rows = out.select("file", "scope", "kind", "name", F.posexplode(scored(F.col("raw"))).alias("position", "p"))
    return rows.select("file", "scope", "kind", "name", "position", F.col("p.type").alias("type"), F.round("p.score", digits).alias("score"))


def function_rows(modules: DataFrame) -> DataFrame:
    """Functions and methods of (project, file, module) as rows of the functions table."""
    base = modules.select("project", "file", "module.*")
    listed = base.select("project", "file", "set", F.explode(F.concat(F.coalesce("funcs", F.array()), F.flatten(F.coalesce(F.transform("classes", lambda c: c["funcs"]), F.array())))).alias("f"))
    names = F.map_keys("f.params")
    parts = F.split("project", "/")
    return listed.select(
        parts[0].alias("author"), F.try_element_at(parts, F.lit(2)).alias("repo"), "file", "set", F.col("f.name").alias("name"), F.col("f.docstring.func").alias("func_descr"), names.alias("arg_names"), F.map_values("f.params").alias("arg_types"),
        F.transform(names, lambda n: F.coalesce(F.try_element_at("f.params_descr", n), F.lit(""))).alias("arg_descrs"), F.transform(names, lambda n: F.transform(F.coalesce(F.try_element_at("f.params_occur", n), F.array()), lambda o: F.array_join(o, " "))).alias("args_occur"),
        F.col("f.ret_type").alias("return_type"), F.col("f.ret_exprs").alias("return_expr"),
    )


def variable_rows(modules: DataFrame) -> DataFrame:
    """Module, class and local variables as rows of the variables table."""
    base = modules.select("file", "module.*")
    functions = base.select("file", "set", F.explode("funcs").alias("f")).unionByName(base.select("file", "set", F.explode(F.flatten(F.transform("classes", lambda c: c["funcs"]))).alias("f")))
    parts = [
        base.select("file", "set", F.explode("variables").alias("var_name", "var_type"), F.col("mod_var_occur").alias("occur")),
        base.select("file", "set", F.explode("classes").alias("c")).select("file", "set", F.explode("c.variables").alias("var_name", "var_type"), F.col("c.cls_var_occur").alias("occur")),
        functions.select("file", "set", F.explode("f.variables").alias("var_name", "var_type"), F.col("f.fn_var_occur").alias("occur")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("file", "set", "var_name", "var_type", F.transform(F.coalesce(F.try_element_at("occur", F.col("var_name")), F.array()), lambda o: F.array_join(o, " ")).alias("var_occur"))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with quoted line breaks; empty and 'nan' strings become null where a type is expected."""
    rows = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    for c in ("return_type", "var_type", "arg_type"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.when(F.col(c).isin("", "nan"), F.lit(None)).otherwise(F.col(c)))
    return rows


def write_csv(table: DataFrame, path: str) -> None:
    """CSV that ``read_csv`` reads: a header, quotes doubled."""
    table.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_frequencies(types: DataFrame, visible: DataFrame, path: str, top_n: int = 1024) -> None:
    """The two frequency lists of a build: all labels with their codes and counts, and the most frequent visible types."""
    from slotloom.operators import labels

    write_csv(labels.encoded(types).select(F.col("code").alias("enc"), "type", F.col("n").alias("count")).orderBy(F.desc("count"), "type"), f"{path}/most_frequent_all_types")
    write_csv(labels.top_types(visible, top_n).select(F.col("type").alias("Types"), F.col("n").alias("Count")).orderBy(F.desc("Count"), "Types"), f"{path}/top_visible_types")


def write_datapoints(table: DataFrame, path: str) -> None:
    """One Parquet table; readers of one task or split scan only its folders."""
    table.write.mode("overwrite").partitionBy("task", "split").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def visible_types(spark: SparkSession, folder: str) -> DataFrame:
    """One type per line of the folder's own files."""
    return spark.read.text(folder).select(F.col("value").alias("type"))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A service table over JDBC; its driver must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def append_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends rows to a service table over JDBC; each partition is a transaction of its own."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


def jdbc_partitioned(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A service table over several connections: ranges of a numeric, date or timestamp column between its least and its greatest value.

    The database gives the two; null values are read with the first range, and an empty table by one connection.
    """
    bounds = jdbc_table(spark, url, f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) bounds", **options).first()
    low, high = tuple(bounds)
    if low is None or low == high:
        return jdbc_table(spark, url, table, **options)
    return jdbc_table(spark, url, table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)


def append_jdbc_epoch(rows: DataFrame, url: str, table: str, epoch: int, **options: str) -> None:
    """Appends an epoch's rows to a service table with a column ``epoch``, once however often it runs.

    The rows go to a staging table of the epoch by as many connections as there are partitions; then one transaction takes what
    the epoch had before out of the table and puts the staged rows in.  The table is made if it isn't there.  A run
    that ends in between leaves the table as it was.
    """
    spark, staging = rows.sparkSession, f"{table}_staging_{epoch}"
    keyed = rows.withColumn("epoch", F.lit(epoch).cast("long"))
    keyed.write.format("jdbc").option("url", url).option("dbtable", staging).options(**options).mode("overwrite").save()
    append_jdbc(keyed.limit(0), url, table, **options)
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        names = ", ".join(f'"{c}"' for c in keyed.columns)
        statement.executeUpdate(f"DELETE FROM {table} WHERE \"epoch\" = {epoch}")
        statement.executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}")
        connection.commit()
        statement.executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
