"""Readers and writers of record tables, truth lists, scores and indexes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions import text as X

RECORD = T.StructType([T.StructField(c, T.StringType(), False) for c in ("entity_id", "business_name", "business_address", "country")])


def _read_tsv(spark: SparkSession, path: str, schema: T.StructType, strict: bool, place: bool) -> DataFrame:
    options = {"sep": "\t", "header": True, "quote": "", "enforceSchema": not strict, "mode": "FAILFAST" if strict else "PERMISSIVE", "encoding": "UTF-8"}
    df = spark.read.options(**options).schema(schema).csv(path)
    text = [(F.coalesce(F.col(f.name), F.lit("")) if f.dataType == T.StringType() else F.col(f.name)).alias(f.name) for f in schema]
    return _numbered(df, text) if place else df.select(*text)


def _numbered(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows of files with ``seq``, their row number from 0 in the order of the files: rows are counted a block of a file, and blocks are added up."""
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = df.select(*columns, *block, F.monotonically_increasing_id().alias("at"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # A row a block of a file, so this window is small however many rows there are.
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    starts = counts.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["file", "block"]).withColumn("seq", F.col("start") + F.col("at") - F.col("first")).drop("file", "block", "at", "first", "start")


def read_records(spark: SparkSession, path: str, *, strict: bool = False, place: bool = False) -> DataFrame:
    """A tab-separated record table, no quoting. Missing fields are empty; a strict read fails on other headers or widths.

    With ``place`` there is a column ``seq``, the row number in the file.
    """
    return _read_tsv(spark, path, RECORD, strict, place)


def read_lists(spark: SparkSession, path: str, column: str, *, place: bool = False) -> DataFrame:
    """A list file as (s1_id, ids); fails on another header or width."""
    schema = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField(column, T.StringType())])
    return _read_tsv(spark, path, schema, True, place).withColumnsRenamed({"source1_entity_id": "s1_id", column: "ids"})


SCORES = "target_id string, candidate_s1_id string, model_probability double, retrieval_score double, candidate_rank int"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score export as (s1_id, target_id, p), by the names in its header; fails where one is absent or a probability is no number."""
    df = spark.read.options(sep="\t", header=True, quote="", mode="FAILFAST").csv(path)
    absent = {"target_id", "candidate_s1_id", "model_probability"} - set(df.columns)
    if absent:
        raise ValueError(f"{path} lacks {', '.join(sorted(absent))}")
    return df.select(F.col("candidate_s1_id").alias("s1_id"), "target_id", F.col("model_probability").cast("double").alias("p"))


def sources_of(spark: SparkSession, folder: str, part: str, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first source with ``seq``, and both noisy ones with is_s2, of a folder of three files named after ``part``."""
    names = {"entity_id": "id", "business_name": "name", "business_address": "addr"}
    read = lambda k, **more: read_records(spark, f"{folder}/{part}_source{k}.tsv", strict=strict, **more).withColumnsRenamed(names)
    return read(1, place=True), union_sources(read(2), read(3))


def read_dict_rows(spark: SparkSession, path: str, *, sep: str = "\t", null: str = "") -> DataFrame:
    """Any delimited table by its header; all columns text."""
    return spark.read.options(sep=sep, header=True, nullValue=null).csv(path)


def of_country(records: DataFrame, country: str) -> DataFrame:
    """A predicate that reaches the scan, and prunes folders of a table partitioned by country."""
    return records.where(F.col("country") == country)


def union_sources(second: DataFrame, third: DataFrame) -> DataFrame:
    """Both noisy sources, tagged is_s2 1 and 0."""
    return second.withColumn("is_s2", F.lit(1)).unionByName(third.withColumn("is_s2", F.lit(0)))


def parse_truth(lists: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) -> (s1_id, target_id), a row a match; blanks and repeats dropped."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("target_id"))


def pool_sample(targets: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """The first n targets by id, and every needed one."""
    head = targets.orderBy("id").limit(n)
    return head.unionByName(targets.join(needed.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi")).dropDuplicates(["id"])


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt to all cores; one of many files is read where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def records_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: three sources by id, language as country, the text's start as name and all the rest as address."""
    d = _spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    return d.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
        (F.col("doc_id") % 3).cast("int").alias("k"),
        "doc_id", F.col("lang").alias("country"),
        line(F.substring(F.coalesce("text", F.lit("")), 1, 40)).alias("name"),
        line(F.substring(F.coalesce("text", F.lit("")), 41, 2**31 - 1)).alias("addr"),
    )


def truth_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a first-source document and another in the same language with the same text, by its hash."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    name = lambda c: F.concat(F.lit("S"), (F.col(c) % 3 + 1).cast("string"), F.lit("-"), F.col(c).cast("string"))
    one = d.where("doc_id % 3 = 0").select(name("doc_id").alias("s1_id"), "lang", "h")
    return one.join(d.where("doc_id % 3 <> 0").select(name("doc_id").alias("target_id"), "lang", "h"), ["lang", "h"]).select("s1_id", "target_id")


def prepare(records: DataFrame) -> DataFrame:
    """Records (id, name, addr, country, ...) with every derived field that blocking and features use."""
    r = records.withColumns({"norm_name": X.normalize_name(F.col("name")), "norm_addr": X.normalize_address(F.col("addr"))})
    return r.withColumns({
        "core": X.core_tokens(F.col("norm_name")), "addr_words": F.array_distinct(X.tokens(F.col("norm_addr"))), "digits": X.address_digits(F.col("addr")),
        "prefix6": F.substring("norm_name", 1, 6), "postal": X.postal(F.col("addr")), "street_num": X.street_number(F.col("addr")),
    })


def id_lists(s1: DataFrame, results: DataFrame, *, order: str = "target_id") -> DataFrame:
    """(s1_id, ids): every s1 row, its targets joined by commas in the order given, empty where there are none."""
    lists = results.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("target_id").alias("t")))).alias("l"))
    return s1.join(lists, "s1_id", "left").withColumn("ids", F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ","), F.lit(""))).drop("l")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _path(spark, path)
    return files.exists(p)


def write_lines(lines: DataFrame, path: str, header: str) -> None:
    """One text file with a header line; fails if the path is taken, appears as a whole or not at all.

    Lines (one text column, in order) are written by all tasks as parts, which are then appended to one file by a
    buffered copy, so that no task and no driver holds them.
    """
    spark = lines.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    parts, whole = path + ".parts", path + ".partial"
    lines.write.mode("overwrite").text(parts)
    (folder, files), (target, _), (done, _) = (_path(spark, x) for x in (parts, whole, path))
    out = files.create(target, True)
    try:
        out.write(bytearray((header + "\n").encode()))
        names = sorted(f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
        for name in names:
            part = files.open(spark._jvm.org.apache.hadoop.fs.Path(name))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    files.delete(folder, True)
    if not files.rename(target, done):
        raise OSError(f"{whole} could not be renamed")


def write_id_lists(lists: DataFrame, path: str, seq: str, column: str) -> None:
    """One tab-separated file in input order, sorted by ranges in all tasks; fails if the path is taken, appears as a whole or not at all."""
    write_lines(lists.orderBy(seq).select(F.concat_ws("\t", "s1_id", "ids").alias("line")), path, f"source1_entity_id\t{column}")


def write_table(table: DataFrame, path: str, *order: str, sep: str = ",") -> None:
    """A table of plain columns as one delimited file in the order given; texts with the delimiter, a quote or a line end are quoted."""
    quoted = lambda c: F.when(F.rlike(c, F.lit(f'[{sep}"\n\r]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [F.coalesce(quoted(F.col(c).cast("string")), F.lit("")) for c in table.columns]
    write_lines((table.orderBy(*order) if order else table).select(F.concat_ws(sep, *cells).alias("line")), path, sep.join(table.columns))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small dictionary as one JSON file, written as a whole; what was there is replaced."""
    p, files = _path(spark, path)
    out = files.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def accepted_scores(scored: DataFrame) -> DataFrame:
    """The score export: accepted pairs, ranks from 1."""
    return scored.where("accepted").select("target_id", F.col("s1_id").alias("candidate_s1_id"), F.col("p").alias("model_probability"), F.col("weight").alias("retrieval_score"), (F.col("rank") + 1).alias("candidate_rank"))


def write_index(postings: DataFrame, path: str) -> None:
    """Postings clustered by key, a folder a country."""
    postings.repartition("country", "channel", "key").sortWithinPartitions("channel", "key", "target_id").write.partitionBy("country").mode("errorifexists").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A finished index; one whose writer did not finish has no success mark and is refused."""
    if not exists(spark, path + "/_SUCCESS"):
        raise ValueError(f"{path} is not a finished index")
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, paths: list[str], ends: int = 1 << 16) -> str:
    """SHA-256 over each input's path, length and modification time, as its file system reports them, and its first and last ``ends`` bytes."""
    h, read = hashlib.sha256(), spark._jvm.org.apache.commons.io.IOUtils.toByteArray
    for path in sorted(paths):
        p, files = _path(spark, path)
        s = files.getFileStatus(p)
        size = s.getLen()
        h.update(json.dumps((path, size, s.getModificationTime())).encode())
        stream = files.open(p)
        try:
            for start in (0, size - ends) if size > ends else (0,):
                stream.seek(start)
                h.update(bytes(read(stream, min(ends, size - start))))
        finally:
            stream.close()
    return h.hexdigest()


def append_ledger(spark: SparkSession, path: str, **entry) -> None:
    """One more line of an experiment ledger in JSON lines."""
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def partition_name(country: Column) -> Column:
    """A folder-safe name of a country."""
    return F.when(F.rlike(country, F.lit("^[A-Za-z0-9_-]+$")), country).otherwise(F.sha1(country.cast("binary")))
