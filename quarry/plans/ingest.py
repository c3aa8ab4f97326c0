"""Ingest queries: kinds and guards of files, with paths made of page addresses and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..sources import files
from .registry import query, table

#: Paths with a variety of names.
_SUFFIXES = ["txt", "MD", "py", "ipynb", "csv", "html", "pdf", "docx", "png", "sql", "pyc", "xyz", "ts", "json"]
_PATH = "'/root/' || source || CASE WHEN doc_id % 9 = 0 THEN '/node_modules/' WHEN doc_id % 10 = 0 THEN '/.' ELSE '/' END || 'file' || doc_id || '.' || [" + ", ".join(f"'{s}'" for s in _SUFFIXES) + "][(doc_id % 14 + 1)::INT]"
_EXT = f"lower(regexp_extract(p, '([.][^./]+)$', 1))"


def _paths(spark, sf):
    folder = F.when(F.col("doc_id") % 9 == 0, "/node_modules/").when(F.col("doc_id") % 10 == 0, "/.").otherwise("/")
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 14 + 1).cast("int"))
    path = F.concat(F.lit("/root/"), "source", folder, F.lit("file"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("length"), "source")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _case(mapping, default) -> str:
    return "CASE " + " ".join(f"WHEN {_EXT} IN {_in(v)} THEN '{k}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


_FROM = f"FROM (SELECT doc_id, {_PATH} AS p, strlen(text) AS length, source FROM documents)"
_IGNORED = "(string_split(p, '/')[-1][1] = '.' OR " + " OR ".join(f"contains(p, '{x}')" for x in files.IGNORED if x[0] not in ".*") + " OR " + " OR ".join(f"ends_with(p, '{x[1:]}')" for x in files.IGNORED if x.startswith("*.")) + ")"


@query("s04_supported", f"SELECT doc_id, {_EXT} IN {_in(files.EXTENSIONS)} AS supported {_FROM}")
def supported(spark, sf):
    return _paths(spark, sf).select("doc_id", files.supported(F.col("path")).alias("supported"))


@query("s05_ignored", f"SELECT doc_id, {_IGNORED} AS ignored {_FROM}")
def ignored(spark, sf):
    return _paths(spark, sf).select("doc_id", files.ignored(F.col("path")).alias("ignored"))


@query("s03_guarded", f"SELECT doc_id, p AS path {_FROM} WHERE length BETWEEN 1 AND 20000 AND {_EXT} IN {_in(files.EXTENSIONS)} AND NOT {_IGNORED}")
def guarded(spark, sf):
    return files.guarded(_paths(spark, sf), most=20000).select("doc_id", "path")


@query("s06_mime", f"SELECT doc_id, CASE {' '.join(f'WHEN {_EXT} = {k!r} THEN {v!r}' for k, v in files.MIME_TYPES.items())} ELSE 'application/octet-stream' END AS mime {_FROM}")
def mime(spark, sf):
    return _paths(spark, sf).select("doc_id", files.mime_type(F.col("path")).alias("mime"))


@query("s07_category", f"SELECT doc_id, {_case(files.CATEGORIES, 'unknown')} AS category {_FROM}")
def category(spark, sf):
    return _paths(spark, sf).select("doc_id", files.category(F.col("path")).alias("category"))


@query("s09_parser", f"SELECT doc_id, {_case(files.PARSERS, 'text')} AS parser {_FROM}")
def parser(spark, sf):
    return _paths(spark, sf).select("doc_id", files.parser(F.col("path")).alias("parser"))


@query("f13_path_prefix", f"SELECT doc_id {_FROM} WHERE starts_with(p, '/root/src1/')")
def path_prefix(spark, sf):
    return _paths(spark, sf).where(tables.under(F.col("path"), "/root/src1")).select("doc_id")


@query("s02_roots", f"SELECT source AS root, count(*) AS scanned, sum(length)::BIGINT AS bytes {_FROM} GROUP BY source")
def roots(spark, sf):
    return _paths(spark, sf).groupBy(F.col("source").alias("root")).agg(F.count(F.lit(1)).alias("scanned"), F.sum("length").alias("bytes"))


@query("s19_by_status", "SELECT vec_id, label FROM embeddings WHERE label = 2")
def by_status(spark, sf):
    return table(spark, sf, "embeddings").where("label = 2").select("vec_id", "label").orderBy("vec_id")


@query("s20_chunk_vectors", "SELECT d.doc_id, e.label, len(e.embedding)::BIGINT AS dims FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.lang = 'en'")
def chunk_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").cast("long").alias("dims"))
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").join(vectors, "doc_id")
