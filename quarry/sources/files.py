"""Files as rows: listing, guards, kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 100 * 1024 * 1024

#: The extensions that are read, and the names that are passed over.
EXTENSIONS = [
    ".txt", ".md", ".markdown", ".rst", ".org", ".pdf", ".docx", ".doc", ".odt", ".csv", ".tsv", ".json", ".jsonl",
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".rb", ".php", ".cs",
    ".swift", ".kt", ".scala", ".r", ".sql", ".sh", ".bash", ".zsh", ".html", ".htm", ".xml", ".yaml", ".yml",
    ".toml", ".ipynb", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff",
]
IGNORED = [".*", "__pycache__", "node_modules", ".git", ".svn", ".hg", "venv", "env", ".venv", "build", "dist", "target", "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll"]

#: Categories by extension; others are unknown.
CATEGORIES = {
    "pdf": [".pdf"],
    "document": [".docx", ".doc", ".odt"],
    "text": [".txt", ".md", ".markdown", ".rst", ".org"],
    "html": [".html", ".htm", ".xml"],
    "data": [".csv", ".tsv", ".json", ".jsonl"],
    "notebook": [".ipynb"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff"],
    "code": [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".go", ".rs", ".rb"],
}
#: Parsers by extension, the first that lists it; other supported files are read as text.
PARSERS = {
    "pdf": [".pdf"],
    "markdown": [".md", ".markdown"],
    "docx": [".docx"],
    "html": [".html", ".htm"],
    "notebook": [".ipynb"],
    "csv": [".csv", ".tsv"],
    "code": [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs", ".rb", ".php", ".cs", ".swift", ".kt", ".scala", ".r", ".sql", ".sh", ".bash", ".zsh"],
    "image": [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff"],
}
MIME_TYPES = {
    ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json",
    ".pdf": "application/pdf", ".py": "text/x-python", ".js": "text/javascript", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".xml": "text/xml",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True, content: bool = False) -> DataFrame:
    """path, modificationTime, length and, if asked, content.  Without it no file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
    return rows if content else rows.drop("content")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case suffix with its dot, or nothing; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """``*.x`` tests the end of the name, a leading dot any hidden name, other patterns the whole path."""

    def one(p: str) -> Column:
        if p.startswith("*."):
            return name_of(path).endswith(p[1:])
        return name_of(path).startswith(".") if p.startswith(".") else path.contains(p)

    return reduce(lambda a, b: a | b, map(one, patterns or IGNORED))


def guarded(files: DataFrame, patterns: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """Files that are supported, not ignored, not empty and not too large."""
    path = F.col("path")
    return files.where(F.col("length").between(1, most) & supported(path) & ~ignored(path, patterns))


def _by_extension(path: Column, table: dict[str, list[str]], default: str) -> Column:
    found = F.lit(default)
    for name, extensions in reversed(table.items()):
        found = F.when(extension(path).isin(extensions), name).otherwise(found)
    return found


def category(path: Column) -> Column:
    return _by_extension(path, CATEGORIES, "unknown")


def parser(path: Column) -> Column:
    return _by_extension(path, PARSERS, "text")


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


def folder_size(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
