"""Item and content sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.operators import convert


def _plain(items: DataFrame) -> DataFrame:
    """One JSON text a row; a single variant or struct column is the item itself."""
    kinds = items.dtypes
    whole = len(kinds) == 1 and (kinds[0][1] == "variant" or kinds[0][1].startswith(("struct", "map")))
    return items.select(F.to_json(items.columns[0] if whole else F.struct(*items.columns)).alias("value"))


def write_jsonl(items: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line, one file a partition."""
    _plain(items).write.mode(mode).text(path)


def write_json_array(items: DataFrame, path: str, *, indent: bool = False) -> int:
    """One file that holds a JSON array, through the driver's file system, row by row; the number of items.

    Parent folders are made.  Rows stream through the driver one at a time; for a large
    result use ``write_jsonl``.
    """
    import json
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in _plain(items).toLocalIterator():
            text = json.dumps(json.loads(row.value), indent=2, ensure_ascii=False) if indent else row.value
            f.write(("," if n else "") + ("\n" if indent else "") + ("\n".join("  " + x for x in text.splitlines()) if indent else text))
            n += 1
        f.write("\n]" if indent and n else "]")
    return n


def write_content(pages: DataFrame, path: str, *, name: str = "page_id", selector: str | None = None) -> None:
    """Converted content as text files, partitioned by page name; the suffix of path (.md, .html, .txt) picks the kind."""
    suffix = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if not path.strip() or suffix not in convert.KINDS:
        raise ValueError("the name must end in .md, .html or .txt")
    text = F.array_join(convert.content("html", convert.KINDS[suffix], selector=selector), "")
    pages.select(F.col(name).cast("string").alias("page"), text.alias("value")).write.partitionBy("page").text(path)


def write_items(items: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: str | None = None) -> None:
    """Columnar and text formats of Spark (parquet, orc, json, csv)."""
    writer = items.write.mode(mode).format(kind)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
