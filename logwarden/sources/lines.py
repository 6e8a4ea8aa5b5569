"""Log files to logical records: file, line_number, line, flags, physical_line_range."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from logwarden.functions.text import strip
from logwarden.operators.ordered import fill_forward, number_rows
from logwarden.session import materialize

# Input suffixes and record flags.
INPUT_SUFFIXES = [".log", ".txt", ".csv", ".json", ".jsonl"]
FLAG_BOM = "had_utf8_bom"
FLAG_LATIN1 = "decode_fallback_latin1"
FLAG_MERGED = "continuation_merged"

_GLOB = "*.{log,LOG,txt,TXT}"


def discover_files(spark: SparkSession, root: str, access_logs_only: bool = False) -> DataFrame:
    """Input files below ``root`` with server type and run id; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(F.col("path").alias("file"), "length", "modificationTime")
    )
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    if access_logs_only:
        files = files.where(name.rlike(r"^access.*\.log$"))
    else:
        files = files.where(name.rlike(r"(?:" + "|".join(s.replace(".", r"\.") for s in INPUT_SUFFIXES) + r")$"))
    return files.withColumns({
        "server_type": server_type_of_path(F.col("file")),
        "run_id": run_id(F.col("file"), root),
    })


def server_type_of_path(path):
    """First folder named apache, nginx or iis; else unknown."""
    hit = F.regexp_extract(F.lower(path), "/(apache|nginx|iis)/", 1)
    return F.coalesce(F.nullif(hit, F.lit("")), F.lit("unknown"))


def run_id(path, root: str):
    """Path below ``root`` without suffix, parts joined by a double underscore."""
    bare = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    pos = F.instr(path, bare)
    relative = F.when(pos > 0, F.substring(path, pos + len(bare), F.length(path))).otherwise(
        F.element_at(F.split(path, "/"), -1))
    return F.replace(F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def read_physical_lines(spark: SparkSession, root: str, glob: str = _GLOB) -> DataFrame:
    """All physical lines with their number; large files are read in parallel splits.

    The text source cuts lines at LF, CRLF and CR and hands the raw bytes on, so bad
    UTF-8 is seen here. Splits of a file are put in order by their byte offset.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value")
    boms = _files_with_bom(spark, root, glob)
    return (
        number_lines(raw).join(boms, "file", "left")
        .withColumn("bom", F.coalesce(F.col("bom"), F.lit(False)) & (F.col("physical_line") == 1))
    )


def number_lines(raw: DataFrame) -> DataFrame:
    """Physical lines of whole files (``file, _start, value``) with their number; bytes that are no UTF-8 are read as Latin-1.

    ``_start`` is the offset of the split that a line comes from; within one, rows come in file order. A split is
    read by one task, so its rows have consecutive ids there: numbering needs first id and size of each split, and
    texts are neither moved nor sorted.
    """
    utf8 = F.is_valid_utf8("value")
    rows = raw.withColumn("_seq", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "_start").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).drop("_n", "_first")
    return rows.join(splits, ["file", "_start"]).select(
        "file", (F.col("_before") + F.col("_seq")).cast("bigint").alias("physical_line"),
        F.when(utf8, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("line"),
        (~utf8).alias("latin1"),
    )


def _files_with_bom(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files that start with a UTF-8 byte-order mark (the line reader drops it silently).

    Three bytes per file are read, inside tasks, with the credentials that the workers have.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(root).select(F.col("path").alias("file"))
    )

    def probe(batches):
        import re
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        for batch in batches:
            marks = []
            for uri in batch["file"]:
                local = urlparse(uri).scheme in ("", "file")
                system, path = (fs.LocalFileSystem(), unquote(urlparse(uri).path)) if local else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
                with system.open_input_stream(path, compression=None) as stream:
                    marks.append(stream.read(3) == b"\xef\xbb\xbf")
            yield pd.DataFrame({"file": batch["file"], "bom": marks})

    return listing.mapInPandas(probe, "file string, bom boolean").where("bom")


def lines_from_binary(files: DataFrame) -> DataFrame:
    """Physical lines of whole files given as ``file, content``; for small files."""
    text = F.decode("content", "ISO-8859-1")
    pieces = files.select("file", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("p", "l"))
    mark = "\xef\xbb\xbf"  # the three BOM bytes, as ISO-8859-1 text
    bom = (F.col("p") == 0) & F.col("l").startswith(mark)
    body = F.when(bom, F.substring("l", 4, F.length("l"))).otherwise(F.col("l"))
    raw = F.encode(body, "ISO-8859-1")
    ok = F.is_valid_utf8(raw.cast("string"))
    return pieces.select(
        "file", (F.col("p") + 1).cast("bigint").alias("physical_line"),
        F.when(ok, raw.cast("string")).otherwise(body).alias("line"),
        (~ok).alias("latin1"), bom.alias("bom"),
    )


def merge_continuations(lines: DataFrame) -> DataFrame:
    """Logical records: an indented line joins the record before it.

    Input: file, physical_line, line, latin1, bom. Parts are joined by a backslash and
    an ``n``, which later marks the request as an injection attempt.
    """
    kept = lines.where(strip("line") != "")
    numbered = kept.withColumn("_indented", F.substring("line", 1, 1).isin(" ", "\t"))
    # Which record an indented line joins is found on line numbers; of the texts only indented ones are moved.
    head = F.when(~F.col("_indented"), F.col("physical_line"))
    found = fill_forward(numbered.select("file", "physical_line", "_indented"), ["file"], "physical_line", head, "_head")
    # Indented lines before the first head of a file form one record, that of head 0.
    found = found.where("_indented").select("file", "physical_line", F.coalesce("_head", F.lit(0)).alias("_head"))
    tails = numbered.where("_indented").join(found, ["file", "physical_line"]).groupBy("file", "_head").agg(
        F.array_sort(F.collect_list(F.struct("physical_line", "line"))).alias("_parts"),
        F.min("physical_line").alias("_first"), F.max("physical_line").alias("_last"),
        F.bool_or("bom").alias("_bom"), F.bool_or("latin1").alias("_latin1"))
    tails = materialize(tails.withColumn("_parts", F.transform("_parts", lambda x: x["line"])), "tails")
    alone = tails.where("_head = 0").select(
        "file", F.array_join("_parts", "\\n").alias("line"), "_bom", "_latin1", (F.size("_parts") > 1).alias("_merged"), "_first", "_last")
    joining = tails.where("_head > 0").select("file", F.col("_head").alias("physical_line"), "_parts", "_last", "_bom", "_latin1")
    no = F.lit(False)
    headed = numbered.where("not _indented").join(joining, ["file", "physical_line"], "left").select(
        "file", F.when(F.col("_parts").isNull(), F.col("line")).otherwise(F.concat_ws("\\n", "line", "_parts")).alias("line"),
        (F.col("bom") | F.coalesce("_bom", no)).alias("_bom"), (F.col("latin1") | F.coalesce("_latin1", no)).alias("_latin1"),
        F.col("_parts").isNotNull().alias("_merged"), F.col("physical_line").alias("_first"), F.coalesce("_last", "physical_line").alias("_last"))
    records = headed.unionByName(alone).select(
        "file", "line",
        F.array_compact(F.array(
            F.when(F.col("_bom"), FLAG_BOM),
            F.when(F.col("_latin1"), FLAG_LATIN1),
            F.when(F.col("_merged"), FLAG_MERGED),
        )).alias("flags"),
        F.array("_first", "_last").alias("physical_line_range"),
    )
    # Numbering reads its input twice; the merge should run once.
    records = materialize(records, "records")
    blocks = records.withColumn("_at", F.col("physical_line_range")[0]).withColumn(
        "_blk", F.floor(F.col("_at") / (1 << 20)))
    return number_rows(blocks, ["file"], "_blk", "_at", "line_number").select(
        "file", "line_number", "line", "flags", "physical_line_range")


def read_log_records(spark: SparkSession, root: str, glob: str = _GLOB) -> DataFrame:
    """Logical records of all text logs below ``root``.

    The numbered lines and the merged records are staged in the shared folder, so the raw
    text is scanned twice (sizes, lines) however many steps follow.
    """
    lines = materialize(read_physical_lines(spark, root, glob), "lines")
    return merge_continuations(lines).withColumn(
        "server_type", server_type_of_path(F.col("file")))


def collector_quality(records: DataFrame) -> DataFrame:
    """Counts of records per collector flag."""
    def n(flag: str):
        return F.count_if(F.array_contains("flags", flag))

    return records.agg(
        n(FLAG_LATIN1).alias("decode_error_records"),
        n(FLAG_BOM).alias("had_bom_records"),
        n(FLAG_MERGED).alias("continuation_merged_records"),
    )
