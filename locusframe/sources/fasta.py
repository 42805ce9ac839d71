"""FASTA haplotypes to chunk tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.sequences import CHUNK_BASES
from locusframe.session import materialize
from locusframe.sources.text import Paths, numbered_lines, write_sorted

LINE_BASES = 80


def _owner(header: Column) -> tuple[Column, Column, Column]:
    """(named founder, position in the founder list, homolog) of a header.

    ``name:pat`` and ``name:mat`` name the founder; ``sampleN`` is founder
    N div 2, homolog N mod 2; anything else is a founder name, paternal.
    """
    colon = header.contains(":")
    number = F.regexp_extract(header, r"^sample(\d+)", 1).try_cast("bigint")
    named = F.when(colon, F.substring_index(header, ":", 1)).when(number.isNull(), header)
    ordinal = F.when(~colon, F.floor(number / 2))
    tail = F.expr("substr(header, instr(header, ':') + 1)")
    homolog = (
        F.when(colon, F.when(tail == "mat", 1).otherwise(0)).when(number.isNotNull(), (number % 2).cast("int")).otherwise(0)
    )
    return named, ordinal, homolog


def read_fasta(
    spark: SparkSession, path: Paths, founders: DataFrame, chunk_bases: int = CHUNK_BASES, chrom: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(haplotypes, chunks) of the founders' sequences.

    Every line is placed by its own task: the header above it and its offset in
    the sequence come from one sweep per split and per-split carries, so a sequence is never gathered.
    A ``sampleN`` beyond the founder list is left out.

    ``chrom`` tells the chromosome of a sequence from its columns ``file`` and
    ``header``; with it, both results carry ``chrom``.  One founder haplotype
    under two headers of a chromosome is an error, in one file or in several.
    """
    trimmed = F.regexp_replace("value", r"\s+$", "")
    is_head = F.col("value").startswith(">")
    bases = F.when(is_head, 0).otherwise(F.length(trimmed)).cast("bigint")
    header = F.when(is_head, trimmed.substr(F.lit(2), F.length(trimmed)))
    rows = numbered_lines(spark, path, ~F.col("value").rlike(r"^\s*(#|$)"), sums={"upto": bases}, last={"own": header})
    placed = rows.withColumns({"n": bases, "value": trimmed}).where(~is_head & F.col("own").isNotNull())
    pieces = placed.select(
        "file",
        "file_no",
        F.col("own.upto").alias("base"),
        F.col("own.is").alias("header"),
        (F.col("upto") - F.col("n") - F.col("own.upto")).alias("offset"),
        "n",
        "value",
    )
    named, ordinal, homolog = _owner(F.col("header"))
    listed = founders.select(F.col("founder").alias("listed"), F.col("ord").cast("bigint").alias("ordinal"))
    owned = (
        pieces.withColumns({"named": named, "ordinal": ordinal, "homolog": homolog})
        .join(materialize(listed, "founder-list"), "ordinal", "left")
        .withColumn("founder", F.coalesce("named", "listed"))
        .where("founder IS NOT NULL")
    )
    last = F.floor((F.col("offset") + F.col("n") - 1) / chunk_bases)
    cut = owned.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("offset") / chunk_bases), last)))
    begin = F.greatest(F.col("chunk_no") * chunk_bases, F.col("offset"))
    stop = F.least((F.col("chunk_no") + 1) * chunk_bases, F.col("offset") + F.col("n"))
    part = F.substring("value", (begin - F.col("offset") + 1).cast("int"), (stop - begin).cast("int"))
    place = [] if chrom is None else ["chrom"]
    if chrom is not None:
        cut = cut.withColumn("chrom", chrom.cast("int"))
    names = [*place, "founder", "homolog"]
    chunks = (
        cut.groupBy("file_no", "base", *names, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), part.alias("bases")))).alias("parts"))
        .select("file_no", "base", *names, "chunk_no", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))
    )
    stored = materialize(chunks, "haplotype-chunks")
    twice = stored.where("chunk_no = 0").groupBy(*names).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"more than one sequence of {', '.join(str(twice[n]) for n in names)}")
    chunks = stored.drop("file_no", "base")
    haplotypes = chunks.groupBy(*names).agg(F.sum(F.length("bases")).alias("seq_len"))
    return haplotypes, chunks


def write_fasta(chunks: DataFrame, path: str, name: str = "ind") -> None:
    """80-column FASTA from chunks whose size is a multiple of 80."""
    wrapped = F.regexp_replace(F.regexp_replace("bases", f"(.{{{LINE_BASES}}})", "$1\n"), "\n$", "")
    side = F.when(F.col("homolog") == 1, ":mat\n").otherwise(":pat\n")
    title = F.when(F.col("chunk_no") == 0, F.concat(F.lit(">"), F.col(name), side)).otherwise("")
    rows = chunks.select(name, "homolog", "chunk_no", F.concat(title, wrapped).alias("value"))
    write_sorted(rows, path, [name, "homolog", "chunk_no"])
