"""SAM text of alignment records: header lines, and one line a record, in the order of the reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import Options


def read_group(line: str) -> tuple[str, str]:
    """(header line, id) of an @RG line in which \\t and \\n may be escaped."""
    text = line.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r").replace("\\\\", "\\")
    if not text.startswith("@RG"):
        raise ValueError("a read group line begins with @RG")
    found = re.search(r"\tID:([^\t\n]+)", text)
    if not found or len(found[1]) > 255:
        raise ValueError("a read group line has an ID of 255 characters at most")
    return text, found[1]


def header(contig_table: DataFrame, o: Options, program: str = "seqloom", command: str = "") -> DataFrame:
    """(ord, line): @SQ lines by contig, the user's lines, and @PG."""
    alt = F.when(F.col("is_alt"), F.lit("\tAH:*")).otherwise(F.lit("")) if "is_alt" in contig_table.columns else F.lit("")
    own = any(x.startswith("@SQ") for x in o.header_lines)
    sq = contig_table.select(F.col("rid").cast("long").alias("ord"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string"), alt).alias("line"))
    rest = [*o.header_lines, *([read_group(o.read_group)[0]] if o.read_group else []), f"@PG\tID:{program}\tPN:{program}" + (f"\tCL:{command}" if command else "")]
    more = contig_table.sparkSession.createDataFrame([((1 << 62) + i, x) for i, x in enumerate(rest)], "ord bigint, line string")
    return more if own else sq.unionByName(more)


def cigar_string(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def ref_length(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin("M", "D")), F.lit(0), lambda acc, x: acc + x["len"])


def _clip(cigar: Column, last: bool) -> Column:
    end = F.element_at(cigar, -1 if last else 1)
    return F.when(F.size(cigar) > 0, F.when(end["op"] == "S", end["len"]).otherwise(F.lit(0))).otherwise(F.lit(0))


def lines(records: DataFrame, reads: DataFrame, contig_table: DataFrame, o: Options, mates: bool = False) -> DataFrame:
    """(read_id, nth, line). ``reads(read_id, name, seq, qual, comment?)``; a read without a record gets an unmapped one.

    With ``mates`` the records carry m_rid, m_pos, m_rev, m_cigar, m_mapped of the mate's first record.
    """
    names = contig_table.select("rid", F.col("name").alias("rname"))
    placed = records.join(names, "rid", "left")
    if mates:
        placed = placed.join(names.select(F.col("rid").alias("m_rid"), F.col("rname").alias("m_rname")), "m_rid", "left")
    primary = ~(F.col("flag").bitwiseAND(0x100) > 0)
    strand_mark = F.when(F.col("flag").bitwiseAND(0x10) > 0, "-").otherwise("+")
    own_sa = F.concat_ws(",", "rname", (F.col("pos") + 1).cast("string"), strand_mark, cigar_string(F.col("cigar")), F.col("mapq").cast("string"), F.col("nm").cast("string"))
    read = W.partitionBy("read_id")
    others = F.filter(F.sort_array(F.collect_list(F.when(primary & F.col("rname").isNotNull(), F.struct("nth", own_sa.alias("sa")))).over(read)), lambda x: x["nth"] != F.col("nth"))
    placed = placed.withColumn("sa", F.when(primary & (F.size(others) > 0), F.concat(F.array_join(F.transform(others, lambda x: x["sa"]), ";"), F.lit(";"))))
    cols = ["read_id", "name", "seq", "qual"] + (["comment"] if "comment" in reads.columns else [])
    all_ = reads.select(*cols).join(placed, "read_id", "left").withColumn("nth", F.coalesce("nth", F.lit(0)))
    flag = F.coalesce("flag", F.lit(4))
    aligned = F.col("cigar").isNotNull() & (F.size("cigar") > 0)
    hard = aligned & (F.col("nth") > 0) & F.lit(not o.soft_clip) & ~F.coalesce("is_alt", F.lit(False))
    cigar = F.when(hard, F.transform("cigar", lambda x: F.struct(x["len"].alias("len"), F.when(x["op"] == "S", "H").otherwise(x["op"]).alias("op")))).otherwise(F.col("cigar"))
    first, last = F.when(hard, _clip(F.col("cigar"), False)).otherwise(F.lit(0)), F.when(hard, _clip(F.col("cigar"), True)).otherwise(F.lit(0))
    back = flag.bitwiseAND(0x10) > 0
    cut = lambda s: F.substr(s, first + 1, F.length(s) - first - last)
    up = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    seq = cut(F.when(back, F.reverse(F.translate(up, "ACGT", "TGCA"))).otherwise(up))
    qual = F.when(F.col("qual").isNull(), F.lit("*")).otherwise(cut(F.when(back, F.reverse("qual")).otherwise(F.col("qual"))))
    hidden = flag.bitwiseAND(0x100) > 0
    tag = lambda name, col, ok=None: F.when(ok if ok is not None else col.isNotNull(), F.concat(F.lit(name), col.cast("string")))
    if mates:
        # An unmapped mate is placed with its mapped one.
        m_rid, m_pos = F.coalesce("m_rid", "rid"), F.coalesce("m_pos", "pos")
        m_name = F.coalesce("m_rname", "rname")
        here = F.coalesce("rname", "m_rname")
        p0 = F.col("pos") + F.when(back, ref_length(F.col("cigar")) - 1).otherwise(0)
        p1 = F.col("m_pos") + F.when(F.col("m_rev"), ref_length(F.col("m_cigar")) - 1).otherwise(0)
        span = -(p0 - p1 + F.when(p0 > p1, 1).when(p0 < p1, -1).otherwise(0))
        place = [F.coalesce(here, F.lit("*")), F.coalesce((F.coalesce("pos", "m_pos") + 1).cast("string"), F.lit("0"))]
        next_ = [F.when(m_name.isNull(), "*").when(m_name == here, "=").otherwise(m_name), F.coalesce((m_pos + 1).cast("string"), F.lit("0")), F.when((F.col("m_rname") == F.col("rname")) & aligned & (F.size("m_cigar") > 0), span.cast("string")).otherwise("0")]
    else:
        place = [F.coalesce("rname", F.lit("*")), F.coalesce((F.col("pos") + 1).cast("string"), F.lit("0"))]
        next_ = [F.lit("*"), F.lit("0"), F.lit("0")]
    tags = [tag("NM:i:", F.col("nm"), aligned), tag("MD:Z:", F.col("md"), aligned)]
    if mates:
        tags.append(tag("MC:Z:", cigar_string(F.col("m_cigar")), F.size("m_cigar") > 0))
    tags += [tag("AS:i:", F.coalesce("score", F.lit(0))), tag("XS:i:", F.coalesce("sub", F.lit(0)), F.coalesce("sub", F.lit(0)) >= 0)]
    if o.read_group:
        tags.append(F.lit(f"RG:Z:{read_group(o.read_group)[1]}"))
    tags += [tag("SA:Z:", F.col("sa")), tag("pa:f:", F.format_string("%.3f", F.col("score") / F.col("alt_sc")), (F.col("alt_sc") > 0) & ~hidden), tag("XA:Z:", F.col("xa"))]
    if o.append_comment and "comment" in reads.columns:
        tags.append(F.col("comment"))
    line = F.concat_ws("\t", F.col("name"), flag.cast("string"), *place, F.coalesce(F.col("mapq").cast("string"), F.lit("0")), F.when(aligned, cigar_string(cigar)).otherwise("*"), *next_, F.when(hidden, "*").otherwise(seq), F.when(hidden, "*").otherwise(qual), *tags)
    return all_.select("read_id", "nth", line.alias("line"))


def write_sam(header_lines: DataFrame, body: DataFrame, path: str) -> None:
    """A folder of text parts, in order: the header's part first. Parts stay sorted by range, so their order is the file's."""
    rows = header_lines.select(F.lit(0).alias("part"), F.col("ord"), F.lit(0).alias("nth"), "line").unionByName(body.select(F.lit(1).alias("part"), F.col("read_id").alias("ord"), "nth", "line"))
    rows.orderBy("part", "ord", "nth").select("line").write.mode("overwrite").text(path)
