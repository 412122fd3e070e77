"""Text forms of results: VCF records and headers, tables, summary lines. Files are written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakwater.functions.scalar import short_id
from breakwater.operators.pileup import ATTRIBUTES
from breakwater.plans.calling import TYPES


def number(x: Column) -> Column:
    """At most six significant digits."""
    return F.format_string("%.6g", x.cast("double"))


def vcf_records(calls: DataFrame, samples: list[str]) -> DataFrame:
    """One ``value`` a call (1-based), in order of place; the sample columns say how many of a sample's reads support it.

    An insertion stands at its node of more edges (``start``, of ``terminal_first``); other calls at their left one.
    """
    kind = F.element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.col("type"))
    length = F.col("rpos") - F.col("lpos")
    start, end = (F.col("start"), F.col("other")) if "start" in calls.columns else (F.col("lpos"), F.col("rpos"))
    weights = F.array_join(F.array(*(number(F.col(f"w_{k}")) for k in ("del", "dup", "inv", "ins", "tra"))), ",")
    info = F.concat_ws(";", F.concat(F.lit("A="), "n_total"), F.lit("CIEND=-10,10"), F.lit("CIPOS=-10,10"), F.concat(F.lit("CF="), number(F.col("cluster_frac"))), F.concat(F.lit("CW="), weights), F.concat(F.lit("D="), "n_del"), F.concat(F.lit("DI="), number(F.col("avg_dist"))), F.concat(F.lit("END="), end + 1), F.concat(F.lit("EV="), "n_everted"), F.concat(F.lit("I="), "n_ins"), F.concat(F.lit("SR="), "n_split"), F.concat(F.lit("SS="), "n_ss"), F.concat(F.lit("SVLEN="), F.when(F.col("type") == "D", -length).otherwise(length)), F.concat(F.lit("SVTYPE="), kind), F.concat(F.lit("T="), "n_tra"), F.concat(F.lit("TAGS="), F.col("tags")), F.concat(F.lit("TF="), "n_far"), F.concat(F.lit("U="), "n_dup"), F.concat(F.lit("V="), "n_inv"))
    by = [F.concat(F.lit(".:.:"), F.coalesce(F.col("by_sample")[s], F.lit(0))) for s in samples]
    line = F.concat_ws("\t", F.col("seqid").cast("string"), (start + 1).cast("string"), F.lit("."), F.lit("N"), F.concat(F.lit("<"), kind, F.lit(">")), F.lit("."), F.lit("PASS"), info, F.lit("GT:DP:SP"), *by)
    return calls.orderBy("seqid", start, end).select(line.alias("value"))


#: The keys of records with their numbers and kinds of values, and what they say.
INFO = [
    ("A", "1", "Integer", "All pieces of evidence"), ("CF", "1", "Float", "Share of the evidence that clusters as the type does"), ("CW", "5", "Float", "Weights of DEL, DUP, INV, INS and BND"),
    ("D", "1", "Integer", "Reads for a deletion"), ("DI", "1", "Float", "Mean distance of mates from the breakpoint"), ("END", "1", "Integer", "Last place of the variant"), ("EV", "1", "Integer", "Everted pairs"),
    ("I", "1", "Integer", "Reads for an insertion"), ("SR", "1", "Integer", "Split reads"), ("SS", "1", "Integer", "Pairs on one strand"), ("SVLEN", ".", "Integer", "Length of ALT less that of REF"), ("SVTYPE", "1", "String", "Type of the variant"),
    ("T", "1", "Integer", "Reads for a translocation"), ("TAGS", ".", "String", "Samples that support the variant"), ("TF", "1", "Integer", "Pairs mapped too far apart"), ("U", "1", "Integer", "Reads for a duplication"), ("V", "1", "Integer", "Reads for an inversion"),
    ("CIPOS", "2", "Integer", "Interval around POS"), ("CIEND", "2", "Integer", "Interval around END"), ("COLLAPSED", "1", "Integer", "Calls merged into this one"), ("ID", ".", "String", "Names of the merged calls"), ("SUPPORT", "2", "Integer", "Evidence at POS and END"), ("MERGED", ".", "Integer", "Whether calls were merged before"), ("REFINED", ".", "Integer", "Whether calls were refined"),
    ("POS", "2", "Integer", "Both breakpoints"), ("LID", ".", "String", "Samples at POS"), ("RID", ".", "String", "Samples at END"), ("FIVE", ".", "Integer", "POS of the merged calls"), ("THREE", ".", "Integer", "END of the merged calls"),
]
MERGED_FORMAT = [("GT", "1", "String", "Genotype"), ("GL", ".", "Float", "Genotype likelihoods"), ("AS", "1", "Integer", "Alternative support"), ("RS", "1", "Integer", "Reference support")]
FORMAT = [("GT", "1", "String", "Genotype"), ("DP", "1", "Integer", "Depth"), ("SP", "1", "Integer", "Reads of the sample that support the variant")]


#: The same of the pileup caller's records.
PILE_INFO = [
    ("LRT", "1", "Float", "Likelihood ratio of target and background frequencies"), ("WAF", "3", "Float", "Allele frequency of background, target and both"), ("GC", "2", "Integer", "Called genotypes of background and target"),
    ("AT", "15", "Float", "Attributes of the pileup"), ("CF", "1", "Float", "Share of reads with over three operations"), ("CISTART", "2", "Integer", "Interval around POS"), ("CIEND", "2", "Integer", "Interval around END"),
    ("PU", "1", "Integer", "Primary reads clipped at POS"), ("SU", "1", "Integer", "Supplementary or split reads clipped at POS"), ("CU", "1", "Integer", "Places of clips among the reads over POS"), ("RD", "1", "Integer", "Reads over POS"),
    ("NC", "1", "Integer", "Clips in the consensus"), ("MQ", "1", "Float", "Mean mapping quality"), ("MQF", "1", "Float", "Share of reads with a mapping quality below 50"), ("SP", "3", "Integer", "Mates, splits and alternative hits at END"),
    ("CHR2", "1", "String", "Contig of END"), ("DI", "1", "Character", "Side of the clips: f or b"), ("END", "1", "Integer", "Other breakpoint"), ("SVLEN", "1", "Integer", "Distance of POS and END"),
]
PILE_FORMAT = [("GT", "1", "String", "Genotype"), ("GL", "3", "Float", "Genotype likelihoods"), ("NR", "1", "Integer", "Reads that do not support the variant"), ("NA", "1", "Integer", "Reads that do"), ("NS", "1", "Integer", "Reads clipped at POS"), ("RD", "1", "Integer", "Reads that pass the filters")]


def pileup_records(calls: DataFrame, samples: list[str]) -> DataFrame:
    """One ``value`` a call of the pileup caller (``piling.pileup_calls`` with ``chrom`` and ``chr2_name``), in order of place."""
    share = lambda c: number(F.try_divide(F.col(c), F.col("n_reads")))
    told = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), ".").otherwise(number(F.col(c)))
    list_of = lambda *xs: F.concat_ws(",", *(x.cast("string") for x in xs))
    key = lambda k, v: F.concat(F.lit(f"{k}="), v.cast("string"))
    sp = F.when(F.col("n_mp") + F.col("n_sr") + F.col("n_xa") > 0, list_of(F.col("n_mp"), F.col("n_sr"), F.col("n_xa"))).otherwise(".")
    pooled = F.try_divide(F.col("alt_t") + F.col("alt_b"), F.col("all_t") + F.col("all_b")) + 1e-6
    info = F.concat_ws(
        ";", key("LRT", number(F.coalesce("lrt", F.lit(0.0)))), key("WAF", list_of(told("af_b"), told("af_t"), number(pooled))), key("GC", list_of(F.col("gc_b"), F.col("gc_t"))),
        key("AT", list_of(*(share(f"n_{c}") for c in [*ATTRIBUTES, "close", "far", "evert"]), number(F.col("depth_ratio")))), key("CF", share("n_complex")), key("CISTART", list_of(F.col("start_low"), F.col("start_high"))),
        key("CIEND", list_of(F.col("ci_low"), F.col("ci_high"))), key("PU", F.col("n_primary")), key("SU", F.col("n_supplement")), key("CU", F.col("n_clusters")), key("RD", F.col("n_reads")), key("NC", F.col("n_clips")),
        key("MQ", share("mapq_sum")), key("MQF", share("n_low")), key("SP", sp), key("CHR2", F.col("chr2_name")), key("DI", F.col("direction")), key("END", F.col("other")), key("SVLEN", F.col("svlen")),
    )

    def sample(name: str) -> Column:
        g = F.col("genotypes")[name]
        said = F.concat_ws(":", g["gt"], list_of(*(number(g[c]) for c in ("gl_aa", "gl_ab", "gl_bb"))), *(g[c].cast("string") for c in ("n_good", "n_bad", "n_clip", "n_reads")))
        return F.when(g.isNull(), "./.:-255,-255,-255:0:0:0:0").otherwise(said)

    line = F.concat_ws("\t", F.col("chrom"), (F.col("bp") + 1).cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.lit("."), F.lit("."), info, F.lit("GT:GL:NR:NA:NS:RD"), *(sample(s) for s in samples))
    return calls.orderBy("chrom", "bp").select(line.alias("value"))


def vcf_header(samples: list[str], version: str = "4.2", reference: str | None = None, info: list | None = None, form: list | None = None) -> str:
    """The header of records: versions, the reference if one is given, keys, and the column names."""
    info, form = info or INFO, form or FORMAT
    said = lambda kind, rows: [f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in rows]
    lines = [f"##fileformat=VCFv{version}", "##source=breakwater", *([f"##reference={reference}"] if reference else []), *said("INFO", info), *said("FORMAT", form)]
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])])


def write_vcf(records: DataFrame, samples: list[str], path: str, reference: str | None = None, header: str | None = None) -> None:
    """Records below their header, which is the folder's first file."""
    header = records.sparkSession.createDataFrame([(header or vcf_header(samples, reference=reference),)], "value string").coalesce(1)
    header.unionByName(records.select("value")).write.text(path)


def merged_records(merged: DataFrame) -> DataFrame:
    """One ``value`` a merged call, in order of place, with one empty sample: merged calls have to be genotyped again.

    Its name is ``WG``, the type and a short hash of both ends and the merged names. The base is the call's own unless several were merged.
    """
    half = lambda c: F.concat((-F.col(c)).cast("string"), F.lit(","), F.col(c).cast("string"))
    key = lambda k, v: F.concat(F.lit(f"{k}="), v.cast("string"))
    list_of = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")).otherwise(".")
    length = F.col("three") - F.col("five")
    pair = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(","), F.col(b).cast("string"))
    info = F.concat_ws(
        ";", key("SVTYPE", F.col("svtype")), key("SVLEN", F.when(F.col("svtype") == "DEL", -length).otherwise(length)), key("ID", F.col("ids")), key("SUPPORT", pair("left_support", "right_support")), key("MERGED", list_of("merged")), key("REFINED", list_of("refined")),
        key("END", F.col("three")), key("POS", pair("five", "three")), key("LID", list_of("lid")), key("FIVE", list_of("fives")), key("THREE", list_of("threes")), key("RID", list_of("rid")), key("CIPOS", half("ci_five")), key("CIEND", half("ci_three")), key("COLLAPSED", F.col("collapsed")),
    )
    name = F.concat_ws(":", F.lit("WG"), F.col("svtype"), short_id(F.concat_ws(":", F.col("seqid").cast("string"), F.col("five").cast("string"), F.col("three").cast("string")), F.col("ids")))
    base = F.when(F.col("collapsed") > 1, "N").otherwise(F.coalesce("base", F.lit("N")))
    line = F.concat_ws("\t", F.col("seqid").cast("string"), F.col("five").cast("string"), name, base, F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("."), F.lit("."), info, F.lit("GT:GL:AS:RS"), F.lit(".:.:.:."))
    return merged.orderBy("seqid", "five", "three", "svtype").select(line.alias("value"))


#: The keys that classification adds.
CLASS_LINES = ['##INFO=<ID=WC,Number=1,Type=String,Description="Class of the variant">', '##INFO=<ID=WP,Number=.,Type=Float,Description="Probability of each class, in text order">']


def classified_lines(header: DataFrame, records: DataFrame) -> DataFrame:
    """A file's header lines (``text.vcf_header_lines``) with those of the classes before its column names, then its records, as text."""
    names = F.startswith("value", F.lit("#CHROM"))
    own = header.select("line", F.explode(F.when(names, F.array(*map(F.lit, CLASS_LINES), F.col("value"))).otherwise(F.array("value"))).alias("value"))
    fields = F.concat(F.array(F.col("chrom"), F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info"), F.when(F.col("format").isNotNull(), F.concat(F.array("format"), F.col("samples"))).otherwise(F.array().cast("array<string>")))
    top = own.distinct().orderBy("line", F.startswith("value", F.lit("#CHROM")), "value").coalesce(1).select("value")
    return top.unionByName(records.orderBy("chrom", "pos", "info").select(F.array_join(fields, "\t").alias("value")))


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated columns with a header."""
    df.write.csv(path, sep="\t", header=True)


def summary_line(rates: DataFrame, tool: str, kind: str, window: int) -> DataFrame:
    """``tool type window FP TP FDR``."""
    return rates.select(F.concat_ws("\t", F.lit(tool), F.lit(kind), F.lit(str(window)), F.col("fp").cast("string"), F.col("tp").cast("string"), number(F.col("fdr"))).alias("value"))


#: How an edge of each kind of evidence is drawn.
DOT_STYLES = {"X": "style=dashed", "R": "color=yellow", "M": "color=magenta", "V": "color=green", "L": "color=brown", "H": "color=purple", "S": "style=dotted", "I": "color=red", "D": "color=blue", "A": "color=orange"}


def dot_graphs(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``seqid, component, dot``: one undirected graph a component, an edge from each of its ends and for each kind of evidence.

    Loops are not drawn. A component's text is gathered into one row, so give it the components that are called (at most 200 nodes).
    """
    kinds = [c for c in DOT_STYLES if c in edges.columns]
    drawn = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.format_string(f" [{DOT_STYLES[c]},penwidth=%d];", F.col(c).cast("long"))) for c in kinds)))
    ends = edges.select("seqid", F.explode(F.when(F.col("lpos") == F.col("rpos"), F.array(F.struct(F.col("lpos").alias("pos"), F.col("rpos").alias("other")))).otherwise(F.array(F.struct(F.col("lpos").alias("pos"), F.col("rpos").alias("other")), F.struct(F.col("rpos").alias("pos"), F.col("lpos").alias("other"))))).alias("e"), drawn.alias("styles")).select("seqid", "e.*", "styles")
    name = lambda c: F.concat(F.col("seqid").cast("string"), F.lit("."), F.col(c).cast("string"))
    line = F.array_join(F.transform("styles", lambda s: F.concat(F.lit("     "), name("pos"), F.lit(" -- "), name("other"), s, F.lit("\n"))), "")
    lines = ends.join(components, ["seqid", "pos"]).select("seqid", "component", "pos", "other", F.when(F.col("pos") == F.col("other"), F.lit("")).otherwise(line).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("seqid", "component").agg(F.concat(F.lit("graph {\n"), body, F.lit("}\n")).alias("dot"))
