"""The engine's queries by name over deterministic views of the driver's tables, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakwater.functions import cigar as C
from breakwater.functions import scalar as S
from breakwater.functions import special as X
from breakwater.operators import alignment as A
from breakwater.operators import breaks as B
from breakwater.operators import calls as K
from breakwater.operators import callsets as V
from breakwater.operators import consensus as M
from breakwater.operators import forest as T
from breakwater.operators import intervals as I
from breakwater.operators import kmers as N
from breakwater.operators import pileup as P
from breakwater.operators import reads as R
from breakwater.operators.skew import for_all_cores
from breakwater.plans import calling
from breakwater.plans import piling as Q
from breakwater.plans.lineage import cut

#: Alignments made from order lines; the same text runs in Spark and in DuckDB.
READS = """
WITH x AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         CAST(round(l_discount*100) AS INT) AS d, CAST(round(l_tax*100) AS INT) AS t, CAST(l_quantity AS INT) AS q,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,
           l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS rn
  FROM lineitem),
y AS (
  SELECT *, CAST((rn-1) % 2 + 1 AS INT) AS mate, CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS rev,
         CAST(CASE WHEN (rn-1) % 2 = 1 AND l_partkey % 19 = 0 THEN (l_orderkey+1) % 5 ELSE l_orderkey % 5 END AS INT) AS ref_id,
         CAST((l_orderkey % 97)*5000 + ((rn-1) % 2)*(CASE WHEN q<=3 THEN 100 WHEN q>=49 THEN 2500 ELSE 700 + 10*(q % 8) END)
           + CASE WHEN (rn-1) % 2 = 1 AND l_partkey % 29 = 0 THEN 20000 ELSE 0 END + 10*(t % 4) AS BIGINT) AS pos
  FROM x),
z AS (
  SELECT *, coalesce(CASE WHEN mate = 1 THEN lead(ref_id) OVER w ELSE lag(ref_id) OVER w END, -1) AS mate_ref_id,
         coalesce(CASE WHEN mate = 1 THEN lead(pos) OVER w ELSE lag(pos) OVER w END, -1) AS mate_pos,
         coalesce(CASE WHEN mate = 1 THEN lead(rev) OVER w ELSE lag(rev) OVER w END, 0) AS mate_rev
  FROM y WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn))
SELECT concat(CAST(l_orderkey AS STRING), ':', CAST(CAST(floor((rn-1)/2.0) AS BIGINT) AS STRING)) AS read_name,
       mate, concat('s', CAST(l_orderkey % 3 AS STRING)) AS sample, ref_id, pos, CAST(q + 10 - CASE WHEN l_partkey % 31 = 0 THEN q + 10 ELSE 0 END AS INT) AS mapq,
       CAST(1 + CASE WHEN mate_ref_id = ref_id AND l_suppkey % 6 <> 0 THEN 2 ELSE 0 END + CASE WHEN mate_ref_id < 0 THEN 8 ELSE 0 END + 16 * rev + 32 * mate_rev
         + CASE WHEN mate = 1 THEN 64 ELSE 128 END + CASE WHEN l_returnflag='A' AND q<=2 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 23 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
       CASE WHEN l_partkey % 23 = 0 THEN '30H70M' WHEN d=0 THEN '100M' WHEN d<=4 THEN concat(CAST(10+t AS STRING),'S',CAST(90-t AS STRING),'M')
            WHEN d<=8 THEN concat(CAST(90-t AS STRING),'M',CAST(10+t AS STRING),'S') WHEN d=9 THEN '40M25D60M' ELSE '50M30I20M' END AS cigar,
       mate_ref_id, mate_pos, CAST(CASE WHEN mate_ref_id = ref_id THEN mate_pos - pos + CASE WHEN mate_pos >= pos THEN 100 ELSE -100 END ELSE 0 END AS BIGINT) AS insert_size,
       CAST(q % 14 AS INT) AS nm,
       CASE WHEN l_partkey % 13 = 0 THEN concat('c', CAST(ref_id AS STRING), ',', CAST(pos + 40 * (q % 30) - 300 AS STRING), ',', CASE WHEN t % 2 = 0 THEN '+' ELSE '-' END, ',',
            CASE WHEN t = 5 THEN '30S40M30S' WHEN t % 3 = 0 THEN '60S40M' ELSE '40M60S' END, ',', CAST(q AS STRING), ',', CAST(q % 13 AS STRING), ';') END AS sa,
       CASE WHEN l_partkey % 11 = 0 THEN concat('c', CAST((ref_id + CASE WHEN q % 4 = 0 THEN 1 ELSE 0 END) % 5 AS STRING), CASE WHEN t % 2 = 0 THEN ',+' ELSE ',-' END, CAST(pos + 20 * (q % 25) + 1 AS STRING), ',', CASE WHEN t = 3 THEN '20S60M20S' WHEN t % 3 = 1 THEN '60M40S' ELSE '100M' END, ',', CAST(t AS STRING), ';', repeat('c1,+101,100M,0;', q % 6)) END AS xa,
       concat(CASE WHEN t >= 7 THEN 'NNNNNNN' ELSE 'ACGTACG' END, repeat('ACGTTGCATC', q % 11)) AS seq,
       repeat(chr(33 + q % 41), 7 + 10 * (q % 11)) AS qual
FROM z
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(READS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    of = lambda *names: F.create_map(*(x for c in names for x in (F.lit(c.upper()), F.col(c))))
    sa, xa = (F.col(c).isNotNull() for c in ("sa", "xa"))
    none = F.expr("CAST(map() AS map<string, string>)")
    return rows.withColumn("tags", F.when(sa & xa, of("sa", "xa")).when(sa, of("sa")).when(xa, of("xa")).otherwise(none))


def contigs(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.col("id").cast("int").alias("ref_id"), F.concat(F.lit("c"), "id").alias("name"))


def written(spark, sf_dir):
    """What pairs, edges within reads and template lengths read of the alignments, as a table; a stored file would be read again instead of made again."""
    return cut(reads(spark, sf_dir).select("sample", "read_name", "mate", "ref_id", "pos", "mapq", "flag", "cigar", "insert_size", R.tells_stats(F.col("xa"), F.col("sa")).alias("tells_stats")))


def kept(spark, sf_dir, rows=None):
    return R.with_cigar(R.graph_read_filter(reads(spark, sf_dir))) if rows is None else R.with_cigar_once(R.graph_read_filter(rows))


def pairs(spark, sf_dir, found=None):
    return calling.pairs_of(kept(spark, sf_dir) if found is None else found, hits=False)


def classes(spark, sf_dir, rows=None, found=None):
    rows = written(spark, sf_dir) if rows is None else rows
    found = kept(spark, sf_dir, rows) if found is None else found
    return R.insert_classes(R.filtered_pairs(pairs(spark, sf_dir, found)), R.template_stats(rows.where("tells_stats")))


def evidence(spark, sf_dir):
    rows = written(spark, sf_dir)
    found = kept(spark, sf_dir, rows)
    return R.insert_edges(classes(spark, sf_dir, rows, found)).unionByName(R.indel_edges(found))


def edges(spark, sf_dir):
    return K.evidence_edges(evidence(spark, sf_dir))


def called(spark, sf_dir):
    """Typed calls and their nodes, from edges, nodes and components that are made once."""
    e = cut(edges(spark, sf_dir))
    points = cut(K.nodes(e))
    return K.typed_calls(e, points, cut(K.components(e))), points


def calls(spark, sf_dir):
    return called(spark, sf_dir)[0]


def breakpoints(spark, sf_dir):
    e = cut(edges(spark, sf_dir))
    return K.best_breakpoints(e, K.nodes(e), K.components(e))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_OPS = "list_transform(range(1, len(o) + 1), lambda i: CASE WHEN o[i] IN ({}) THEN n[i] ELSE 0 END)"
_sum = lambda letters: "CAST(list_sum(" + _OPS.format(", ".join(f"'{c}'" for c in letters)) + ") AS INT)"
_PAIR_COLUMNS = "ref_id pos end_pos mapq flag front front_len back back_len matched read_len reverse insert_size nm xa".split()
_EVIDENCE = R.EVIDENCE
_letters = lambda text, p="": " + ".join(f"{p}\"{c}\"" for c in text)
CTE = {
    "reads": READS,
    "ops": "SELECT *, list_transform(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), lambda x: CAST(x AS INT)) AS n, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) AS o FROM reads",
    "cig": f"SELECT read_name, mate, sample, ref_id, pos, mapq, flag, cigar, mate_ref_id, mate_pos, insert_size, nm, sa, xa, seq, qual, n, o, pos + {_sum('MXD=N')} - 1 AS end_pos, {_sum('M')} AS matched, {_sum('MIS=X')} AS read_len, o[1] AS front, n[1] AS front_len, o[-1] AS back, n[-1] AS back_len, (flag & 16) <> 0 AS reverse FROM ops",
    "kept": "SELECT * FROM cig WHERE (flag & 2048) = 0 AND (flag & 256) = 0 AND (flag & 1) <> 0 AND (flag & 1024) = 0 AND NOT ((flag & 4) <> 0 AND (flag & 8) <> 0)",
    "pairs": "SELECT a.sample, a.read_name, " + ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _PAIR_COLUMNS) + " FROM kept a JOIN kept b ON a.sample = b.sample AND a.read_name = b.read_name AND a.mate = 1 AND b.mate = 2",
    "proper": "SELECT * FROM reads WHERE (flag & 4) = 0 AND (flag & 2) <> 0 AND (flag & 1024) = 0 AND (flag & 8) = 0 AND xa IS NULL AND sa IS NULL AND abs(insert_size) < 10000 AND ref_id = mate_ref_id",
    "stats": "SELECT sample, count(*) AS n, avg(abs(insert_size)) AS mean, stddev_samp(abs(insert_size)) AS sd, CAST(quantile_disc(abs(insert_size), 0.5) AS BIGINT) AS median, greatest(0, avg(abs(insert_size)) - 1.6 * stddev_samp(abs(insert_size))) AS low, avg(abs(insert_size)) + 2.5 * stddev_samp(abs(insert_size)) AS high, avg(mapq) AS mapq FROM proper GROUP BY sample",
    "good": """SELECT * FROM pairs WHERE (a_flag & 4) = 0 AND (b_flag & 4) = 0 AND least(a_mapq, b_mapq) >= 5 AND greatest(a_mapq, b_mapq) >= 20
        AND NOT (a_front = 'M' AND a_front_len = a_read_len AND b_front = 'M' AND b_front_len = b_read_len) AND a_matched + b_matched >= 100
        AND NOT (a_ref_id = b_ref_id AND CASE WHEN a_pos <= b_pos THEN a_back = 'S' AND b_front = 'S' ELSE a_front = 'S' AND b_back = 'S' END)
        AND NOT (a_ref_id = b_ref_id AND a_pos <= b_end_pos AND b_pos <= a_end_pos AND (least(a_end_pos, b_end_pos) - greatest(a_pos, b_pos)) * 1.0 / (a_read_len + b_read_len) > 0.2)
        AND a_ref_id = b_ref_id""",
    "classes": """SELECT *, CASE WHEN CASE WHEN a_pos <= b_pos THEN a_reverse AND NOT b_reverse ELSE b_reverse AND NOT a_reverse END THEN 'X'
        WHEN abs(a_insert_size) > high THEN CASE WHEN a_reverse = b_reverse THEN 'M' ELSE 'H' END
        WHEN abs(a_insert_size) < low THEN CASE WHEN a_reverse = b_reverse THEN 'R' ELSE 'L' END WHEN a_reverse = b_reverse THEN 'A' END AS evidence
        FROM good JOIN (SELECT sample, low, high FROM stats) USING (sample)""",
    "far": """SELECT sample, a_ref_id AS seqid, evidence,
        CASE WHEN a_front = 'S' OR a_back = 'S' THEN CASE WHEN a_back = 'S' THEN a_end_pos ELSE a_pos END WHEN b_back = 'S' THEN b_end_pos ELSE a_pos END AS a,
        CASE WHEN (a_front = 'S' OR a_back = 'S') AND b_back = 'S' THEN b_end_pos ELSE b_pos END AS b
        FROM classes WHERE evidence IS NOT NULL AND ((a_front = 'S' AND a_front_len >= 5) OR (a_back = 'S' AND a_back_len >= 5) OR (b_front = 'S' AND b_front_len >= 5) OR (b_back = 'S' AND b_back_len >= 5))""",
    "inner_ops": "SELECT sample, ref_id, pos, mapq, n, o, unnest(range(1, len(o) + 1)) AS i FROM kept",
    "within": "SELECT sample, ref_id AS seqid, o[i] AS evidence, pos + coalesce(CAST(list_sum(list_transform(range(1, i), lambda k: CASE WHEN o[k] IN ('M', 'D', 'N', '=', 'X') THEN n[k] ELSE 0 END)) AS BIGINT), 0) AS a, n[i] AS size FROM inner_ops WHERE mapq >= 30 AND o[i] IN ('I', 'D') AND n[i] >= 20",
    "evidence": "SELECT sample, seqid, evidence, least(a, b) AS lpos, greatest(a, b) AS rpos FROM (SELECT sample, seqid, evidence, a, b FROM far UNION ALL SELECT sample, seqid, evidence, a, a + size AS b FROM within) WHERE a <> b",
    "edges": "SELECT seqid, lpos, rpos, " + ", ".join(f"count(*) FILTER (evidence = '{c}') AS \"{c}\"" for c in _EVIDENCE) + " FROM evidence GROUP BY ALL",
    "ends": "SELECT seqid, lpos AS pos, rpos AS other, * EXCLUDE (seqid, lpos, rpos) FROM edges UNION ALL SELECT seqid, rpos, lpos, * EXCLUDE (seqid, lpos, rpos) FROM edges",
    "nodes": f"SELECT seqid, pos, count(*) AS degree, CAST(sum({_letters(_EVIDENCE)}) AS BIGINT) AS support FROM ends GROUP BY ALL",
    "reach": "SELECT seqid, pos AS node, pos AS seen FROM nodes UNION SELECT r.seqid, r.node, e.other FROM reach r JOIN ends e ON r.seqid = e.seqid AND r.seen = e.pos",
    "comps": "SELECT seqid, pos, component, count(*) OVER (PARTITION BY seqid, component) AS size FROM (SELECT seqid, node AS pos, min(seen) AS component FROM reach GROUP BY ALL)",
    "scored": "SELECT e.seqid, e.lpos, e.rpos, c.component, c.size, l.support + r.support AS score FROM edges e JOIN comps c ON e.seqid = c.seqid AND e.lpos = c.pos JOIN nodes l ON e.seqid = l.seqid AND e.lpos = l.pos JOIN nodes r ON e.seqid = r.seqid AND e.rpos = r.pos WHERE c.size BETWEEN 3 AND 200",
    "best": "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY seqid, component ORDER BY score DESC, lpos, rpos) AS k FROM scored) WHERE k = 1",
    "touch": "SELECT b.component, b.lpos, b.rpos, e.* FROM best b JOIN ends e ON b.seqid = e.seqid AND e.pos IN (b.lpos, b.rpos)",
    "counted": "SELECT seqid, component, " + ", ".join(f"CAST(sum({_letters(v)}) AS BIGINT) AS n_{k}" for k, v in K.COUNTERS.items()) + " FROM touch WHERE NOT (pos = rpos AND other = lpos) GROUP BY ALL",
    "typed": """SELECT *, CASE WHEN n_ins > greatest(n_del, n_dup, n_inv) THEN 'I' WHEN n_inv > greatest(n_del, n_dup) THEN 'V' WHEN n_dup > n_del THEN 'U' ELSE 'D' END AS type
        FROM best JOIN counted USING (seqid, component)""",
    "votes": """SELECT t.seqid, t.component, c.type, t.pos = t.lpos AS is_left, t.other, t.lpos, t.rpos, d.degree = 1 AS leaf, o.degree = 1 AS own, abs(t.other - t.lpos) AS dl, abs(t.other - t.rpos) AS dr, "H", "X", "R", "A", "M"
        FROM touch t JOIN typed c ON t.seqid = c.seqid AND t.component = c.component JOIN nodes d ON d.seqid = t.seqid AND d.pos = t.other JOIN nodes o ON o.seqid = t.seqid AND o.pos = t.pos""",
    "voted": """SELECT seqid, component,
        sum(CASE WHEN type = 'D' AND "H" > 0 AND CASE WHEN is_left THEN other > rpos ELSE other < lpos END THEN "H"
                 WHEN type = 'U' AND "X" > 0 AND ((leaf AND dr < dl) OR (NOT is_left AND other = lpos AND NOT leaf AND own)) THEN "X"
                 WHEN type = 'V' AND leaf AND NOT ("R" = 0 AND "A" > 0) AND ((is_left AND other BETWEEN lpos AND rpos AND dr < dl) OR (NOT is_left AND other > lpos AND other < rpos AND dr > dl)) THEN "R" + "A" + "M" ELSE 0 END) AS y,
        sum(CASE WHEN type = 'U' AND "X" > 0 AND leaf AND dr >= dl THEN "X"
                 WHEN type = 'V' AND leaf AND NOT ("R" = 0 AND "A" > 0) AND ((is_left AND other BETWEEN lpos AND rpos AND dr >= dl) OR (NOT is_left AND other > lpos AND other < rpos AND dr <= dl)) THEN "R" + "A" + "M" ELSE 0 END) AS n,
        avg(CASE WHEN type = 'D' AND "H" > 0 AND is_left AND other > rpos THEN dr WHEN type = 'D' AND "H" > 0 AND NOT is_left AND other < lpos THEN dl
                 WHEN type = 'V' AND leaf AND NOT ("R" = 0 AND "A" > 0) AND ((is_left AND other BETWEEN lpos AND rpos AND dr < dl) OR (NOT is_left AND other > lpos AND other < rpos AND dr > dl)) THEN dr END) AS d
        FROM votes GROUP BY ALL""",
    "calls": """SELECT t.*, CASE WHEN y + n > 0 THEN y * 1.0 / (y + n) ELSE 0.0 END AS cluster_frac, coalesce(d, 0.0) AS avg_dist FROM typed t JOIN voted USING (seqid, component)""",
    "checked": """SELECT * FROM calls WHERE n_total >= 3 AND CASE type WHEN 'D' THEN (cluster_frac > 0.1 AND n_far > 1 AND n_del > 1) OR (n_internal_del > 2 AND n_split > 2)
        WHEN 'U' THEN (cluster_frac > 0.1 AND n_everted > 1 AND n_dup > 1) OR (n_split > 3 AND rpos - lpos < 500)
        WHEN 'V' THEN (cluster_frac > 0.1 AND n_ss > 2 AND n_inv > 2) OR NOT (rpos - lpos < 500 AND (n_ss < 3 OR n_inv < 3 OR n_split < 1)) WHEN 'I' THEN n_ins > 4 ELSE false END""",
    "pile": "SELECT * FROM cig WHERE (flag & 4) = 0 AND (flag & 1024) = 0 AND (flag & 256) = 0 AND (sa IS NOT NULL OR mapq >= 1) AND coalesce(len(string_split(xa, ';')), 0) <= 5 AND length(seq) >= 20 AND length(replace(substr(seq, 1, 10), 'N', '')) >= 5",
    "places": "SELECT DISTINCT ref_id, unnest(list_filter([CASE WHEN front = 'S' AND front_len > 9 THEN pos END, CASE WHEN back = 'S' AND back_len > 9 THEN end_pos END], lambda x: x IS NOT NULL)) AS bp FROM pile WHERE mapq > 15",
    "marks": "SELECT *, (flag & 2) <> 0 AS proper, (flag & 16) <> 0 AS rev, (flag & 32) <> 0 AS mrev, (flag & 8) = 0 AS mated, (flag & 2048) <> 0 AS sup, sa IS NOT NULL AS split, coalesce(split_part(sa, ',', 3) = '+', false) AS plus, ref_id <> mate_ref_id AS crossed FROM pile",
    "feat": """SELECT read_name, sample, ref_id, pos, end_pos, mapq, mate_ref_id, mate_pos, sa, xa, abs(insert_size) AS insert, split, sup, mated AND NOT crossed AS mapped_pair, rev = mrev AS same_pair, len(o) > 3 AS complex, mapq < 50 AS low, NOT mated AS mate_missing, proper OR NOT split AS paired, NOT proper AS discordant,
        ((rev AND NOT mrev AND pos < mate_pos) OR (NOT rev AND mrev AND pos > mate_pos)) AND (split OR (mated AND NOT crossed)) AS evert, NOT split AND mated AND crossed AS cross_, NOT split AND mated AND NOT crossed AND rev = mrev AS same_strand,
        split AND plus <> rev AS split_same, split AND mated AND rev = mrev AS first_same, split AND mated AND plus AND NOT rev AS second_same, split AND mated AND NOT plus AS split_other, split AND mated AND crossed AS split_cross,
        CASE WHEN split THEN 0 ELSE len(list_filter(range(1, len(o) + 1), lambda i: o[i] = 'I' AND n[i] > 3)) END AS inserted, CASE WHEN split THEN 0 ELSE len(list_filter(range(1, len(o) + 1), lambda i: o[i] = 'D' AND n[i] > 3)) END AS deleted,
        NOT sup AND front = 'S' AS soft_front, NOT sup AND back = 'S' AS soft_back, (sup AND front = 'H') OR (split AND NOT sup AND front = 'S') AS extra_front, (sup AND back = 'H') OR (split AND NOT sup AND back = 'S') AS extra_back FROM marks""",
    "support": "SELECT ref_id, spot, count(*) AS n FROM (SELECT ref_id, unnest(list_filter([CASE WHEN front = 'S' THEN pos END, CASE WHEN back = 'S' THEN end_pos END], lambda x: x IS NOT NULL)) AS spot FROM pile WHERE (flag & 2048) = 0) GROUP BY ALL",
    "piled": """SELECT p.bp, f.*, split OR cross_ OR same_strand OR soft_front OR soft_back OR inserted > 0 OR deleted > 0 AS odd, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS clips, coalesce(mapped_pair AND abs(insert - t.mean) > 2.5 * t.sd, false) AS deviant, coalesce(mapped_pair AND abs(insert - t.mean) > 2.5 * t.sd AND insert > t.mean, false) AS far
        FROM places p JOIN feat f ON p.ref_id = f.ref_id AND p.bp BETWEEN f.pos AND f.end_pos LEFT JOIN support a ON a.ref_id = f.ref_id AND a.spot = f.pos LEFT JOIN support b ON b.ref_id = f.ref_id AND b.spot = f.end_pos LEFT JOIN stats t ON t.sample = f.sample""",
    "near": "SELECT * REPLACE (bool_or(odd) OVER (PARTITION BY ref_id, bp, read_name) AS odd), (abs(pos - bp) < 5 OR abs(end_pos - bp) < 5) AND (soft_front OR soft_back) AND clips > 1 AS clipped, mapped_pair AND same_pair AS same FROM piled",
    "marked": "SELECT *, clipped OR same OR deviant OR odd AS alt FROM near WHERE NOT sup",
    "gls": """SELECT ref_id, bp, sample, n, n_alt, CASE WHEN n >= 2 AND n > n_alt THEN aa - n * ln(2) ELSE -255.0 END AS gl_aa, CASE WHEN n >= 2 AND n > n_alt AND n_alt > 0 THEN -n * ln(2) ELSE -255.0 END AS gl_ab, CASE WHEN n >= 2 AND n_alt > 0 THEN bb - n * ln(2) ELSE -255.0 END AS gl_bb
        FROM (SELECT ref_id, bp, sample, count(*) AS n, count(*) FILTER (alt) AS n_alt, sum(CASE WHEN alt THEN ln(2 * e) ELSE ln(2 * (1 - e)) END) AS aa, sum(CASE WHEN alt THEN ln(2 * (1 - e)) ELSE ln(2 * e) END) AS bb
              FROM (SELECT *, pow(10, -greatest(mapq, 1) / 10.0) AS e FROM marked) GROUP BY ALL)""",
    "genos": "SELECT *, CASE WHEN n < 2 THEN './.' WHEN gl_aa >= gl_ab AND gl_aa >= gl_bb THEN '0/0' WHEN gl_ab >= gl_bb THEN '0/1' ELSE '1/1' END AS gt FROM gls",
    "spans": "SELECT user_id % 50 AS seqid, CAST(floor(epoch(ts) / 60) AS BIGINT) AS five, CAST(floor(epoch(ts) / 60) AS BIGINT) + CAST(floor(value) AS BIGINT) AS three, event_type AS svtype, event_id AS id, CAST(event_id % 7 AS BIGINT) AS support FROM events",
}
_NEEDS = "reads proper ops cig kept pairs stats good classes far inner_ops within evidence edges ends nodes reach comps scored best touch counted typed votes voted calls checked pile places marks feat support piled near marked gls genos".split()
_GRAPH = {"reach", "comps", "scored", "best", "touch", "counted", "typed", "votes", "voted", "calls", "checked"}
_PILE = {"pile", "places", "marks", "feat", "support", "piled", "near", "marked", "gls", "genos"}


def sql(last: str, select: str) -> str:
    """``select`` after all views up to ``last``."""
    names = ["spans"] if last == "spans" else [n for n in _NEEDS[: _NEEDS.index(last) + 1] if not (last in _PILE and n != "stats" and (n in _GRAPH or _NEEDS.index("kept") <= _NEEDS.index(n) < _NEEDS.index("pile")))]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n" + select


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
_s6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("read_filter", sql("kept", "SELECT read_name, mate, sample, ref_id, pos, mapq, flag, cigar FROM kept"))
def _(spark, d):
    return R.graph_read_filter(reads(spark, d)).select("read_name", "mate", "sample", "ref_id", "pos", "mapq", "flag", "cigar")


@query("cigar_parse", sql("cig", "SELECT read_name, mate, array_to_string(list_transform(range(1, len(o) + 1), lambda i: concat(CAST(n[i] AS VARCHAR), o[i])), '') AS cigar, len(o) AS n_ops, pos + 0 AS pos, end_pos, matched, read_len, front, back, (front = 'S' AND front_len >= 5) OR (back = 'S' AND back_len >= 5) AS long_clip FROM cig"))
def _(spark, d):
    out = R.with_cigar(reads(spark, d))
    return out.select("read_name", "mate", C.cigar_text(F.col("ops")).alias("cigar"), F.size("ops").cast("long").alias("n_ops"), "pos", "end_pos", "matched", "read_len", "front", "back", C.long_clip(F.col("ops"), 5).alias("long_clip"))


@query("library_stats", sql("stats", f"SELECT sample, n, median, {_s6('mean', 'sd', 'low', 'high', 'mapq')} FROM stats"))
def _(spark, d):
    return R.library_stats(reads(spark, d)).select("sample", "n", "median", *_r6("mean", "sd", "low", "high", "mapq"))


@query("stats_filter", sql("proper", "SELECT read_name, mate, sample FROM proper"))
def _(spark, d):
    return R.stats_read_filter(reads(spark, d)).select("read_name", "mate", "sample")


@query("depth_stats", sql("cig", "SELECT sample, count(*) AS places, round(avg(n), 6) AS mean_depth, round(stddev_samp(n), 6) AS sd_depth FROM (SELECT sample, ref_id, spot, count(*) AS n FROM (SELECT sample, ref_id, unnest(range(CAST(ceil(pos / 100.0) AS BIGINT), CAST(floor(end_pos / 100.0) AS BIGINT) + 1)) AS spot FROM cig) GROUP BY ALL) GROUP BY sample"))
def _(spark, d):
    return R.depth_stats(R.with_cigar(reads(spark, d))).select("sample", "places", *_r6("mean_depth", "sd_depth"))


@query("base_quality", sql("proper", "SELECT sample, round(sum(q) * 1.0 / sum(n), 6) AS base_quality FROM (SELECT sample, length(qual) AS n, length(qual) * (ascii(qual) - 33) AS q FROM proper) GROUP BY sample"))
def _(spark, d):
    return R.base_quality(reads(spark, d)).select("sample", *_r6("base_quality"))


@query("pile_filter", sql("pile", "SELECT read_name, mate FROM pile"))
def _(spark, d):
    return R.pileup_read_filter(reads(spark, d)).select("read_name", "mate")


@query("clean_sequence", sql("reads", "SELECT read_name, mate FROM reads WHERE length(seq) >= 20 AND length(replace(substr(seq, 1, 10), 'N', '')) >= 5"))
def _(spark, d):
    return reads(spark, d).where(R.clean_sequence(F.col("seq"))).select("read_name", "mate")


@query("contig_filter", sql("reads", "SELECT read_name, mate FROM reads WHERE ref_id IN (1, 2, 4)"))
def _(spark, d):
    lengths = contigs(spark).withColumn("length", F.when(F.col("ref_id") == 0, 900).otherwise(5000))
    return R.contig_filter(reads(spark, d), lengths, lengths.where("ref_id = 3")).select("read_name", "mate")


@query("region_filter", sql("cig", "SELECT read_name, mate FROM cig WHERE ref_id = 2 AND pos < 300000 AND end_pos >= 20000"))
def _(spark, d):
    return R.region_filter(R.with_cigar(reads(spark, d)), 2, 20000, 300000).select("read_name", "mate")


@query("mismatch_filter", sql("pairs", "SELECT sample, read_name FROM pairs WHERE a_nm <= 10 AND b_nm <= 10 AND coalesce(len(string_split(a_xa, ';')), 0) <= 3 AND coalesce(len(string_split(b_xa, ';')), 0) <= 3"))
def _(spark, d):
    few = lambda r: (r["nm"] <= 10) & R.few_hits(r["xa"])
    return calling.pairs_of(kept(spark, d)).where(few(F.col("r1")) & few(F.col("r2"))).select("sample", "read_name")


_SPLIT = """, s AS (SELECT *, split_part(sa, ',', 1) AS sc, CAST(split_part(sa, ',', 2) AS BIGINT) - 1 AS sp, split_part(sa, ',', 3) = '-' AS srev, split_part(sa, ',', 4) AS scig, CAST(split_part(sa, ',', 5) AS INT) AS smapq, CAST(rtrim(split_part(sa, ',', 6), ';') AS INT) AS snm FROM kept WHERE sa IS NOT NULL),
    e AS (SELECT *, CASE WHEN back IN ('S', 'H') THEN end_pos ELSE pos END AS a, CASE WHEN scig LIKE '%S' THEN sp + list_sum(list_transform(regexp_extract_all(scig, '([0-9]+)M', 1), lambda x: CAST(x AS BIGINT))) ELSE sp END AS b FROM s
          WHERE snm <= 10 AND smapq >= 5 AND NOT (front IN ('S', 'H') AND back IN ('S', 'H')) AND scig <> '30S40M30S' AND sc = concat('c', ref_id))
    SELECT sample, ref_id AS seqid, CAST(least(a, b) AS BIGINT) AS lpos, CAST(greatest(a, b) AS BIGINT) AS rpos, CASE WHEN (front IN ('S', 'H') AND b > a) OR (back IN ('S', 'H') AND b < a) THEN 'Z' WHEN reverse <> srev THEN 'V' ELSE 'S' END AS evidence FROM e WHERE a <> b"""


@query("split_edges", sql("kept", "").rstrip() + _SPLIT)
def _(spark, d):
    return R.split_edges(kept(spark, d), contigs(spark))


@query("mate_pairs", sql("pairs", "SELECT sample, read_name, a_pos AS pos1, b_pos AS pos2 FROM pairs"))
def _(spark, d):
    mates = R.mate_pairs(R.graph_read_filter(reads(spark, d)).select("sample", "read_name", "mate", "pos"))
    return mates.select("sample", "read_name", F.col("r1.pos").alias("pos1"), F.col("r2.pos").alias("pos2"))


@query("unpaired_reads", sql("kept", "SELECT sample, read_name, min(mate) AS mate FROM kept GROUP BY ALL HAVING min(mate) = max(mate)"))
def _(spark, d):
    return R.unpaired_reads(kept(spark, d))


@query("pair_filter", sql("good", "SELECT sample, read_name FROM good"))
def _(spark, d):
    return R.filtered_pairs(pairs(spark, d)).select("sample", "read_name")


@query("insert_class", sql("classes", "SELECT sample, read_name, evidence FROM classes"))
def _(spark, d):
    return classes(spark, d).select("sample", "read_name", "evidence")


@query("cigar_indel_edges", sql("within", "SELECT sample, seqid, evidence, a AS lpos, a + size AS rpos FROM within"))
def _(spark, d):
    return R.indel_edges(kept(spark, d)).select("sample", "seqid", "evidence", "lpos", "rpos")


_edge_list = "seqid, lpos, rpos, " + ", ".join(f"\"{c}\" AS e_{c.lower()}" for c in _EVIDENCE)


@query("evidence_edges", sql("edges", f"SELECT {_edge_list} FROM edges"))
def _(spark, d):
    return edges(spark, d).select("seqid", "lpos", "rpos", *(F.col(c).alias(f"e_{c.lower()}") for c in _EVIDENCE))


@query("node_support", sql("nodes", "SELECT * FROM nodes"))
def _(spark, d):
    return K.nodes(edges(spark, d))


@query("sample_support", sql("evidence", "SELECT seqid, pos, sample, count(*) AS n FROM (SELECT seqid, unnest([lpos, rpos]) AS pos, sample FROM evidence) GROUP BY ALL"))
def _(spark, d):
    return K.sample_support(evidence(spark, d))


@query("components", sql("comps", "SELECT * FROM comps"))
def _(spark, d):
    return K.components(edges(spark, d))


@query("best_breakpoint", sql("best", "SELECT seqid, component, size, score, lpos, rpos FROM best"))
def _(spark, d):
    return breakpoints(spark, d)


_counts = [f"n_{k}" for k in K.COUNTERS]


@query("sv_counts", sql("typed", f"SELECT seqid, component, lpos, rpos, type, {', '.join(_counts)} FROM typed"))
def _(spark, d):
    return calls(spark, d).select("seqid", "component", "lpos", "rpos", "type", *_counts)


@query("cluster_fraction", sql("calls", f"SELECT seqid, component, type, {_s6('cluster_frac', 'avg_dist')} FROM calls"))
def _(spark, d):
    return calls(spark, d).select("seqid", "component", "type", *_r6("cluster_frac", "avg_dist"))


_weights = ", ".join(f"round(n_{k} * 1.0 / nullif(n_del + n_dup + n_inv + n_ins + n_tra, 0), 6) AS w_{k}" for k in ("del", "dup", "inv", "ins", "tra"))


@query("sv_calls", sql("checked", f"SELECT seqid, lpos, rpos, type, n_total, {_s6('cluster_frac', 'avg_dist')}, {_weights} FROM checked"))
def _(spark, d):
    out = K.emitted(calls(spark, d))
    return out.select("seqid", "lpos", "rpos", "type", "n_total", *_r6("cluster_frac", "avg_dist", "w_del", "w_dup", "w_inv", "w_ins", "w_tra"))


@query("tiling", sql("reads", "SELECT ref_id, CAST(floor(pos / 100000.0) AS BIGINT) AS tile, count(*) AS n FROM reads GROUP BY ALL"))
def _(spark, d):
    return reads(spark, d).groupBy("ref_id", I.tile(F.col("pos"), 100_000).alias("tile")).agg(F.count("*").alias("n"))


def pile(spark, d):
    return R.with_cigar(R.pileup_read_filter(reads(spark, d)))


@query("clip_positions", sql("places", "SELECT * FROM places"))
def _(spark, d):
    return P.clip_positions(pile(spark, d))


def piled(spark, d):
    p = cut(pile(spark, d).drop("seq", "qual"))
    return P.pileup(P.clip_positions(p), P.pile_features(p))


def evidenced(spark, d):
    """What the samples' reads say of each clip place, from sums of equal spans that are laid over the places."""
    rows = cut(reads(spark, d))
    p = cut(R.with_cigar(R.pileup_read_filter(rows)).drop("seq", "qual"))
    spans = P.evidence_spans(cut(P.with_support(P.pile_features(p), P.clip_support(p), R.library_stats(rows))))
    return P.span_evidence(P.clip_positions(p), cut(spans))


_FLAGS = "complex low mate_missing paired discordant split evert same_strand split_same first_same second_same split_other split_cross soft_front soft_back".split()
_AT = lambda f, b: f"CAST(sum(CAST({f} AND pos = bp AS INT) + CAST({b} AND end_pos = bp AS INT)) AS BIGINT)"
_PLACE = "SELECT ref_id, bp, count(*) AS n_reads, CAST(sum(mapq) AS BIGINT) AS mapq_sum, count(*) FILTER (cross_) AS n_cross, " + ", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in _FLAGS) + f", CAST(sum(inserted) AS BIGINT) AS n_inserted, CAST(sum(deleted) AS BIGINT) AS n_deleted, {_AT('soft_front', 'soft_back')} AS n_primary, {_AT('extra_front', 'extra_back')} AS n_supplement, count(*) FILTER (odd) AS n_odd FROM piled GROUP BY ALL"


@query("pileup_counts", sql("piled", _PLACE))
def _(spark, d):
    return P.pileup_counts(piled(spark, d))


@query("attributes", sql("piled", "SELECT ref_id, bp, " + ", ".join(f"round(n_{c} * 1.0 / n_reads, 6) AS at_{c}" for c in P.ATTRIBUTES) + f" FROM ({_PLACE})"))
def _(spark, d):
    out = P.attributes(P.pileup_counts(piled(spark, d)))
    return out.select("ref_id", "bp", *(F.round(F.col("at")[k], 6).alias(f"at_{c}") for k, c in enumerate(P.ATTRIBUTES)))


@query("scoring_gates", sql("piled", f"SELECT ref_id, bp FROM ({_PLACE}) WHERE (n_primary >= 3 OR n_supplement >= 2) AND NOT (n_discordant = 0 AND n_split = 0 AND n_evert = 0 AND n_primary < 3)"))
def _(spark, d):
    return P.scoring_gates(P.pileup_counts(piled(spark, d))).select("ref_id", "bp")


_CLIPS = """, c AS (SELECT ref_id, pos, unnest([{'bp': pos, 'direction': 'f', 'on': front = 'S', 'bases': substr(seq, 1, front_len), 'q': substr(qual, greatest(front_len - 4, 1), 5)}, {'bp': end_pos, 'direction': 'b', 'on': back = 'S', 'bases': substr(seq, greatest(length(seq) - back_len + 1, 1), back_len), 'q': substr(qual, greatest(length(qual) - back_len + 1, 1), 5)}]) AS e FROM pile WHERE (flag & 2048) = 0),
    clips AS (SELECT ref_id, e.bp AS bp, e.direction AS direction, e.bases AS bases FROM c WHERE e.on AND coalesce(length(e.q) * (ascii(e.q) - 33), 0) / 5.0 >= 20)"""


@query("clip_bases", sql("pile", _CLIPS + " SELECT ref_id, bp, direction, count(*) AS n, min(bases) AS least, max(bases) AS most FROM clips GROUP BY ALL"))
def _(spark, d):
    return P.clip_bases(pile(spark, d)).groupBy("ref_id", "bp", "direction").agg(F.count("*").alias("n"), F.min("bases").alias("least"), F.max("bases").alias("most"))


@query("clip_direction", sql("pile", ", c AS (SELECT ref_id, unnest([{'bp': pos, 'd': 'f', 'on': front = 'S'}, {'bp': end_pos, 'd': 'b', 'on': back = 'S'}]) AS e FROM pile WHERE (flag & 2048) = 0) SELECT ref_id, bp, CASE WHEN b > f THEN 'b' ELSE 'f' END AS direction, greatest(f, b) AS n FROM (SELECT ref_id, e.bp AS bp, count(*) FILTER (e.d = 'f') AS f, count(*) FILTER (e.d = 'b') AS b FROM c WHERE e.on GROUP BY ALL)"))
def _(spark, d):
    return P.clip_direction(P.clip_bases(pile(spark, d), quality=-99))


def other_ends(spark, d):
    p = cut(pile(spark, d).select("ref_id", "pos", "mate_ref_id", "mate_pos", "sa", "xa"))
    at = lambda c, end: p.where(c).select("ref_id", F.col("pos").alias("bp"), end.alias("end"))
    hit = lambda x: F.get(x, F.lit(0))["pos"]
    return P.end_union(at("mate_ref_id = ref_id", F.col("mate_pos")), at("sa IS NOT NULL", hit(C.parse_sa(F.col("sa")))), at("xa IS NOT NULL", hit(C.parse_xa(F.col("xa")))))


_UNION = ", u AS (SELECT ref_id, pos AS bp, mate_pos AS \"end\", 'mp' AS source FROM pile WHERE mate_ref_id = ref_id UNION ALL SELECT ref_id, pos, CAST(split_part(sa, ',', 2) AS BIGINT) - 1, 'sr' FROM pile WHERE sa IS NOT NULL UNION ALL SELECT ref_id, pos, CAST(substr(split_part(xa, ',', 2), 2) AS BIGINT) - 1, 'xa' FROM pile WHERE xa IS NOT NULL) "


@query("end_union", sql("pile", _UNION + "SELECT * FROM u"))
def _(spark, d):
    return other_ends(spark, d)


@query("odd_names", sql("piled", "SELECT ref_id, bp, count(DISTINCT read_name) AS n_odd_names FROM piled WHERE odd GROUP BY ALL"))
def _(spark, d):
    p = cut(pile(spark, d).drop("seq", "qual"))
    return P.odd_names(P.clip_positions(p), cut(P.odd_spans(P.pile_features(p))))


@query("evaluation_partner", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey % 4 > 0 OR (l_discount * 10 >= 0.5 AND l_linenumber >= 2 AND (l_quantity >= 6 OR l_tax >= 0.01))) AND l_linenumber * 4 / nullif(l_quantity, 0) <= 1.5 AND l_linenumber * 4 <= 18 AND l_suppkey % 9 <= 1.4 * (l_partkey % 7) AND CASE WHEN l_partkey % 4 > 0 THEN l_suppkey % 5 ELSE 0 END >= 1 AND l_quantity >= 3 AND l_suppkey % 9 <= 6 AND l_partkey % 7 <= 5")
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 10 AS si", "l_linenumber + 4 AS pu", "l_quantity AS nc", "l_tax * 100 AS su", "l_linenumber * 4 AS n", "l_suppkey % 9 AS cu", "l_partkey % 7 AS rd", "CASE WHEN l_partkey % 4 > 0 THEN concat('c1,', l_partkey, ',', l_suppkey % 5) END AS be")
    return V.evaluation_filter(t, 1, 3, 6, 5).select("l_orderkey", "l_linenumber")


@query("clip_consensus")
def _(spark, d):
    bases = Q.clipped_bases(cut(pile(spark, d)))
    return M.place_consensus(bases, P.clip_direction(bases).where("n >= 2"))


_GATED = _CLIPS + """, cnt AS (SELECT ref_id, bp, count(*) AS n_reads, count(*) FILTER (discordant) AS n_discordant, count(*) FILTER (split) AS n_split, count(*) FILTER (evert) AS n_evert,
        sum(CAST(soft_front AND pos = bp AS INT) + CAST(soft_back AND end_pos = bp AS INT)) AS n_primary, sum(CAST(extra_front AND pos = bp AS INT) + CAST(extra_back AND end_pos = bp AS INT)) AS n_supplement,
        count(*) FILTER (far AND NOT sup) AS n_far, count(*) FILTER (deviant AND NOT far AND NOT sup) AS n_close, count(*) FILTER (deviant AND NOT sup AND insert = 0) AS n_zero,
        len(list_distinct(list_concat(coalesce(list(pos) FILTER (soft_front), []), coalesce(list(end_pos) FILTER (soft_back), [])))) + len(list_distinct(list_concat(coalesce(list(pos) FILTER (extra_front), []), coalesce(list(end_pos) FILTER (extra_back), [])))) AS n_clusters,
        sum(CAST(soft_front AND abs(pos - bp) <= 50 AS INT) + CAST(soft_back AND abs(end_pos - bp) <= 50 AS INT)) AS cn, sum(CASE WHEN soft_front AND abs(pos - bp) <= 50 THEN pos - bp ELSE 0 END + CASE WHEN soft_back AND abs(end_pos - bp) <= 50 THEN end_pos - bp ELSE 0 END) AS cs,
        sum(CASE WHEN soft_front AND abs(pos - bp) <= 50 THEN (pos - bp) * (pos - bp) ELSE 0 END + CASE WHEN soft_back AND abs(end_pos - bp) <= 50 THEN (end_pos - bp) * (end_pos - bp) ELSE 0 END) AS cq
      FROM piled GROUP BY ALL),
    bounds AS (SELECT *, CASE WHEN cn > 1 THEN CAST(floor(1.96 * sqrt(CAST(cn * cq - cs * cs AS DOUBLE) / CAST(cn * (cn - 1) AS DOUBLE))) AS BIGINT) + 1 ELSE 0 END AS half FROM cnt),
    dirs AS (SELECT ref_id, bp, CASE WHEN b > f THEN 'b' ELSE 'f' END AS direction, greatest(f, b) AS n_clips FROM (SELECT ref_id, bp, count(*) FILTER (direction = 'f') AS f, count(*) FILTER (direction = 'b') AS b FROM clips WHERE length(bases) >= 5 GROUP BY ALL) WHERE greatest(f, b) >= 2),
    gated AS (SELECT b.*, direction, n_clips FROM bounds b JOIN dirs USING (ref_id, bp) WHERE (n_primary >= 3 OR n_supplement >= 2) AND NOT (n_discordant = 0 AND n_split = 0 AND n_evert = 0 AND n_primary < 3))"""


def features(spark, d):
    rows = cut(reads(spark, d))
    p = Q.prepared_pile(rows)
    return p, Q.featured(p, rows)


def gated(p, f):
    """Places that pass the gates before the consensus, which SQL cannot tell."""
    return cut(Q.counted_places(p, f).join(P.clip_direction(Q.clipped_bases(p)).where("n >= 2").withColumnRenamed("n", "n_clips"), Q.PLACE))


@query("start_interval", sql("piled", _GATED + " SELECT ref_id, bp, bp - half AS start_low, bp + half AS start_high FROM bounds"))
def _(spark, d):
    p, f = features(spark, d)
    return P.start_bounds(P.pileup_counts(P.pileup(P.clip_positions(p), cut(P.stacked(f))), P.counted_more())).select("ref_id", "bp", "start_low", "start_high")


@query("pileup_gates", sql("piled", _GATED + " SELECT ref_id, bp, direction, n_clips, n_far, n_close, n_zero, CAST(n_clusters AS BIGINT) AS n_clusters FROM gated"))
def _(spark, d):
    return gated(*features(spark, d)).select("ref_id", "bp", "direction", "n_clips", "n_far", "n_close", "n_zero", "n_clusters")


_SPAN = "list_sum(list_transform(regexp_extract_all(cig, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT)))"
_ENDED = _GATED + f""", over AS (SELECT g.direction, p.* FROM gated g JOIN piled p USING (ref_id, bp)),
    said AS (SELECT ref_id, bp, 'sr' AS source, split_part(h, ',', 1) AS seqid, CAST(split_part(h, ',', 2) AS BIGINT) - 1 AS spot, split_part(h, ',', 4) AS cig FROM (SELECT ref_id, bp, unnest(string_split(rtrim(sa, ';'), ';')) AS h FROM over WHERE sa IS NOT NULL)
             UNION ALL SELECT ref_id, bp, 'xa', split_part(h, ',', 1), CAST(substr(split_part(h, ',', 2), 2) AS BIGINT) - 1, split_part(h, ',', 3) FROM (SELECT ref_id, bp, unnest(string_split(rtrim(xa, ';'), ';')) AS h FROM over WHERE xa IS NOT NULL)),
    hits AS (SELECT ref_id, bp, source, CAST(substr(seqid, 2) AS INT) AS hit_ref, CASE WHEN cig LIKE '%S' THEN spot + {_SPAN} - 1 ELSE spot END AS e, NOT regexp_matches(cig, '^[0-9]+S.*S$') AS usable FROM said),
    others AS (SELECT ref_id, bp, ref_id AS other FROM over WHERE deviant AND NOT sup UNION ALL SELECT ref_id, bp, mate_ref_id FROM over WHERE NOT mate_missing AND mate_ref_id <> ref_id UNION ALL SELECT ref_id, bp, hit_ref FROM hits WHERE source = 'sr'),
    best_other AS (SELECT ref_id, bp, first(other ORDER BY n DESC, other <> ref_id, other) AS other FROM (SELECT ref_id, bp, other, count(*) AS n FROM others GROUP BY ALL) GROUP BY ALL),
    chosen AS (SELECT ref_id, bp, coalesce(other, ref_id) AS chr2 FROM gated LEFT JOIN best_other USING (ref_id, bp)),
    ends2 AS (SELECT ref_id, bp, mate_pos AS e, 'mp' AS source FROM over JOIN chosen USING (ref_id, bp) WHERE deviant AND NOT sup AND chr2 = ref_id
              UNION ALL SELECT ref_id, bp, mate_pos, 'mp' FROM over JOIN chosen USING (ref_id, bp) WHERE chr2 <> ref_id AND mate_ref_id = chr2 AND NOT mate_missing AND ((soft_front AND pos = bp) OR (soft_back AND end_pos = bp))
              UNION ALL SELECT ref_id, bp, e, source FROM hits JOIN chosen USING (ref_id, bp) WHERE usable AND hit_ref = chr2),
    zones AS (SELECT ref_id, bp, CASE WHEN count(*) FILTER (source = 'mp') > 1 THEN CAST(sum(e) FILTER (source = 'mp') // count(*) FILTER (source = 'mp') AS BIGINT) ELSE bp END AS zone FROM ends2 GROUP BY ref_id, bp),
    tens AS (SELECT ref_id, bp, CAST(floor((e + 5) / 10.0) * 10 AS BIGINT) AS ten, count(*) AS n FROM ends2 GROUP BY ALL),
    won AS (SELECT * FROM (SELECT ref_id, bp, first(ten ORDER BY n DESC, abs(ten - zone), ten) AS ten FROM tens JOIN zones USING (ref_id, bp) GROUP BY ALL) WHERE ten <> 0),
    sums AS (SELECT ref_id, bp, ten, count(*) FILTER (abs(e - ten) < 150) AS n_ends, coalesce(sum(e - ten) FILTER (abs(e - ten) < 150), 0) AS s, coalesce(sum((e - ten) * (e - ten)) FILTER (abs(e - ten) < 150), 0) AS q, first(e ORDER BY abs(e - ten), e) AS nearest,
        count(*) FILTER (source = 'mp' AND abs(e - ten) < 150) AS n_mp, count(*) FILTER (source = 'sr' AND abs(e - ten) < 150) AS n_sr, count(*) FILTER (source = 'xa' AND abs(e - ten) < 150) AS n_xa FROM ends2 JOIN won USING (ref_id, bp) GROUP BY ALL),
    honed AS (SELECT ref_id, bp, first(e ORDER BY n DESC, e) AS e FROM (SELECT ref_id, bp, e, count(*) AS n FROM ends2 JOIN sums USING (ref_id, bp) WHERE abs(e - nearest) <= 20 GROUP BY ALL) GROUP BY ALL),
    found AS (SELECT g.*, c.chr2, s.n_ends, coalesce(n_mp, 0) AS n_mp, coalesce(n_sr, 0) AS n_sr, coalesce(n_xa, 0) AS n_xa, h.e, z.zone IS NOT NULL AS has, CASE WHEN n_ends > 1 THEN CAST(floor(1.96 * sqrt(CAST(n_ends * q - s * s AS DOUBLE) / CAST(n_ends * (n_ends - 1) AS DOUBLE))) AS BIGINT) ELSE 0 END AS spread
        FROM gated g JOIN chosen c USING (ref_id, bp) LEFT JOIN sums s USING (ref_id, bp) LEFT JOIN honed h USING (ref_id, bp) LEFT JOIN zones z USING (ref_id, bp)),
    placed AS (SELECT *, CASE WHEN has AND n_zero > coalesce(n_ends, 0) THEN bp + 1 ELSE coalesce(e + 1, 0) END AS other, CASE WHEN has AND n_zero > coalesce(n_ends, 0) THEN bp + 1 ELSE coalesce(e - spread, 0) END AS ci_low, CASE WHEN has AND n_zero > coalesce(n_ends, 0) THEN bp + 1 ELSE coalesce(e + spread, 0) END AS ci_high FROM found),
    ended AS (SELECT *, CASE WHEN NOT has OR chr2 <> ref_id THEN 0 ELSE abs(bp - other) END AS svlen FROM placed),
    open AS (SELECT * FROM ended WHERE other <> 0 AND NOT (svlen > 1000000 AND n_mp = 0 AND n_sr = 0))"""


@query("other_ends", sql("piled", _ENDED + " SELECT ref_id, bp, chr2, CAST(other AS BIGINT) AS other, CAST(ci_low AS BIGINT) AS ci_low, CAST(ci_high AS BIGINT) AS ci_high, CAST(svlen AS BIGINT) AS svlen, n_mp, n_sr, n_xa FROM open"))
def _(spark, d):
    p, f = features(spark, d)
    return Q.end_gates(Q.other_ends(gated(p, f), f, contigs(spark))).select("ref_id", "bp", "chr2", "other", "ci_low", "ci_high", "svlen", "n_mp", "n_sr", "n_xa")


@query("pileup_calls", sql("marked", _ENDED + """, ev AS (SELECT m.*, count(*) FILTER (clipped) OVER w AS n_clip, count(*) OVER w AS depth FROM marked m JOIN open o USING (ref_id, bp) WINDOW w AS (PARTITION BY ref_id, bp, m.sample)),
    ruled AS (SELECT *, pow(10, -greatest(mapq, 1) / 10.0) AS err, alt AND n_clip > 1 AND n_clip * 1.0 / depth > 0.01 AS bad FROM ev),
    gl AS (SELECT ref_id, bp, sample, any_value(n_clip) AS n_clip, count(*) AS n, count(*) FILTER (bad) AS k, sum(CASE WHEN bad THEN ln(2 * err) ELSE ln(2 * (1 - err)) END) AS aa, sum(CASE WHEN bad THEN ln(2 * (1 - err)) ELSE ln(2 * err) END) AS bb FROM ruled GROUP BY ALL),
    gls2 AS (SELECT *, CASE WHEN n > k THEN aa - n * ln(2) ELSE -255.0 END AS gaa, CASE WHEN n > k AND k > 0 THEN -n * ln(2) ELSE -255.0 END AS gab, CASE WHEN k > 0 THEN bb - n * ln(2) ELSE -255.0 END AS gbb FROM gl),
    typed2 AS (SELECT *, CASE WHEN n < 2 THEN '.' WHEN gaa >= gab AND gaa >= gbb THEN '0' WHEN gab >= gbb THEN '1' ELSE '2' END AS g FROM gls2),
    deep AS (SELECT sample, avg(n) AS mean_depth FROM (SELECT sample, ref_id, spot, count(*) AS n FROM (SELECT sample, ref_id, unnest(range(CAST(ceil(pos / 100.0) AS BIGINT), CAST(floor(end_pos / 100.0) AS BIGINT) + 1)) AS spot FROM pile) GROUP BY ALL) GROUP BY sample),
    called AS (SELECT ref_id, bp, sum(CASE WHEN g = '1' THEN 1 WHEN g = '2' THEN 2 ELSE 0 END) AS n_alleles, max(CASE WHEN n < 2 THEN 0 ELSE k END) AS most_bad, avg(n / mean_depth) FILTER (g IN ('1', '2')) AS depth_ratio, count(*) FILTER (g <> '.' AND sample = 's0') AS gc_t, count(*) FILTER (g <> '.' AND sample <> 's0') AS gc_b,
        string_agg(concat(sample, '=', g, ':', CASE WHEN n < 2 THEN 0 ELSE n - k END, ':', CASE WHEN n < 2 THEN 0 ELSE k END, ':', n_clip, ':', n), ' ' ORDER BY sample) AS samples FROM typed2 LEFT JOIN deep USING (sample) GROUP BY ALL)
    SELECT ref_id, bp, chr2, CAST(other AS BIGINT) AS other, CAST(svlen AS BIGINT) AS svlen, CAST(n_alleles AS BIGINT) AS n_alleles, round(depth_ratio, 6) AS depth_ratio, gc_t, gc_b, samples FROM open JOIN called USING (ref_id, bp) WHERE n_alleles > 0 AND most_bad > 1"""))
def _(spark, d):
    p, f = features(spark, d)
    found = cut(Q.end_gates(Q.other_ends(gated(p, f), f, contigs(spark))))
    out = Q.genotyped(found, cut(Q.sample_genotypes(found, f, most=None)), F.col("sample") == "s0", R.depth_stats(p))
    of = F.transform(F.array_sort(F.map_entries("genotypes")), lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"]["gt"] == "./.", ".").when(e["value"]["gt"] == "0/0", "0").when(e["value"]["gt"] == "0/1", "1").otherwise("2"), *(x for c in ("n_good", "n_bad", "n_clip", "n_reads") for x in (F.lit(":"), e["value"][c].cast("string")))))
    return out.select("ref_id", "bp", "chr2", "other", "svlen", "n_alleles", F.round("depth_ratio", 6).alias("depth_ratio"), "gc_t", "gc_b", F.array_join(of, " ").alias("samples"))


@query("sample_evidence", sql("marked", "SELECT ref_id, bp, sample, count(*) AS n_reads, count(*) FILTER (alt) AS n_alt, count(*) FILTER (clipped) AS n_clip, count(*) FILTER (same) AS n_same, count(*) FILTER (deviant) AS n_deviant, count(*) FILTER (far) AS n_far, count(*) FILTER (deviant AND NOT far) AS n_close, round(count(*) FILTER (clipped) * 1.0 / count(*), 6) AS clip_share FROM marked GROUP BY ALL"))
def _(spark, d):
    out = evidenced(spark, d).withColumn("clip_share", F.round("clip_share", 6))
    return out.select("ref_id", "bp", "sample", "n_reads", "n_alt", "n_clip", "n_same", "n_deviant", "n_far", "n_close", "clip_share")


def genotypes(spark, d):
    return P.span_likelihoods(evidenced(spark, d), ["ref_id", "bp", "sample"])


@query("genotype_gl", sql("genos", f"SELECT ref_id, bp, sample, n, n_alt, gt, {_s6('gl_aa', 'gl_ab', 'gl_bb')} FROM genos"))
def _(spark, d):
    return genotypes(spark, d).select("ref_id", "bp", "sample", "n", "n_alt", "gt", *_r6("gl_aa", "gl_ab", "gl_bb"))


_ll = lambda a, n, p: f"({a} * ln(CASE WHEN {p} > 0 THEN {p} END) + ({n} - {a}) * ln(CASE WHEN 1 - {p} > 0 THEN 1 - {p} END))"
_af = "(ka * 1.0 / nullif(na, 0) + 1e-6)", "(kb * 1.0 / nullif(nb, 0) + 1e-6)", "((ka + kb) * 1.0 / nullif(na + nb, 0) + 1e-6)"


@query("assoc_lrt", sql("genos", f"""SELECT ref_id, bp, ka AS alt_t, na AS all_t, kb AS alt_b, nb AS all_b, round({_af[0]}, 6) AS af_t, round({_af[1]}, 6) AS af_b,
    round(greatest(coalesce(2 * ({_ll('ka', 'na', _af[0])} + {_ll('kb', 'nb', _af[1])} - {_ll('ka', 'na', _af[2])} - {_ll('kb', 'nb', _af[2])}), 0.0), 0.0), 6) AS lrt
    FROM (SELECT ref_id, bp, CAST(sum(CASE WHEN sample = 's0' THEN a ELSE 0 END) AS BIGINT) AS ka, CAST(sum(CASE WHEN sample = 's0' THEN 2 ELSE 0 END) AS BIGINT) AS na, CAST(sum(CASE WHEN sample <> 's0' THEN a ELSE 0 END) AS BIGINT) AS kb, CAST(sum(CASE WHEN sample <> 's0' THEN 2 ELSE 0 END) AS BIGINT) AS nb
          FROM (SELECT *, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 ELSE 2 END AS a FROM genos WHERE gt <> './.') GROUP BY ALL)"""))
def _(spark, d):
    out = P.association(genotypes(spark, d), F.col("sample") == "s0", ["ref_id", "bp"])
    return out.select("ref_id", "bp", "alt_t", "all_t", "alt_b", "all_b", *_r6("af_t", "af_b", "lrt"))


def mate_ends(spark, d):
    mates = R.mate_pairs(R.graph_read_filter(reads(spark, d)).select("sample", "read_name", "mate", "ref_id", "pos"))
    return mates.select("sample", (F.col("r1.pos") % 5000).alias("bp"), F.col("r2.pos").alias("end"), F.col("r1.ref_id").alias("ref_id"))


_ENDS = "SELECT a_ref_id AS ref_id, a_pos % 5000 AS bp, b_pos AS \"end\" FROM pairs"


@query("end_mode", sql("pairs", f"""SELECT ref_id, bp, CASE WHEN most < 2 THEN nb ELSE fb END AS best_end, CASE WHEN most < 2 THEN nn ELSE fn END AS n FROM (
    SELECT ref_id, bp, max(n) AS most, first(bucket ORDER BY n DESC, abs(bucket - bp), bucket) AS fb, first(n ORDER BY n DESC, abs(bucket - bp), bucket) AS fn, first(bucket ORDER BY abs(bucket - bp), bucket) AS nb, first(n ORDER BY abs(bucket - bp), bucket) AS nn
    FROM (SELECT ref_id, bp, CAST(floor(("end" + 5) / 10.0) * 10 AS BIGINT) AS bucket, count(*) AS n FROM ({_ENDS}) GROUP BY ALL) GROUP BY ALL)"""))
def _(spark, d):
    return P.end_mode(mate_ends(spark, d), ["ref_id"])


@query("partner_contig", "WITH m AS (SELECT l_partkey % 100 AS place, CAST(l_suppkey % 4 AS INT) AS ref_id, CAST(l_orderkey % 4 AS INT) AS mate_ref_id FROM lineitem), c AS (SELECT place, ref_id, mate_ref_id, count(*) AS n FROM m GROUP BY ALL) SELECT place, ref_id, mate_ref_id AS partner, n FROM (SELECT *, row_number() OVER (PARTITION BY place, ref_id ORDER BY n DESC, (ref_id = mate_ref_id) DESC, mate_ref_id) AS k FROM c) WHERE k = 1")
def _(spark, d):
    m = table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("place"), (F.col("l_suppkey") % 4).cast("int").alias("ref_id"), (F.col("l_orderkey") % 4).cast("int").alias("mate_ref_id"))
    return P.partner_contig(m, ["place"])


def spans(spark, d):
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("seqid"), minute.alias("five"), (minute + F.floor("value").cast("long")).alias("three"), F.col("event_type").alias("svtype"), F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("support"))


_ISLANDS = "i AS (SELECT *, sum(fresh) OVER (PARTITION BY seqid ORDER BY five, three, svtype, id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN five - lag(five) OVER w < 5 AND three - lag(three) OVER w < 5 THEN 0 ELSE 1 END AS fresh FROM spans WINDOW w AS (PARTITION BY seqid ORDER BY five, three, svtype, id)))"


@query("merge_calls", sql("spans", "").rstrip() + ",\n" + _ISLANDS + """ SELECT seqid, svtype, CAST(ceil(avg(five) - 0.5) AS BIGINT) AS five, CAST(ceil(avg(three) - 0.5) AS BIGINT) AS three, CAST(greatest(10, ceil(2 * coalesce(sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST(five AS HUGEINT) * five) - CAST(sum(five) AS HUGEINT) * CAST(sum(five) AS HUGEINT) AS DOUBLE) / CAST(nullif(count(*) * (count(*) - 1), 0) AS DOUBLE)), 0))) AS BIGINT) AS ci_five, CAST(greatest(10, ceil(2 * coalesce(sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST(three AS HUGEINT) * three) - CAST(sum(three) AS HUGEINT) * CAST(sum(three) AS HUGEINT) AS DOUBLE) / CAST(nullif(count(*) * (count(*) - 1), 0) AS DOUBLE)), 0))) AS BIGINT) AS ci_three, CAST(sum(support) AS BIGINT) AS support, count(*) AS collapsed, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM i GROUP BY seqid, island, svtype""")
def _(spark, d):
    return V.merge_calls(spans(spark, d))


def truth_pair(spark, d):
    c = spans(spark, d).select(F.col("id").alias("call_id"), "seqid", F.col("five").alias("start"), F.col("three").alias("end"))
    t = c.where("call_id % 3 = 0").select("seqid", F.col("call_id").alias("truth_id"), F.array(F.col("start") + F.col("call_id") % 60 - 30, F.col("end") + F.col("call_id") % 60 - 30).alias("anchors"))
    return c, t


_TRUTH = ",\nt AS (SELECT seqid, id AS truth_id, unnest([five + id % 60 - 30, three + id % 60 - 30]) AS a FROM spans WHERE id % 3 = 0), c AS (SELECT id AS call_id, seqid, unnest([five, three]) AS p FROM spans), m AS (SELECT s.id AS call_id, min(truth_id) AS truth_id FROM spans s LEFT JOIN c ON c.call_id = s.id LEFT JOIN t ON t.seqid = c.seqid AND c.p >= a - 25 AND c.p < a + 25 GROUP BY s.id) "


@query("truth_match", sql("spans", "").rstrip() + _TRUTH + "SELECT call_id, truth_id FROM m")
def _(spark, d):
    return V.truth_matches(*truth_pair(spark, d)).select("call_id", "truth_id")


@query("fdr", sql("spans", "").rstrip() + _TRUTH + "SELECT count(DISTINCT truth_id) AS tp, count(*) FILTER (truth_id IS NULL) AS fp, round(count(*) FILTER (truth_id IS NULL) * 1.0 / (count(DISTINCT truth_id) + count(*) FILTER (truth_id IS NULL)), 6) AS fdr FROM m")
def _(spark, d):
    return V.discovery_rates(V.truth_matches(*truth_pair(spark, d))).withColumn("fdr", F.round("fdr", 6))


_FILTER_IN = "SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' ELSE 'INS' END AS svtype, CAST(l_quantity * 20 - 30 AS BIGINT) AS svlen, l_suppkey % 10 AS tf, l_partkey % 9 AS u, l_orderkey % 8 AS v, {w} AS cw, CAST(l_quantity AS BIGINT) AS a, {sp} AS sp FROM {t}"
_CW = "(l_tax * 10, l_discount * 10, l_tax * 5, l_discount * 5, l_tax * 2.5)"
_SP = "(l_orderkey % 12, l_partkey % 5, l_suppkey % 3)"


@query("call_filter", "WITH c AS (" + _FILTER_IN.format(w="list_value" + _CW, sp="list_value" + _SP, t="lineitem") + """) SELECT l_orderkey, l_linenumber, svtype, svlen FROM c WHERE abs(svlen) BETWEEN 50 AND 1000000 AND (svtype <> 'DEL' OR tf >= 4) AND (svtype <> 'DUP' OR u >= 4) AND (svtype <> 'INV' OR v >= 4)
    AND cw[CASE svtype WHEN 'DEL' THEN 1 WHEN 'DUP' THEN 2 WHEN 'INV' THEN 3 ELSE 4 END] >= 0.2 AND cw[5] <= 0.2 AND a >= 1.5 * len(list_filter(sp, lambda x: x > 0)) AND list_max(sp) > 7""")
def _(spark, d):
    c = spark.sql(_FILTER_IN.format(w="array" + _CW, sp="array" + _SP, t="{lineitem}"), lineitem=table(spark, d, "lineitem"))
    return V.high_coverage_filter(c).select("l_orderkey", "l_linenumber", "svtype", "svlen")


_INFO = "concat('A=', CAST(l_quantity AS BIGINT), ';CF=', l_linenumber, ';ST=', l_linestatus, ';FLAG')"


@query("info_map", f"SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS cf, l_linestatus AS st, CAST(NULL AS VARCHAR) AS missing, l_linestatus AS st_regex FROM lineitem")
def _(spark, d):
    i = F.expr(_INFO)
    m = S.info_map(i)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m["A"].alias("a"), m["CF"].alias("cf"), m["ST"].alias("st"), m["NO"].alias("missing"), S.info_value(i, "ST").alias("st_regex"))


@query("vcf_select", "SELECT chrom, pos, id, a, st FROM (SELECT concat('chr', l_suppkey % 5) AS chrom, l_partkey AS pos, l_orderkey AS id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS a, l_linestatus AS st, row_number() OVER (PARTITION BY l_suppkey % 5, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus) AS k FROM lineitem) WHERE k = 1 AND chrom = 'chr1' AND pos BETWEEN 10 AND 900")
def _(spark, d):
    lines = F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus")
    t = table(spark, d, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_orderkey").alias("id"), F.expr(_INFO).alias("info"), lines.alias("line"))
    return V.select_columns(t, ["chrom", "pos", "id"], ["A", "ST"], "chr1", 10, 900)


@query("pooled_af", "SELECT l_orderkey, l_linenumber, round(l_partkey * 1.0 / nullif(l_partkey + l_suppkey, 0), 6) AS af_target, round(l_linenumber * 1.0 / nullif(l_linenumber + l_orderkey, 0), 6) AS af_background FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem")
    return V.pooled_frequency(t, "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", *_r6("af_target", "af_background"))


_ACGT = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query("kmer_entropy", """WITH k AS (SELECT doc_id, substr(text, i, 4) AS kmer, count(*) AS n FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 4, 0) + 1)) AS i FROM documents) GROUP BY ALL)
    SELECT doc_id, count(*) AS kinds, round(-sum(n * 1.0 / t * ln(n * 1.0 / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM k) GROUP BY doc_id""")
def _(spark, d):
    e = for_all_cores(table(spark, d, "documents")).select("doc_id", N.four_entropy()("text").alias("e")).where("e.kinds IS NOT NULL")
    return e.select("doc_id", "e.kinds", F.round("e.entropy", 6).alias("entropy"))


@query("kmer_pack", """WITH t AS (SELECT doc_id, list_transform(string_split(regexp_replace({_ACGT}, '[^ATGC]', 'A', 'g'), ''), lambda c: CASE c WHEN 'T' THEN 1 WHEN 'G' THEN 2 WHEN 'C' THEN 3 ELSE 0 END) AS d FROM documents WHERE length(text) >= 6),
    v AS (SELECT doc_id, list_transform(range(1, len(d) - 4), lambda i: d[i + 0] * 1024 + d[i + 1] * 256 + d[i + 2] * 64 + d[i + 3] * 16 + d[i + 4] * 4 + d[i + 5] * 1) AS v FROM t)
    SELECT doc_id, len(v) AS n, CAST(list_min(v) AS BIGINT) AS low, CAST(list_max(v) AS BIGINT) AS high, CAST(list_sum(v) AS BIGINT) AS total FROM v""".replace("{_ACGT}", _ACGT))
def _(spark, d):
    text = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    k = for_all_cores(table(spark, d, "documents")).select("doc_id", N.packed_range(6)(text).alias("v")).where("v.n > 0")
    return k.select("doc_id", "v.*")


@query("character_entropy", """WITH c AS (SELECT p_partkey, length(p_name) AS t, x, count(*) AS n FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS x FROM part) GROUP BY ALL)
    SELECT p_partkey, round(-sum(n * 1.0 / t * log2(n * 1.0 / t)), 6) AS bits FROM c GROUP BY p_partkey""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.character_entropy(F.col("p_name")), 6).alias("bits"))


_BASES = "translate(lower({}), 'abcdefghijklmnopqrstuvwxyz #0123456789', 'ACGTACGTACGTACGTACGTACGTACGTACGTACGTAC')"


def clips(spark, d):
    """At most as many clips of a place as vote, the first in text order; ranking bounds what is gathered."""
    named = table(spark, d, "part").select((F.col("p_partkey") % 500).alias("place"), F.expr(_BASES.format("concat(p_brand, p_name)")).alias("clip"))
    first = named.select("place", "clip", F.row_number().over(Window.partitionBy("place").orderBy("clip")).alias("k")).where(F.col("k") <= A.VOTERS)
    return first.groupBy("place").agg(F.array_sort(F.collect_list("clip")).alias("clips"))


@query("consensus", f"""WITH c AS (SELECT p_partkey % 500 AS place, {_BASES.format("concat(p_brand, p_name)")} AS clip FROM part),
    f AS (SELECT place, clip FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY clip) AS k FROM c) WHERE k <= {A.VOTERS}),
    b AS (SELECT place, i, CASE WHEN count(DISTINCT substr(clip, i, 1)) = 1 THEN min(substr(clip, i, 1)) ELSE 'N' END AS base FROM (SELECT place, clip, CAST(unnest(range(1, length(clip) + 1)) AS INT) AS i FROM f) GROUP BY ALL)
    SELECT place, string_agg(base, '' ORDER BY i) AS consensus, CAST(sum(CASE WHEN base = 'N' THEN 1 ELSE 0 END) AS INT) AS n_open FROM b GROUP BY place""")
def _(spark, d):
    voted = clips(spark, d).select("place", A.consensus(F.col("clips")).alias("consensus"))
    return voted.select("place", "consensus", A.n_count(F.col("consensus")).alias("n_open"))


@query("sw_align")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_BASES.format("p_name")).alias("query"), F.expr(_BASES.format("concat(p_type, p_name, p_brand)")).alias("window"))
    aligned = p.select("p_partkey", F.lit(1000).alias("pos"), F.lit(1400).alias("end"), A.local_alignment()("query", "window").alias("x"))
    return aligned.select("p_partkey", "x.*", A.refined_end(F.col("pos"), F.col("end"), F.col("x")).alias("y")).select("p_partkey", "score", "ref_begin", "ref_end", "query_begin", "query_end", "mismatches", "y.end", "y.kind")


@query("pair_hmm")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_BASES.format("concat(p_type, p_name)")).alias("hap"), F.expr(_BASES.format("p_type")).alias("read"))
    return p.select("p_partkey", F.round(A.pair_likelihood("hap", "read", F.expr("repeat('I', length(read))")), 6).alias("log10_likelihood"))


@query("natural_breaks", """WITH c AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_returnflag) AS m, sum(n) OVER w AS cn, sum(n * v) OVER w AS cs, sum(n * v * v) OVER w AS cq FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY v)),
    z AS (SELECT l_returnflag, i, cn, cs, cq, v FROM r UNION ALL SELECT DISTINCT l_returnflag, 0, 0, 0, 0, 0 FROM r),
    p AS (SELECT a.l_returnflag, a.i AS i, b.i AS j, b.cn - a.cn AS n, b.cq - a.cq - (b.cs - a.cs) * (b.cs - a.cs) / (b.cn - a.cn) AS cost FROM z a JOIN z b ON a.l_returnflag = b.l_returnflag AND a.i < b.i),
    t AS (SELECT x.l_returnflag, x.j AS i1, y.j AS i2, row_number() OVER (PARTITION BY x.l_returnflag ORDER BY x.cost + y.cost + w.cost) AS k FROM p x JOIN p y ON x.l_returnflag = y.l_returnflag AND x.i = 0 AND y.i = x.j JOIN p w ON w.l_returnflag = x.l_returnflag AND w.i = y.j JOIN (SELECT DISTINCT l_returnflag, m FROM r) e ON e.l_returnflag = x.l_returnflag AND w.j = e.m),
    g AS (SELECT r.l_returnflag, CASE WHEN r.i <= i1 THEN 1 WHEN r.i <= i2 THEN 2 ELSE 3 END AS class, v, n FROM r JOIN t ON r.l_returnflag = t.l_returnflag AND t.k = 1)
    SELECT l_returnflag, class, min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS n, round(sum(n * v * v) - sum(n * v) * sum(n * v) / sum(n), 4) AS deviation FROM g GROUP BY ALL""")
def _(spark, d):
    return B.natural_breaks(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 3).withColumn("deviation", F.round("deviation", 4))


@query("special_functions", "SELECT o_orderkey, round(lgamma(o_totalprice / 1000), 6) AS log_gamma, round(lgamma(o_orderkey + 1), 4) AS log_factorial, round(sin(0) + 1, 6) AS identity FROM orders")
def _(spark, d):
    x = F.col("o_totalprice").cast("double") / 1000
    w = X.lambert_w(x)
    return table(spark, d, "orders").select("o_orderkey", F.round(X.lgamma(x), 6).alias("log_gamma"), F.round(X.lgamma(F.col("o_orderkey") + 1), 4).alias("log_factorial"), F.round(w * F.exp(w) / x, 6).alias("identity"))


@query("rf_classify")
def _(spark, d):
    near = (F.col("c_acctbal") / 1000).cast("double")
    rows = table(spark, d, "customer").select("c_custkey", F.array(near, F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 7).cast("double")).alias("features"), F.when(F.col("c_acctbal") > 4000, "DEL").otherwise("DUP").alias("label"))
    scored = T.score_forest(rows, T.train_forest(rows, trees=20), least=0.6)
    return scored.select("c_custkey", "label", "wc")


@query("ins_nodes", sql("checked", "SELECT c.seqid, c.component, CASE WHEN r.degree > l.degree AND type = 'I' THEN rpos ELSE lpos END AS start, CASE WHEN r.degree > l.degree AND type = 'I' THEN lpos ELSE rpos END AS other FROM calls c JOIN nodes l ON c.seqid = l.seqid AND c.lpos = l.pos JOIN nodes r ON c.seqid = r.seqid AND c.rpos = r.pos"))
def _(spark, d):
    return K.terminal_first(*called(spark, d)).select("seqid", "component", "start", "other")


@query("weighted_neighbours", sql("ends", "SELECT seqid, pos, round(sum(other * \"H\") * 1.0 / nullif(sum(\"H\"), 0), 6) AS mean_other FROM ends GROUP BY ALL"))
def _(spark, d):
    return K.weighted_neighbours(edges(spark, d)).select("seqid", "pos", *_r6("mean_other"))


@query("contig_counts", sql("best", "SELECT seqid, count(*) AS n FROM best GROUP BY ALL"))
def _(spark, d):
    return K.contig_counts(breakpoints(spark, d))


@query("end_interval", sql("pile", _UNION + """, m AS (SELECT ref_id, bp, bucket, count(*) AS n FROM (SELECT *, CAST(floor(("end" + 5) / 10.0) * 10 AS BIGINT) AS bucket FROM u) GROUP BY ALL),
    b AS (SELECT ref_id, bp, CASE WHEN max(n) < 2 THEN first(bucket ORDER BY abs(bucket - bp), bucket) ELSE first(bucket ORDER BY n DESC, abs(bucket - bp), bucket) END AS best_end FROM m GROUP BY ALL),
    w AS (SELECT ref_id, bp, best_end, "end" FROM u JOIN b USING (ref_id, bp) WHERE abs("end" - best_end) <= 150),
    r AS (SELECT ref_id, bp, first("end" ORDER BY m DESC, "end") AS refined_end FROM (SELECT ref_id, bp, "end", count(*) AS m FROM w WHERE abs("end" - best_end) <= 20 GROUP BY ALL) GROUP BY ALL)
    SELECT ref_id, bp, best_end, round(avg("end"), 6) AS mean_end, round(coalesce(sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST("end" - best_end AS HUGEINT) * ("end" - best_end)) - CAST(sum("end" - best_end) AS HUGEINT) * CAST(sum("end" - best_end) AS HUGEINT) AS DOUBLE) / CAST(nullif(count(*) * (count(*) - 1), 0) AS DOUBLE)), 0), 6) AS sd_end, any_value(refined_end) AS refined_end, best_end - CAST(floor(1.96 * coalesce(sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST("end" - best_end AS HUGEINT) * ("end" - best_end)) - CAST(sum("end" - best_end) AS HUGEINT) * CAST(sum("end" - best_end) AS HUGEINT) AS DOUBLE) / CAST(nullif(count(*) * (count(*) - 1), 0) AS DOUBLE)), 0)) AS BIGINT) AS ci_low, best_end + CAST(floor(1.96 * coalesce(sqrt(CAST(CAST(count(*) AS HUGEINT) * sum(CAST("end" - best_end AS HUGEINT) * ("end" - best_end)) - CAST(sum("end" - best_end) AS HUGEINT) * CAST(sum("end" - best_end) AS HUGEINT) AS DOUBLE) / CAST(nullif(count(*) * (count(*) - 1), 0) AS DOUBLE)), 0)) AS BIGINT) AS ci_high FROM w LEFT JOIN r USING (ref_id, bp) GROUP BY ref_id, bp, best_end"""))
def _(spark, d):
    u = cut(other_ends(spark, d).groupBy("ref_id", "bp", "end").agg(F.count("*").alias("n")))
    out = P.end_interval(u, P.end_mode(u, ["ref_id"]).select("ref_id", "bp", "best_end"), ["ref_id"])
    return out.select("ref_id", "bp", "best_end", *_r6("mean_end", "sd_end"), "refined_end", "ci_low", "ci_high")


@query("tag_hits", sql("reads", "SELECT read_name, mate, 'SA' AS tag, split_part(sa, ',', 1) AS seqid, CAST(split_part(sa, ',', 2) AS BIGINT) - 1 AS pos, CAST(rtrim(split_part(sa, ',', 6), ';') AS INT) AS nm FROM reads WHERE sa IS NOT NULL UNION ALL SELECT read_name, mate, 'XA', split_part(h, ',', 1), CAST(substr(split_part(h, ',', 2), 2) AS BIGINT) - 1, CAST(split_part(h, ',', 4) AS INT) FROM (SELECT read_name, mate, unnest(string_split(rtrim(xa, ';'), ';')) AS h FROM reads WHERE xa IS NOT NULL)"))
def _(spark, d):
    r = reads(spark, d)
    hits = lambda tag, parse: r.select("read_name", "mate", F.lit(tag).alias("tag"), F.explode(parse(F.col(tag.lower()))).alias("h")).select("read_name", "mate", "tag", "h.seqid", "h.pos", "h.nm")
    return hits("SA", C.parse_sa).unionByName(hits("XA", C.parse_xa))


@query("xp_hits", "SELECT l_orderkey, l_linenumber, concat('c', l_suppkey % 5) AS seqid, l_partkey - 1 AS pos, l_linestatus = 'O' AS reverse, CAST(l_quantity AS INT) + 5 AS span FROM lineitem")
def _(spark, d):
    tag = F.expr("concat('c', l_suppkey % 5, ',', CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END, l_partkey, ',5M', CAST(l_quantity AS INT), 'D;')")
    h = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(C.parse_xp(tag)).alias("h"))
    return h.select("l_orderkey", "l_linenumber", "h.seqid", "h.pos", "h.reverse", C.reference_span(F.col("h.cigar")).alias("span"))


@query("cigar_quirk", sql("ops", "SELECT read_name, mate, array_to_string(list_transform(o, lambda x: concat(CAST(n[1] AS VARCHAR), x)), '') AS cigar, o[1] IN ('S', 'H') AND o[-1] IN ('S', 'H') AS both FROM ops"))
def _(spark, d):
    ops = C.parse_cigar(F.col("cigar"), first_length=True)
    return reads(spark, d).select("read_name", "mate", C.cigar_text(ops).alias("cigar"), C.both_clipped(ops).alias("both"))


@query("quality_functions", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 41 AS q, round(pow(10, -(CAST(l_quantity AS INT) % 41) / 10.0), 9) AS p, round(log10(pow(10, -l_discount * 10) + pow(10, -l_tax * 10)), 6) AS added, CAST(ceil(l_extendedprice / 7 - 0.5) AS BIGINT) AS halved, CAST(floor((l_partkey + 5) / 10.0) * 10 AS BIGINT) AS tens, round(1 / (1 + exp(-l_discount)), 6) AS squashed FROM lineitem")
def _(spark, d):
    q = S.phred(F.expr("chr(33 + CAST(l_quantity AS INT) % 41)"))
    double = lambda c: F.col(c).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), F.round(S.error_probability(q), 9).alias("p"), F.round(S.log10_add(-double("l_discount") * 10, -double("l_tax") * 10), 6).alias("added"), S.round_half_down(double("l_extendedprice") / 7).cast("long").alias("halved"), S.round_to_ten(F.col("l_partkey")).alias("tens"), F.round(S.sigmoid(double("l_discount")), 6).alias("squashed"))


@query("text_functions", "SELECT p_partkey, len(string_split_regex(p_name, '[ a]')) AS n_parts, array_to_string(string_split_regex(p_name, '[ a]'), '_') AS joined, CAST(p_partkey AS VARCHAR) AS bare, replace(p_brand, '.', '') AS plain, substr(sha256(concat(p_brand, '|', p_name)), 1, 8) AS short, greatest(least(p_partkey, 50) - 20, 0) AS low, greatest(p_partkey, 50) + 20 AS high FROM part")
def _(spark, d):
    parts = S.split_any(F.col("p_name"), " a")
    low, high = S.slop(F.col("p_partkey"), F.lit(50).cast("long"), 20)
    return table(spark, d, "part").select("p_partkey", F.size(parts).cast("long").alias("n_parts"), F.array_join(parts, "_").alias("joined"), S.strip_chr(F.concat(F.lit("chr"), F.col("p_partkey").cast("string"))).alias("bare"), S.strip_dots(F.col("p_brand")).alias("plain"), S.short_id(F.col("p_brand"), F.col("p_name")).alias("short"), low.alias("low"), high.alias("high"))


@query("class_share", "SELECT l_orderkey, l_linenumber, round(greatest(l_tax, l_discount, 0.02) / (l_tax + l_discount + 0.02), 6) AS share FROM lineitem")
def _(spark, d):
    p = F.array(F.col("l_tax").cast("double"), F.col("l_discount").cast("double"), F.lit(0.02))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.class_share(p), 6).alias("share"))


def bed_calls(spark, d):
    return spans(spark, d).select("seqid", F.col("five").alias("start"), F.when(F.col("id") % 7 > 0, F.col("three")).alias("end"), F.when(F.col("id") % 5 == 0, F.col("seqid") + 1).otherwise(F.col("seqid")).alias("chr2"), "svtype", F.col("id").alias("call_id"), "support")


@query("to_bed", sql("spans", "").rstrip() + " SELECT seqid AS chr, greatest(least(five, three) - 10, 0) AS start, greatest(five, three) + 10 AS \"end\", concat(svtype, ':', id) AS name, support AS score FROM spans WHERE id % 7 > 0 AND id % 5 > 0")
def _(spark, d):
    return V.to_bed(bed_calls(spark, d), 10, paired=True)


@query("to_bedpe", sql("spans", "").rstrip() + " SELECT seqid AS chr_a, greatest(least(five, three) - 10, 0) AS start_a, least(five, three) + 10 AS end_a, CASE WHEN id % 5 = 0 THEN seqid + 1 ELSE seqid END AS chr_b, greatest(greatest(five, three) - 10, 0) AS start_b, greatest(five, three) + 10 AS end_b, concat_ws('_', seqid, row_number() OVER (ORDER BY seqid, five, three, id), svtype) AS name, support AS score FROM spans WHERE id % 7 > 0")
def _(spark, d):
    return V.to_bedpe(bed_calls(spark, d).where("end IS NOT NULL"), 10)


@query("evaluation_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 >= 0.5 AND l_linenumber >= 2 AND (l_quantity >= 6 OR l_tax >= 0.01) AND l_linenumber * 4 / nullif(l_quantity, 0) <= 1.5 AND l_linenumber * 4 <= 18 AND l_suppkey % 9 <= 1.4 * (l_partkey % 7)")
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 10 AS si", "l_linenumber + 4 AS pu", "l_quantity AS nc", "l_tax * 100 AS su", "l_linenumber * 4 AS n", "l_suppkey % 9 AS cu", "l_partkey % 7 AS rd")
    return V.evaluation_filter(t).select("l_orderkey", "l_linenumber")


@query("classifier_filter", "SELECT l_orderkey, l_linenumber, 'specific' AS mode FROM lineitem WHERE l_partkey % 3 = 1 AND l_linenumber >= 2 AND l_quantity >= 3 UNION ALL SELECT l_orderkey, l_linenumber, 'sensitive' FROM lineitem WHERE l_quantity >= 2")
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS nc", "CASE l_partkey % 3 WHEN 0 THEN 'nan' WHEN 1 THEN '17' END AS ed", "l_linenumber AS be")
    of = lambda mode: V.classifier_filter(t, mode).select("l_orderkey", "l_linenumber", F.lit(mode).alias("mode"))
    return of("specific").unionByName(of("sensitive"))


@query("without_contigs", sql("spans", "").rstrip() + " SELECT seqid, id FROM spans WHERE seqid NOT IN (3, 17)")
def _(spark, d):
    return V.without_contigs(spans(spark, d), [3, 17]).select("seqid", "id")


def typed_truth(spark, d):
    c, t = truth_pair(spark, d)
    types = spans(spark, d).select("id", "svtype")
    return c.join(types, F.col("id") == F.col("call_id")).drop("id"), t.join(types, F.col("id") == F.col("truth_id")).drop("id")


_TYPED = _TRUTH.replace("SELECT seqid, id AS truth_id,", "SELECT seqid, svtype, id AS truth_id,").replace("SELECT id AS call_id, seqid, unnest", "SELECT id AS call_id, seqid, svtype, unnest").replace("ON t.seqid = c.seqid AND", "ON t.seqid = c.seqid AND t.svtype = c.svtype AND")


@query("typed_truth", sql("spans", "").rstrip() + _TYPED + "SELECT call_id, truth_id FROM m")
def _(spark, d):
    return V.truth_matches(*typed_truth(spark, d), by=("seqid", "svtype")).select("call_id", "truth_id")


@query("population_truth", sql("spans", "").rstrip() + _TRUTH + "SELECT min(call_id) AS call_id, truth_id FROM m WHERE truth_id IS NOT NULL GROUP BY truth_id UNION ALL SELECT call_id, truth_id FROM m WHERE truth_id IS NULL")
def _(spark, d):
    return V.once_per_truth(V.truth_matches(*truth_pair(spark, d)))
