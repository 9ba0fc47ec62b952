"""Source and sink rows (S): driver tables are staged in a format and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labeltrail.operators import trace
from labeltrail.operators.ranking import top_one
from labeltrail.plans.registry import query
from labeltrail.plans.trace_queries import FUSED_SQL, fused, fused_scored
from labeltrail.session import shared_folder
from labeltrail.sources import readers, records, writers

ORD = "select o_orderkey, o_orderpriority, o_totalprice from orders"
SCHEMA = "o_orderkey bigint, o_orderpriority string, o_totalprice double"


def orders(t):
    return t.raw("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")


def place(t, name):
    return f"{shared_folder(t.spark, 'staged')}/{name}"


@query("s01_typed_tsv", ORD)
def _s01(t):
    p = place(t, "o.tsv")
    writers.write_new(orders(t), p, "csv", sep="\t", header="true")
    return readers.read_tsv(t.spark, p, SCHEMA)


@query("s02_gzip_tsv", ORD)
def _s02(t):
    p = writers.write_tsv_gz(orders(t), place(t, "o.tsv.gz"))
    return readers.read_tsv(t.spark, p, SCHEMA, gz_partitions=8)


@query("s03_suffix_read", "select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderpriority end o_orderpriority from orders union all select o_orderkey, o_orderpriority from orders")
def _s03(t):
    o = orders(t).select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    a = writers.write_table(o, place(t, "o.csv"))
    b = writers.write_table(orders(t).select("o_orderkey", "o_orderpriority"), place(t, "o.parquet"))
    return readers.read_table(t.spark, a, "o_orderkey bigint, o_orderpriority string").unionByName(readers.read_table(t.spark, b))


@query("s04_suffix_write", ORD)
def _s04(t):
    return readers.read_table(t.spark, writers.write_table(orders(t), place(t, "o.tsv")), SCHEMA)


@query("s05_projected_scan", "select l_orderkey, l_partkey from lineitem")
def _s05(t):
    return readers.projected(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_partkey"])


@query("s06_filtered_modality_scan", "select query_id, reference_id, rk sequence_rank, price sequence_price from v_seq where rk <= 2", FUSED_SQL)
def _s06(t):
    from labeltrail.operators.candidates import modality_ranks

    p = writers.write_zstd(modality_ranks(t.pairs.where(F.col("disc") <= 0.08), "price", 4), place(t, "seq.parquet"))
    return readers.modality_scan(t.spark, p, "sequence", 2, ["price"])


@query("s07_positional_hits", "select l_orderkey query_id, l_partkey reference_id, l_linenumber input_order, l_quantity fident from lineitem")
def _s07(t):
    p = place(t, "hits.m8")
    t.hits.select("query_id", "reference_id", F.col("line").alias("input_order"), F.col("qty").alias("fident")).write.option("sep", "\t").csv(p)
    return readers.positional_hits(t.spark, p, "query_id bigint, reference_id bigint, input_order int, fident double", ["input_order"])


@query("s08_member_map", "select p_partkey::varchar id, case when p_size % 4 <> 0 then (p_size)::varchar else p_partkey::varchar end representative from part")
def _s08(t):
    p = place(t, "clusters.tsv")
    part = t.raw("part")
    part.where(F.col("p_size") % 4 != 0).select(F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).write.option("sep", "\t").csv(p)
    return readers.member_map(t.spark, p, part.select(F.col("p_partkey").cast("string").alias("id")))


@query("s09_comment_skipping_tsv", "select o_orderkey, o_orderpriority from orders where o_orderkey % 10 <> 0")
def _s09(t):
    p = place(t, "commented.tsv.gz")
    line = F.concat_ws("\t", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("#"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")), "o_orderpriority")
    orders(t).select(line.alias("value")).write.option("compression", "gzip").text(p)
    return readers.read_tsv(t.spark, p, "o_orderkey bigint, o_orderpriority string", header=False, comment="#")


@query("s10_json_documents", "select event_id, (props->>'k')::bigint k, value from events")
def _s10(t):
    p = place(t, "docs.json")
    e = t.raw("events").select("event_id", F.from_json("props", "k bigint").alias("props"), "value")
    e.write.json(p)
    d = readers.read_json_document(t.spark, p, "event_id bigint, props struct<k:bigint>, value double", whole_file=False)
    return d.select("event_id", "props.k", "value")


FASTA_SQL = {"v_seqs": """select 'P'||p_partkey id, upper(replace(p_name, ' ', ''))||repeat('ACDE', (p_size % 5)::int) sequence from part"""}


def fasta(t):
    seq = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.expr("repeat('acde', cast(p_size % 5 as int))"))
    rec = F.concat(F.lit(">P"), "p_partkey", F.lit(" a>b "), "p_brand", F.lit("\n"), F.substring(seq, 1, 6), F.lit("\n"), F.substring(seq, 7, 1000))
    p = place(t, "seqs.fasta")
    t.raw("part").select(rec.alias("value")).write.text(p)
    return p


@query("s11_fasta_records", "select id, sequence, sha256(sequence) sha256, length(sequence)::int length from v_seqs", FASTA_SQL)
def _s11(t):
    return records.read_fasta(t.spark, fasta(t))


@query("s12_fasta_subset_hashes", "select id, sha256(sequence) sha256 from v_seqs where id in (select 'P'||l_partkey from lineitem where l_discount >= 0.1)", FASTA_SQL)
def _s12(t):
    ids = t.hits.where(F.col("disc") >= 0.1).select(F.concat(F.lit("P"), "reference_id").alias("id")).distinct()
    return records.fasta_hashes(t.spark, fasta(t), ids)


@query("s13_flat_file_records", "select p_partkey::varchar entry, p_name name, p_brand||' '||p_type class from part")
def _s13(t):
    p = place(t, "entries.txt")
    rec = F.concat(F.lit("ENTRY       "), "p_partkey", F.lit("\nNAME        "), "p_name", F.lit("\nCLASS       "), "p_brand", F.lit("\nCLASS       "), "p_type", F.lit("\n///"))
    t.raw("part").select(rec.alias("value")).write.text(p)
    r = records.read_flat_file(t.spark, p)
    return r.select(F.col("record")["ENTRY"].alias("entry"), F.col("record")["NAME"].alias("name"), F.col("record")["CLASS"].alias("class"))


def xml(t):
    p, c = place(t, "entries.xml"), F.col
    act = F.array(*[F.struct(F.lit(k).alias("_code"), c(v).alias("_VALUE")) for k, v in (("A", "p_type"), ("B", "p_brand"))])
    site = F.array(*[F.struct((c("p_size") + d).alias("_position"), F.lit(r).alias("_role")) for d, r in ((0, "binding"), (1, "catalytic"))])
    e = t.raw("part").select(c("p_partkey").alias("id"), c("p_name").alias("name"), act.alias("activity"), site.alias("site"))
    e.write.format("xml").option("rowTag", "entry").option("rootTag", "entries").save(p)
    return p


@query("s14_xml_entry_activities", "select p_partkey::varchar id, 0::int n, 'A' code, p_type label from part union all select p_partkey::varchar, 1, 'B', p_brand from part")
def _s14(t):
    return records.entry_activities(records.read_entries(t.spark, xml(t)))


@query("s14b_xml_entry_sites", "select p_partkey::varchar id, p_size::int position, 'binding' \"role\" from part union all select p_partkey::varchar, (p_size + 1)::int, 'catalytic' from part")
def _s14b(t):
    return records.entry_sites(records.read_entries(t.spark, xml(t)))


@query("s15_html_detail_pages", """select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, regexp_extract(html, '<html lang="([a-z]+)"', 1) lang, len(regexp_extract_all(html, '<h[1-6]'))::int headings,
    len(regexp_extract_all(html, 'href="([^"]*)"'))::int links, coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[1], '') first_link from pages""")
def _s15(t):
    p = records.parse_pages(t.raw("pages"))
    return p.select("page_id", "title", "lang", "headings", F.size("links").alias("links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"))


@query("s16_exclusive_sink", "select o_orderkey, o_orderpriority, o_totalprice, true refused from orders")
def _s16(t):
    p = writers.write_new(orders(t), place(t, "once.parquet"))
    try:
        writers.write_new(orders(t), p)
        refused = False
    except AnalysisException:  # the path exists already
        refused = True
    return t.spark.read.parquet(p).withColumn("refused", F.lit(refused))


@query("s17_zstd_parquet_sink", ORD)
def _s17(t):
    return t.spark.read.parquet(writers.write_zstd(orders(t), place(t, "o.parquet")))


@query("s18_bounded_files_sink", "select count(*) \"rows\", true bounded from orders")
def _s18(t):
    p = writers.write_zstd(orders(t), place(t, "o.parquet"), rows_per_file=500)
    per = t.spark.read.parquet(p).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("rows"), (F.max("n") <= 500).alias("bounded"))


@query("s19_gz_tsv_export", "select o_orderpriority, count(*) orders, round(sum(o_totalprice), 2) total from orders group by 1")
def _s19(t):
    g = orders(t).groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    p = writers.write_tsv_gz(g, place(t, "summary.tsv.gz"))
    return readers.read_tsv(t.spark, p, "o_orderpriority string, orders bigint, total double")


@query("s20_bundle_parity", "select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderpriority end o_orderpriority, o_totalprice from orders")
def _s20(t):
    o = orders(t).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return t.spark.read.parquet(writers.write_bundle(o, place(t, "bundle"))["parquet"])


@query("s21_manifest_verification", "select 'DIFFERS' problem, 1::bigint files union all select 'MISSING', 1")
def _s21(t):
    p = writers.write_zstd(orders(t).repartition(4), place(t, "o.parquet"))
    inv = writers.inventory(t.spark, p, "*.parquet").select("path", "sha256")
    first = inv.agg(F.min("path").alias("first"))
    m = inv.join(F.broadcast(first)).select("path", F.when(F.col("path") == F.col("first"), "0").otherwise(F.col("sha256")).alias("sha256"))
    m = m.unionByName(first.select(F.concat("first", F.lit(".gone")).alias("path"), F.lit("0").alias("sha256")))
    return writers.manifest_problems(t.spark, p, m, "*.parquet").groupBy("problem").agg(F.count("*").alias("files"))


@query("s22_file_inventory", "select 3::bigint files, 3::bigint digests, true sized")
def _s22(t):
    p = writers.write_zstd(orders(t).repartition(3), place(t, "o.parquet"))
    inv = writers.inventory(t.spark, p, "*.parquet")
    return inv.agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("digests"), (F.min("bytes") > 0).alias("sized"))


@query("s23_wide_table_adapter", """select query_id, endpoint, candidate_id, label, (fused_rank <= 2)::int retained, score from (select query_id, reference_id candidate_id, fused_rank, unnest(['L3','L4']) endpoint, unnest([l3, l4]) label, unnest([raw, cal::double]) score from v_fused_scored)""", FUSED_SQL)
def _s23(t):
    rows = fused_scored(t).withColumn("row_id", F.col("reference_id"))
    counts = t.trace_queries.withColumn("method", F.lit("TOP1"))
    sel = top_one(rows, ["query_id"], [("raw", "desc"), ("row_id", "asc")]).select("query_id", F.lit("L3").alias("endpoint"), "row_id")
    tables = writers.adapt_scored(counts, t.library, sel, rows, "TOP1", {"L3": ("l3", "raw"), "L4": ("l4", "cal")}, "fused_rank", 2)
    return tables["candidates"].withColumn("retained", F.col("retained").cast("int"))


@query("s24_disjoint_chunk_merge", "select query_id, reference_id, price from v_pairs")
def _s24(t):
    base = place(t, "chunks")
    p = t.pairs.select("query_id", "reference_id", "price")
    paths = [writers.write_zstd(p.where(F.pmod("query_id", F.lit(3)) == i), f"{base}/chunk={i}.parquet") for i in range(3)]
    return readers.merged_chunks(t.spark, paths, ["query_id", "reference_id"])


@query("s25_commented_report", "select o_orderkey::varchar id, o_orderstatus status, substr(o_orderpriority, 1, 1) level from orders where o_orderkey % 9 <> 0")
def _s25(t):
    p = place(t, "report.out")
    line = F.when(F.col("o_orderkey") % 9 == 0, F.lit("# comment")).otherwise(
        F.concat(F.lit(" "), "o_orderkey", F.lit("   "), "o_orderstatus", F.lit("\t "), F.substring("o_orderpriority", 1, 1), F.lit("  extra")))
    t.raw("orders").select(line.alias("value")).write.text(p)
    r = readers.report_rows(t.spark, p, 3)
    return r.select(F.col("fields")[0].alias("id"), F.col("fields")[1].alias("status"), F.col("fields")[2].alias("level"))


@query("s26_typed_shard_set", "select l_orderkey query_id, l_partkey reference_id, max(l_extendedprice) price, (l_orderkey % 4)::int shard from lineitem group by 1, 2")
def _s26(t):
    base = place(t, "shards")
    p = t.pairs.select("query_id", "reference_id", "price")
    paths = []
    for i in range(4):
        paths.append(f"{base}/shard_{i}.tsv")
        p.where(F.pmod("query_id", F.lit(4)) == i).write.option("sep", "\t").csv(paths[-1])
    name = F.regexp_extract(F.input_file_name(), r"shard_([0-9]+)", 1).cast("int")
    return readers.shard_set(t.spark, paths, "query_id bigint, reference_id bigint, price double", ["query_id", "reference_id"], name)


@query("s01b_trace_from_portable_tables", """select count(*) queries, 0::bigint problems from v_trace_queries""")
def _s01b(t):
    """Write the four portable tables, read them typed, check the rules and trace."""
    from labeltrail.operators.ranking import attach_one_row

    base = place(t, "input")
    text = lambda df, c: df.withColumn(c, F.when(F.col(c), "1").when(~F.col(c), "0").otherwise(""))
    tables = {
        "queries": t.trace_queries.select("query_id", "endpoint", F.to_json("truth_labels").alias("truth_labels")),
        "library": t.library, "candidates": text(t.cand.select("query_id", "endpoint", "candidate_id", "label", "retained", "score"), "retained"),
        "outputs": text(t.outputs.withColumn("selected_candidate_id", F.coalesce(F.col("selected_candidate_id").cast("string"), F.lit(""))), "accepted")}
    for n, df in tables.items():
        df.write.option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(f"{base}/{n}.tsv")
    got = readers.diagnostic_tables(t.spark, base)
    bad = readers.trace_input_problems(got).agg(F.count("*").alias("problems"))
    states = trace.support_trace(got["queries"], got["library"], got["candidates"], got["outputs"])
    return attach_one_row(states.agg(F.count("state").alias("queries")), bad)
