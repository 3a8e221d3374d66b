"""Queries on taking files in, on logs that grow, and on graph batches, from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import features, ingest, pdf, records
from ..shipping import ship_package
from ..sources import folder_source
from ..sources.batches import BatchStore
from ..sources.shared import shared_dir
from ..sources.tables import table


def _pick(index, *values):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.concat(_pick(k, "", "a/", "../"), F.concat(F.lit("f"), k), _pick(k, ".md", ".TXT", ".exe", "", ".pdf"))
    return table(spark, sf_dir, "customer").select(k.alias("upload"), F.col("c_nationkey").alias("space"), F.when(k % 11 == 0, "x/").when(k % 13 == 0, "a:b.md").otherwise(path).alias("path"), _pick(k, 10, 0, 600 * 1024 * 1024, 7, 1, -1, 99).alias("size"))


def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir).select("upload", ingest.upload_problem(F.col("path"), F.col("size")).alias("problem"))


def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.upload_rows(_uploads(spark, sf_dir))
    out = None
    for name, df in rows.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("upload").alias("uploads"))
        out = one if out is None else out.unionByName(one)
    return out


def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick(F.col("n_nationkey"), "all Markdown files", "show *.json please", "find text", "list **", "everything", "*", "the .txt ones")
    return table(spark, sf_dir, "nation").select("n_nationkey", ingest.requested_pattern(said).alias("pattern"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every fourth one a format that isn't read here."""
    name = F.concat(F.lit("d"), "doc_id", _pick(F.col("doc_id"), ".txt", ".md", ".json", ".pdf"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/x/"), name).alias("path"), name.alias("name"), F.regexp_extract(name, r"\.(\w+)$", 1).alias("suffix"), F.col("text").cast("binary").alias("content"))


def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.ingested(_files(spark, sf_dir))["documents"]
    return out.select("path", "method", "hash", "n_chars", "status", (F.col("chunks") > 0).alias("chunked"))


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set in PDF files, twelve words a line and fifty lines a page, and read back: pages, words, and a hash of all
    characters but blanks. Documents are dealt over all cores by number: a Parquet file of few row groups would go to as many
    tasks."""
    cut = lambda xs, n, make: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / n) - 1, F.lit(0)).cast("int")), lambda k: make(F.slice(xs, k * n + 1, F.lit(n))))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = texts.repartition(max(4 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions()), "doc_id")
    docs = dealt.select("doc_id", F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "").alias("words"))
    lines = docs.select("doc_id", cut(F.col("words"), 12, lambda x: F.array_join(x, " ")).alias("lines"))
    page = lambda x: F.transform(x, lambda t, k: F.struct(F.lit(40.0).alias("x"), (800.0 - 14 * k).alias("y"), t.alias("text")))
    files = pdf.made_files(lines.select("doc_id", cut(F.col("lines"), 50, page).alias("placed")), "doc_id")
    read = pdf.read_files(files, "doc_id", parts=("pages",))
    return read.select("doc_id", F.size("pages").alias("pages"), F.sha2(F.regexp_replace(F.array_join("pages", ""), "[\\x20\\x09-\\x0D]", ""), 256).alias("hash"), "error")


def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight orders to a file, as a table under its caption, read back by the words' places. Files are dealt over all cores by
    number: by their bytes, which are few for the work on them, a few tasks would get them all."""
    k = F.col("o_orderkey")
    cells = F.array(k.cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"))
    o = table(spark, sf_dir, "orders").select(F.floor(k / 8).alias("file"), F.struct(k.alias("k"), cells.alias("cells")).alias("row"))
    rows = o.repartition(4 * spark.sparkContext.defaultParallelism, "file").groupBy("file").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    set_at = lambda y, cs: F.transform(cs, lambda t, i: F.struct((50.0 + 150 * i).alias("x"), y.alias("y"), t.alias("text")))
    head = F.concat(F.array(F.struct(F.lit(50.0).alias("x"), F.lit(780.0).alias("y"), F.concat(F.lit("Table 1: Orders from "), (F.col("file") * 8).cast("string")).alias("text"))), set_at(F.lit(760.0), F.array(F.lit("Order"), F.lit("State"), F.lit("Total price"))))
    body = F.flatten(F.transform("rows", lambda r, i: set_at(745.0 - 15 * i, r["cells"])))
    read = pdf.read_files(pdf.made_files(rows.select("file", F.array(F.concat(head, body)).alias("placed")), "file"), "file", parts=("tables",))
    t = read.select("file", F.explode("tables").alias("t"))
    return t.select("file", "t.caption", F.array_join(F.transform("t.cells", lambda r: F.array_join(r, "|")), ";").alias("cells"))


def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed uploads in three batches of four tables each, every batch tried twice: what the tables hold in the end."""
    store = BatchStore(spark, shared_dir(spark, "uploads"))
    for batch in (0, 1, 2, 1, 0, 2):
        store.write(batch, ingest.upload_rows(_uploads(spark, sf_dir).where(F.col("upload") % 3 == batch)))
    out = None
    for name, rows in ingest.upload_rows(_uploads(spark, sf_dir)).items():
        spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        one = store.read(name, spec).groupBy(F.lit(name).alias("name"), "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("upload").alias("uploads"))
        out = one if out is None else out.unionByName(one)
    return out


def _rtf(text: str) -> bytes:
    codes = "".join("\\par " if c == "\n" else f"\\u{ord(c)} ?" for c in text)
    return b"{\\rtf1 " + codes.encode() + b"}"


def folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Markdown, RTF and PDF files by their tasks, and the folder read as a data source: what each
    Markdown and RTF file's text holds but for blanks. The filter on the suffix chooses files before they are opened."""
    ship_package(spark)
    folder = shared_dir(spark, "files")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(base)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, words = ("md", "rtf", "pdf")[key % 3], (text or "").split()
                lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)] or [""]
                pages = [[(40.0, 800.0 - 14 * k, x) for k, x in enumerate(lines[low : low + 50])] for low in range(0, len(lines), 50)]
                with store.open_output_stream(f"{base}/d{key}.{kind}") as file:
                    file.write(pdf.made(pages) if kind == "pdf" else _rtf(text or "") if kind == "rtf" else (text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_id"])

    table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(write, "doc_id long").write.format("noop").mode("overwrite").save()
    folder_source.register(spark)
    read = spark.read.format("folder").schema("name string, suffix string, text string, error string").load(folder).where(F.col("suffix").isin("md", "rtf"))
    key = F.regexp_extract("name", r"^d(-?\d+)\.", 1).cast("long")
    return read.select(key.alias("doc_id"), "suffix", F.sha2(F.regexp_replace("text", "[\\s\\x{a0}]", ""), 256).alias("hash"), "error")


def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("old").alias("state"))
    new = c.where("conv_id % 3 = 0 AND turn < 3").withColumn("state", F.lit("new"))
    once = ingest.replaced(c, new, "conv_id")
    return ingest.replaced(once, new, "conv_id")


def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("scope"), F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id")
    return ingest.state(e, "scope", "key", ["ts", "event_id"])


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("job"), (F.col("event_id") % 300).alias("document"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "lang")
    return ingest.jobs_with_documents(jobs, docs)


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("step"))
    return ingest.next_step(steps, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity")), "entity", "step")


def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.where("event_id % 2 = 0").select("event_id", F.lit("log").alias("origin"))
    incoming = e.where("event_id % 3 = 0").select("event_id", F.lit("b").alias("origin")).unionByName(e.where("event_id % 6 = 3").select("event_id", F.lit("a").alias("origin")))
    return ingest.appended(log, incoming, "event_id", ["origin"])


def collated_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("nodes"))
    return features.collated(graphs, "c_nationkey", "nodes")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    out = features.embedded(asked, _vectors(spark, sf_dir), 64)
    return out.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


def node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    place = v.select("id", (F.col("id") % 7).alias("degree"), (F.col("id") % 3 / 3).alias("clustering")).where("id % 5 > 0")
    return features.value_features(v.select("id", F.transform("x", lambda y: y / 3).alias("x")), place).withColumn("value", F.round("value", 5))


def link_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbours by id, linked if they have the same label; features are the products of their places. Trained on
    one side of a hash split, measured on the other."""
    v = _vectors(spark, sf_dir)
    pairs = None
    for k in range(1, 6):
        other = v.select((F.col("id") - k).alias("id"), F.col("x").alias("y"), F.col("label").alias("other"))
        one = v.join(other, "id").select(F.concat_ws("-", "id", F.lit(k)).alias("pair"), F.zip_with("x", "y", lambda a, b: a * b).alias("x"), (F.col("label") == F.col("other")).cast("int").alias("label"))
        pairs = one if pairs is None else pairs.unionByName(one)
    sides = features.split(pairs, "pair", 0.8)
    model = features.trained_links(sides.where("side = 'train'"))
    out = features.validation_loss(model, sides.where("side = 'validation'"))
    return out.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = records.candidate_models("a", None, " b ", "a", "")
    return table(spark, sf_dir, "region").select("r_regionkey", F.lit(",".join(names)).alias("names"), content_hash(F.col("r_name")).alias("hash"))


QUERIES = {f.__name__: f for f in (
    pdf_texts, pdf_tables, upload_batches, folder_documents, upload_checks, upload_rows, file_requests, ingested_documents, replaced_chunks, stored_state, job_documents, next_steps, appended_log,
    collated_graphs, asked_vectors, node_values, link_training, model_candidates,
)}

_UPLOADS = """u AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'a:b.md' ELSE 'f' || c_custkey || ['.md', '.TXT', '.exe', '', '.pdf'][c_custkey % 5 + 1] END AS name, [10, 0, 629145600, 7, 1, -1, 99][c_custkey % 7 + 1] AS size FROM customer),
c AS (SELECT k, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'name' WHEN k % 5 IN (2, 3) THEN 'suffix' WHEN size <= 0 OR size > 524288000 THEN 'size' END AS problem FROM u)"""
_TEXT = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, e'\r\n', e'\n'), e'\r', e'\n'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
ORACLE_SQL = {
    "upload_batches": f"WITH {_UPLOADS} SELECT name, batch, n, s::BIGINT AS uploads FROM (SELECT k % 3 AS batch, count(*) AS n, sum(k) AS s FROM c WHERE problem IS NULL GROUP BY 1), (SELECT unnest(['files', 'versions', 'documents', 'jobs']) AS name)",
    "folder_documents": r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'md' ELSE 'rtf' END AS suffix, sha256(regexp_replace(coalesce(text, ''), '[\s\x{a0}]', '', 'g')) AS hash, NULL::VARCHAR AS error FROM documents WHERE doc_id % 3 < 2",
    "pdf_texts": r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, greatest(1, ceil(ceil(n / 12) / 50))::INT AS pages, sha256(t) AS hash, NULL::VARCHAR AS error FROM w""",
    "pdf_tables": """WITH r AS (SELECT o_orderkey // 8 AS file, string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_totalprice::DECIMAL(15, 2), ';' ORDER BY o_orderkey) AS rows FROM orders GROUP BY 1)
SELECT file, 'Table 1: Orders from ' || file * 8 AS caption, 'Order|State|Total price;' || rows AS cells FROM r""",
    "upload_checks": f"WITH {_UPLOADS} SELECT k AS upload, problem FROM c",
    "upload_rows": f"WITH {_UPLOADS} SELECT name, n, s::BIGINT AS uploads FROM (SELECT count(*) AS n, sum(k) AS s FROM c WHERE problem IS NULL), (SELECT unnest(['files', 'versions', 'documents', 'jobs']) AS name)",
    "file_requests": "SELECT n_nationkey, ['*.md', '*.json', '*.txt', '**', '*', '*.', '*.txt'][n_nationkey % 7 + 1] AS pattern FROM nation",
    "ingested_documents": f"""
WITH d AS (SELECT doc_id, '/x/d' || doc_id || ['.txt', '.md', '.json', '.pdf'][doc_id % 4 + 1] AS path, ['plain', 'none', 'plain', 'external'][doc_id % 4 + 1] AS method, CASE WHEN doc_id % 4 < 3 THEN {_TEXT} END AS t FROM documents)
SELECT path, method, sha256(t) AS hash, length(t) AS n_chars, CASE WHEN coalesce(t, '') = '' THEN 'failed' ELSE 'succeeded' END AS status, coalesce(t, '') <> '' AS chunked FROM d""",
    "replaced_chunks": "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn < 3) THEN 'new' ELSE 'old' END AS state FROM conversations WHERE conv_id % 3 <> 0 OR turn < 3 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn < 3)",
    "stored_state": "SELECT user_id % 5 AS scope, event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
    "job_documents": "SELECT doc_id AS document, event_id AS job, lang FROM events JOIN documents ON doc_id = event_id % 300 WHERE event_type = 'view'",
    "next_steps": "SELECT o_orderkey AS entity, coalesce(max(l_linenumber), -1)::INT + 1 AS next FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "appended_log": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'log' ELSE 'a' END AS origin FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0",
    "collated_graphs": "WITH g AS (SELECT c_nationkey, count(*) AS nodes FROM customer GROUP BY 1) SELECT *, coalesce(sum(nodes) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_node FROM g",
    "asked_vectors": "SELECT p_partkey AS id, round(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 0), 5) AS total FROM part LEFT JOIN embeddings ON vec_id = p_partkey",
    "node_values": """
WITH v AS (SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / 3) ** 2))) AS n FROM embeddings)
SELECT id, round(least(100, 0.4::DOUBLE * least(n * 100, 100) + CASE WHEN id % 5 > 0 THEN 30 * (id % 7) / (SELECT max(id % 7) FROM v WHERE id % 5 > 0) + 30 * (id % 3 / 3) ELSE 0 END), 5) AS value FROM v""",
    "model_candidates": "SELECT r_regionkey, 'a,b' AS names, sha256(r_name) AS hash FROM region",
}
