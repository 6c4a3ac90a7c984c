"""Queries on the hierarchy, whole documents, sinks, tokens and metrics."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue import sql as Q
from catalogue.entries import entries
from catalogue.sql import with_
from sheafspark.functions import text as L
from sheafspark.functions.tokens import Vocabulary, token_counter
from sheafspark.operators import document, metrics, tokens, tree
from sheafspark.options import BundleOptions
from sheafspark.plans.pack import pack
from sheafspark.session import shared_dir
from sheafspark.sinks import bundles as sink
from sheafspark.sources.bundles import read_bundles, read_structure
from sheafspark.sources.corpus import list_corpus, read_corpus
from sheafspark.streaming.files import running_totals, write_entries

_PATTERN = public_tokenizers.PATTERN
BYTE_BPE = Vocabulary("byte_bpe_50k", "tiktoken", public_tokenizers.path("byte_bpe_50k.tiktoken"), _PATTERN)
VOCABULARIES = (
    BYTE_BPE,
    Vocabulary("byte_bpe_multi_50k", "tiktoken", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), _PATTERN),
    Vocabulary("byte_bpe_50k_json", "huggingface", public_tokenizers.path("byte_bpe_50k.json")),
)


def _paths(files):
    return files.select("bundle_id", "path")


# ---- hierarchy


def tree_nodes(spark, sf):
    return tree.tree_nodes(_paths(C.doc_paths(spark, sf)))


def page_tree(spark, sf):
    return tree.tree_nodes(_paths(C.pages(spark, sf)))


def children_listing(spark, sf):
    return tree.children(tree.tree_nodes(_paths(C.doc_paths(spark, sf))))


def folder_sizes(spark, sf):
    return tree.folder_sizes(tree.tree_nodes(_paths(C.doc_paths(spark, sf))))


def directory_rollup(spark, sf):
    return tree.directory_rollup(entries(C.docs(spark, sf)), "size", "lines")


def folder_ranks(spark, sf):
    """The five folders of each bundle with the most bytes below them."""
    return tree.largest_folders(directory_rollup(spark, sf), "size", 5)


def depth_profile(spark, sf):
    return tree.depth_profile(tree.tree_nodes(_paths(C.pages(spark, sf))))


def structure_rows(spark, sf):
    return tree.structure_rows(_paths(C.doc_paths(spark, sf)))


# ---- documents and sinks


def _rows(spark, sf, line_numbers=False):
    files = C.docs(spark, sf)
    return document.document_rows(entries(files, line_numbers=line_numbers), files, line_numbers)


def _byte_rows(spark, sf):
    files = C.byte_files(spark, sf)
    return document.document_rows(entries(files, True), files)


def bundle_documents(spark, sf):
    return document.document_sizes(_rows(spark, sf))


def document_rows(spark, sf):
    return _rows(spark, sf).select("bundle_id", "section", "sort_key", F.md5("line").alias("line_md5"))


def _roundtrip(spark, sf, gzip_level):
    """Write the byte corpus, read it back; texts come back with plain newlines."""
    target = shared_dir(spark)
    sink.write_bundles(_byte_rows(spark, sf), target, gzip_level)
    back = read_bundles(spark, target)
    return back.select("bundle_id", "path", "size", "lines", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def bundle_roundtrip(spark, sf):
    return _roundtrip(spark, sf, None)


def gzip_roundtrip(spark, sf):
    return _roundtrip(spark, sf, 9)


def gzip_level1(spark, sf):
    return _roundtrip(spark, sf, 1)


def gzip_level6(spark, sf):
    return _roundtrip(spark, sf, 6)


def written_summary(spark, sf):
    """Metrics written as a table and read back."""
    target = shared_dir(spark)
    sink.write_summary(metrics.bundle_metrics(document.document_sizes(_byte_rows(spark, sf))), target)
    return spark.read.parquet(target)


def structure_roundtrip(spark, sf):
    """Write docs, rebuild the paths from the nesting of the structure section."""
    target = shared_dir(spark)
    sink.write_bundles(_rows(spark, sf), target)
    return read_structure(spark, target)


def comment_roundtrip(spark, sf):
    """Write the byte corpus, read the comments of the entries without text."""
    target = shared_dir(spark)
    sink.write_bundles(_byte_rows(spark, sf), target)
    back = read_bundles(spark, target).where("comment IS NOT NULL")
    return back.select("bundle_id", "path", "size", "lines", "comment")


def pack_run(spark, sf):
    """The whole run: metrics of the packed documents, with the files re-read for their bytes."""
    target = shared_dir(spark)
    packed = pack(C.docs(spark, sf), target, BundleOptions(extend_exclude=("src/",), line_numbers=True))
    return packed.metrics.join(sink.written_bytes(spark, target).withColumnRenamed("output_bytes", "file_bytes"), "bundle_id")


def bundle_metrics(spark, sf):
    return metrics.bundle_metrics(document.document_sizes(_byte_rows(spark, sf)))


def corpus_scan(spark, sf):
    """Scan the folder tree the sink wrote: part files, sizes and decoded text per bundle folder."""
    target = shared_dir(spark)
    sink.write_bundles(_rows(spark, sf), target)
    files = read_corpus(spark, target, "children", replace=[".crc"])
    return entries(files).groupBy("bundle_id", "disposition").agg(
        F.sum("size").alias("n_bytes"), F.sum(F.octet_length("body")).cast("bigint").alias("text_bytes"),
        F.sum("lines").alias("n_lines"),
    )


def sink_names(spark, sf):
    docs = C.table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    plan = docs.select(
        "doc_id",
        F.concat(
            F.lit("out.dir/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"),
            F.when(k == 0, ".xml").when(k == 1, ".XML.GZ").when(k == 2, "").when(k == 3, ".gz").otherwise(".gz.xml"),
        ).alias("output_file"),
        (F.col("doc_id") % 2 == 0).alias("gzip"),
    )
    return sink.sink_names(plan)


# ---- models and tokens


def _requests(spark, sf):
    """One request per document; a name in eleven, two of them unknown."""
    names = ["gpt5", "GPT4o", "gpt4", "Gpt3.5", "deepseek-v4", "deepseek-V3", "deepseek-r1", "DeepSeek", "glm5.2", "gpt2", "unknown"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 11 + 1).cast("int"))
    return C.table(spark, sf, "documents").select("doc_id", name.alias("model_name"))


def model_resolution(spark, sf):
    return tokens.resolve_models(_requests(spark, sf))


def unsupported_models(spark, sf):
    return tokens.unsupported_models(_requests(spark, sf))


def file_tokens(spark, sf):
    made = entries(C.docs(spark, sf))
    return tokens.count_tokens(made, "body", BYTE_BPE).select("bundle_id", "path", "n_tokens")


def bundle_tokens(spark, sf):
    return tokens.bundle_tokens(_rows(spark, sf), BYTE_BPE)


def model_comparison(spark, sf):
    return tokens.compare_models(entries(C.docs(spark, sf)), "body", VOCABULARIES)


def shared_vocabulary(spark, sf):
    """Two encoders of one vocabulary must count every text alike."""
    made = entries(C.docs(spark, sf))
    ranks, json = token_counter(VOCABULARIES[0])(F.col("body")), token_counter(VOCABULARIES[2])(F.col("body"))
    counted = made.select("bundle_id", F.octet_length("body").alias("size"), ranks.alias("a"), json.alias("b"))
    return counted.groupBy("bundle_id").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("a") != F.col("b")).alias("n_different"),
        F.count_if((F.col("a") == 0) != (F.col("size") == 0)).alias("n_wrongly_empty"),
    )


def token_overhead(spark, sf):
    return tokens.token_overhead(entries(C.docs(spark, sf)), BYTE_BPE)


def compression_profile(spark, sf):
    return metrics.compression_profile(_rows(spark, sf), (1, 6, 9))


# ---- streams


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    # A pattern, as a stream takes a plain path for a folder: the table may be one file or a folder of parts.
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/{{conversations.parquet}}")
    path = F.concat(F.lit("turn_"), F.col("turn").cast("string"), F.lit("_"), F.col("role"), F.lit(".txt"))
    return C.from_table(arriving, F.col("conv_id"), path, F.col("text"))


def streamed_entries(spark, sf):
    target, checkpoint = shared_dir(spark), shared_dir(spark)
    write_entries(_stream(spark, sf), target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("bundle_id", "path", "size", "lines", "disposition", F.md5("body").alias("body_md5"))


def streamed_totals(spark, sf):
    """Running totals per bundle, taken from the last state of the stream."""
    target, checkpoint = shared_dir(spark), shared_dir(spark)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(target)

    totals = running_totals(_stream(spark, sf))
    query = (
        totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)


QUERIES = {
    "tree_nodes": tree_nodes,
    "page_tree": page_tree,
    "children_listing": children_listing,
    "folder_sizes": folder_sizes,
    "directory_rollup": directory_rollup,
    "folder_ranks": folder_ranks,
    "depth_profile": depth_profile,
    "structure_rows": structure_rows,
    "bundle_documents": bundle_documents,
    "document_rows": document_rows,
    "bundle_roundtrip": bundle_roundtrip,
    "gzip_roundtrip": gzip_roundtrip,
    "gzip_level1": gzip_level1,
    "gzip_level6": gzip_level6,
    "written_summary": written_summary,
    "structure_roundtrip": structure_roundtrip,
    "comment_roundtrip": comment_roundtrip,
    "bundle_metrics": bundle_metrics,
    "pack_run": pack_run,
    "corpus_scan": corpus_scan,
    "sink_names": sink_names,
    "model_resolution": model_resolution,
    "unsupported_models": unsupported_models,
    "file_tokens": file_tokens,
    "bundle_tokens": bundle_tokens,
    "model_comparison": model_comparison,
    "shared_vocabulary": shared_vocabulary,
    "token_overhead": token_overhead,
    "compression_profile": compression_profile,
    "streamed_entries": streamed_entries,
    "streamed_totals": streamed_totals,
}


# ---- SQL


def _tree_sql(corpus: str, source: str) -> str:
    node = "node_path"
    return (
        with_(corpus, Q.folders(source))
        + f"""SELECT bundle_id, node_path, {Q.parent(node)} AS parent_path, {Q.name(node)} AS name,
  CAST(length(node_path) - length(replace(node_path, '/', '')) AS INTEGER) AS depth, kind
FROM (SELECT bundle_id, path AS node_path, 'file' AS kind FROM {source}
      UNION ALL SELECT bundle_id, node_path, 'folder' FROM folders)"""
    )


def _structure(source: str) -> str:
    def indent(path: str) -> str:
        return f"repeat('  ', length({path}) - length(replace({path}, '/', '')) + 2)"

    parent_key = Q.folder_key(f"({Q.parent('path')})")
    node_key = Q.folder_key("node_path")
    return f"""
SELECT bundle_id, {parent_key} || '0' || {Q.name('path')} AS sort_key,
  {indent('path')} || '<file path="' || {Q.attr(Q.name('path'))} || '" />' AS line FROM {source}
UNION ALL SELECT bundle_id, {node_key},
  {indent('node_path')} || '<folder name="' || {Q.attr(Q.name('node_path'))} || '">' FROM folders
UNION ALL SELECT bundle_id, ({node_key}) || '2', {indent('node_path')} || '</folder>' FROM folders"""


# What every document must say, written out here: the check does not ask the engine for it.
HEADER = """\
<?xml version="1.0" encoding="utf-8"?>
<repository>
  <file_summary>
    <purpose>One document holding the readable content of a collection of files,
laid out so that a program or a language model can take it in at once.</purpose>
    <file_format>1. This summary.
2. repository_structure: the folders and files, nested by name.
3. repository_files: one element per file with its path, its size in bytes,
   its number of lines, and its text in CDATA. Binary files and text that
   XML 1.0 cannot hold carry a comment instead.</file_format>
    <instructions>- Look at the files themselves, their text, layout and purpose.
- Leave the markup of this document out of the discussion.
- Take the language of a file from the extension of its path.</instructions>
    <usage_guidelines>- Read only: make changes in the original files.
- Tell files apart by their full path.
- The content may be confidential; treat it like its source.</usage_guidelines>
    <notes>- Paths ruled out by ignore files or by the exclusion options are missing.
- The structure section lists every kept file, also those without text.</notes>
    <additional_info>Written by sheafspark.</additional_info>
  </file_summary>"""
NUMBERED_HEADER = HEADER.replace(
    "</instructions>",
    """
- Every line starts with its number, padded to equal width, and two spaces.
  The numbers are for reference and are not part of the file.</instructions>""",
)
_FRAME = (
    (1, "", "  <repository_structure>\n    <summary>The folders and files of the collection.</summary>"),
    (1, "3", "  </repository_structure>"),
    (2, "", "  <repository_files>\n    <summary>The files with their full paths and, where it can be shown, their text.</summary>"),
    (2, "3", "  </repository_files>"),
    (3, "", "</repository>"),
)


def _document_ctes(source: str, entry: str, line_numbers: bool = False) -> str:
    rows = ((0, "", NUMBERED_HEADER if line_numbers else HEADER), *_FRAME)
    frame = " UNION ALL ".join(
        f"SELECT bundle_id, {s} AS section, {Q.quoted(k)} AS sort_key, {Q.quoted(v)} AS line FROM (SELECT DISTINCT bundle_id FROM {source})"
        for s, k, v in rows
    )
    return f"""
document_rows AS (
  {frame}
  UNION ALL SELECT bundle_id, 1, sort_key, line FROM ({_structure(source)})
  UNION ALL SELECT bundle_id, 2, '1' || path, '    ' || {entry} FROM {source})
"""


_SIZES = """
document_sizes AS (
  SELECT bundle_id, count(*) FILTER (section = 2 AND starts_with(sort_key, '1')) AS n_files, count(*) AS n_rows, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS xml_bytes
  FROM document_rows GROUP BY bundle_id)
"""

_DOC_ENTRY = Q.text_entry("path", "size", "text")
_DOCUMENTS = (C.DOCS, Q.folders("docs"), _document_ctes("docs", _DOC_ENTRY), _SIZES)

_BYTES_ENTRY = (
    f"CASE disposition_on WHEN 'binary' THEN {Q.entry('path', 'size', chr(39) + '0' + chr(39), Q.quoted('<!-- This file is a binary file and not included -->'))} "
    f"WHEN 'xml_omitted' THEN {Q.entry('path', 'size', chr(39) + '0' + chr(39), Q.quoted('<!-- Text content omitted: XML 1.0 cannot represent character U+000B -->'))} "
    f"ELSE {Q.text_entry('path', 'size', 'text_on')} END"
)

_ROUNDTRIP = with_(C.BYTES) + f"""
SELECT bundle_id, path, size,
  CASE WHEN disposition_on = 'text' THEN {Q.lines('text_on')} ELSE 0 END AS lines,
  md5(CASE WHEN disposition_on = 'text' THEN {Q.newlines('text_on')} ELSE '' END) AS text_md5 FROM byte_files"""

_KEPT = f"""
kept AS (
  SELECT bundle_id, path, size, {Q.numbered('text')} AS text FROM docs
  WHERE NOT {C.DEFAULT_EXCLUDED} AND NOT contains(lower(path), 'src/'))
"""

_MODEL_VALUES = """VALUES
  ('gpt5', 'gpt5', 'GPT-5', 'o200k_base', 'tiktoken'),
  ('gpt4o', 'gpt4o', 'GPT-4o', 'o200k_base', 'tiktoken'),
  ('gpt4', 'gpt4', 'GPT-4', 'cl100k_base', 'tiktoken'),
  ('gpt3.5', 'gpt3.5', 'GPT-3.5', 'cl100k_base', 'tiktoken'),
  ('deepseek-v4', 'deepseek-v4', 'DeepSeek V4', 'deepseek_v4', 'huggingface'),
  ('deepseek-v3', 'deepseek-v3', 'DeepSeek V3', 'deepseek_v3', 'huggingface'),
  ('deepseek-r1', 'deepseek-r1', 'DeepSeek R1', 'deepseek_r1', 'huggingface'),
  ('glm5.2', 'glm5.2', 'GLM-5.2', 'glm_5_2', 'huggingface'),
  ('deepseek', 'deepseek-r1', 'DeepSeek R1', 'deepseek_r1', 'huggingface')"""

_REQUESTS = """
requests AS (
  SELECT doc_id, (['gpt5', 'GPT4o', 'gpt4', 'Gpt3.5', 'deepseek-v4', 'deepseek-V3', 'deepseek-r1', 'DeepSeek',
    'glm5.2', 'gpt2', 'unknown'])[CAST(doc_id % 11 + 1 AS INTEGER)] AS model_name FROM documents)
"""

_CHAT_TEXT = """
chat_files AS (
  SELECT CAST(conv_id AS VARCHAR) AS bundle_id, 'turn_' || turn || '_' || role || '.txt' AS path,
    octet_length(encode(text)) AS size, text FROM conversations)
"""

_ROLLUP = (
    with_(C.DOCS, Q.folders("docs"))
    + f"""SELECT f.bundle_id, f.node_path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size,
  CAST(sum({Q.lines('text')}) AS BIGINT) AS lines
FROM (SELECT * FROM folders UNION ALL SELECT DISTINCT bundle_id, '' FROM docs) f
JOIN docs d ON f.bundle_id = d.bundle_id AND (f.node_path = '' OR starts_with(d.path, f.node_path || '/'))
GROUP BY f.bundle_id, f.node_path"""
)

SQL = {
    "tree_nodes": _tree_sql(C.DOCS, "docs"),
    "page_tree": _tree_sql(C.PAGES, "pages_corpus"),
    "children_listing": with_("nodes AS (" + _tree_sql(C.DOCS, "docs") + ")")
    + "SELECT bundle_id, parent_path, kind, name FROM nodes",
    "folder_sizes": with_("nodes AS (" + _tree_sql(C.DOCS, "docs") + ")")
    + """SELECT bundle_id, parent_path, count(*) FILTER (kind = 'file') AS n_files,
  count(*) FILTER (kind = 'folder') AS n_folders FROM nodes GROUP BY ALL""",
    "directory_rollup": _ROLLUP,
    "folder_ranks": f"""SELECT * FROM (
  SELECT *, rank() OVER (PARTITION BY bundle_id ORDER BY size DESC) AS size_rank
  FROM ({_ROLLUP}) WHERE node_path <> '') WHERE size_rank <= 5""",
    "depth_profile": with_("nodes AS (" + _tree_sql(C.PAGES, "pages_corpus") + ")")
    + """SELECT bundle_id, depth, CAST(sum(files) AS BIGINT) AS n_files, CAST(sum(folders) AS BIGINT) AS n_folders,
  max(files + folders) AS max_children
FROM (SELECT bundle_id, depth, parent_path, count(*) FILTER (kind = 'file') AS files,
        count(*) FILTER (kind = 'folder') AS folders FROM nodes GROUP BY ALL)
GROUP BY bundle_id, depth""",
    "structure_rows": with_(C.DOCS, Q.folders("docs")) + _structure("docs"),
    "bundle_documents": with_(*_DOCUMENTS) + "SELECT * FROM document_sizes",
    "document_rows": with_(*_DOCUMENTS) + "SELECT bundle_id, section, sort_key, md5(line) AS line_md5 FROM document_rows",
    "bundle_roundtrip": _ROUNDTRIP,
    "gzip_roundtrip": _ROUNDTRIP,
    "gzip_level1": _ROUNDTRIP,
    "gzip_level6": _ROUNDTRIP,
    "structure_roundtrip": with_(C.DOCS) + "SELECT bundle_id, path FROM docs",
    "comment_roundtrip": with_(C.BYTES)
    + """SELECT bundle_id, path, size, 0 AS lines, CASE disposition_on
  WHEN 'binary' THEN ' This file is a binary file and not included '
  ELSE ' Text content omitted: XML 1.0 cannot represent character U+000B ' END AS comment
FROM byte_files WHERE disposition_on <> 'text'""",
    "bundle_metrics": with_(C.BYTES, Q.folders("byte_files"), _document_ctes("byte_files", _BYTES_ENTRY), _SIZES)
    + "SELECT bundle_id, n_files, xml_bytes, xml_bytes AS output_bytes FROM document_sizes",
    "written_summary": with_(C.BYTES, Q.folders("byte_files"), _document_ctes("byte_files", _BYTES_ENTRY), _SIZES)
    + "SELECT bundle_id, n_files, xml_bytes, xml_bytes AS output_bytes FROM document_sizes",
    "pack_run": with_(C.DOCS, _KEPT, Q.folders("kept"), _document_ctes("kept", _DOC_ENTRY, True), _SIZES)
    + "SELECT bundle_id, n_files, xml_bytes, xml_bytes AS output_bytes, xml_bytes AS file_bytes FROM document_sizes",
    "corpus_scan": with_(*_DOCUMENTS)
    + f"""SELECT 'bundle_id=' || bundle_id AS bundle_id, 'text' AS disposition, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS n_bytes,
  CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS text_bytes,
  CAST(sum({Q.lines("(line || chr(10))")}) AS BIGINT) AS n_lines FROM document_rows GROUP BY bundle_id""",
    "sink_names": """
SELECT doc_id, output_file, doc_id % 2 = 0 AS gzip,
  output_file || CASE WHEN doc_id % 2 = 0 AND doc_id % 5 IN (0, 2, 4) THEN '.gz' ELSE '' END AS effective_file
FROM (SELECT doc_id, 'out.dir/' || source || '_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.xml'
        WHEN 1 THEN '.XML.GZ' WHEN 2 THEN '' WHEN 3 THEN '.gz' ELSE '.gz.xml' END AS output_file FROM documents)""",
    "model_resolution": with_(_REQUESTS, f"models(alias, model, display_name, vocab, kind) AS ({_MODEL_VALUES})")
    + """SELECT doc_id, model_name, model, display_name, vocab, kind
FROM requests LEFT JOIN models ON lower(model_name) = alias""",
    "unsupported_models": with_(_REQUESTS)
    + """SELECT DISTINCT model_name, 'Unsupported model: ' || model_name || '. Supported models: '
  || 'gpt5, gpt4o, gpt4, gpt3.5, deepseek-v4, deepseek-v3, deepseek-r1, glm5.2, deepseek' AS message
FROM requests WHERE lower(model_name) IN ('gpt2', 'unknown')""",
    "shared_vocabulary": """
SELECT source AS bundle_id, count(*) AS n_files, CAST(0 AS BIGINT) AS n_different, CAST(0 AS BIGINT) AS n_wrongly_empty
FROM documents GROUP BY source""",
    "streamed_entries": with_(_CHAT_TEXT)
    + f"SELECT bundle_id, path, size, {Q.lines('text')} AS lines, 'text' AS disposition, md5(text) AS body_md5 FROM chat_files",
    "streamed_totals": with_(_CHAT_TEXT)
    + f"""SELECT bundle_id, 'text' AS disposition, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes,
  CAST(sum({Q.lines('text')}) AS BIGINT) AS n_lines FROM chat_files GROUP BY bundle_id""",
}
